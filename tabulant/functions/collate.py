"""Keys that compare without regard to case.

Spark has a collation for it (``UTF8_LCASE``).  Joins on collated columns are
hash or merge joins on the collation key, and a sort compares them as they are;
but groupings and distincts of collated columns can only run as sort-based
aggregates, whose rows are sorted on both sides of the shuffle.  Grouping by
the ``lower()`` text stays a hash aggregate.  So sorts and joins here use the
collation, groupings the lower-cased key (``tests/test_collate.py`` compares
the plans).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numeric import _col

CASELESS = "UTF8_LCASE"


def collated(c: str | Column) -> Column:
    """The text as a caseless column: equality, order and LIKE on it disregard case."""
    return F.collate(_col(c), CASELESS)


def group_caseless(df: DataFrame, key: str, aggs: dict[str, Column]) -> DataFrame:
    """One row for each key without regard to case, with the smallest spelling as its name."""
    out = df.groupBy(F.lower(F.col(key)).alias("__key")).agg(F.min(key).alias(key), *[c.alias(n) for n, c in aggs.items()])
    return out.drop("__key")


def distinct_caseless(df: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct combinations of keys without regard to case, each in its smallest spelling.

    The spelling is one that occurs: the smallest combination, not the smallest of each column.
    """
    folded = [F.lower(F.col(k)).alias(f"__{i}") for i, k in enumerate(keys)]
    return df.groupBy(*folded).agg(F.min(F.struct(*keys)).alias("__name")).select("__name.*")


def sort_caseless(df: DataFrame, key: str, *then: str | Column) -> DataFrame:
    """Rows ordered by a key without regard to case; spellings of one key by ``then``."""
    return df.orderBy(collated(key), *then)


def join_caseless(fact: DataFrame, dim: DataFrame, left_on: str, right_on: str, how: str = "inner") -> DataFrame:
    """Rows of both sides whose keys are equal but for case; the right key is kept under its own name."""
    return fact.join(dim, collated(fact[left_on]) == collated(dim[right_on]), how)
