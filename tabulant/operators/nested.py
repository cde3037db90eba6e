"""Lookups that nest their matches, and ordered lists per group, as bounded arrays.

A key may hold a third of all rows, so no array here holds a whole group: a
lookup comes in chunks of a stated number of matches, and an ordered list
keeps the last ``n``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .join import forget_partitioning

DIGIT_BITS = 16   # of an id that one window looks at: at most 65536 rows
ID_BITS = 64


def position_in_key(df: DataFrame, key: str, id_col: str, name: str = "position") -> DataFrame:
    """Add the place (from 0) of each row among its key's rows by a unique whole-number id.

    The id is ranked digit by digit, as in a radix sort: rows are counted for
    each prefix of the id, the counts of earlier siblings are added up from
    the longest to the shortest prefix, and rows are numbered only among those
    that share all but the last digit.  As ids are unique no window holds more
    than ``2**DIGIT_BITS`` rows, however hot a key; no step samples or runs
    ahead.  Equal ids (and NULL, which comes first) are numbered in any order.
    """
    i, k = F.col(id_col).cast("long"), F.col(key)
    prefix = lambda bits: F.shiftright(i, bits)
    counts = df.groupBy(k.alias("__k"), prefix(DIGIT_BITS).alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    levels = [counts]
    for _ in range(DIGIT_BITS, ID_BITS - DIGIT_BITS, DIGIT_BITS):
        up = F.shiftright("__p", DIGIT_BITS).alias("__p")
        levels.append(levels[-1].groupBy("__k", up).agg(F.sum("__n").alias("__n")))
    earlier = lambda *by: F.coalesce(F.sum("__n").over(
        Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = levels[-1].select("__k", "__p", earlier("__k").alias("__before"))
    for level in reversed(levels[:-1]):
        parent = placed.select(F.col("__k").alias("__pk"), F.col("__p").alias("__parent"), "__before")
        level = level.withColumn("__up", F.shiftright("__p", DIGIT_BITS))
        level = level.withColumn("__own", earlier("__k", "__up"))
        placed = level.join(parent, F.col("__k").eqNullSafe(F.col("__pk")) & F.col("__up").eqNullSafe(F.col("__parent"))).select(
            "__k", "__p", (F.col("__before") + F.col("__own")).alias("__before"))
    local = F.row_number().over(Window.partitionBy(k, prefix(DIGIT_BITS)).orderBy(i))
    rows = df.withColumns({"__local": local, "__prefix": prefix(DIGIT_BITS)})
    out = rows.join(placed, k.eqNullSafe(F.col("__k")) & F.col("__prefix").eqNullSafe(F.col("__p")))
    return out.select(*df.columns, (F.col("__before") + F.col("__local") - 1).alias(name))


def lookup_nested(fact: DataFrame, dim: DataFrame, left_on: str, right_on: str, id_col: str, fields: list[str | Column],
                  as_name: str = "matches", chunk_name: str = "chunk", chunk_rows: int = 1000, how: str = "left") -> DataFrame:
    """Fact rows with all their matches as arrays of structs, ``chunk_rows`` matches to a row.

    A fact with more matches than that has several rows, numbered by
    ``chunk_name`` from 0; its matches are in the order of the dimension's unique
    id, across chunks too.  ``how='left'`` keeps a fact without matches as one
    row with an empty array (the lookup kept as an array), ``'inner'`` drops it
    (the non-empty-array test).  NULL keys match nothing.  ``col(as_name +
    '.field')`` is the array of one field.

    Matches are nested before they meet the facts, so a hot key is many rows,
    which adaptive execution can deal over many tasks; facts without a match
    are found apart by an anti-join, since an outer join cannot be split there.
    """
    if how not in ("left", "inner"):
        raise ValueError("how must be 'left' or 'inner'")
    own = dim.filter(F.col(right_on).isNotNull()).select(
        F.col(right_on).alias("__key"), F.col(id_col).cast("long").alias("__id"), F.struct(*fields).alias("__match"))
    placed = position_in_key(own, "__key", "__id", "__at").withColumn("__chunk", F.floor(F.col("__at") / F.lit(chunk_rows)))
    listed = F.sort_array(F.collect_list(F.struct("__id", "__match")))
    nested = placed.groupBy("__key", "__chunk").agg(F.transform(listed, lambda s: s["__match"]).alias("__list"))
    matched = nested.join(fact, nested["__key"] == fact[left_on]).select(
        *[fact[c] for c in fact.columns], F.col("__chunk").alias(chunk_name), F.col("__list").alias(as_name))
    if how == "inner":
        return matched
    keys = forget_partitioning(own.select("__key").distinct())
    alone = fact.join(keys, fact[left_on] == keys["__key"], "left_anti")
    empty = F.array().cast(matched.schema[as_name].dataType)
    return matched.unionByName(alone.select("*", F.lit(0).cast("long").alias(chunk_name), empty.alias(as_name)))


def last_list(df: DataFrame, keys: list[str], order: list[str], fields: list[str], n: int, name: str = "last") -> DataFrame:
    """Per group the last ``n`` rows by ``order`` as an array of structs (order and fields), in ascending order.

    Rows that tie in ``order`` are ordered by the fields, so the list does not
    depend on how rows are stored; NULL comes first.  Spark keeps at most ``n``
    rows of a group for each task before the shuffle and after it, so a hot
    group is never whole anywhere.
    """
    parts = list(dict.fromkeys([*order, *fields]))
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in parts])
    kept = df.select(*dict.fromkeys([*keys, *parts])).withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n)
    return kept.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*parts))).alias(name))
