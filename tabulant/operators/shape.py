"""Duplicate profiling, de-duplication and row-level reshaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..functions.numeric import row_sum
from ..session import cut_lineage
from .join import forget_partitioning


def digest_of(*keys: str) -> Column:
    """SHA-256 of the keys' text (lengths included, so that parts cannot run together); NULL if any is NULL."""
    parts = [F.concat(F.char_length(F.col(k).cast("string")).cast("string"), F.lit(":"), F.col(k).cast("string")) for k in keys]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def profile_dupes(df: DataFrame, key: str, names: tuple[str, str, str] = ("n_rows", "n_distinct", "n_surplus"),
                  digest: bool = False) -> DataFrame:
    """Rows, distinct (non-null) key values, and surplus copies, as one row.

    With ``digest``, for wide keys such as whole texts, SHA-256 digests are
    counted in place of the keys: 32 bytes are shuffled for each distinct key.
    """
    counted = df.select((digest_of(key) if digest else F.col(key)).alias("__k"))
    out = counted.agg(F.count(F.lit(1)).alias(names[0]), F.count_distinct("__k").alias(names[1]))
    return out.select(names[0], names[1], (F.col(names[0]) - F.col(names[1])).alias(names[2]))


def rows_of_duplicate_keys(df: DataFrame, key: str | list[str], digest: bool = False) -> DataFrame:
    """Every row whose key occurs more than once (``IN (… HAVING COUNT(*) > 1)``).

    The duplicated keys come from a partial/final count; rows are then kept
    with a left-semi join, which AQE can split if one key is hot.

    With ``digest``, for wide keys such as whole texts, both the count and the
    join are on SHA-256 digests: the count shuffles 32 bytes for each distinct
    key of a task, and rows with their texts are shuffled once, by the join,
    whatever the number of duplicates.
    """
    keys = [key] if isinstance(key, str) else list(key)
    on = ["__digest"] if digest else keys
    rows = df.withColumn("__digest", digest_of(*keys)) if digest else df
    dup = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > 1).select(*on)
    return rows.join(forget_partitioning(dup), on, "left_semi").select(*df.columns)


def row_digest(df: DataFrame) -> Column:
    """SHA-256 of a whole row, NULL told apart from empty text; equal rows have equal digests."""
    def part(field):
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (DoubleType, FloatType)):
            c = F.when(c == 0, F.lit(0.0)).otherwise(c)   # -0.0 and 0.0 are one value
        text = c.cast("string")
        return F.coalesce(F.concat(F.char_length(text).cast("string"), F.lit(":"), text), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*[part(f) for f in df.schema.fields]).cast("binary"), 256))


def distinct_wide(df: DataFrame, most_repeated: int = 1 << 20) -> DataFrame:
    """The distinct rows of a table with wide columns such as whole texts (``SELECT DISTINCT *``).

    Digests of whole rows are counted first: 32 bytes are shuffled for each
    distinct row of a task, and the digests that repeat are kept as a reliable
    checkpoint and counted, which are the jobs that run here.  Up to
    ``most_repeated`` of them are broadcast: rows whose digest occurs once are
    distinct and pass without a shuffle, only rows whose digest repeats are
    fetched and compared in full.  Beyond that, broadcasting would not be
    bounded and fetching would shuffle the table twice, so all rows are
    compared at once.  Either way equality of whole rows decides, not the
    digest, and copies of a hot row are one row for each task before they are
    shuffled.
    """
    rows = df.withColumn("__digest", row_digest(df))
    repeated = rows.groupBy("__digest").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > 1).select("__digest")
    repeated = cut_lineage(repeated)
    if repeated.count() > most_repeated:
        return df.distinct()
    columns = [F.col(f"`{c}`") for c in df.columns]
    alone = rows.join(F.broadcast(repeated), "__digest", "left_anti").select(*columns)
    return alone.unionByName(rows.join(F.broadcast(repeated), "__digest", "left_semi").select(*columns).distinct())


def dedupe_clean(df: DataFrame, exclude: Column | None = None, keys: list[str] | None = None, digest: bool = False) -> DataFrame:
    """Drop excluded rows, then duplicates.

    ``exclude`` is a boolean column marking rows to remove (a NULL test keeps
    the row); ``keys=None`` de-duplicates whole rows (``SELECT DISTINCT *``),
    a key list keeps one row per key combination.  ``digest``, for whole rows
    with wide columns, finds the copies by digests first (``distinct_wide``).
    """
    kept = df.filter(~F.coalesce(exclude, F.lit(False))) if exclude is not None else df
    if keys:
        return kept.dropDuplicates(keys)
    return distinct_wide(kept) if digest else kept.distinct()


def dedupe_project(df: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct combinations of the projected columns only (group by compound key)."""
    return df.select(*keys).distinct()


def row_total(df: DataFrame, cols: list[str], name: str = "row_total") -> DataFrame:
    """Add the sum of several columns of the same row."""
    return df.withColumn(name, row_sum([F.col(c) for c in cols]))
