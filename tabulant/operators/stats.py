"""Deviation, z-scores and correlation."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import mean, to_fixed
from .join import enrich, forget_partitioning


def group_deviation(df: DataFrame, group: str, value: str, keep: list[str], scale: int = 0,
                    avg_name: str = "avg_group", delta_name: str = "delta_from_avg",
                    fixed: int | None = None) -> DataFrame:
    """Each row's value, its group mean, and the absolute distance between them.

    The group mean is a partial/final aggregate joined back on the group key,
    where AQE can broadcast the short side or split a hot group -- not a
    window over raw rows.
    """
    v = F.col(value) if fixed is None else to_fixed(value, fixed)
    per = forget_partitioning(df.groupBy(group).agg(mean(value, fixed).alias("__gavg")))
    joined = enrich(df.select(*keep, group, v.alias("__v")), per, group)
    return joined.select(*keep, group,
                         F.round(F.col("__gavg"), scale).alias(avg_name),
                         F.round(F.abs(F.col("__v") - F.col("__gavg")), scale).alias(delta_name))


def group_zscore(df: DataFrame, group: str, value: str, keep: list[str], scale: int = 3,
                 name: str = "zscore") -> DataFrame:
    """Group-level z-score ``(group mean - overall mean) / overall population sd`` on every row.

    The group means and the overall mean and sd are partial/final aggregates;
    the overall pair are scalar subqueries of the same plan (one row each),
    so nothing runs until the result is asked for.
    """
    v = F.col(value).cast("double")
    per = forget_partitioning(df.groupBy(group).agg(F.avg(v).alias("__gavg")))
    overall = df.agg(F.avg(v).alias("m"), F.nullif(F.stddev_pop(v), F.lit(0.0)).alias("s"))
    z = F.round((F.col("__gavg") - overall.select("m").scalar()) / overall.select("s").scalar(), scale)
    return enrich(df.select(*keep, group), per.select(group, z.alias(name)), group).select(*keep, group, name)


def corr_pair(df: DataFrame, x: str, y: str, keys: list[str] | None = None, scale: int = 6,
              name: str = "r") -> DataFrame:
    """Pearson correlation of two columns, overall or per group."""
    r = F.round(F.corr(F.col(x).cast("double"), F.col(y).cast("double")), scale).alias(name)
    return df.groupBy(*keys).agg(r) if keys else df.agg(r)


def corr_matrix(df: DataFrame, cols: list[str], scale: int = 6) -> DataFrame:
    """Long-form correlation matrix ``(x, y, r)`` for every ordered pair.

    All pairwise correlations come from one aggregate pass; the matrix is
    then unfolded from that single row (diagonal = 1, symmetric entries
    reuse the same value).
    """
    pairs = list(combinations(cols, 2))
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"__{i}")
                   for i, (a, b) in enumerate(pairs)])
    cells = []
    for c in cols:
        cells.append(F.struct(F.lit(c).alias("x"), F.lit(c).alias("y"), F.lit(1.0).alias("r")))
    for i, (a, b) in enumerate(pairs):
        cells.append(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"__{i}").alias("r")))
        cells.append(F.struct(F.lit(b).alias("x"), F.lit(a).alias("y"), F.col(f"__{i}").alias("r")))
    return one.select(F.explode(F.array(*cells)).alias("c")).select(
        "c.x", "c.y", F.round(F.col("c.r"), scale).alias("r"))
