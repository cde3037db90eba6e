"""Grouped summaries.

All aggregates here are algebraic (count, sum, avg, min, max, std-dev), so
Spark runs them as a partial aggregate before the shuffle and a final one
after it: a hot key is combined map-side and never lands whole in one task.
Windows appear only over already-aggregated, small tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import floor_half_up, mean, percent_of, total, units_mean


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def mean_by(df: DataFrame, keys: list[str | Column], measures: list[str], scale: int | None = 2,
            prefix: str = "avg_", total_name: str | None = None, fixed: int | None = None) -> DataFrame:
    """Mean of each measure per group (global mean when ``keys`` is empty).

    ``total_name`` adds the mean of the row sum of all measures (NULL parts
    make that row's sum NULL, so it is skipped by ``avg``).  ``fixed=d``
    treats the measures as d-decimal fixed-point values and averages them
    exactly (long unit sums, one decimal division per group).
    """
    def rnd(c):
        return F.round(c, scale) if scale is not None else c
    aggs = []
    if total_name:
        total = None
        for m in measures:
            total = F.col(m) if total is None else total + F.col(m)
        aggs.append(rnd(mean(total, fixed)).alias(total_name))
    aggs += [rnd(mean(m, fixed)).alias(f"{prefix}{m}") for m in measures]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def count_by(df: DataFrame, keys: list[str | Column], name: str = "n") -> DataFrame:
    """Rows per group."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def count_distinct_of(df: DataFrame, col: str, name: str) -> DataFrame:
    """One-row count of distinct non-null values."""
    return df.agg(F.count_distinct(F.col(col)).alias(name))


def sum_by(df: DataFrame, keys: list[str | Column], amount: str, rounding: str = "exact",
           name: str = "total", scale: int | None = None, fixed: int | None = None) -> DataFrame:
    """Sum per group; ``rounding='each_half_up'`` rounds every row (``FLOOR(x+0.5)``) first.

    ``fixed=d`` sums d-decimal values exactly (as ``DECIMAL(38, d)``).
    """
    if rounding == "exact":
        val = total(amount, fixed)
        val = F.round(val, scale) if scale is not None else val
    elif rounding == "each_half_up":
        val = F.sum(floor_half_up(F.col(amount).cast("double")))
    else:
        raise ValueError("rounding must be 'exact' or 'each_half_up'")
    return df.groupBy(*keys).agg(val.alias(name))


def mean_of_means(branches: list[tuple[DataFrame, list[str | Column], dict[str, str]]],
                  scale: int = 2, fixed: int | None = None) -> DataFrame:
    """Average, over all groups of all branches, of each branch's group means.

    Each branch is ``(df, group_keys, {output_name: input_column})``; every
    branch must map the same output names.  Group means are rounded to
    ``scale`` before the outer mean (as the source does), then the branches
    are stacked with ``unionByName`` and averaged once more.
    """
    names = list(branches[0][2].keys())
    parts = []
    for df, keys, mapping in branches:
        if list(mapping.keys()) != names:
            raise ValueError("every branch must produce the same measures")
        aggs = [F.round(mean(src, fixed), scale).alias(out) for out, src in mapping.items()]
        parts.append(df.groupBy(*keys).agg(*aggs).select(*names))
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p)
    return stacked.agg(*[F.round(F.avg(F.col(n)), scale).alias(n) for n in names])


def profile_measure(sources: list[tuple[str, DataFrame, str]], high: float, scale: int = 2,
                    label: str = "source", positive_only: bool = True, fixed: int | None = None) -> DataFrame:
    """Distribution summary of one measure from several sources, stacked.

    Per source: count, mean, max, min, population std-dev and the number of
    values above ``high``; only present (and, by default, positive) values
    count.
    """
    parts = []
    for name, df, col in sources:
        v = F.col(col)
        kept = df.filter(v.isNotNull() & (v > 0) if positive_only else v.isNotNull())
        parts.append(kept.agg(
            F.count(F.lit(1)).alias("total_items"),
            F.round(mean(v, fixed), scale).alias("avg_value"),
            F.round(F.max(v), scale).alias("max_value"),
            F.round(F.min(v), scale).alias("min_value"),
            F.round(F.stddev_pop(v), scale).alias("stddev_value"),
            F.count_if(v > F.lit(high)).alias("high_items"),
        ).select(F.lit(name).alias(label), "*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def count_levels(df: DataFrame, outer: list[str], inner: list[str],
                 names: tuple[str, str] = ("records_outer", "records_inner")) -> DataFrame:
    """Row counts at two nested granularities, side by side.

    Counted once at the fine level (partial/final aggregate); the coarse
    count is a window sum over that small result, so no window ever spans
    raw rows.  The two count columns get distinct names.
    """
    fine = df.groupBy(*outer, *inner).agg(F.count(F.lit(1)).alias(names[1]))
    w = Window.partitionBy(*outer)
    return fine.select(*outer, F.sum(names[1]).over(w).alias(names[0]), *inner, names[1])


def cohort_compare(df: DataFrame, key: str, cohorts: dict[str, list], measures: list[str],
                   scale: int | None = 4, label: str = "cohort", prefix: str = "avg_",
                   case_insensitive: bool = True, fixed: int | None = None) -> DataFrame:
    """Mean of measures for named cohorts of keys, one row per cohort."""
    k = F.lower(F.col(key)) if case_insensitive else F.col(key)
    tag = None
    for name, members in cohorts.items():
        vals = [m.lower() if case_insensitive and isinstance(m, str) else m for m in members]
        cond = k.isin(*vals)
        tag = F.when(cond, F.lit(name)) if tag is None else tag.when(cond, F.lit(name))
    tagged = df.select(tag.alias(label), *measures)
    return mean_by(tagged.filter(F.col(label).isNotNull()), [label], measures, scale=scale, prefix=prefix,
                   fixed=fixed)


def tier_summary(per_entity: DataFrame, tier: Column, measures: dict[str, str], count_name: str = "n_entities",
                 tier_name: str = "tier", scale: int = 2, minmax: str | None = None,
                 distinct_key: str | None = None, fixed: int | None = None,
                 pre: dict[str, tuple[Column, Column]] | None = None) -> DataFrame:
    """Classify entities into tiers and summarise each tier.

    ``per_entity`` holds one row per entity (or, for the fan-out form, one
    row per joined fact with ``distinct_key`` naming the entity).  Output:
    tier, entity count (distinct when ``distinct_key``), mean of each
    measure (``{out: col}``) and, for ``minmax``, its min and max.  ``pre`` is
    for facts summed per entity before the join: for each output (fixed-point
    units, count of values) of a row, from which the means over all joined
    facts are exact.
    """
    t = per_entity.withColumn(tier_name, tier)
    cnt = F.count_distinct(F.col(distinct_key)) if distinct_key else F.count(F.lit(1))
    aggs = [cnt.alias(count_name)]
    aggs += [F.round(mean(src, fixed), scale).alias(out) for out, src in measures.items()]
    aggs += [F.round(units_mean(F.sum(u), F.sum(n), fixed), scale).alias(out) for out, (u, n) in (pre or {}).items()]
    if minmax:
        aggs += [F.round(F.min(F.col(minmax)), scale).alias(f"min_{minmax}"),
                 F.round(F.max(F.col(minmax)), scale).alias(f"max_{minmax}")]
    return t.groupBy(tier_name).agg(*aggs)


def share_of_total(df: DataFrame, group: list[str], level: list[str], count_name: str = "item_count",
                   pct_name: str = "pct_items", scale: int = 2) -> DataFrame:
    """Rows per (group, level) and their percentage within the group.

    Counting is a partial/final aggregate; the per-group total is a window
    over that aggregated result (one row per level), replacing the join of
    two aggregates.
    """
    counts = df.groupBy(*group, *level).agg(F.count(F.lit(1)).alias(count_name))
    w = Window.partitionBy(*group)
    return counts.withColumn(pct_name, percent_of(F.col(count_name), F.sum(count_name).over(w), scale))
