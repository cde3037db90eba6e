"""Entity-by-period panel operators.

Group sizes in a panel are unbounded (one entity may hold a third of all
rows), so nothing here windows over raw rows without a per-partition limit:
extremes use partial/final aggregates (``min_by``/``max_by``), "last n rows"
uses a ``row_number() <= n`` filter that Spark plans as a partial
WindowGroupLimit before the shuffle, and calendar windows join per-entity
maxima back (AQE broadcasts them when small and splits hot keys otherwise)
-- or, when the caller states that each entity holds a bounded number of
rows, take the maximum with a window partitioned by entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import mean, mean_of_parts, rounder, total, units_mean
from ..functions.predicates import any_known
from .join import enrich, forget_partitioning

# Winter months by hemisphere, and the labels of the split at noon.
NORTH_WINTER = (12, 1, 2)
SOUTH_WINTER = (6, 7, 8)
NOON_LABELS = ("Before 12", "After 12")


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_last_delta(df: DataFrame, entity: str, period: str, value: str, tiebreak: str | None = None,
                     scale: int = 2, rounding: str = "half_up",
                     names: tuple[str, str, str] = ("initial_value", "final_value", "delta")) -> DataFrame:
    """Value at each entity's first and last period and the change between them.

    One aggregate replaces the self-join on (entity, extreme period): the
    value is taken with ``min_by``/``max_by`` over ``(period, tiebreak)``, so
    ties on the period resolve to the smallest / largest tiebreak instead of
    fanning out.  Periods compare by their typed value, not as text.
    """
    order = F.struct(F.col(period), F.col(tiebreak)) if tiebreak else F.col(period)
    rnd = rounder(rounding)
    agg = df.groupBy(entity).agg(
        F.min_by(F.col(value).cast("double"), order).alias("__first"),
        F.max_by(F.col(value).cast("double"), order).alias("__last"),
    )
    return agg.select(
        entity,
        rnd(F.col("__first"), scale).alias(names[0]),
        rnd(F.col("__last"), scale).alias(names[1]),
        rnd(F.col("__last") - F.col("__first"), scale).alias(names[2]),
    )


def last_n_periods_avg(df: DataFrame, entity: str, period: str, measures: list[str], n: int,
                       by: str = "period", scale: int = 2, prefix: str = "avg_",
                       count_name: str = "n_periods", fixed: int | None = None,
                       bounded_groups: bool = False) -> DataFrame:
    """Mean of measures over each entity's latest ``n`` periods.

    ``by='period'``: calendar window -- rows whose period is at least the
    entity's latest period minus ``n - 1`` (gaps shorten the window).
    ``by='rows'``: the entity's last ``n`` rows by period (gaps do not); of
    rows of one period those with the larger measures count as later.

    For ``by='period'`` the entity's latest period is, by default, a
    partial/final aggregate joined back (safe however many rows an entity
    has).  ``bounded_groups=True`` states that each entity holds a bounded
    number of rows (e.g. one per period after aggregation); the latest
    period then comes from a window partitioned by entity, and the final
    grouping reuses that partitioning -- one shuffle instead of three.
    """
    if by == "rows":
        w = Window.partitionBy(entity).orderBy(F.col(period).desc(), *[F.col(m).desc_nulls_last() for m in measures])
        kept = df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n)
    elif by == "period" and bounded_groups:
        latest = F.max(period).over(Window.partitionBy(entity))
        kept = df.withColumn("__latest", latest).filter(F.col(period) >= F.col("__latest") - F.lit(n - 1))
    elif by == "period":
        latest = df.groupBy(entity).agg(F.max(period).alias("__latest"))
        kept = enrich(df, forget_partitioning(latest), entity).filter(F.col(period) >= F.col("__latest") - F.lit(n - 1))
    else:
        raise ValueError("by must be 'rows' or 'period'")
    aggs = [F.count(F.lit(1)).alias(count_name)]
    aggs += [F.round(mean(m, fixed), scale).alias(f"{prefix}{m}") for m in measures]
    return kept.groupBy(entity).agg(*aggs)


def peak_period(df: DataFrame, entity: str, period: str, measures: list[str],
                prefix: str = "peak_", ties: str = "smallest") -> DataFrame:
    """Period of the single largest observation of each measure, per entity.

    One aggregate with one ``max_by`` per measure (instead of a row_number
    window per measure).  Ties on the value go to the smallest period
    (``ties='smallest'``) or the largest (``'largest'``); NULL values never win
    over a present one.
    """
    p = F.col(period)
    tie = -p if ties == "smallest" else p
    aggs = [F.max_by(p, F.struct(F.col(m), tie)).alias(f"{prefix}{m}")
            for m in measures]
    return df.filter(F.coalesce(*[F.col(m) for m in measures]).isNotNull()).groupBy(entity).agg(*aggs)


def pivot_measure(df: DataFrame, key: str | list[str], pivot: str, values: list, measure: str,
                  agg: str = "avg", scale: int = 2, prefix: str = "", fixed: int | None = None) -> DataFrame:
    """Long -> wide: one output column per listed pivot value.

    Listing the values keeps the plan to a single aggregate (no extra job to
    discover them); values without rows give NULL columns.
    """
    fn = {"avg": lambda c: mean(c, fixed), "sum": lambda c: total(c, fixed), "max": F.max, "min": F.min,
          "count": F.count}[agg]
    keys = [key] if isinstance(key, str) else list(key)
    wide = df.groupBy(*keys).pivot(pivot, values).agg(fn(F.col(measure)))
    out = [F.col(k) for k in keys]
    for v in values:
        col = F.col(f"`{v}`")
        out.append((F.round(col.cast("double"), scale) if agg != "count" else col).alias(f"{prefix}{v}"))
    return wide.select(*out)


def pivot_open(df: DataFrame, key: str | list[str], pivot: str, measure: Column, max_columns: int = 20, map_rows: int = 1000,
               null_name: str = "(null)", rest: str = "rest", part: str = "part") -> DataFrame:
    """Long -> wide without knowing the pivot's values: the most frequent become columns, the others a map.

    ``measure`` is an aggregate.  The ``max_columns`` values with the most rows
    (ties: the smaller as text) are found first, in one aggregate and a top-k:
    that is the one job that runs while the plan is built, as column names
    have to be known.  All other values of a key are entries of the map
    column ``rest``, so none is lost and the number of columns is bounded.  A key
    with more than about ``map_rows`` other values has several rows, numbered
    by ``part`` from 0, with its entries dealt over them by a hash; its columns
    are filled in part 0.  NULL pivot values count as ``null_name``.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rows = df.withColumn("__p", F.coalesce(F.col(pivot).cast("string"), F.lit(null_name)))
    top = rows.groupBy("__p").agg(F.count(F.lit(1)).alias("__n")).orderBy(F.desc("__n"), "__p").limit(max_columns)
    heavy = [r[0] for r in top.select("__p").collect()]   # at most max_columns values
    cells = rows.groupBy(*keys, "__p").agg(measure.alias("__v")).withColumn("__heavy", F.col("__p").isin(*heavy))
    others = cells.groupBy(*keys).agg(F.count_if(~F.col("__heavy")).alias("__m"))
    others = forget_partitioning(others.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__m"))
    same = None
    for i, k in enumerate(keys):
        term = F.col(k).eqNullSafe(F.col(f"__k{i}"))
        same = term if same is None else same & term
    parts = F.greatest(F.ceil(F.col("__m") / F.lit(map_rows)), F.lit(1))
    place = F.when(F.col("__heavy"), F.lit(0)).otherwise(F.pmod(F.xxhash64("__p"), parts)).cast("long")
    dealt = cells.join(others, same).withColumn(part, place)
    entries = F.sort_array(F.collect_list(F.when(~F.col("__heavy"), F.struct("__p", "__v"))))
    wide = [F.max(F.when(F.col("__p") == v, F.col("__v"))).alias(v) for v in heavy]
    return dealt.groupBy(*keys, part).agg(*wide, F.map_from_entries(entries).alias(rest))


def seasonal_mean(df: DataFrame, entity: str, month: str, measures: list[str], southern: Column,
                  north_months: tuple[int, ...] = NORTH_WINTER, south_months: tuple[int, ...] = SOUTH_WINTER,
                  scale: int = 4, prefix: str = "avg_winter_", extra_keys: list[str] | None = None,
                  fixed: int | None = None, pre: dict[str, tuple[Column, Column]] | None = None) -> DataFrame:
    """Mean of measures over each entity's winter months, hemisphere-aware.

    ``southern`` is a boolean column per row; northern rows count Dec-Feb,
    southern rows Jun-Aug (the month sets are parameters).  ``pre`` is for
    rows that are already sums: for each measure (fixed-point units, count of
    values) columns of a row, so that facts can be aggregated before they are
    joined to the attributes, and the means stay exact.
    """
    south = F.coalesce(southern, F.lit(False))
    in_season = (south & F.col(month).isin(*south_months)) | (~south & F.col(month).isin(*north_months))
    keys = [entity] + list(extra_keys or [])
    of = lambda m: (units_mean(F.sum(pre[m][0]), F.sum(pre[m][1]), fixed) if pre else mean(m, fixed))
    aggs = [F.round(of(m), scale).alias(f"{prefix}{m}") for m in measures]
    return df.filter(in_season).groupBy(*keys).agg(*aggs)


def time_split_sum(df: DataFrame, hour: str | Column, amount: str, split_hour: int = 12,
                   labels: tuple[str, str] = NOON_LABELS, scale: int = 2,
                   names: tuple[str, str] = ("period", "amt"), fixed: int | None = None) -> DataFrame:
    """Total amount before / after a split hour; hours outside 0-23 are invalid and dropped."""
    h = _c(hour)
    valid = df.filter(h.between(0, 23))
    label = F.when(h < split_hour, F.lit(labels[0])).otherwise(F.lit(labels[1]))
    return (valid.groupBy(label.alias(names[0]))
            .agg(F.round(total(amount, fixed), scale).alias(names[1])))


def variation_index(df: DataFrame, entity: str, measures: list[str], skip_null: bool = False,
                    index_name: str = "variation_index", prefix: str = "std_", scale: int = 4,
                    require_any: bool = False) -> DataFrame:
    """Sample std-dev of each measure per entity and their equal-weight mean.

    ``skip_null=False`` makes the index NULL when any std-dev is NULL (an
    entity with one row); ``True`` averages the std-devs that exist.
    ``require_any`` first drops rows where every measure is NULL, so an
    entity with no numeric value at all yields no row.
    """
    if require_any:
        df = df.filter(any_known(measures))
    aggs = [F.stddev_samp(F.col(m).cast("double")).alias(f"{prefix}{m}") for m in measures]
    per = df.groupBy(entity).agg(*aggs)
    std_cols = [f"{prefix}{m}" for m in measures]
    idx = mean_of_parts(std_cols, skip_null=skip_null)
    return per.select(entity, *[F.round(F.col(c), scale).alias(c) for c in std_cols],
                      F.round(idx, scale).alias(index_name))


def period_mean_enrich(attrs: DataFrame, facts: DataFrame, attr_key: str, fact_key: str, period: str,
                       lo, hi, measures: list[str], attr_cols: list[str], require: list[str] | None = None,
                       scale: int = 2, prefix: str = "avg_", fixed: int | None = None,
                       lexical: bool = False) -> DataFrame:
    """Entity attributes with the mean of measures over a period range.

    Facts are restricted to ``lo <= period <= hi`` and aggregated per entity
    first (partial/final aggregate), then joined to the attributes -- the
    outer join of the source degrades to inner because the period filter
    sits on the fact side.  ``require`` lists attribute columns that must be
    present (not NULL and not blank).  ``lexical=True`` compares the period as
    text (``year >= '2010' AND year <= '2020'`` on a text column), which
    agrees with the numeric range only while all periods have the same width.
    """
    a = attrs
    for c in require or []:
        a = a.filter(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != F.lit("")))
    in_range = (F.col(period).cast("string").between(str(lo), str(hi)) if lexical
                else F.col(period).between(lo, hi))
    per = (facts.filter(in_range)
           .groupBy(F.col(fact_key).alias("__fk"))
           .agg(*[mean(m, fixed).alias(f"__{m}") for m in measures]))
    joined = a.select(attr_key, *[c for c in attr_cols if c != attr_key]).join(
        per, F.col(attr_key) == F.col("__fk"), "inner")
    out = [attr_key] + [c for c in attr_cols if c != attr_key]
    out += [F.round(F.col(f"__{m}"), scale).alias(f"{prefix}{m}") for m in measures]
    return joined.select(*out)
