"""Enrichment joins, distinct unions and the bucket scaffold.

Join sides are left to the planner: it broadcasts a side whose statistics are
below ``autoBroadcastJoinThreshold``, and adaptive execution switches to a
broadcast or splits skewed partitions from the sizes it sees at run time.
Nothing here probes a side or hints by row count, so building a query runs no
job and the plan does not depend on the data of the day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import mean


def enrich(fact: DataFrame, dim: DataFrame, left_on: str | list[str], right_on: str | list[str] | None = None,
           how: str = "inner", case_insensitive: bool = False) -> DataFrame:
    """Attach dimension attributes to fact rows by equality of keys.

    ``how='inner'`` drops unmatched facts (lookup + unwind), ``'left'`` keeps
    them with NULL attributes (lookup kept as an outer match).  Right-side key
    columns are dropped from the result.  With ``case_insensitive`` the keys
    are compared through ``lower()`` helper columns, which keeps the join a
    plain hash equi-join.  A key repeated in ``dim`` fans the fact row out,
    exactly as SQL does.
    """
    lk = [left_on] if isinstance(left_on, str) else list(left_on)
    rk = lk if right_on is None else ([right_on] if isinstance(right_on, str) else list(right_on))
    renamed = [f"__rk{i}" for i in range(len(rk))]
    key_cols = [(F.lower(F.col(k)) if case_insensitive else F.col(k)).alias(t) for k, t in zip(rk, renamed)]
    right = dim.select(*key_cols, *[c for c in dim.columns if c not in rk])
    cond = None
    for lcol, tmp in zip(lk, renamed):
        left_key = F.lower(fact[lcol]) if case_insensitive else fact[lcol]
        term = left_key == right[tmp]
        cond = term if cond is None else cond & term
    out = fact.join(right, cond, how)
    return out.drop(*renamed)


def forget_partitioning(df: DataFrame) -> DataFrame:
    """The same rows and partitions (no shuffle), but the planner no longer knows by what they are partitioned.

    For an aggregate that is joined back to facts on its grouping key: known
    to be partitioned by it, it would meet the facts without an exchange of its
    own, and adaptive execution then cannot split a hot key of the facts.
    Shuffling the short side again is what makes that split possible.
    """
    return df.coalesce(1 << 20)


def semi_match(fact: DataFrame, dim: DataFrame, left_on: str, right_on: str | None = None) -> DataFrame:
    """Fact rows that have at least one match in ``dim`` (non-empty lookup)."""
    rk = right_on or left_on
    keys = forget_partitioning(dim.select(F.col(rk).alias("__k")).distinct())
    return fact.join(keys, fact[left_on] == keys["__k"], "left_semi")


def fanout_sum(fact: DataFrame, dim: DataFrame, key: str, unit_cols: list[str], dim_keys: list[str]) -> DataFrame:
    """Sums of fact columns per ``dim_keys`` over a many-to-many join on ``key``, without the joined rows.

    A key that ``dim`` repeats multiplies every matching fact, as the join
    would.  Facts are summed per key first and dimension rows counted per
    (key, ``dim_keys``), so the join meets each key once per combination and a
    hot key costs one row.  ``n_rows`` counts the rows the join would have.
    """
    sums = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in unit_cols]
    facts = fact.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), *sums)
    dims = dim.groupBy(F.col(key).alias("__k"), *dim_keys).agg(F.count(F.lit(1)).alias("__m"))
    both = facts.join(dims, facts[key] == dims["__k"])
    times = [F.sum((F.col(c) * F.col("__m")).cast("decimal(38,0)")).alias(c) for c in unit_cols]
    return both.groupBy(*dim_keys).agg(F.sum(F.col("__n") * F.col("__m")).alias("n_rows"), *times)


def distinct_union(*parts: DataFrame) -> DataFrame:
    """The distinct rows of all parts (SQL ``UNION``): each is made distinct map-side before the one shuffle."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def bucket_scaffold(df: DataFrame, value: str, measures: list[str], start: int, stop: int,
                    width: float = 1.0, scale: int = 2, label: str = "bucket",
                    prefix: str = "avg_", fixed: int | None = None) -> DataFrame:
    """Mean of measures per fixed-width bucket of ``value``, empty buckets kept.

    The scaffold is the constant relation ``start .. stop-1`` (one row per
    bucket).  Facts are first aggregated per bucket -- a partial/final hash
    aggregate, skew-safe -- and the at most ``stop - start`` rows are then
    left-joined onto the scaffold, so buckets without facts keep NULL means
    and facts outside the scaffold drop out, as the outer join does.
    The label reads ``"<lo> to <hi>"``.
    """
    bucket = F.floor(F.col(value) / F.lit(width)) if width != 1 else F.floor(F.col(value))
    aggs = [mean(m, fixed).alias(f"__{m}") for m in measures]
    per_bucket = df.groupBy(bucket.cast("bigint").alias("__b")).agg(*aggs)
    scaffold = df.sparkSession.range(start, stop).withColumnRenamed("id", "__b")
    joined = scaffold.join(F.broadcast(per_bucket.filter(F.col("__b").between(start, stop - 1))), "__b", "left")
    lo = F.col("__b").cast("string")
    hi = (F.col("__b") + F.lit(1)).cast("string")
    cols = [F.concat(lo, F.lit(" to "), hi).alias(label)]
    cols += [F.round(F.col(f"__{m}"), scale).alias(f"{prefix}{m}") for m in measures]
    return joined.select(*cols)
