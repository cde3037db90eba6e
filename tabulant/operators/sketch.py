"""Distinct counts from mergeable sketches.

A sketch of a group's values is a few kilobytes whatever their number.  States
can be stored (per day, say) and merged into those of any coarser group later,
without the rows; a merged state equals the one of a single pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K = 12   # 4096 registers: 4 KB a state


def sketch_by(df: DataFrame, keys: list[str | Column], value: str, name: str = "sketch", lg_k: int = LG_K) -> DataFrame:
    """One state for each group, of its distinct values; NULL values do not count.

    Tasks send one state for each group they saw, so a hot group costs the
    shuffle no more than another.
    """
    return _settled(df.groupBy(*keys).agg(F.hll_sketch_agg(value, lg_k).alias(name)), name)


def merge_sketches(states: DataFrame, keys: list[str | Column], name: str = "sketch") -> DataFrame:
    """States merged into those of coarser groups (of everything when ``keys`` is empty)."""
    return _settled(states.groupBy(*keys).agg(F.hll_union_agg(name).alias(name)), name)


def _settled(states: DataFrame, name: str) -> DataFrame:
    """States without the trace of the order in which values came, so that equal sets of values have equal states."""
    return states.withColumn(name, F.hll_union(name, name))


def estimate(name: str | Column = "sketch") -> Column:
    """The estimated number of distinct values of a state (``long``)."""
    return F.hll_sketch_estimate(name)


def error_bound(exact: Column, lg_k: int = LG_K, deviations: float = 4.0) -> Column:
    """How far an estimate may be from ``exact``: four standard deviations of the sketch, and one for rounding."""
    return exact * F.lit(deviations * 1.04 / 2 ** (lg_k / 2)) + F.lit(1.0)
