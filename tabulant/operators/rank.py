"""Top-k overall and per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows in ``order`` (planned as TakeOrderedAndProject: per-partition top-k, then merge)."""
    return df.orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, group: list[str | Column], order: list[Column], k: int,
                    rank_name: str = "rank_no") -> DataFrame:
    """Rows ranked ``1..k`` within each group by ``order``.

    ``row_number() <= k`` is planned with a partial WindowGroupLimit before
    the shuffle, so a hot group sends at most ``k`` rows per map partition.
    Ties must be broken by the caller's ``order`` for a deterministic result.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank_name, F.row_number().over(w)).filter(F.col(rank_name) <= k)
