"""Several groupings of one scan in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def facets(df: DataFrame, groups: dict[str, list[str]], aggs: dict[str, Column], name: str = "facet") -> DataFrame:
    """One row for each group of each facet: the facet's name, its keys (NULL in the other facets' columns), the aggregates.

    ``groups`` maps a facet's name to its grouping columns; none of them is
    the grand total.  All facets come from one scan: every row is expanded to
    one copy for each facet, summed up before the one shuffle, and told apart by
    the grouping id, so a NULL key is a group of its own facet.  An empty
    input has no groups, and no grand total either.
    """
    columns = list(dict.fromkeys(k for keys in groups.values() for k in keys))
    if len({frozenset(keys) for keys in groups.values()}) < len(groups):
        raise ValueError("facets on the same keys are one facet with more aggregates")
    out = df.groupingSets([[F.col(k) for k in keys] for keys in groups.values()], *[F.col(k) for k in columns]).agg(
        F.grouping_id().alias("__set"), *[c.alias(n) for n, c in aggs.items()])
    label = None
    for facet, keys in groups.items():
        bits = sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in keys)
        test = F.col("__set") == bits
        label = F.when(test, facet) if label is None else label.when(test, facet)
    return out.select(label.alias(name), *columns, *aggs)
