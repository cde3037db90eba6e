"""Lookups of values in tables of intervals, as equality joins.

Intervals are dealt into cells of equal width and values look into their cell,
so the join is a hash or merge join on the cell with the bounds tested on what
meets there; a comparison of every value with every interval is never planned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def range_lookup(facts: DataFrame, value: str, tiers: DataFrame, lo: str, hi: str, fields: list[str], width: float,
                 levels: int = 1, closed: str = "left", how: str = "inner") -> DataFrame:
    """Fact rows with ``fields`` of every interval that holds their value.

    ``closed`` says which bounds belong to an interval: ``'left'`` (lo <= v <
    hi), ``'right'``, ``'both'`` or ``'none'``.  A NULL bound is open: the
    interval has no end there.  Intervals may overlap (a fact then matches
    several) and be empty (they match nothing); NULL and NaN values match none.

    ``width`` should be near the usual length of an interval: an interval is
    in as many cells as it is long.  With ``levels`` > 1 cells double in width
    from level to level, an interval lies at the level that fits its length
    (two cells, the last level takes what is longer) and a value looks into one
    cell a level.  ``how='left'`` keeps facts without an interval, with NULL
    fields; it needs ``levels=1``, where a fact is one row of the join.
    """
    tests = {"left": lambda v: (v >= F.col("__lo")) & (v < F.col("__hi")), "right": lambda v: (v > F.col("__lo")) & (v <= F.col("__hi")),
             "both": lambda v: (v >= F.col("__lo")) & (v <= F.col("__hi")), "none": lambda v: (v > F.col("__lo")) & (v < F.col("__hi"))}
    if closed not in tests or how not in ("inner", "left") or (how == "left" and levels > 1):
        raise ValueError("closed is left, right, both or none; how is inner, or left with one level")
    low, high = F.col(lo).cast("double"), F.col(hi).cast("double")
    infinity = F.lit(float("inf"))
    own = tiers.select(F.coalesce(low, -infinity).alias("__lo"), F.coalesce(high, infinity).alias("__hi"), *fields)
    # The range of all finite bounds: cells beyond it are folded into one on either side, where open intervals end.
    finite = lambda c: F.when((c > -infinity) & (c < infinity), c)
    known = own.agg(F.least(F.min(finite(F.col("__lo"))), F.min(finite(F.col("__hi")))).alias("a"),
                    F.greatest(F.max(finite(F.col("__lo"))), F.max(finite(F.col("__hi")))).alias("b"))
    first, last = (F.coalesce(known.select(c).scalar(), F.lit(0.0)) for c in "ab")

    def cell(v: Column, level: Column) -> Column:
        size = F.lit(float(width)) * F.pow(F.lit(2.0), level)
        edge = lambda bound, out: F.floor(bound / size) + out
        inside = F.when(v <= first, edge(first, 0)).when(v >= last, edge(last, 0)).otherwise(F.floor(v / size))
        return F.when(v < first, edge(first, -1)).when(v > last, edge(last, 1)).otherwise(inside)

    span = F.col("__hi") - F.col("__lo")
    top = F.lit(levels - 1)
    level = F.when(span >= F.lit(float(width) * 2.0 ** (levels - 1)), top).when(span <= F.lit(float(width)), 0).otherwise(
        F.least(F.ceil(F.log2(span / F.lit(float(width)))).cast("int"), top)).cast("int")
    dealt = own.filter(F.col("__lo") <= F.col("__hi")).withColumn("__level", level)
    dealt = dealt.withColumn("__cell", F.explode(F.sequence(cell(F.col("__lo"), F.col("__level")), cell(F.col("__hi"), F.col("__level")))))
    probe = facts.withColumn("__v", F.col(value).cast("double"))
    if levels == 1:
        probe = probe.withColumn("__at_level", F.lit(0))
    else:
        probe = probe.withColumn("__at_level", F.explode(F.sequence(F.lit(0), top)))
    probe = probe.withColumn("__at_cell", F.when(~F.isnan("__v"), cell(F.col("__v"), F.col("__at_level"))))
    same = (F.col("__at_level") == F.col("__level")) & (F.col("__at_cell") == F.col("__cell")) & tests[closed](F.col("__v"))
    return probe.join(dealt, same, how).select(*facts.columns, *fields)
