"""``Column`` helpers on array columns: slices, elements, and exact means of a field."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import _col, to_units, units_mean


def tail(items: str | Column, n: int) -> Column:
    """The last ``n`` elements (``$slice`` with a negative count); all if there are fewer."""
    size = F.size(_col(items))
    return F.slice(_col(items), F.greatest(size - n, F.lit(0)) + 1, F.lit(n))


def head(items: str | Column, n: int) -> Column:
    """The first ``n`` elements; all if there are fewer."""
    return F.slice(_col(items), 1, n)


def element(items: str | Column, at: int) -> Column:
    """The element at ``at`` from 0 (negative: from the end, -1 the last); NULL beyond either end."""
    return F.try_element_at(_col(items), F.lit(at + 1 if at >= 0 else at))


def mean_of(items: str | Column, decimals: int = 2) -> Column:
    """Exact mean of an array's fixed-point values, NULL ones left out (``$avg`` on an array field); NULL if none is left."""
    known = F.filter(_col(items), lambda x: x.isNotNull())
    units = F.aggregate(known, F.lit(0).cast("decimal(38,0)"), lambda s, x: (s + to_units(x, decimals)).cast("decimal(38,0)"))
    return units_mean(units, F.size(known).cast("long"), decimals)
