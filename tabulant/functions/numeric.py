"""Arithmetic helpers: the two rounding modes, guarded division, part means."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_up(c: str | Column, scale: int = 0) -> Column:
    """SQL ``ROUND``: halves go away from zero."""
    return F.round(_col(c), scale)


def round_half_even(c: str | Column, scale: int = 0) -> Column:
    """Document-store ``$round``: halves go to the even neighbour."""
    return F.bround(_col(c), scale)


def rounder(mode: str):
    """Pick a rounding function by name: ``'half_up'`` or ``'half_even'``."""
    if mode == "half_up":
        return round_half_up
    if mode == "half_even":
        return round_half_even
    raise ValueError(f"unknown rounding mode {mode!r}")


def floor_half_up(c: str | Column) -> Column:
    """``FLOOR(x + 0.5)``: nearest whole number, halves up (also for negatives)."""
    return F.floor(_col(c) + F.lit(0.5))


def safe_divide(num: str | Column, den: str | Column) -> Column:
    """Division that yields NULL for a zero or NULL denominator."""
    return F.try_divide(_col(num), _col(den))


def to_units(c: str | Column, decimals: int = 2) -> Column:
    """A fixed-point value as a whole number of ``10^-decimals`` units (``long``).

    Rounds half away from zero on the stored double: a value that carries at
    most ``decimals`` digits maps to its exact unit count, further digits are
    rounded away.  Primitive arithmetic keeps the per-row work inside
    generated code.
    """
    col = _col(c).cast("double")
    f = F.lit(float(10 ** decimals))
    return (F.signum(col) * F.floor(F.abs(col) * f + F.lit(0.5))).cast("long")


LOW_BITS = 20  # of a unit count; sums of the rest and of these bits each stay far inside a long


def unit_sum(c: str | Column, decimals: int = 2) -> Column:
    """Aggregate: the exact total of a fixed-point column's unit counts, as ``DECIMAL(38, 0)``.

    High and low bits are summed apart as primitive ``long`` values and put
    together once per group, so totals beyond the range of a ``long`` are
    exact too (up to 2**43 rows).
    """
    return units_total(to_units(c, decimals))


def units_total(units: str | Column) -> Column:
    """Aggregate: the exact total of ``long`` unit counts, as ``DECIMAL(38, 0)``."""
    u = _col(units)
    high, low = F.sum(F.shiftright(u, LOW_BITS)), F.sum(u.bitwiseAND(F.lit((1 << LOW_BITS) - 1)))
    return (high.cast("decimal(28,0)") * F.lit(1 << LOW_BITS).cast("decimal(8,0)") + low.cast("decimal(28,0)")
            ).cast("decimal(38,0)")


def units_to_fixed(total_units: str | Column, decimals: int = 2) -> Column:
    """A unit total (e.g. from ``unit_sum``) as ``DECIMAL(38, decimals)``."""
    return (_col(total_units).cast("decimal(38,0)")
            / F.lit(10 ** decimals).cast("decimal(38,0)")).cast(f"decimal(38,{decimals})")


def units_mean(total_units: str | Column, count: str | Column, decimals: int = 2) -> Column:
    """Exact mean from a unit total and a row count, at six decimals half-up; NULL when count is 0."""
    n = (_col(count) * F.lit(10 ** decimals)).cast("decimal(38,0)")
    return F.try_divide(_col(total_units).cast("decimal(38,0)"), n).cast("decimal(38,6)")


def fixed_sum(c: str | Column, decimals: int = 2) -> Column:
    """Exact sum of a fixed-point column, as ``DECIMAL(38, decimals)`` (aggregate).

    Sums units as ``long`` halves, so the per-row work avoids big-decimal
    arithmetic; only the final value is converted.
    """
    return units_to_fixed(unit_sum(c, decimals), decimals)


def fixed_mean(c: str | Column, decimals: int = 2) -> Column:
    """Exact mean of a fixed-point column at six decimals, halves away from zero (aggregate).

    Equal to ``AVG(CAST(c AS DECIMAL(p, decimals)))``: the unit total is
    divided once per group in decimal; NULL for no rows.
    """
    return units_mean(unit_sum(c, decimals), F.count(_col(c)), decimals)


def to_fixed(c: str | Column, decimals: int = 2) -> Column:
    """Per-row exact ``DECIMAL(38, decimals)`` of a fixed-point double (via its unit count)."""
    return (to_units(c, decimals).cast("decimal(38,0)")
            / F.lit(10 ** decimals).cast("decimal(38,0)")).cast(f"decimal(38,{decimals})")


def mean(c: str | Column, fixed: int | None = None) -> Column:
    """``avg`` of a column; ``fixed=d`` makes it the exact fixed-point mean of d-decimal values."""
    return F.avg(_col(c)) if fixed is None else fixed_mean(c, fixed)


def total(c: str | Column, fixed: int | None = None) -> Column:
    """``sum`` of a column; ``fixed=d`` makes it the exact fixed-point sum of d-decimal values."""
    return F.sum(_col(c)) if fixed is None else fixed_sum(c, fixed)


def percent_of(part: str | Column, whole: str | Column, scale: int = 2) -> Column:
    """``ROUND(part * 100 / whole, scale)`` as a double."""
    return F.round(F.try_divide(_col(part).cast("double") * F.lit(100.0), _col(whole).cast("double")), scale)


def mean_of_parts(cols: list[str | Column], skip_null: bool = False) -> Column:
    """Mean of several columns in one row.

    ``skip_null=False`` is the SQL form ``(a+b+c+d)/4`` -- NULL if any part is
    NULL.  ``skip_null=True`` averages only the non-null parts (NULL when all
    are NULL), as the pipeline form with ``$filter`` + ``$size`` does.
    """
    parts = [_col(c).cast("double") for c in cols]
    if not skip_null:
        total = parts[0]
        for p in parts[1:]:
            total = total + p
        return total / F.lit(float(len(parts)))
    arr = F.filter(F.array(*parts), lambda x: x.isNotNull())
    summed = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)
    return F.try_divide(summed, F.size(arr).cast("double"))


def row_sum(cols: list[str | Column]) -> Column:
    """``a + b + ...`` in one row (NULL if any part is NULL)."""
    parts = [_col(c) for c in cols]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def format_fixed(c: str | Column, decimals: int) -> Column:
    """Thousands-separated text with fixed decimals (SQL ``FORMAT``).

    ``format_number`` rounds half-even, so the value is rounded half-up
    first, as ``FORMAT`` does.
    """
    return F.format_number(F.round(_col(c), decimals), decimals)
