"""Predicates and ordering helpers with explicit NULL and case rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _like_escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def contains_text(c: str | Column, needle: str, case_sensitive: bool = False) -> Column:
    """``LIKE '%needle%'``; case-insensitive by default, as the SQL dialect compares."""
    pattern = "%" + _like_escape(needle) + "%"
    return _col(c).like(pattern) if case_sensitive else _col(c).ilike(pattern)


def matches(c: str | Column, regex: str, case_sensitive: bool = True) -> Column:
    """Regular-expression test (document-store ``$regex``, ``i`` flag when insensitive)."""
    return _col(c).rlike(regex if case_sensitive else "(?i)" + regex)


def known(cond: Column) -> Column:
    """A comparison where NULL counts as false (``null > k`` is false in pipelines)."""
    return F.coalesce(cond, F.lit(False))


def exclude_both(a: Column, b: Column, keep_null: bool = True) -> Column:
    """Keep rows that do not satisfy both ``a`` and ``b``.

    ``keep_null=True`` is the ``$nor`` form (a row whose test is unknown is
    kept); ``False`` is SQL ``NOT (a AND b)``, which drops unknown rows.
    """
    both = a & b
    return ~known(both) if keep_null else ~both


def any_known(cols: list[str | Column]) -> Column:
    """At least one of the columns is not NULL."""
    return F.coalesce(*[_col(c) for c in cols]).isNotNull()


def ordinal_position(c: str | Column, values: list) -> Column:
    """1-based position of ``c`` in a fixed list, 0 when absent (SQL ``FIELD``)."""
    return F.array_position(F.array(*[F.lit(v) for v in values]), _col(c))
