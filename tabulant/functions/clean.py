"""Column expressions that type and clean text-stored values.

Every function returns a ``Column`` built from Spark's own functions, so the
work stays inside whole-stage codegen.  Junk never raises: ANSI mode is on,
so conversions go through ``try_cast`` / ``try_to_date`` and bad values
become NULL (deliberately not 0, so junk cannot enter a mean or pass an
``= 0`` test).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters that appear inside number columns of the source
# dumps and must be removed before a cast -- the mis-decoded "Â", the
# no-break space, the plain space and the thousands comma.
NUMBER_MARKS = "Â\u00a0 ,"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: str | Column) -> Column:
    """Trimmed text, with '' turned into NULL (both mean "missing")."""
    return F.nullif(F.trim(_col(c)), F.lit(""))


def strip_marks(c: str | Column) -> Column:
    """Remove stray encoding marks, spaces and thousands separators (one ``translate`` pass)."""
    return F.translate(_col(c).cast("string"), NUMBER_MARKS, "")


def to_number(c: str | Column, dtype: str = "double") -> Column:
    """Lenient text -> number: strip marks, blank -> NULL, junk -> NULL."""
    return F.nullif(strip_marks(c), F.lit("")).try_cast(dtype)


def strict_number(c: str | Column, dtype: str = "double") -> Column:
    """Plain cast; raises on junk under ANSI mode (the document-store ``$toDouble``)."""
    return _col(c).cast(dtype)


def coalesce_existing(df: DataFrame, names: list[str]) -> Column:
    """First non-null of the columns that exist in ``df`` (schema drift in key case)."""
    present = [F.col(n) for n in names if n in df.columns]
    if not present:
        raise ValueError(f"none of {names} in {df.columns}")
    return F.coalesce(*present) if len(present) > 1 else present[0]


def parse_hour(c: str | Column) -> Column:
    """Hour of an ``HH:mm`` text, allowing 24 and above (``hour()`` would raise)."""
    return F.split_part(_col(c).cast("string"), F.lit(":"), F.lit(1)).try_cast("int")


def parse_dmy(c: str | Column) -> Column:
    """``d/m/Y`` text -> date; one- and two-digit day and month both accepted."""
    return F.try_to_date(_col(c), "d/M/yyyy")


def split_pair(c: str | Column, sep: str = "/") -> tuple[Column, Column]:
    """Two halves of a packed ``a/b`` field (text before the first, after the last sep)."""
    col = _col(c)
    return F.substring_index(col, sep, 1), F.substring_index(col, sep, -1)


def strip_prefix(c: str | Column, prefix_len: int) -> Column:
    """Text after a fixed-width prefix (``CUST_1`` -> ``1``), as SQL ``SUBSTRING(s, n+1)``."""
    return F.substring(_col(c), prefix_len + 1, 1 << 30)


def id_from_prefixed(c: str | Column, prefix_len: int, dtype: str = "bigint") -> Column:
    """Numeric id behind a fixed-width prefix; NULL when the rest is not a number."""
    return strip_prefix(c, prefix_len).try_cast(dtype)


def is_true_text(c: str | Column) -> Column:
    """Boolean from a text flag stored as ``'True'``; anything else is false."""
    return F.coalesce(_col(c) == F.lit("True"), F.lit(False))


def onehot_label(pairs: list[tuple[str | Column, str]], default: str) -> Column:
    """Fold one-hot flag columns into one label: first true flag wins."""
    expr = None
    for flag, label in pairs:
        cond = is_true_text(flag) if isinstance(flag, str) else F.coalesce(flag, F.lit(False))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default))
