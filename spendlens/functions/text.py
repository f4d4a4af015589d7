"""Report lines as Column expressions.

``key_value_line`` is the generic ``Label=value | Label=value`` form (NULL
prints ``null``); ``fixed`` renders a number with a fixed count of decimals
(Java ``%.Nf``, half-up) by casting to decimal — no string formatting of
doubles, which differs between engines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DataType, DoubleType, FloatType

SEP = " | "
NULL_TEXT = "null"
RATIO_DIGITS = 4

# Characters Java's String.trim() removes: every code point <= U+0020.
_JAVA_TRIM = r"^[\x00-\x20]+|[\x00-\x20]+$"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_text(c: Column | str) -> Column:
    return F.coalesce(_c(c).cast("string"), F.lit(NULL_TEXT))


def fixed(c: Column | str, digits: int) -> Column:
    """``String.format("%.{digits}f", x)`` for decimals and doubles."""
    return F.coalesce(_c(c).cast(f"decimal(38,{digits})").cast("string"), F.lit(NULL_TEXT))


def plain(c: Column | str, kind: DataType) -> Column:
    """``%s``: a double (a ratio) as plain decimal text with RATIO_DIGITS
    decimals, as a decimal column of a database prints, never in E notation."""
    return fixed(c, RATIO_DIGITS) if isinstance(kind, (DoubleType, FloatType)) else as_text(c)


def whole(c: Column | str) -> Column:
    """``%d``: an integer; NULL reads as 0, as ``getInt`` does."""
    return F.coalesce(_c(c).cast("string"), F.lit("0"))


def key_value_line(df: DataFrame, columns: list[str] | None = None) -> Column:
    cols = columns or df.columns
    return F.concat_ws(SEP, *[F.concat(F.lit(f"{c}="), as_text(F.col(f"`{c}`"))) for c in cols])


def template_line(*pieces: str | Column) -> Column:
    """Concatenate literal text and Columns: ``template_line("A=", col, " | B=", col2)``."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces])


def java_trim(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), _JAVA_TRIM, "")
