"""Integer-cent helpers: exact money arithmetic without rounding surprises."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F

CENT = Decimal("0.01")


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_cents(c: Column | str) -> Column:
    """Money (or a double price) as bigint cents; doubles round half-up at 2 digits."""
    return (_c(c).cast("decimal(18,2)") * F.lit(100)).cast("bigint")


def from_cents(c: Column | str, precision: int = 12) -> Column:
    """bigint cents back to ``decimal(precision, 2)``."""
    return (_c(c).cast("decimal(20,0)") * F.lit(CENT)).cast(f"decimal({precision},2)")


def intdiv(a: Column | str, b: Column | str | int) -> Column:
    """Exact ``floor(a / b)`` for non-negative integers (SQL ``div``), as bigint.

    ``a - pmod(a, b)`` is an exact multiple of ``b``, so the decimal division
    below has no rounding; operands are widened to decimal(38,0) first.
    """
    a = _c(a).cast("decimal(38,0)")
    b = (F.lit(b) if isinstance(b, int) else _c(b)).cast("decimal(38,0)")
    return ((a - F.pmod(a, b)) / b).cast("bigint")


def share_of(total_cents: Column | str, part: Column | str, whole: Column | str) -> Column:
    """``floor(total * part / whole)`` in cents; exact, and the product cannot overflow."""
    t = _c(total_cents).cast("decimal(38,0)")
    p = _c(part).cast("decimal(38,0)")
    return intdiv(t * p, whole)


def spend_so_far(c: Column | str = "CurrentBudget") -> Column:
    """A campaign's spend; NULL is nothing spent yet. One rule for W3, W9 and T1."""
    return F.coalesce(_c(c), F.lit(0))
