"""Metric formulas as Column expressions — the single home of every formula.

All built-in expressions (JVM side, whole-stage codegen); no Python UDFs.
Ratios are double, computed as one IEEE multiply-then-divide so every engine
gets the same bits; a zero or NULL denominator gives NULL (Spark 4 ANSI mode
would otherwise raise). Means are summed in decimal, since sums of doubles
depend on their order, and shown with ``AVG_DIGITS`` decimals.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schema import MONEY_SUM

AVG_DIGITS = 6


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: Column | str, den: Column | str, scale: float = 1.0) -> Column:
    """``scale * num / den`` as double; NULL when ``den`` is 0 or NULL."""
    num, den = _c(num), _c(den)
    value = num.cast("double") * F.lit(float(scale)) / den.cast("double")
    return F.when(den != 0, value)


def ctr(clicks: Column | str = "Clicks", impressions: Column | str = "Impressions") -> Column:
    """Click-through rate in percent."""
    return ratio(clicks, impressions, 100.0)


def cost_per_click(cost: Column | str = "CostPerAd", clicks: Column | str = "Clicks") -> Column:
    return ratio(cost, clicks)


def roas(revenue: Column | str = "AttributedRevenue", cost: Column | str = "CostPerAd") -> Column:
    """Return on ad spend."""
    return ratio(revenue, cost)


def utilization_pct(spend: Column | str = "TotalSpend", budget: Column | str = "Budget") -> Column:
    return ratio(spend, budget, 100.0)


def roi_pct(revenue: Column | str, spend: Column | str) -> Column:
    """``100 * (revenue - spend) / spend``; the difference is taken exactly in decimal."""
    return ratio(_c(revenue) - _c(spend), spend, 100.0)


def exact_mean(c: Column | str) -> Column:
    """The mean of doubles, the same whatever the order: summed as
    decimal(38,18), divided once."""
    c = _c(c)
    return F.sum(c.cast("decimal(38,18)")).cast("double") / F.count(c)


def money_sum(c: Column | str) -> Column:
    """``IFNULL(SUM(x), 0)`` as decimal(38,2): exact, order independent."""
    return F.coalesce(F.sum(_c(c)), F.lit(0)).cast(MONEY_SUM)
