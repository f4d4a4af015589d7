"""Column-level building blocks: metric formulas, cent arithmetic, text lines."""

from . import metrics, money, text  # noqa: F401
