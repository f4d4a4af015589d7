"""The one argument passed around: a bundle of model DataFrames.

A table may be given as a DataFrame or as a zero-argument callable that
builds it; callables run on first access and are memoized, so a query only
pays for (and analyzes) the tables it reads.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

TABLE_NAMES = (
    "campaign", "ad", "campaign_product", "product", "orders", "customer",
    "customer_segment", "platform", "region", "order_line", "marketing_user",
)

Source = DataFrame | Callable[[], DataFrame] | None


class Tables:
    __slots__ = ("_src", "_cache")

    def __init__(self, **tables: Source):
        unknown = set(tables) - set(TABLE_NAMES)
        if unknown:
            raise TypeError(f"unknown tables: {sorted(unknown)}")
        self._src = dict(tables)
        self._cache: dict[str, DataFrame | None] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLE_NAMES:
            raise AttributeError(name)
        if name not in self._cache:
            src = self._src.get(name)
            self._cache[name] = src() if callable(src) and not isinstance(src, DataFrame) else src
        return self._cache[name]

    def with_(self, **changes: Source) -> "Tables":
        """A new bundle with some tables swapped (e.g. a new snapshot)."""
        merged = {n: self._cache.get(n, self._src.get(n)) for n in TABLE_NAMES}
        merged.update(changes)
        return Tables(**{k: v for k, v in merged.items() if v is not None})

    def register(self, prefix: str = "") -> None:
        """Register every table as a temp view (``prefix`` + name)."""
        for name in TABLE_NAMES:
            df = getattr(self, name)
            if df is not None:
                df.createOrReplaceTempView(prefix + name)
