"""Input checks for operators that take user-built request DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame


def require_columns(df: DataFrame, columns: list[str], what: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} needs column(s) {missing}; got {df.columns}")
