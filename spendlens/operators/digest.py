"""Bulk digest match (the login lookup, re-aimed as a column operator).

``users`` holds (Username, PasswordHash = lower-hex SHA-256, Role);
``candidates`` holds a user name and a clear value. Only users with the
given role count. An unknown user and a wrong digest both give plain
``false``. The clear value is hashed in the scan's stage (built-in
``sha2``) and never written out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def digest_match(users: DataFrame, candidates: DataFrame, value_col: str = "Password",
                 role: str = "MARKETING", keep: list[str] | None = None,
                 collation: str | None = None) -> DataFrame:
    """``collation`` (e.g. ``"UTF8_LCASE"``) compares the role case-insensitively."""
    role_col = F.collate("Role", collation) if collation else F.col("Role")
    allowed = users.where(role_col == F.lit(role)).select("Username", "PasswordHash")
    hashed = candidates.withColumn("_digest", F.sha2(F.col(value_col).cast("string"), 256)).drop(value_col)
    j = hashed.join(allowed, "Username", "left")
    matched = F.coalesce(F.col("PasswordHash") == F.col("_digest"), F.lit(False)).alias("matched")
    cols = keep if keep is not None else [c for c in candidates.columns if c != value_col]
    return j.select(*cols, matched)
