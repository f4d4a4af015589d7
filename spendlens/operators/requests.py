"""Request text to typed columns: what a form or a CSV file delivers, checked once.

Each column is trimmed and parsed by built-in functions that give NULL instead
of failing; a row whose text does not parse, or that leaves a required column
blank, goes to the rejects with the name of its first such column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DataType, DateType, StringType, StructType

from .checks import require_columns

ISO_DATE = "yyyy-MM-dd"


def _parsed(c: Column, kind: DataType) -> Column:
    if isinstance(kind, StringType):
        return c
    if isinstance(kind, DateType):
        return F.try_to_date(c, ISO_DATE)
    return c.try_cast(kind)


def typed_requests(text: DataFrame, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(rows with ``schema``'s columns and types, rejects: the text as it came, with a Reason).

    Blank text is NULL; ``schema``'s fields that are not nullable are required.
    """
    require_columns(text, schema.fieldNames(), "request text")
    # text as it came beside what it parses to, under names that cannot clash
    cells = [F.nullif(F.trim(F.col(f.name).cast("string")), F.lit("")) for f in schema]
    values = [_parsed(c, f.dataType) for c, f in zip(cells, schema)]
    why = F.coalesce(*[
        F.when((c.isNotNull() & v.isNull()), F.lit(f"{f.name} does not parse"))
        .when(F.lit(not f.nullable) & c.isNull(), F.lit(f"{f.name} is missing"))
        for c, v, f in zip(cells, values, schema)])
    both = text.select(F.struct(*text.columns).alias("came"),
                       F.struct(*[v.alias(f.name) for v, f in zip(values, schema)]).alias("typed"), why.alias("why"))
    rows = both.where("why IS NULL").select(*[F.col(f"typed.{n}").alias(n) for n in schema.fieldNames()])
    rejects = both.where("why IS NOT NULL").select(
        *[F.col("came").getField(c).alias(c) for c in text.columns], F.col("why").alias("Reason"))
    return rows, rejects
