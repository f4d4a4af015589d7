"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch_path, ship_package

#: The white space the contracts name: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"


def session(df: DataFrame) -> SparkSession:
    """The frame's session, with this package shipped to its executors."""
    spark = df.sparkSession
    ship_package(spark)
    return spark


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under the shared folder and read back: lineage
    ends there, so a lost executor costs no recomputation of what is above."""
    spark = session(df)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def without_spaces(c: Column) -> Column:
    """``c`` with every [\\x20\\x09-\\x0D] character deleted."""
    for ch in SPACES:
        c = F.replace(c, F.lit(ch), F.lit(""))
    return c


def in_pieces(batches: Iterable[pa.RecordBatch], text: str, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about ``limit`` bytes of column
    ``text`` (one longer text is a piece of its own): bounds a task's memory."""
    for b in batches:
        if b.num_rows == 0:
            continue
        i = b.schema.get_field_index(text)
        lengths = pc.fill_null(pc.binary_length(b.column(i)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for k, n in enumerate(lengths.tolist()):
            if held and held + n > limit:
                yield b.slice(start, k - start)
                start, held = k, 0
            held += n
        yield b.slice(start)
