"""Dense, ordered ids without a single-partition window (W8's scale path).

Rows are range-partitioned on the order columns, numbered inside each
partition, and shifted by the row count of all earlier partitions. The
offset table has one row per partition — its size is bounded by the
partition count, so broadcasting it is safe at any data size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import shared_dir


def dense_index(df: DataFrame, order_cols: list[str], out: str = "index",
                partitions: int | None = None) -> DataFrame:
    """Add ``out`` = 1-based position of each row in ``order_cols`` order.

    The order columns must be unique (they are the request's ``seq``).
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Materialized once (to the shared checkpoint folder): two evaluations of
    # a range exchange may sample different bounds, and both uses must agree.
    shared_dir(spark)
    # Numbers within a sorted partition need no second exchange: the upper bits
    # of monotonically_increasing_id are the partition, the lower 33 the place.
    ranged = df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols) \
        .withColumn("_at", F.monotonically_increasing_id()).checkpoint(eager=True) \
        .withColumn("_pid", F.shiftright("_at", 33))
    local = ranged.withColumn("_rn", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return local.join(F.broadcast(offsets), "_pid") \
        .withColumn(out, (F.col("_off") + F.col("_rn")).cast("bigint")) \
        .drop("_at", "_pid", "_rn", "_off")


def next_id(existing: DataFrame, id_col: str) -> int:
    """``IFNULL(MAX(id), 0) + 1`` — one scalar, read once."""
    m = existing.agg(F.max(id_col).alias("m")).first()["m"]
    return int(m or 0) + 1


#: Settings under which the Parquet source answers MIN, MAX and COUNT from file footers.
FOOTER_CONF = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}


def footer_max(spark: SparkSession, path: str, id_col: str) -> DataFrame:
    """One row, ``m``: the largest ``id_col`` of the Parquet table at ``path``, planned from its file footers
    (``PushedAggregation``), so that no column is read however long the table is. The plan belongs to a session of
    its own, whose settings say so; the caller's are left alone."""
    own = spark.newSession()
    for k, v in FOOTER_CONF.items():
        own.conf.set(k, v)
    return own.read.parquet(path).agg(F.max(id_col).alias("m"))


def stored_next_id(spark: SparkSession, path: str, id_col: str) -> int:
    """``next_id`` of a stored table, from its footers; an empty table gives 1. A file whose footer holds no
    maximum (all its ids are NULL, or its writer left statistics out) makes Spark refuse, and then the column is read."""
    try:
        return int(footer_max(spark, path, id_col).first()["m"] or 0) + 1
    except Exception as e:  # the driver's error or the task's, by the setting both name
        if "spark.sql.parquet.aggregatePushdown" not in str(e):
            raise
    return next_id(spark.read.parquet(path), id_col)


def assign_stored_ids(path: str, requests: DataFrame, id_col: str,
                      order_cols: list[str] | None = None) -> DataFrame:
    """``assign_ids`` after the largest id of the stored table at ``path``, which is not scanned."""
    return _numbered(requests, stored_next_id(requests.sparkSession, path, id_col), id_col, order_cols)


def _numbered(requests: DataFrame, start: int, id_col: str, order_cols: list[str] | None) -> DataFrame:
    idx = dense_index(requests, order_cols or ["seq"], out="_idx")
    return idx.withColumn(id_col, (F.lit(start - 1) + F.col("_idx")).cast("bigint")).drop("_idx")


def assign_ids(existing: DataFrame, requests: DataFrame, id_col: str,
               order_cols: list[str] | None = None) -> DataFrame:
    """Give each request ``id_col`` = max(existing) + its rank in request order."""
    return _numbered(requests, next_id(existing, id_col), id_col, order_cols)
