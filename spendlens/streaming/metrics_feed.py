"""The ad metrics feed — absolute counters, last one wins (W4 on a stream).

Each micro-batch is reduced to the latest counters per AdID and appended
to a delta folder keyed by epoch (overwriting that epoch's folder, so a
replayed batch is idempotent). The current ad table is merge-on-read: base
⟕ latest counters per AdID (by the feed's day, then arrival), then the
touched ads are recalculated (W5). A
batch costs work in proportion to the batch, never to the ad table.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators.writes import latest_per_key, update_ad_metrics
from ..tables import Tables

FEED = StructType([
    StructField("seq", LongType()),
    StructField("AdID", LongType()),
    StructField("Impressions", LongType()),
    StructField("Clicks", LongType()),
])

#: A delta as read back: the feed and the folders it lies in.
DELTA = StructType([*FEED.fields, StructField("run", StringType()), StructField("epoch", LongType())])


def daily_counters(events: DataFrame) -> DataFrame:
    """Event log → daily absolute counters per ad (a daily sync feed), as a batch;
    ``counters`` does the same on a stream of events.

    ``view`` counts as an impression and ``click`` as a click; the feed row
    for (ad, day) carries the totals up to the end of that day. Events are
    aggregated to (ad, day) first, so the running total runs over at most
    one row per day of an ad, however hot the ad is.
    """
    ev = events.where(F.col("event_type").isin("view", "click")).select(
        F.col("user_id").alias("AdID"),
        F.unix_date(F.to_date("ts")).cast("bigint").alias("seq"),
        F.col("event_type"))
    daily = ev.groupBy("AdID", "seq").agg(
        F.count_if(F.col("event_type") == "view").alias("_v"),
        F.count_if(F.col("event_type") == "click").alias("_c"))
    w = Window.partitionBy("AdID").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return daily.select(
        "seq", "AdID",
        F.sum("_v").over(w).cast("bigint").alias("Impressions"),
        F.sum("_c").over(w).cast("bigint").alias("Clicks"))


def feed_run(checkpoint: str) -> str:
    """The name of a checkpoint's own delta folder."""
    return hashlib.md5(checkpoint.encode()).hexdigest()[:12]


def _sink_batch(delta_root: str, run: str):
    def write(batch: DataFrame, epoch_id: int) -> None:
        latest = latest_per_key(batch, ["AdID"], ["seq", "Impressions", "Clicks"], seq="seq").drop("_matched")
        latest.write.mode("overwrite").parquet(f"{delta_root}/run={run}/epoch={epoch_id}")
    return write


def run_feed(spark: SparkSession, source: str, delta_root: str, checkpoint: str,
             max_files_per_trigger: int | None = None) -> None:
    """Apply whatever arrived in ``source`` since the last run (availableNow).

    ``max_files_per_trigger`` bounds each micro-batch on a large backlog. The
    deltas of a checkpoint have a folder of their own, so that a stream started
    anew (whose epochs count from 0 again) overwrites nothing.
    """
    run = feed_run(checkpoint)
    reader = spark.readStream.schema(FEED)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source)
    q = (stream.writeStream.foreachBatch(_sink_batch(delta_root, run))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def merged_ads(spark: SparkSession, t: Tables, delta_root: str) -> DataFrame:
    """Merge-on-read: apply the latest counters per AdID.

    "Latest" is the feed's own order (``seq``, the day), not arrival: an
    older day's absolute counters arriving late must not overwrite a newer
    day's. Arrival (``epoch``) only breaks ties, so a re-sent day wins.
    """
    return update_ad_metrics(t, _in_order(spark.read.schema(DELTA).parquet(delta_root)))


def _in_order(deltas: DataFrame) -> DataFrame:
    req = deltas.withColumn("_order", F.struct("seq", "epoch", "run"))
    return req.select(F.col("_order").alias("seq"), "AdID", "Impressions", "Clicks")


def compact(spark: SparkSession, t: Tables, delta_root: str, snapshot_path: str) -> DataFrame:
    """Snapshot swap: write base + deltas as a new ad snapshot version.

    Write to a fresh path (never over the input being read); readers switch
    to it. The delta folders that were there at the start, and no others, are
    folded in and then removed, so that later reads don't go through the whole
    history; a batch that lands meanwhile stays.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(delta_root)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    folders = [f.getPath() for run in fs.listStatus(root) if run.isDirectory() and "run=" in run.getPath().getName()
               for f in fs.listStatus(run.getPath()) if f.getPath().getName().startswith("epoch=")]
    if folders:
        deltas = spark.read.schema(DELTA).option("basePath", delta_root).parquet(*[f.toString() for f in folders])
        merged = update_ad_metrics(t, _in_order(deltas))
    else:
        merged = t.ad
    merged.write.mode("errorifexists").parquet(snapshot_path)
    for f in folders:
        fs.delete(f, True)
    return spark.read.schema(t.ad.schema).parquet(snapshot_path)
