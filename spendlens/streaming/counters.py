"""T2's feed as a stream: the event log to daily absolute counters per ad.

Events are deduplicated by identifier and counted by the day of their own
time. State per ad is a running total of closed days and one entry for each day
that the watermark has not closed; ``ADS`` ads in a row share one value. A batch that changes a day sends that day's and all later
open days' counters again: the feed is absolute and the last one wins
(``metrics_feed``), so readers need no corrections.

* A late event within ``delay`` counts for its own day and all after it.
* An event later than that is dropped by the watermark.
* An event without a time counts in all open days' counters and all later ones'.
* A repeated event (same ``event_id``, within ``delay``) counts once.
* A day closes when the watermark is a day past its end: its entry is folded into the
  total, at the next batch or by a timer, so state per ad is bounded by the days within ``delay``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..session import ship_package
from .admission import rocksdb_state_store
from .metrics_feed import DELTA, FEED, feed_run

DAY_MS = 86_400_000
#: Days from a day's start (UTC) to its closing: one more than the day itself, for session time zones behind UTC.
CLOSES_AFTER = 2
#: Ads whose state is one value (a power of 2): each state value costs calls between Spark and Python, whatever it holds.
ADS = 32
#: Before all days: the day of events without a time, and the last closed day when none is.
NO_DAY = -(1 << 40)

Counts = dict[Any, tuple[int, int]]


class RunningCounters(StatefulProcessor):
    """Running views and clicks of ``ADS`` ads in a row, in one value, so that a batch reads and
    writes their state once, however many of them and of their open days it has.

    A batch with events of these ads closes the days that the watermark has passed; a timer,
    one at a time, does so when no more come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("counters", "through long, timer long, ad array<long>, views array<long>, clicks array<long>, "
                                          "open_ad array<long>, open_day array<long>, open_views array<long>, open_clicks array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        changed: Counts = {}
        for pdf in rows:
            days = pdf["seq"].fillna(NO_DAY).to_numpy(np.int64)
            place, at = np.unique(days * ADS + pdf["AdID"].to_numpy(np.int64) % ADS, return_inverse=True)
            views = np.bincount(at, weights=pdf["view"].to_numpy(np.int64), minlength=place.size).astype(np.int64)
            clicks = np.bincount(at, minlength=place.size) - views
            for p, v, c in zip(place.tolist(), views.tolist(), clicks.tolist()):
                _count(changed, (p % ADS, p // ADS), v, c)
        if not changed:
            return
        through, timer, closed, opened = self._read()
        first: dict[int, int] = {}
        for (ad, day), (v, c) in changed.items():
            first[ad] = min(day, first.get(ad, day))
            if day <= through:
                _count(closed, ad, v, c)
            else:
                _count(opened, (ad, day), v, c)
        running, out = dict(closed), []
        for (ad, day), (v, c) in sorted(opened.items()):
            _count(running, ad, v, c)
            if ad in first and day >= first[ad]:
                out.append((day, int(key[0]) * ADS + ad, *running[ad]))
        self._write(through, timer, closed, opened, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame(out, columns=FEED.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        through, _, closed, opened = self._read()
        self._write(through, 0, closed, opened, expiredTimerInfo.getExpiryTimeInMs())
        return iter(())

    def _read(self) -> tuple[int, int, Counts, Counts]:
        """The last closed day, the pending timer (0: none), totals of closed days by ad, counts of open days by ad and day."""
        kept = self.state.get()
        if kept is None:
            return NO_DAY, 0, {}, {}
        through, timer, ad, views, clicks, open_ad, open_day, open_views, open_clicks = kept
        return through, timer, dict(zip(ad, zip(views, clicks))), dict(zip(zip(open_ad, open_day), zip(open_views, open_clicks)))

    def _write(self, through: int, timer: int, closed: Counts, opened: Counts, watermark: int) -> None:
        """Keep the state with the days that ``watermark`` closes folded into the totals; days left
        open have a timer at the closing of the last of them as it stands."""
        last = watermark // DAY_MS - CLOSES_AFTER
        for ad, day in [k for k in opened if k[1] <= last]:
            through = max(through, day)
            _count(closed, ad, *opened.pop((ad, day)))
        if opened and not timer:
            timer = (max(day for _, day in opened) + CLOSES_AFTER) * DAY_MS
            self.handle.registerTimer(timer)
        columns = [[k for k in closed], *_columns(closed.values()), *_columns(opened), *_columns(opened.values())]
        self.state.update((through, timer, *columns))

    def close(self) -> None:
        pass


def _count(counts: Counts, key, views: int, clicks: int) -> None:
    before = counts.get(key, (0, 0))
    counts[key] = (before[0] + views, before[1] + clicks)


def _columns(pairs) -> tuple[list[int], list[int]]:
    pairs = list(pairs)
    return [a for a, _ in pairs], [b for _, b in pairs]


def counters_stream(events: DataFrame, delay: str) -> DataFrame:
    """FEED rows of a stream of (event_id, ts, user_id, event_type); other types than view and click and events without an ad are no counters."""
    counted = events.where(F.col("event_type").isin("view", "click") & F.col("user_id").isNotNull()) \
        .withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"]) \
        .select(F.col("user_id").alias("AdID"), "ts", F.unix_date(F.to_date("ts")).cast("bigint").alias("seq"),
                (F.col("event_type") == "view").alias("view"), F.shiftright("user_id", ADS.bit_length() - 1).alias("_ads"))
    return counted.groupBy("_ads").transformWithStateInPandas(RunningCounters(), FEED, "Append", "EventTime")


def run_counters(spark: SparkSession, source: str, schema: StructType, delta_root: str, checkpoint: str, delay: str = "1 day",
                 max_files_per_trigger: int | None = None) -> None:
    """Count whatever events arrived in ``source`` since the last run (availableNow)
    into deltas under ``delta_root``, where ``metrics_feed.merged_ads`` and ``counters`` find them."""
    ship_package(spark)
    run = feed_run(checkpoint)
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)

    def write(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{delta_root}/run={run}/epoch={epoch_id}")

    with rocksdb_state_store(spark):
        q = (counters_stream(reader.parquet(source), delay).writeStream.foreachBatch(write).outputMode("append")
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        q.awaitTermination()


def counters(spark: SparkSession, delta_root: str) -> DataFrame:
    """The feed as it stands: of each ad and day the counters sent last."""
    last = F.max_by(F.struct("Impressions", "Clicks"), F.struct("epoch", "run")).alias("c")
    return spark.read.schema(DELTA).parquet(delta_root).groupBy("seq", "AdID").agg(last) \
        .select("seq", "AdID", "c.Impressions", "c.Clicks")
