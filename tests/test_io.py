"""Sources and sinks through real files: text lines, model snapshots, T2 compaction."""

from __future__ import annotations

import datetime as dt
import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from spendlens.operators import reports as R
from spendlens.operators import writes as W
from spendlens.operators.admission import admit_ads
from spendlens.operators.text import parse_report_lines, read_lines, report_lines, write_lines
from spendlens.plans import registry as REG
from spendlens.session import scratch_path
from spendlens.sources.driver import model_from_driver, read_driver_table
from spendlens.streaming import metrics_feed as T2


def test_text_sink_and_source_round_trip(spark):
    t = model_from_driver(spark, SF_SMALL)
    df = R.segment_platform_affinity(t)
    path = tempfile.mkdtemp(prefix="spendlens-lines-") + "/out"
    write_lines(report_lines(df), path)
    back = parse_report_lines(read_lines(spark, path))
    want = sorted(tuple(str(v) for v in r) for r in df.collect())
    assert sorted(tuple(r) for r in back.collect()) == want


def test_registered_views_answer_sql(spark):
    t = model_from_driver(spark, SF_SMALL)
    t.register(prefix="m_")
    n = spark.sql("SELECT count(*) FROM m_campaign c JOIN m_platform p USING (PlatformID)").first()[0]
    assert n == t.campaign.count()


def test_full_campaign_snapshot_after_admission(spark):
    t = REG.fresh_ledger(model_from_driver(spark, SF_SMALL))
    admitted, _ = admit_ads(REG._requests(t), t.campaign)
    snap = W.with_spend(t, admitted)
    assert snap.columns == t.campaign.columns and snap.count() == t.campaign.count()
    led = {r.CampaignID: r.CurrentBudget for r in W.campaign_spend_ledger(t, admitted).collect()}
    assert all(led[r.CampaignID] == r.CurrentBudget for r in snap.collect())


def test_metrics_feed_compaction_is_a_snapshot_swap(spark):
    t = model_from_driver(spark, SF_SMALL)
    feed = T2.daily_counters(read_driver_table(spark, SF_SMALL, "events"))
    root = scratch_path(spark, "compact")
    feed.write.parquet(f"{root}/in")
    T2.run_feed(spark, f"{root}/in", f"{root}/delta", f"{root}/chk")
    snap = T2.compact(spark, t, f"{root}/delta", f"{root}/ad_v1")
    want = W.update_ad_metrics(t, feed)
    assert snap.exceptAll(want).count() == 0 and want.exceptAll(snap).count() == 0
    assert snap.where(F.col("AdID").isNull()).count() == 0
    # the deltas folded in are gone; a later feed starts from the snapshot
    left = spark.read.schema(T2.DELTA).option("recursiveFileLookup", "true").parquet(f"{root}/delta")
    assert left.count() == 0
    again = T2.compact(spark, t.with_(ad=snap), f"{root}/delta", f"{root}/ad_v2")
    assert again.exceptAll(snap).count() == 0 and again.count() == snap.count()


def test_metrics_feed_in_bounded_batches_equals_one_batch(spark):
    t = model_from_driver(spark, SF_SMALL)
    feed = T2.daily_counters(read_driver_table(spark, SF_SMALL, "events"))
    root = scratch_path(spark, "bounded")
    feed.repartition(6).write.parquet(f"{root}/in")
    T2.run_feed(spark, f"{root}/in", f"{root}/delta", f"{root}/chk", max_files_per_trigger=2)
    got = T2.merged_ads(spark, t, f"{root}/delta")
    want = W.update_ad_metrics(t, feed)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_stream_admission_follows_arrival_order(spark):
    """Across micro-batches arrival decides (a stream cannot wait for earlier
    seqs); within one batch, seq does."""
    from conftest import D, campaign_row, make_tables
    from spendlens.streaming import admission as T1
    t = make_tables(spark, campaign=[campaign_row(1, 100)])
    schema = "seq long, AdID long, CampaignID long, CostPerAd decimal(12,2)"
    root = scratch_path(spark, "arrival")
    for rows in ([(10, 10, 1, D(60))], [(5, 5, 1, D(50)), (6, 6, 1, D(40))]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{root}/in")
        T1.run_admission(spark, f"{root}/in", spark.createDataFrame([], schema).schema, t.campaign,
                         f"{root}/out", f"{root}/chk")
    got = {r.seq: r.admitted for r in spark.read.schema(T1.DECISION).parquet(f"{root}/out").collect()}
    assert got == {10: True, 5: False, 6: True}


def test_scratch_is_released(spark):
    from spendlens.session import release_scratch
    path = scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    assert release_scratch(spark) >= 1
    assert release_scratch(spark) == 0
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path)


def test_event_counters_with_late_repeated_and_too_late_events(spark):
    """T2 as a stream: late events count for their day, repeats once, what the watermark has passed is dropped,
    and days that closed still count in what follows."""
    import tempfile

    from spendlens.streaming import counters as T2S
    from spendlens.streaming.metrics_feed import daily_counters
    root = tempfile.mkdtemp(prefix="spendlens-counters-")
    schema = "event_id long, ts timestamp, user_id long, event_type string"

    def land(rows):
        df = spark.createDataFrame([(i, dt.datetime(2024, 1, 1) + dt.timedelta(days=d, hours=h), u, k) for i, d, h, u, k in rows], schema)
        df.coalesce(1).write.mode("append").parquet(f"{root}/in")
        T2S.run_counters(spark, f"{root}/in", df.schema, f"{root}/delta", f"{root}/chk", delay="2 days")
        return df

    def now():
        return sorted((r.seq - 19723, r.AdID, r.Impressions, r.Clicks) for r in T2S.counters(spark, f"{root}/delta").collect())

    first = land([(1, 0, 1, 7, "view"), (2, 0, 2, 7, "click"), (3, 1, 0, 7, "view"), (4, 1, 3, 8, "view"), (5, 1, 3, 8, "purchase"),
                  (6, 1, 4, None, "view")])
    assert now() == [(0, 7, 1, 1), (1, 7, 2, 1), (1, 8, 1, 0)]
    late = land([(1, 0, 1, 7, "view"), (7, 0, 5, 7, "view"), (8, 2, 1, 7, "click"), (8, 2, 1, 7, "click")])   # a repeat, a late one, twice in a batch
    assert now() == [(0, 7, 2, 1), (1, 7, 3, 1), (1, 8, 1, 0), (2, 7, 3, 2)]
    far = land([(9, 9, 0, 7, "view"), (10, 9, 0, 8, "click")])
    land([(11, 9, 1, 8, "click")])                                          # a batch for the watermark to pass the first days
    land([(12, 0, 6, 7, "view"), (13, 9, 2, 7, "view")])                    # 12 is beyond the delay
    assert now() == [(0, 7, 2, 1), (1, 7, 3, 1), (1, 8, 1, 0), (2, 7, 3, 2), (9, 7, 5, 2), (9, 8, 1, 2)]
    more = spark.createDataFrame([(11, dt.datetime(2024, 1, 10, 1), 8, "click"), (13, dt.datetime(2024, 1, 10, 2), 7, "view")], schema)
    events = first.unionByName(late).unionByName(far).unionByName(more).dropDuplicates(["event_id"]).where("user_id IS NOT NULL")
    assert now() == sorted((r.seq - 19723, r.AdID, r.Impressions, r.Clicks) for r in daily_counters(events).collect())


def test_rollups_add_up_with_repeated_orders_and_days(spark, tmp_path):
    """Order identifiers that repeat across days count once; a day added again replaces itself;
    organic orders and unknown customers count where the views count them."""
    from conftest import D, ad_row, campaign_row, make_tables
    from spendlens.operators import views as V
    from spendlens.operators.rollups import Rollups
    dims = dict(campaign=[campaign_row(1, 100), campaign_row(2, 50, platform=2), campaign_row(3, 10)],
                platform=[(1, "P1"), (2, "P2")], region=[(1, "R1"), (2, "R2")],
                customer_segment=[(1, "S1", "young", "low"), (2, "S2", None, "high")],
                customer=[(1, 1, 1), (2, 2, 2), (3, 1, 2), (4, None, None)], product=[(1, "a", D(5)), (2, "b", D(7))])
    orders = [[(10, 1, 1, D(5)), (11, 2, 2, D("7.10")), (12, 3, None, D(9))],
              [(10, 1, 1, D(5)), (40000, 1, 1, D(3)), (13, 99, 1, D(1)), (14, 4, 2, D(2)), (-5, 2, 1, None)],
              [(40000, 3, 2, D(4)), (11, 2, 2, D(8))]]
    ads = [[ad_row(1, 1), ad_row(2, 2, cost=7)], [ad_row(3, 1, clicks=0, cost=3)], []]
    lines = [[(10, 1, D(5), D("0.10"))], [(11, 2, D(7), D(0)), (10, 1, D(5), D("0.05"))], []]
    rolled = Rollups(spark, str(tmp_path))
    for k in (0, 1, 2, 1):                     # the second day is sent again
        rolled.add(f"d{k}", make_tables(spark, **dims, orders=orders[k], ad=ads[k], order_line=lines[k]))
    t = make_tables(spark, **dims, orders=sum(orders, []), ad=sum(ads, []), order_line=sum(lines, []))
    for got, want in [(rolled.campaign_performance(t), V.campaign_performance_view(t)), (rolled.platform_performance(t), V.platform_performance_view(t)),
                      (rolled.region_performance(t), V.region_performance_view(t)), (rolled.segment_performance(t), V.segment_performance_view(t)),
                      (rolled.product_performance(t), V.product_performance_view(t)), (rolled.campaign_by_segment(t), V.campaign_by_segment_view(t)),
                      (rolled.segment_platform_affinity(t), R.segment_platform_affinity(t))]:
        assert got.schema.names == want.schema.names
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) != []


def test_rollup_keeps_a_word_an_order_at_most(spark, tmp_path):
    """Orders thinly spread over identifiers (below zero and at the ends of words too) take one number each, not a bitmap of a range."""
    from conftest import D, campaign_row, make_tables
    from spendlens.operators import views as V
    from spendlens.operators.rollups import Rollups
    ids = [k * 40_000 for k in range(-60, 60)] + [63, 64, 65, 127, -1, -64, -65]
    t = make_tables(spark, campaign=[campaign_row(c, 10) for c in range(5)], platform=[(1, "P")], customer=[(1, 1, 1), (2, 2, 1)],
                    customer_segment=[(1, "S1", "young", "low"), (2, "S2", None, "high")],
                    orders=[(i, 1 + i % 2, i % 5, D(1)) for i in ids + ids[::3]])
    rolled = Rollups(spark, str(tmp_path))
    rolled.add("d0", t)
    stored = rolled.read("order_ids")
    assert dict(stored.dtypes)["bits"] == "bigint" and stored.count() <= len(ids)
    assert sorted(map(str, rolled.campaign_by_segment(t).collect())) == sorted(map(str, V.campaign_by_segment_view(t).collect()))
    assert sum(r.Orders for r in rolled.segment_platform_affinity(t).collect()) == len(ids)


def test_counters_read_and_write_state_once_a_batch():
    """A batch with 10 days of 20 ads asks for their state once, however many days are open; a timer closes them when no more come."""
    import pandas as pd
    from spendlens.streaming.counters import CLOSES_AFTER, DAY_MS, RunningCounters

    class State:
        kept, calls = None, 0

        def get(self):
            self.calls += 1
            return self.kept

        def update(self, value):
            self.calls, self.kept = self.calls + 1, value

    class Handle:
        def __init__(self):
            self.state, self.timers = State(), []

        def getValueState(self, name, schema):
            return self.state

        def registerTimer(self, at):
            self.timers.append(at)

    class At:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

        getExpiryTimeInMs = getCurrentWatermarkInMs

    counters, handle = RunningCounters(), Handle()
    counters.init(handle)
    first = pd.DataFrame([(64 + ad, day, day % 2 == 0) for ad in range(20) for day in range(100, 110)], columns=["AdID", "seq", "view"])
    out = pd.concat(counters.handleInputRows((2,), iter([first[::2], first[1::2]]), At(0)))
    assert handle.state.calls == 2 and handle.timers == [(109 + CLOSES_AFTER) * DAY_MS]
    assert len(out) == 200 and out[out.AdID == 70].sort_values("seq").iloc[-1].tolist() == [109, 70, 5, 5]
    late = pd.DataFrame([(70, 108, True)], columns=["AdID", "seq", "view"])
    out = pd.concat(counters.handleInputRows((2,), iter([late]), At(107 * DAY_MS)))
    assert out.values.tolist() == [[108, 70, 6, 4], [109, 70, 6, 5]]
    assert handle.state.calls == 4 and len(handle.timers) == 1 and min(handle.state.kept[6]) == 106
    untimed = pd.DataFrame([(71, None, True)], columns=["AdID", "seq", "view"])   # counts in all open days of its ad
    out = pd.concat(counters.handleInputRows((2,), iter([untimed.astype({"seq": float})]), At(107 * DAY_MS)))
    assert out.values.tolist() == [[106, 71, 5, 3], [107, 71, 5, 4], [108, 71, 6, 4], [109, 71, 6, 5]]
    list(counters.handleExpiredTimer((2,), At(0), At(handle.timers[0])))
    assert handle.state.kept[5] == [] and len(handle.timers) == 1
    out = pd.concat(counters.handleInputRows((2,), iter([pd.DataFrame([(70, 120, False)], columns=["AdID", "seq", "view"])]), At(119 * DAY_MS)))
    assert out.values.tolist() == [[120, 70, 6, 6]] and len(handle.timers) == 2
