
from __future__ import annotations

import contextlib
import io
import tempfile

import pytest

from pyspark.sql import functions as F

from conftest import SF_SMALL
from spendlens.operators import reports as R
from spendlens.operators import views as V
from spendlens.plans.explain import summary
from spendlens.sources.driver import model_from_driver
from spendlens.sources.model import read_model, write_model


def _plan(df, mode: str = "formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode=mode)
    return buf.getvalue()


@pytest.fixture(scope="module")
def stored(spark):
    """The sf0.001 model written as parquet and read back with explicit schemas."""
    root = tempfile.mkdtemp(prefix="spendlens-model-")
    write_model(model_from_driver(spark, SF_SMALL), root, mode="overwrite")
    return read_model(spark, root)


def test_campaign_filter_reaches_the_scan(stored):
    for df in (R.ad_performance(stored, 4), R.campaign_products(stored, 4), R.campaign_by_segment(stored, 4)):
        plan = _plan(df)
        pushed = [ln for ln in plan.splitlines() if ln.startswith("PushedFilters")]
        assert any("EqualTo(CampaignID,4)" in ln for ln in pushed), plan


def test_scan_reads_only_needed_columns(stored):
    plan = _plan(R.campaigns_ending_soon(stored, 14))
    assert "ReadSchema: struct<CampaignID:bigint,EndDate:date,Objective:string>" in plan, plan


def test_top_k_is_take_ordered(stored):
    assert "TakeOrderedAndProject" in _plan(R.top_ads_by_roas(stored, 10))


def test_campaign_view_aggregates_facts_before_joining(stored):
    plan = _plan(V.campaign_performance_view(stored), "extended")
    optimized = plan.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    # ads and orders are each rolled up by CampaignID; no join sees raw rows of both
    assert optimized.count("Aggregate [CampaignID") == 2, optimized
    assert V.campaign_performance_view(stored).count() == stored.campaign.count()


def test_bucketed_model_needs_no_shuffle_for_co_located_work(spark):
    from spendlens.sources.model import read_model_tables, save_model_tables
    save_model_tables(model_from_driver(spark, SF_SMALL), "spendlens_test", buckets=4)
    t = read_model_tables(spark, "spendlens_test")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        v6 = _plan(V.product_performance_view(t))
        r9 = _plan(R.underperforming_ads(t))
        assert "SortMergeJoin" in v6 and "Exchange" not in v6, v6
        # the only exchange left is the report's ORDER BY (range partitioning)
        # beside the rollup, dealt out anew: the ads themselves are read in place
        assert "SortMergeJoin" in r9 and r9.count("hashpartitioning") == 1, r9
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert V.product_performance_view(t).count() == model_from_driver(spark, SF_SMALL).product.count()


def test_cluster_conf_sizes_partitions():
    from spendlens.session import cluster_conf
    c = cluster_conf(100 * 1024 ** 4, executors=1000, cores_per_executor=8)
    assert int(c["spark.sql.shuffle.partitions"]) == 409600      # 100 TB / 256 MB
    assert int(cluster_conf(10 ** 6, 10, 4)["spark.sql.shuffle.partitions"]) == 80   # two waves minimum


def test_no_cross_joins_or_row_udfs_in_any_operator(spark, stored):
    """Every registered batch operator: no cartesian product, no nested-loop
    join, no row-at-a-time Python UDF."""
    from spendlens.plans.registry import OPERATORS
    for key, op in OPERATORS.items():
        if key.startswith("stream_"):
            continue
        plan = _plan(op(spark, stored))
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
            assert bad not in plan, (key, bad)


def test_no_window_over_campaigns_in_fact_reports(stored):
    """R9 and L2 aggregate then join; a window partitioned by campaign would
    put a hot campaign's ads into one task."""
    for df in (R.underperforming_ads(stored), R.campaign_performance(stored), R.segment_platform_affinity(stored)):
        assert "Window" not in _plan(df)


def test_orders_cross_few_exchanges(spark, stored):
    """R10 shuffles the orders twice for its joins and V7 once, whatever the dimensions' sizes."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df, keys in ((R.segment_platform_affinity(stored), ["CampaignID", "CustomerID"]),
                         (V.campaign_by_segment_view(stored), ["CustomerID"])):
            plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
            # exchanges that carry the orders' amounts, from the scan up to the aggregate
            depth, found = [], []
            for line in plan:
                indent = len(line) - len(line.lstrip(" :+-"))
                depth = [(i, x) for i, x in depth if i < indent]
                if "Exchange hashpartitioning" in line:
                    depth.append((indent, line))
                if "TotalAmount" in line and "FileScan" in line:
                    # a join's exchange has one key, an aggregate's has all of its own
                    inner = [x.split("hashpartitioning(")[1].split(")")[0] for _, x in depth]
                    found = [k.split("#")[0] for k in inner if k.count("#") == 1]
            assert sorted(found) == keys, found
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_ending_soon_pushes_both_bounds(stored):
    import datetime as dt
    plan = _plan(R.campaigns_ending_soon(stored, 14, dt.date(2001, 7, 20)))
    assert "GreaterThanOrEqual(EndDate" in plan and "LessThanOrEqual(EndDate" in plan, plan


def test_a_metrics_batch_reads_only_its_campaigns(stored, spark):
    """Ads and orders end at a semi join with the batch's campaigns, and few exchanges are left (W5: of rollups and one of ads)."""
    from spendlens.operators import writes as W
    batch = stored.ad.where("AdID % 40 = 0").selectExpr("AdID AS seq", "AdID", "Impressions", "Clicks + 1 AS Clicks")
    df = W.update_ad_metrics(stored, batch)
    s = summary(df)
    assert s["shuffles"] <= 8 and s["windows"] == 0, s
    assert _plan(df).count("LeftSemi") >= 2
    assert summary(W.recalc_ad_metrics(stored))["shuffles"] <= 8


@pytest.mark.parametrize("bound", [10**6, 0])
def test_a_metrics_batch_equals_the_full_recalculation(stored, spark, monkeypatch, bound):
    from spendlens.operators import writes as W
    monkeypatch.setattr(W, "BATCH_BROADCAST", bound)
    batch = stored.ad.where("AdID % 7 = 0").selectExpr("AdID AS seq", "AdID", "Impressions", "Clicks * 3 + AdID % 2 AS Clicks") \
        .unionByName(stored.ad.where("AdID % 14 = 0").selectExpr("AdID + 1000000 AS seq", "AdID", "Impressions", "0L AS Clicks")) \
        .unionByName(spark.sql("SELECT 1L AS seq, -5L AS AdID, 1L AS Impressions, 1L AS Clicks"))
    last = batch.groupBy("AdID").agg(F.max_by("Clicks", "seq").alias("c"))
    after = stored.ad.join(last, "AdID", "left").withColumn("Clicks", F.coalesce("c", "Clicks")).select(stored.ad.columns)
    full = W.recalc_ad_metrics(stored, ad=after)
    want = full.join(last, "AdID", "left_semi").unionByName(stored.ad.join(last, "AdID", "left_anti"))
    got = W.update_ad_metrics(stored, batch)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    only = W.recalc_ad_metrics(stored, ad=after, only=last.select("AdID"))
    assert only.exceptAll(full.join(last, "AdID", "left_semi").unionByName(after.join(last, "AdID", "left_anti"))).count() == 0


def test_pricing_needs_few_exchanges(stored, spark):
    """One aggregate by pair, one join with the products."""
    from spendlens.operators import writes as W
    from spendlens.plans import registry as REG
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made, rejects = W.price_campaign_products(REG.present_links(stored), REG.price_requests(stored))
        assert summary(made)["shuffles"] <= 5 and summary(rejects)["shuffles"] <= 10, (summary(made), summary(rejects))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_next_id_comes_from_file_footers(spark, tmp_path):
    from spendlens.operators import ids
    path = str(tmp_path / "t")
    spark.range(5, 1000).selectExpr("id AS CampaignID", "cast(id AS string) AS text").repartition(7).write.parquet(path)
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    plan = _plan(ids.footer_max(spark, path, "CampaignID"))
    assert "PushedAggregation: [MAX(CampaignID)]" in plan, plan
    assert ids.stored_next_id(spark, path, "CampaignID") == 1000
    assert spark.conf.get("spark.sql.sources.useV1SourceList") == before
    empty = str(tmp_path / "empty")
    spark.read.parquet(path).where("CampaignID < 0").write.parquet(empty)
    assert ids.stored_next_id(spark, empty, "CampaignID") == 1


def test_next_id_of_ids_that_are_null(spark, tmp_path):
    from spendlens.operators import ids
    path = str(tmp_path / "t")
    spark.sql("SELECT * FROM VALUES (CAST(NULL AS BIGINT)), (7L), (-3L) v(CampaignID)").write.parquet(path)
    assert ids.stored_next_id(spark, path, "CampaignID") == 8
