"""Hot keys: one customer with a third of all orders, one campaign with a third
of all ads. Results must stay whole and exact; checked against DuckDB SQL
over the same stored tables."""

from __future__ import annotations

import decimal
import tempfile

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from spendlens.operators import reports as R
from spendlens.operators import views as V
from spendlens.sources.driver import model_from_driver
from spendlens.sources.model import read_model, write_model


@pytest.fixture(scope="module")
def skewed(spark):
    t = model_from_driver(spark, SF_SMALL)
    hot_customer = F.when(F.col("OrderID") % 3 == 0, F.lit(7)).otherwise(F.col("CustomerID"))
    hot_campaign = F.when(F.col("AdID") % 3 == 0, F.lit(4)).otherwise(F.col("CampaignID"))
    t = t.with_(orders=t.orders.withColumn("CustomerID", hot_customer),
                ad=t.ad.withColumn("CampaignID", hot_campaign))
    root = tempfile.mkdtemp(prefix="spendlens-skew-")
    write_model(t, root, mode="overwrite")
    con = duckdb.connect()
    for name in ("campaign", "ad", "orders", "customer", "customer_segment", "platform", "region"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{root}/{name}/*.parquet')")
    return read_model(spark, root), con


def _rows(df):
    return sorted(tuple(float(v) if isinstance(v, decimal.Decimal) else v for v in r) for r in df)


def test_affinity_under_skew(skewed):
    t, con = skewed
    want = con.execute("""
        SELECT s.SegmentName, p.PlatformName, COUNT(DISTINCT o.OrderID), COALESCE(SUM(o.TotalAmount), 0)
        FROM orders o JOIN customer c ON c.CustomerID = o.CustomerID
        JOIN customer_segment s ON s.SegmentID = c.SegmentID
        JOIN campaign k ON k.CampaignID = o.CampaignID JOIN platform p ON p.PlatformID = k.PlatformID
        GROUP BY 1, 2""").fetchall()
    assert _rows(R.segment_platform_affinity(t).collect()) == _rows(want)


def test_underperforming_under_skew(skewed):
    t, con = skewed
    want = con.execute("""
        WITH v AS (SELECT AdID, CampaignID,
                   CASE WHEN Impressions <> 0 THEN CAST(Clicks AS DOUBLE) * 100.0 / Impressions END AS CTR
                   FROM ad WHERE CampaignID IS NOT NULL),
             a AS (SELECT CampaignID, AVG(CTR) AS m FROM v GROUP BY 1)
        SELECT v.AdID FROM v JOIN a USING (CampaignID) WHERE v.CTR < a.m * 0.5""").fetchall()
    got = [r.AdID for r in R.underperforming_ads(t).collect()]
    assert sorted(got) == sorted(r[0] for r in want)
    assert any(r.CampaignID == 4 for r in R.underperforming_ads(t).collect())


def test_region_revenue_under_skew(skewed):
    t, con = skewed
    want = con.execute("""
        SELECT r.RegionName, COUNT(*), SUM(o.TotalAmount)
        FROM orders o JOIN customer c ON c.CustomerID = o.CustomerID JOIN region r ON r.RegionID = c.RegionID
        GROUP BY 1""").fetchall()
    got = V.region_performance_view(t).select("RegionName", "TotalOrders", "TotalRevenue").collect()
    assert _rows(got) == _rows(want)


@pytest.fixture(scope="module")
def hot_ads(spark):
    """Seven tenths of 200,000 ads in one campaign, as files."""
    from spendlens.schema import MODEL, conform
    from spendlens.tables import Tables
    root = tempfile.mkdtemp(prefix="spendlens-hot-")
    i = F.col("id")
    ad = spark.range(200_000).select(
        i.alias("AdID"), F.when(i % 10 < 7, F.lit(4)).otherwise(i % 50).alias("CampaignID"),
        F.concat(F.lit("ad"), i).alias("AdName"), (i % 1000 + 1).alias("Impressions"), (i % 37).alias("Clicks"),
        F.lit(0.0).alias("ConversionRate"), F.lit(1).alias("CostPerAd"), F.lit(0).alias("AttributedRevenue"))
    orders = spark.range(1000).select(i.alias("OrderID"), i.alias("CustomerID"), (i % 50).alias("CampaignID"),
                                      F.lit(10).alias("TotalAmount"))
    conform(ad, MODEL["ad"]).repartition(16).write.mode("overwrite").parquet(f"{root}/ad")
    conform(orders, MODEL["orders"]).write.mode("overwrite").parquet(f"{root}/orders")
    return Tables(ad=spark.read.schema(MODEL["ad"]).parquet(f"{root}/ad"),
                  orders=spark.read.schema(MODEL["orders"]).parquet(f"{root}/orders"))


def _final_plan(spark, df) -> str:
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50k"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        # without its ORDER BY, whose sampling would run the plan apart
        df.write.format("noop").mode("overwrite").save()
        df.collect()
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("op", ["underperforming", "recalc", "update"])
def test_a_hot_campaign_is_split(spark, hot_ads, op):
    from spendlens.operators import writes as W
    df = {"underperforming": lambda: R.underperforming_ads(hot_ads),
          "recalc": lambda: W.recalc_ad_metrics(hot_ads).select("AdID", "AttributedRevenue", "ConversionRate"),
          "update": lambda: W.update_ad_metrics(hot_ads, hot_ads.ad.where("AdID % 5 = 0").selectExpr(
              "AdID AS seq", "AdID", "Impressions", "Clicks + 1 AS Clicks")).select("AdID", "AttributedRevenue")}[op]()
    assert "skew=true" in _final_plan(spark, df)
