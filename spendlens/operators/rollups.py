"""Stored rollups of V2–V7 and R10 that grow by a day at a time.

A day's facts are aggregated once and written to that day's partition; a view
adds the partitions up, so a new day costs its own facts, and a day added again replaces itself.

* ``ads``      spend, ads, clicks, impressions by campaign
* ``orders``   orders and revenue by campaign, segment and region
* ``lines``    net revenue by product
* ``order_ids``  the identifiers of orders by campaign and segment, as words of 64 bits, one for each
  64 identifiers in a row. COUNT(DISTINCT OrderID) cannot be added up over days, words can: ``bit_or`` merges them at any
  coarser grain, exactly. There are at most as many words as orders, however thinly a campaign's are spread, and each is
  a number that aggregates in place.

A customer counts with the segment and region of the day it was added; names and
platforms are looked up when a view is read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.metrics import money_sum
from ..functions.money import to_cents
from ..tables import Tables
from . import views as V

_SCHEMAS = {
    "ads": "CampaignID long, TotalSpend decimal(38,2), spend_cents long, NumAds long, clicks long, impressions long, day string",
    "orders": "CampaignID long, SegmentID long, RegionID long, known boolean, n long, revenue decimal(38,2), day string",
    "lines": "ProductID long, RevenueGenerated decimal(38,4), day string",
    "order_ids": "CampaignID long, SegmentID long, word long, bits long, day string",
}


class Rollups:
    """The rollups under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def add(self, day: str, t: Tables) -> None:
        """Roll up a day's ``ad``, ``orders`` and ``order_line`` (with ``customer`` as it
        stands) into the day's partition of each rollup; what was there goes."""
        sold = t.orders.join(t.customer.withColumn("known", F.lit(True)), "CustomerID", "left") \
            .withColumn("known", F.coalesce("known", F.lit(False)))
        rolled = {
            "ads": t.ad.groupBy("CampaignID").agg(
                money_sum("CostPerAd").alias("TotalSpend"), F.sum(to_cents("CostPerAd")).alias("spend_cents"),
                F.count("AdID").alias("NumAds"), F.sum("Clicks").alias("clicks"), F.sum("Impressions").alias("impressions")),
            "orders": sold.groupBy("CampaignID", "SegmentID", "RegionID", "known").agg(
                F.count(F.lit(1)).alias("n"), F.sum("TotalAmount").cast("decimal(38,2)").alias("revenue")),
            "lines": V.lines_by_product(t.order_line),
            "order_ids": sold.where("known AND CampaignID IS NOT NULL AND OrderID IS NOT NULL")
            .groupBy("CampaignID", "SegmentID", F.shiftright("OrderID", 6).alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, CAST(OrderID & 63 AS INT))")).alias("bits")),
        }
        for name, df in rolled.items():
            df.write.mode("overwrite").parquet(f"{self.root}/{name}/day={day}")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(_SCHEMAS[name]).parquet(f"{self.root}/{name}")

    def _facts(self, t: Tables) -> DataFrame:
        ads = self.read("ads").groupBy("CampaignID").agg(
            money_sum("TotalSpend").alias("TotalSpend"), F.sum("NumAds").alias("NumAds"),
            F.sum("clicks").alias("_clicks"), F.sum("impressions").alias("_impressions"))
        orders = self.read("orders").where(F.col("CampaignID").isNotNull()).groupBy("CampaignID").agg(
            money_sum("revenue").alias("ActualOrderRevenue"), F.sum("n").alias("_orders"))
        return V.campaign_facts(t, ads, orders)

    def campaign_performance(self, t: Tables) -> DataFrame:
        """V2."""
        return V.campaign_performance_view(t, self._facts(t))

    def platform_performance(self, t: Tables) -> DataFrame:
        """V5."""
        return V.platform_performance_view(t, self._facts(t))

    def _allocated(self, key: str, names: DataFrame, name_col: str) -> DataFrame:
        by_group = self.read("orders").where("known").groupBy("CampaignID", key).agg(
            F.sum("n").alias("_n"), F.sum("revenue").cast("decimal(38,2)").alias("_rev"))
        spend = self.read("ads").groupBy("CampaignID").agg(F.sum("spend_cents").alias("_spend_cents"))
        return V.allocated(by_group, spend, key, names, name_col)

    def region_performance(self, t: Tables) -> DataFrame:
        """V3."""
        return self._allocated("RegionID", t.region.select("RegionID", "RegionName"), "RegionName")

    def segment_performance(self, t: Tables) -> DataFrame:
        """V4."""
        return self._allocated("SegmentID", t.customer_segment.select("SegmentID", "SegmentName"), "SegmentName")

    def product_performance(self, t: Tables) -> DataFrame:
        """V6."""
        lines = self.read("lines").groupBy("ProductID").agg(F.sum("RevenueGenerated").cast("decimal(38,4)").alias("RevenueGenerated"))
        return V.product_performance_view(t, lines)

    def _distinct_orders(self, names: Callable[[DataFrame], DataFrame], keys: list[str]) -> DataFrame:
        """Distinct orders and revenue by ``keys``, which ``names`` looks up."""
        merged = names(self.read("order_ids")).groupBy(*keys, "word").agg(F.bit_or("bits").alias("bits"))
        ids = merged.select(*keys, F.bit_count("bits").cast("long").alias("Orders"), F.lit(None).cast("decimal(38,2)").alias("Revenue"))
        sold = names(self.read("orders").where("known AND CampaignID IS NOT NULL"))
        return ids.unionByName(sold.select(*keys, F.lit(0).cast("long").alias("Orders"), F.col("revenue").alias("Revenue"))) \
            .groupBy(*keys).agg(F.sum("Orders").cast("bigint").alias("Orders"), money_sum("Revenue").alias("Revenue"))

    def campaign_by_segment(self, t: Tables) -> DataFrame:
        """V7."""
        return self._distinct_orders(lambda df: df.join(t.customer_segment, "SegmentID"),
                                     ["CampaignID", "SegmentName", "AgeGroup", "IncomeCategory"])

    def segment_platform_affinity(self, t: Tables) -> DataFrame:
        """R10."""
        where = t.campaign.select("CampaignID", "PlatformID").join(t.platform, "PlatformID").drop("PlatformID")
        segments = t.customer_segment.select("SegmentID", "SegmentName")
        return self._distinct_orders(lambda df: df.join(where, "CampaignID").join(segments, "SegmentID"),
                                     ["SegmentName", "PlatformName"]).orderBy(F.desc("Revenue"), "SegmentName", "PlatformName")
