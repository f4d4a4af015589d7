"""The seven metric views (V1–V7) and the view catalog.

Shape rules that matter at scale:
* Facts are aggregated to the view's grain *before* any join, so ads and
  orders never meet row-by-row (that fan-out would inflate both sums).
* Dimension joins carry no hint: Catalyst broadcasts a side only when its
  size estimate is under ``spark.sql.autoBroadcastJoinThreshold`` and AQE
  re-checks with runtime sizes; beyond that the join stays sort-merge.
  AQE's skew-join split handles a hot campaign or customer key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.metrics import ctr, cost_per_click, money_sum, roas, roi_pct, utilization_pct
from ..functions.money import from_cents, share_of, to_cents
from ..schema import MONEY_SUM
from ..tables import Tables

VIEW_NAMES = {
    "vw_AdPerformance": "ad_performance_view",
    "vw_CampaignPerformance": "campaign_performance_view",
    "vw_RegionPerformance": "region_performance_view",
    "vw_SegmentPerformance": "segment_performance_view",
    "vw_PlatformPerformance": "platform_performance_view",
    "vw_ProductPerformance": "product_performance_view",
    "vw_CampaignBySegment": "campaign_by_segment_view",
}


# --- V1 -------------------------------------------------------------------

def ad_performance_view(t: Tables) -> DataFrame:
    return t.ad.select(
        "AdID", "AdName", "CampaignID",
        ctr().alias("CTR"),
        "ConversionRate",
        cost_per_click().alias("CostPerClick"),
        roas().alias("ROAS"),
        "AttributedRevenue",
        "CostPerAd",
    )


# --- V2 -------------------------------------------------------------------

def ads_by_campaign(ad: DataFrame) -> DataFrame:
    """Ad facts rolled up to campaign grain (partial aggregation map-side)."""
    return ad.groupBy("CampaignID").agg(
        money_sum("CostPerAd").alias("TotalSpend"),
        F.count("AdID").alias("NumAds"),
        F.sum("Clicks").alias("_clicks"),
        F.sum("Impressions").alias("_impressions"),
    )


def orders_by_campaign(orders: DataFrame) -> DataFrame:
    return orders.where(F.col("CampaignID").isNotNull()).groupBy("CampaignID").agg(
        money_sum("TotalAmount").alias("ActualOrderRevenue"),
        F.count(F.lit(1)).alias("_orders"),
    )


def campaign_facts(t: Tables, ads: DataFrame | None = None, orders: DataFrame | None = None) -> DataFrame:
    """Campaign ⟕ Platform ⟕ ad rollup ⟕ order rollup, one row per campaign;
    ``ads`` and ``orders`` are rollups made elsewhere (``rollups``)."""
    c = t.campaign.join(t.platform, "PlatformID", "left")
    c = c.join(ads if ads is not None else ads_by_campaign(t.ad), "CampaignID", "left")
    c = c.join(orders if orders is not None else orders_by_campaign(t.orders), "CampaignID", "left")
    zero = F.lit(0)
    return c.select(
        "CampaignID", "PlatformID", "PlatformName", "Objective", "Budget",
        F.coalesce("TotalSpend", zero).cast(MONEY_SUM).alias("TotalSpend"),
        F.coalesce("ActualOrderRevenue", zero).cast(MONEY_SUM).alias("ActualOrderRevenue"),
        F.coalesce("NumAds", zero).cast("bigint").alias("NumAds"),
        F.coalesce("_orders", zero).cast("bigint").alias("TotalOrders"),
        F.coalesce("_clicks", zero).cast("bigint").alias("Clicks"),
        F.coalesce("_impressions", zero).cast("bigint").alias("Impressions"),
    )


def campaign_performance_view(t: Tables, facts: DataFrame | None = None) -> DataFrame:
    f = facts if facts is not None else campaign_facts(t)
    return f.select(
        "CampaignID", "Objective", "PlatformName", "Budget", "TotalSpend",
        utilization_pct("TotalSpend", "Budget").alias("BudgetUtilizationPct"),
        "ActualOrderRevenue",
        roi_pct("ActualOrderRevenue", "TotalSpend").alias("ROIPercent"),
        "NumAds",
        ctr("Clicks", "Impressions").alias("CTR"),
    )


# --- V3 / V4: revenue by a customer attribute, spend allocated -------------

def _allocated_performance(t: Tables, key: str, names: DataFrame, name_col: str) -> DataFrame:
    """Orders and revenue by a customer attribute (all orders, organic ones
    included); campaign spend allocated to it pro rata to each campaign's
    revenue there (floor cents per campaign × group, the rest to its largest
    group; organic orders carry no spend).

    The one big join is orders ⋈ customer on CustomerID (sort-merge, both
    sides shuffled once); it is reduced straight away to campaign × group
    grain, so the allocation works on small tables.
    """
    o = t.orders.select("CampaignID", "CustomerID", "TotalAmount")
    o = o.join(t.customer.select("CustomerID", key), "CustomerID")
    by_group = o.groupBy("CampaignID", key).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("TotalAmount").alias("_rev"))
    spend_c = t.ad.groupBy("CampaignID").agg(F.sum(to_cents("CostPerAd")).alias("_spend_cents"))
    return allocated(by_group, spend_c, key, names, name_col)


def allocated(by_group: DataFrame, spend_c: DataFrame, key: str, names: DataFrame, name_col: str) -> DataFrame:
    """The performance of a customer attribute from orders rolled up to (CampaignID,
    ``key``: ``_n``, ``_rev``) and spend to campaigns (``_spend_cents``)."""
    # A campaign's total revenue over its groups: the window runs over the
    # rolled-up rows (at most one per group value per campaign) and shares
    # the CampaignID exchange with the spend join below.
    by_group = by_group.withColumn("_rev_c", F.sum("_rev").over(Window.partitionBy("CampaignID")))
    g = by_group.join(spend_c, "CampaignID", "left")
    rev_cents = (F.col("_rev") * F.lit(100)).cast("decimal(38,0)")
    rev_c_cents = (F.col("_rev_c") * F.lit(100)).cast("decimal(38,0)")
    alloc = F.when(rev_c_cents > 0,
                   share_of(F.coalesce("_spend_cents", F.lit(0)), rev_cents, rev_c_cents)).otherwise(F.lit(0))
    # What the floors leave over goes to the campaign's largest share, so that
    # its spend is allocated to the cent (windows over rolled-up rows, as above).
    camp = Window.partitionBy("CampaignID")
    g = g.withColumn("_floor", alloc).withColumn("_place", F.row_number().over(
        camp.orderBy(F.col("_rev").desc(), F.col(key).asc_nulls_last())))
    left_over = F.coalesce("_spend_cents", F.lit(0)) - F.sum("_floor").over(camp)
    g = g.withColumn("_alloc_cents", F.col("_floor") + F.when(
        (F.col("_place") == 1) & (rev_c_cents > 0), left_over).otherwise(F.lit(0)))
    agg = g.groupBy(key).agg(
        F.sum("_n").cast("bigint").alias("TotalOrders"),
        money_sum("_rev").alias("TotalRevenue"),
        F.sum(F.col("_alloc_cents").cast("decimal(38,0)")).alias("_alloc"),
    )
    agg = agg.join(names, key)
    spend = from_cents("_alloc", 38).alias("TotalSpend")
    return agg.select(name_col, "TotalOrders", "TotalRevenue", spend).select(
        name_col, "TotalOrders", "TotalRevenue", "TotalSpend",
        roi_pct("TotalRevenue", "TotalSpend").alias("ROIPercent"))


def region_performance_view(t: Tables) -> DataFrame:
    return _allocated_performance(t, "RegionID", t.region.select("RegionID", "RegionName"), "RegionName")


def segment_performance_view(t: Tables) -> DataFrame:
    return _allocated_performance(
        t, "SegmentID", t.customer_segment.select("SegmentID", "SegmentName"), "SegmentName")


# --- V5 -------------------------------------------------------------------

def platform_performance_view(t: Tables, facts: DataFrame | None = None) -> DataFrame:
    """V2's campaign rollups summed by platform: spend is exact here."""
    f = (facts if facts is not None else campaign_facts(t)).where(F.col("PlatformName").isNotNull())
    agg = f.groupBy("PlatformName").agg(
        F.sum("TotalOrders").cast("bigint").alias("TotalOrders"),
        money_sum("ActualOrderRevenue").alias("TotalRevenue"),
        money_sum("TotalSpend").alias("TotalSpend"),
    )
    return agg.select("PlatformName", "TotalOrders", "TotalRevenue", "TotalSpend",
                      roi_pct("TotalRevenue", "TotalSpend").alias("ROIPercent"))


# --- V6 -------------------------------------------------------------------

def lines_by_product(lines: DataFrame) -> DataFrame:
    return lines.groupBy("ProductID").agg(
        F.sum(F.col("Price") * (F.lit(1) - F.col("Discount"))).cast("decimal(38,4)").alias("RevenueGenerated"))


def product_performance_view(t: Tables, lines: DataFrame | None = None) -> DataFrame:
    """Net line revenue per product; lines are rolled up before the product join."""
    lines = lines if lines is not None else lines_by_product(t.order_line)
    return lines.join(t.product.select("ProductID", "ProductName"), "ProductID").select(
        "ProductID", "ProductName", "RevenueGenerated")


# --- V7 -------------------------------------------------------------------

def campaign_by_segment_view(t: Tables) -> DataFrame:
    # Dimensions first: the orders cross one exchange for their joins, on a key
    # of customer grain, and never one on the few segment ids.
    who = t.customer.select("CustomerID", "SegmentID").join(t.customer_segment, "SegmentID").drop("SegmentID")
    o = t.orders.where(F.col("CampaignID").isNotNull()).join(who, "CustomerID")
    return o.groupBy("CampaignID", "SegmentName", "AgeGroup", "IncomeCategory").agg(
        F.count_distinct("OrderID").alias("Orders"),
        money_sum("TotalAmount").alias("Revenue"),
    )


# --- S2: view catalog -------------------------------------------------------

def register_views(spark: SparkSession, t: Tables) -> list[str]:
    """Register all seven views under their reference names; return the names."""
    g = globals()
    for view, fn in VIEW_NAMES.items():
        g[fn](t).createOrReplaceTempView(view)
    return list(VIEW_NAMES)


def read_view(spark: SparkSession, name: str) -> DataFrame:
    """``SELECT * FROM vw_X`` — a view scan by name."""
    return spark.table(name)
