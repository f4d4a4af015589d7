"""Listings (L1–L4) and the ten reports (R1–R10), plus parameter binding (S3).

Each report is a lazy DataFrame; sorts carry a tie-break so output order is
deterministic. ``top_ads_by_roas`` is sort + limit, planned as
TakeOrderedAndProject (per-partition top-N, no global sort).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.metrics import AVG_DIGITS, exact_mean, money_sum
from ..tables import Tables
from . import views as V
from .writes import respread


def _desc(c: str):
    return F.col(c).desc_nulls_last()


# --- listings ----------------------------------------------------------------

def list_campaigns(t: Tables) -> DataFrame:
    return t.campaign.select(
        "CampaignID", "PlatformID", "StartDate", "EndDate", "Budget", "CurrentBudget", "Objective",
    ).orderBy("CampaignID")


def campaign_performance(t: Tables) -> DataFrame:
    return V.campaign_performance_view(t).orderBy(_desc("ROIPercent"), "CampaignID")


def ad_performance(t: Tables, campaign_id: int | None = None) -> DataFrame:
    """V1, optionally for one campaign (NULL = no filter), best ROAS first."""
    v = V.ad_performance_view(t)
    if campaign_id is not None:
        v = v.where(F.col("CampaignID") == F.lit(int(campaign_id)))
    return v.orderBy(_desc("ROAS"), "AdID")


def ad_performance_bound(spark: SparkSession, t: Tables, campaign_id: int | None) -> DataFrame:
    """S3: the same listing through SQL with a bound, optional parameter."""
    V.ad_performance_view(t).createOrReplaceTempView("vw_AdPerformance")
    where = " WHERE CampaignID = :campaign" if campaign_id is not None else ""
    args = {"campaign": int(campaign_id)} if campaign_id is not None else {}
    return spark.sql(
        f"SELECT * FROM vw_AdPerformance{where} ORDER BY ROAS DESC NULLS LAST, AdID", args=args)


def campaign_products(t: Tables, campaign_id: int) -> DataFrame:
    cp = t.campaign_product.where(F.col("CampaignID") == F.lit(int(campaign_id)))
    return cp.join(t.product, "ProductID").select(
        "ProductID", "ProductName", "MRP", "Discount", "SellingPrice",
    ).orderBy("ProductName", "ProductID")


# --- R1–R5 -------------------------------------------------------------------

def region_performance(t: Tables) -> DataFrame:
    return V.region_performance_view(t).orderBy(_desc("TotalRevenue"), "RegionName")


def segment_performance(t: Tables) -> DataFrame:
    return V.segment_performance_view(t).orderBy(_desc("TotalRevenue"), "SegmentName")


def platform_performance(t: Tables) -> DataFrame:
    return V.platform_performance_view(t).orderBy(_desc("TotalRevenue"), "PlatformName")


def product_performance(t: Tables) -> DataFrame:
    return V.product_performance_view(t).orderBy(_desc("RevenueGenerated"), "ProductID")


def campaign_by_segment(t: Tables, campaign_id: int) -> DataFrame:
    """V7 for one campaign; the key filter sits below the aggregate."""
    return V.campaign_by_segment_view(t).where(F.col("CampaignID") == F.lit(int(campaign_id))) \
        .orderBy(_desc("Revenue"), "SegmentName")


# --- R6–R10 ------------------------------------------------------------------

def budget_alerts(t: Tables, threshold_pct: float) -> DataFrame:
    """Campaigns at or above a utilization threshold (NULL utilization drops out)."""
    v = V.campaign_performance_view(t)
    return v.where(F.col("BudgetUtilizationPct") >= F.lit(float(threshold_pct))).select(
        "CampaignID", "Objective", "Budget", "TotalSpend", "BudgetUtilizationPct",
    ).orderBy(_desc("BudgetUtilizationPct"), "CampaignID")


def campaigns_ending_soon(t: Tables, within_days: int, as_of: dt.date | None = None) -> DataFrame:
    """EndDate on or after ``as_of`` and at most ``within_days`` away (today = 0)."""
    today = F.lit(as_of) if as_of is not None else F.current_date()
    days_left = F.datediff(F.col("EndDate"), today)
    last = F.date_add(today, int(within_days))  # both bounds are on the column, so both reach the scan
    return t.campaign.where((F.col("EndDate") >= today) & (F.col("EndDate") <= last)).select(
        "CampaignID", "Objective", "EndDate", days_left.cast("int").alias("DaysLeft"),
    ).orderBy("DaysLeft", "CampaignID")


def top_ads_by_roas(t: Tables, n: int) -> DataFrame:
    if n < 0:
        raise ValueError("n must be >= 0")
    v = V.ad_performance_view(t).where(F.col("ROAS").isNotNull())
    return v.select("AdID", "AdName", "CampaignID", "ROAS", "CostPerAd", "AttributedRevenue") \
        .orderBy(_desc("ROAS"), "AdID").limit(int(n))


def underperforming_ads(t: Tables, factor: float = 0.5) -> DataFrame:
    """Ads whose CTR is below ``factor`` × their campaign's mean CTR.

    Written as the aggregate-then-join the reference uses rather than a
    window: the per-campaign mean is a partial aggregation (a hot campaign
    collapses map-side), and the join back is skew-split by AQE (the rollup is
    dealt out anew for that), whereas a window would put a whole hot campaign
    into one task. The mean is compared as it is and rounded only for display.
    """
    v = V.ad_performance_view(t).where(F.col("CampaignID").isNotNull())
    avg = v.groupBy("CampaignID").agg(exact_mean("CTR").alias("_mean"))
    return v.join(respread(avg), "CampaignID").where(F.col("CTR") < F.col("_mean") * F.lit(float(factor))).select(
        "AdID", "AdName", "CampaignID", "CTR", F.round("_mean", AVG_DIGITS).alias("avg_ctr"),
    ).orderBy("CTR", "AdID")


def segment_platform_affinity(t: Tables, collation: str | None = None) -> DataFrame:
    """Orders ⋈ Customer ⋈ Segment ⋈ Campaign ⋈ Platform, grouped by names.

    Dimensions meet first (campaign ⋈ platform, customer ⋈ segment), so that
    the orders cross two joins, on campaigns and on customers, and never an
    exchange on the few platforms or segments. ``collation`` (e.g.
    ``"UTF8_LCASE"``) groups names the way a case-insensitive database
    collation would; default is binary.
    """
    where = t.campaign.select("CampaignID", "PlatformID").join(t.platform, "PlatformID").drop("PlatformID")
    who = t.customer.select("CustomerID", "SegmentID").join(
        t.customer_segment.select("SegmentID", "SegmentName"), "SegmentID").drop("SegmentID")
    o = t.orders.select("OrderID", "CustomerID", "CampaignID", "TotalAmount")
    o = o.join(where, "CampaignID").join(who, "CustomerID")
    if collation:
        o = o.withColumn("SegmentName", F.collate("SegmentName", collation)) \
            .withColumn("PlatformName", F.collate("PlatformName", collation))
    return o.groupBy("SegmentName", "PlatformName").agg(
        F.count_distinct("OrderID").alias("Orders"),
        money_sum("TotalAmount").alias("Revenue"),
    ).orderBy(_desc("Revenue"), "SegmentName", "PlatformName")


# Every listing and report by name, with its parameters in call order.
REPORTS = {
    "list_campaigns": list_campaigns,
    "campaign_performance": campaign_performance,
    "ad_performance": ad_performance,                  # (campaign_id=None)
    "campaign_products": campaign_products,            # (campaign_id)
    "region_performance": region_performance,
    "segment_performance": segment_performance,
    "platform_performance": platform_performance,
    "product_performance": product_performance,
    "campaign_by_segment": campaign_by_segment,        # (campaign_id)
    "budget_alerts": budget_alerts,                    # (threshold_pct)
    "campaigns_ending_soon": campaigns_ending_soon,    # (within_days, as_of=None)
    "top_ads_by_roas": top_ads_by_roas,                # (n)
    "underperforming_ads": underperforming_ads,        # (factor=0.5)
    "segment_platform_affinity": segment_platform_affinity,
}


def run_report(t: Tables, name: str, *params) -> DataFrame:
    return REPORTS[name](t, *params)
