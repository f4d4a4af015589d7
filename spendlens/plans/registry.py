"""Every implemented operator as a query over the driver's tables.

Each entry takes (spark, sf_dir) and returns a DataFrame. Report parameters
(README, "Decisions"); both are mirrored in ``plans/oracle.py``.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DateType, DecimalType, LongType, StringType, StructField, StructType

from ..functions.money import from_cents, intdiv, to_cents
from ..operators import reports as R
from ..operators import views as V
from ..operators import writes as W
from ..operators.admission import admit_ads
from ..operators.digest import digest_match
from ..operators.ids import assign_ids, assign_stored_ids
from ..operators.requests import typed_requests
from ..operators.text import (REPORT_FORMATS, formatted_lines, parse_report_lines, parse_stored_lines, read_lines,
                              report_lines, write_lines, write_ordered_lines)
from ..schema import CAMPAIGN_PRODUCT
from ..session import scratch_path
from ..sources.model import read_table
from ..sources.driver import AS_OF, ad_requests, model_from_driver, read_driver_table
from ..operators.rollups import Rollups
from ..streaming import admission as T1
from ..streaming import counters as T2S
from ..streaming import metrics_feed as T2

CAMPAIGN = 4
THRESHOLD_PCT = 85.0
WITHIN_DAYS = 14
TOP_N = 10
FACTOR = 0.5
UNKNOWN_OFFSET = 10**12


# --- request sets: business rules over the tables, so every row flows through ---

def campaign_requests(t) -> DataFrame:
    """Bulk clone: every campaign re-issued as a new campaign (seq = its id)."""
    return t.campaign.select(
        F.col("CampaignID").alias("seq"), "PlatformID", "StartDate", "EndDate", "Budget", "Objective")


def budget_requests(t) -> DataFrame:
    """Every overspent campaign (spend > budget): budget := spend, then
    := 110% of spend (the later request wins); plus a request for an unknown
    id per campaign (a silent no-op)."""
    c = t.campaign.where(F.col("CurrentBudget") > F.col("Budget"))
    first = c.select("CampaignID", (F.col("CampaignID") * 2).alias("seq"),
                     F.col("CurrentBudget").cast("decimal(14,2)").alias("Budget"))
    second = c.select("CampaignID", (F.col("CampaignID") * 2 + 1).alias("seq"),
                      F.round(F.col("CurrentBudget") * F.lit(Decimal("1.1")), 2).cast("decimal(14,2)").alias("Budget"))
    unknown = c.select((F.col("CampaignID") + F.lit(UNKNOWN_OFFSET)).alias("CampaignID"),
                       F.lit(0).cast("bigint").alias("seq"), "Budget")
    return first.unionByName(second).unionByName(unknown)


def ad_metric_requests(t) -> DataFrame:
    """A sync carrying new absolute counters (doubled) for every ad with clicks."""
    return t.ad.where(F.col("Clicks") > 0).select(
        F.col("AdID").alias("seq"), "AdID",
        (F.col("Impressions") * 2).alias("Impressions"), (F.col("Clicks") * 2).alias("Clicks"))


def discount_requests(t) -> DataFrame:
    """Every campaign product without a discount gets 5%."""
    return t.campaign_product.where(F.col("Discount") == 0).select(
        F.lit(1).cast("bigint").alias("seq"), "CampaignID", "ProductID",
        F.lit(Decimal("5.00")).cast("decimal(5,2)").alias("Discount"))


def digest_candidates(spark: SparkSession, sf: str) -> DataFrame:
    c = read_driver_table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("CustomerID"), F.col("c_name").alias("Username"),
                    F.col("c_name").alias("Password"))


# --- operators over a model bundle ---------------------------------------------
# Each takes (spark, tables); the registered queries below feed them the model
# mapped from the driver's tables, and PLANS.md feeds them a stored model.
# Reports and listings keep their ORDER BY; writes return unordered snapshots
# (sorting a whole table snapshot would be a global sort for nothing).

def fresh_ledger(t):
    """The bundle at the start of an admission run: nothing spent yet."""
    return t.with_(campaign=t.campaign.withColumn("CurrentBudget", F.lit(0).cast("decimal(14,2)")))


def _requests(t) -> DataFrame:
    return ad_requests(t).select("seq", "AdID", "CampaignID", "CostPerAd")


def view_catalog_read(spark, t):
    V.register_views(spark, t)
    return V.read_view(spark, "vw_CampaignPerformance").orderBy("CampaignID")


def admitted_ads(spark, t):
    t = fresh_ledger(t)
    return admit_ads(_requests(t), t.campaign, materialize=False)[0]


def rejected_ads(spark, t):
    t = fresh_ledger(t)
    return admit_ads(_requests(t), t.campaign, materialize=False)[1]


def spend_ledger(spark, t):
    t = fresh_ledger(t)
    return W.campaign_spend_ledger(t, admit_ads(_requests(t), t.campaign, materialize=False)[0])


def new_campaign_ids(spark, t):
    return assign_ids(t.campaign.select("CampaignID"), campaign_requests(t), "CampaignID") \
        .select("seq", "CampaignID")


def new_ids_after_stored(spark, t):
    """W8 after a stored campaign table, whose footers tell the largest id."""
    path = scratch_path(spark, "campaign-ids")
    t.campaign.select("CampaignID", "Objective").write.parquet(path)
    return assign_stored_ids(path, campaign_requests(t), "CampaignID").select("seq", "CampaignID")


def recalculated_ads(spark, t):
    return W.recalc_ad_metrics(t, ad=W.update_ad_metrics(t, ad_metric_requests(t)))


def priced_links(spark, t):
    empty = spark.createDataFrame([], CAMPAIGN_PRODUCT)
    requests = t.campaign_product.select(F.col("ProductID").alias("seq"), "CampaignID", "ProductID", "Discount")
    snapshot, _ = W.price_campaign_products(t.with_(campaign_product=empty), requests)
    return snapshot


def price_requests(t) -> DataFrame:
    """Every link requested again where its product is even, its lowest
    discount counting; where it is odd the link is new, and asked for twice.
    Every seventh product is unknown, every eleventh request has no seq."""
    p = F.col("ProductID")
    asked = t.campaign_product.select(
        F.when(p % 11 == 0, F.lit(None)).otherwise(p).cast("bigint").alias("seq"), "CampaignID",
        F.when(p % 7 == 0, p + F.lit(UNKNOWN_OFFSET)).otherwise(p).alias("ProductID"), "Discount")
    return asked.unionByName(asked.where(p % 2 == 1).withColumn("seq", F.col("seq") + 1))


def present_links(t):
    """The bundle with the links of even products only."""
    return t.with_(campaign_product=t.campaign_product.where(F.col("ProductID") % 2 == 0))


def price_rejects(spark, t):
    return W.price_campaign_products(present_links(t), price_requests(t))[1]


def created_ads(spark, t):
    """Every ad requested once more, against an empty ledger."""
    t = fresh_ledger(t)
    return W.create_ads(t, ad_requests(t).drop("AdID"))[0]


def stale_after_discounts(spark, t):
    t2 = t.with_(campaign_product=W.update_discounts(t, discount_requests(t)))
    return W.stale_prices(t2)


AFFINITY = ["SegmentName", "PlatformName", "Orders", "Revenue"]


def affinity_lines(spark, t):
    """The report's lines through a text file and back."""
    path = scratch_path(spark, "lines")
    write_lines(report_lines(R.segment_platform_affinity(t)), path)
    return read_lines(spark, path)


def parsed_lines(spark, t):
    header = " | ".join(f"{c}=" for c in AFFINITY)
    return parse_report_lines(affinity_lines(spark, t), header)


def reread_lines(spark, t):
    """The report's lines through numbered parts and back: header and order come from the files."""
    path = scratch_path(spark, "ordered-lines")
    report = R.segment_platform_affinity(t)
    order = [F.col("Revenue").desc_nulls_last(), F.col("SegmentName").asc(), F.col("PlatformName").asc()]
    write_ordered_lines(report_lines(report, keep=AFFINITY), path, order)
    return parse_stored_lines(spark, path)


REPORT_PARAMS = {"campaign_products": (CAMPAIGN,), "campaign_by_segment": (CAMPAIGN,), "budget_alerts": (THRESHOLD_PCT,),
                 "campaigns_ending_soon": (WITHIN_DAYS, AS_OF), "top_ads_by_roas": (TOP_N,),
                 "underperforming_ads": (FACTOR,)}


def all_report_lines(spark, t):
    """Every report that has a format of its own, as its lines."""
    out = None
    for name in REPORT_FORMATS:
        lines = formatted_lines(R.run_report(t, name, *REPORT_PARAMS.get(name, ())), name) \
            .select(F.lit(name).alias("report"), "line")
        out = lines if out is None else out.unionByName(lines)
    return out


def stored_campaigns(spark, t):
    """The campaign table written and read as a model table."""
    root = scratch_path(spark, "model")
    t.campaign.write.parquet(f"{root}/campaign")
    return R.list_campaigns(t.with_(campaign=read_table(spark, root, "campaign")))


CAMPAIGN_REQUEST = StructType([
    StructField("seq", LongType(), False), StructField("PlatformID", LongType(), False),
    StructField("StartDate", DateType()), StructField("EndDate", DateType()),
    StructField("Budget", DecimalType(14, 2), False), StructField("Objective", StringType())])


def request_text(t) -> DataFrame:
    """Every campaign as the text of a form: padded, some dates and amounts unreadable, some blank."""
    i = F.col("CampaignID")
    return t.campaign.select(
        i.cast("string").alias("seq"), F.concat(F.lit("  "), F.col("PlatformID").cast("string")).alias("PlatformID"),
        F.when(i % 13 == 5, F.lit("soon")).otherwise(F.col("StartDate").cast("string")).alias("StartDate"),
        F.when(i % 7 == 3, F.lit(" ")).otherwise(F.col("EndDate").cast("string")).alias("EndDate"),
        F.when(i % 17 == 4, F.lit("12,50")).when(i % 19 == 6, F.lit(""))
        .otherwise(F.concat(F.col("Budget").cast("string"), F.lit(" "))).alias("Budget"),
        "Objective")


def daily_rollups(spark, t, days: int = 3) -> Rollups:
    """Every fact rolled up, in ``days`` parts by identifier (ids grow with time)."""
    def part(df: DataFrame, key: str, k: int) -> DataFrame:
        lo, hi = df.agg(F.min(key), F.max(key)).first()
        return df.where(F.floor((F.col(key) - F.lit(lo or 0)) * days / F.lit((hi or 0) - (lo or 0) + 1)) == k)
    rolled = Rollups(spark, scratch_path(spark, "rollups"))
    for k in range(days):
        rolled.add(f"day{k}", t.with_(ad=part(t.ad, "AdID", k), orders=part(t.orders, "OrderID", k),
                                      order_line=part(t.order_line, "OrderID", k)))
    return rolled


def streamed_admissions(spark, t, chunks: int = 3):
    t = fresh_ledger(t)
    req = _requests(t)
    root = scratch_path(spark, "stream-admit")
    with T1.rocksdb_state_store(spark):
        for _ in _arrive_in_order(req, f"{root}/in", chunks):
            T1.run_admission(spark, f"{root}/in", req.schema, t.campaign, f"{root}/out", f"{root}/chk",
                             api="transformWithState")
    decisions = spark.read.schema(T1.DECISION).parquet(f"{root}/out")
    return decisions.where("admitted").select("seq", "AdID", "CampaignID", "CostPerAd")


def streamed_budget_changes(spark, t, api: str = "transformWithState"):
    """Requests in two runs. In the first, budgets are half of what they are
    in the second, and every campaign whose id ends in 7 does not exist yet."""
    req = _requests(fresh_ledger(t))
    full = fresh_ledger(t).campaign
    half = full.where(F.col("CampaignID") % 10 != 7).withColumn(
        "Budget", from_cents(intdiv(to_cents("Budget"), 2), 14))
    bound = req.agg(F.max("seq")).first()[0] or 0
    root = scratch_path(spark, "stream-budgets")
    early = F.col("seq") * 2 <= F.lit(bound)
    with T1.rocksdb_state_store(spark):
        for part, ledger in ((req.where(early), half), (req.where(~early), full)):
            part.write.mode("append").parquet(f"{root}/in")
            T1.run_admission(spark, f"{root}/in", req.schema, ledger, f"{root}/out", f"{root}/chk", api=api)
    return spark.read.schema(T1.DECISION).parquet(f"{root}/out")


OPERATORS: dict[str, Callable] = {
    # S1–S6
    "load_campaigns": stored_campaigns,
    "view_catalog": view_catalog_read,
    "ad_performance_bound": lambda s, t: R.ad_performance_bound(s, t, CAMPAIGN),
    "report_lines": affinity_lines,
    "report_lines_parse": parsed_lines,
    "report_lines_reread": reread_lines,
    "report_lines_fmt": lambda s, t: formatted_lines(R.segment_platform_affinity(t), "segment_platform_affinity"),
    "report_lines_all": all_report_lines,
    # V1–V7
    "vw_ad_performance": lambda s, t: V.ad_performance_view(t),
    "vw_campaign_performance": lambda s, t: V.campaign_performance_view(t),
    "vw_region_performance": lambda s, t: V.region_performance_view(t),
    "vw_segment_performance": lambda s, t: V.segment_performance_view(t),
    "vw_platform_performance": lambda s, t: V.platform_performance_view(t),
    "vw_product_performance": lambda s, t: V.product_performance_view(t),
    "vw_campaign_by_segment": lambda s, t: V.campaign_by_segment_view(t),
    # the views and R10 from stored daily rollups
    "rollup_campaign_performance": lambda s, t: daily_rollups(s, t).campaign_performance(t),
    "rollup_region_performance": lambda s, t: daily_rollups(s, t).region_performance(t),
    "rollup_segment_performance": lambda s, t: daily_rollups(s, t).segment_performance(t),
    "rollup_platform_performance": lambda s, t: daily_rollups(s, t).platform_performance(t),
    "rollup_product_performance": lambda s, t: daily_rollups(s, t).product_performance(t),
    "rollup_campaign_by_segment": lambda s, t: daily_rollups(s, t).campaign_by_segment(t),
    "rollup_segment_platform_affinity": lambda s, t: daily_rollups(s, t).segment_platform_affinity(t),
    # L1–L4
    "list_campaigns": lambda s, t: R.list_campaigns(t),
    "campaign_performance": lambda s, t: R.campaign_performance(t),
    "ad_performance": lambda s, t: R.ad_performance(t),
    "campaign_products": lambda s, t: R.campaign_products(t, CAMPAIGN),
    # R1–R10
    "region_performance": lambda s, t: R.region_performance(t),
    "segment_performance": lambda s, t: R.segment_performance(t),
    "platform_performance": lambda s, t: R.platform_performance(t),
    "product_performance": lambda s, t: R.product_performance(t),
    "campaign_by_segment": lambda s, t: R.campaign_by_segment(t, CAMPAIGN),
    "budget_alerts": lambda s, t: R.budget_alerts(t, THRESHOLD_PCT),
    "campaigns_ending_soon": lambda s, t: R.campaigns_ending_soon(t, WITHIN_DAYS, AS_OF),
    "top_ads_by_roas": lambda s, t: R.top_ads_by_roas(t, TOP_N),
    "underperforming_ads": lambda s, t: R.underperforming_ads(t, FACTOR),
    "segment_platform_affinity": lambda s, t: R.segment_platform_affinity(t),
    # W1–W9
    "create_campaigns": lambda s, t: W.create_campaigns(t, campaign_requests(t)),
    "assign_ids": new_campaign_ids,
    "assign_stored_ids": new_ids_after_stored,
    "typed_requests": lambda s, t: typed_requests(request_text(t), CAMPAIGN_REQUEST)[0],
    "rejected_requests": lambda s, t: typed_requests(request_text(t), CAMPAIGN_REQUEST)[1],
    "update_budgets": lambda s, t: W.update_budgets(t, budget_requests(t)),
    "admit_ads": admitted_ads,
    "rejected_ads": rejected_ads,
    "create_ads": created_ads,
    "update_ad_metrics": lambda s, t: W.update_ad_metrics(t, ad_metric_requests(t)),
    "recalc_ad_metrics": recalculated_ads,
    "price_campaign_products": priced_links,
    "price_rejects": price_rejects,
    "update_discounts": lambda s, t: W.update_discounts(t, discount_requests(t)),
    "stale_prices": stale_after_discounts,
    "campaign_spend_ledger": spend_ledger,
    # T1
    "stream_admit_ads": streamed_admissions,
    "stream_budget_changes": streamed_budget_changes,
}


# --- queries over the driver's tables ------------------------------------------

def _t(spark: SparkSession, sf: str, **kw):
    return model_from_driver(spark, sf, **kw)


def q_digest_match(spark, sf):
    t = _t(spark, sf)
    return digest_match(t.marketing_user, digest_candidates(spark, sf), keep=["CustomerID"])


def q_stream_ad_metrics(spark, sf, chunks: int = 4):
    t = _t(spark, sf)
    feed = T2.daily_counters(read_driver_table(spark, sf, "events"))
    root = scratch_path(spark, "stream-metrics")
    for _ in _arrive_in_order(feed, f"{root}/in", chunks):
        T2.run_feed(spark, f"{root}/in", f"{root}/delta", f"{root}/chk")
    return T2.merged_ads(spark, t, f"{root}/delta")


def q_stream_counters(spark, sf, chunks: int = 3):
    """The event log through the counting stream: every click comes a chunk late, every view comes twice, the second time a chunk later."""
    events = read_driver_table(spark, sf, "events")
    root = scratch_path(spark, "stream-counters")
    lo, span = events.agg(F.min(F.unix_timestamp("ts")), F.max(F.unix_timestamp("ts")) - F.min(F.unix_timestamp("ts"))).first()
    chunk = F.floor((F.unix_timestamp("ts") - F.lit(lo)) * chunks / F.lit((span or 0) + 1))
    lands = F.least(chunk + F.when(F.col("event_type") == "click", F.lit(1)).otherwise(F.lit(0)), F.lit(chunks - 1))
    placed = events.withColumn("_lands", lands)
    placed = placed.unionByName(placed.where("event_type = 'view'").withColumn("_lands", F.least(F.col("_lands") + 1, F.lit(chunks - 1))))
    for k in range(chunks):
        placed.where(F.col("_lands") == k).drop("_lands").write.mode("append").parquet(f"{root}/in")
        T2S.run_counters(spark, f"{root}/in", events.schema, f"{root}/delta", f"{root}/chk", delay=f"{2 * (span or 0) // chunks + 1} seconds")
    return T2S.counters(spark, f"{root}/delta")


def q_admit(spark, sf):
    return admitted_ads(spark, _t(spark, sf))


def q_stream_admit_ads(spark, sf):
    return streamed_admissions(spark, _t(spark, sf))


def _arrive_in_order(df: DataFrame, path: str, chunks: int):
    """Land ``df`` in ``path`` as ``chunks`` appends in ``seq`` order,
    yielding after each so the stream can catch up (arrival = seq order)."""
    bounds = df.approxQuantile("seq", [i / chunks for i in range(1, chunks)], 0.01)
    edges = [None, *sorted(set(bounds)), None]
    for lo, hi in zip(edges, edges[1:]):
        part = df
        if lo is not None:
            part = part.where(F.col("seq") > F.lit(lo))
        if hi is not None:
            part = part.where(F.col("seq") <= F.lit(hi))
        part.write.mode("append").parquet(path)
        yield


def _over_driver(op: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: op(spark, _t(spark, sf))


def present(df: DataFrame) -> DataFrame:
    """Registered-query output: money as double (computed exactly in decimal,
    converted last) and dates as ISO text — representations every client
    (pandas, Arrow, plain Python) receives identically from Spark and from
    the DuckDB oracle. The library operators themselves keep decimal and
    date types."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, DateType):
            c = c.cast("string")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def _presented(q: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: present(q(spark, sf))


RAW_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{key: _over_driver(op) for key, op in OPERATORS.items()},
    "digest_match": q_digest_match,
    "stream_ad_metrics": q_stream_ad_metrics,
    "stream_daily_counters": q_stream_counters,
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    key: _presented(q) for key, q in RAW_QUERIES.items()}
