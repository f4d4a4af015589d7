"""Rule-checked writes as batch table operators.

The reference applies one row per call; here a DataFrame of requests is
applied to a base table and a new snapshot DataFrame is returned (write it
to a new path; never over the input being read). Requests carry ``seq``:
for updates the highest ``seq`` per key wins (``max_by``, a partial
aggregate, so a hot key collapses map-side), and the value is replaced on
a *matched flag*, not ``coalesce``, so an explicit NULL is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.metrics import ratio
from ..functions.money import from_cents, share_of, spend_so_far
from ..schema import AD, CAMPAIGN, CAMPAIGN_PRODUCT, conform
from ..tables import Tables
from .admission import admit_ads, checkpointed
from .checks import require_columns
from .ids import assign_ids


def latest_per_key(requests: DataFrame, keys: list[str], values: list[str], seq: str = "seq") -> DataFrame:
    """One row per key holding the values of the highest ``seq``. A request
    without ``seq`` has no place in the order and changes nothing; of requests
    with one ``seq`` the greatest values win."""
    packed = F.max_by(F.struct(*[F.col(v) for v in values]),
                      F.struct(F.col(seq).alias("_seq"), *[F.col(v) for v in values])).alias("_v")
    return requests.where(F.col(seq).isNotNull()).groupBy(*keys).agg(packed).select(
        *keys, *[F.col(f"_v.{v}").alias(v) for v in values], F.lit(True).alias("_matched"))


def _apply_updates(base: DataFrame, upd: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    renamed = upd.select(*keys, *[F.col(v).alias(f"_new_{v}") for v in values], "_matched")
    j = base.join(renamed, keys, "left")
    cols = []
    for c in base.columns:
        if c in values:
            cols.append(F.when(F.col("_matched"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return j.select(*cols, F.coalesce("_matched", F.lit(False)).alias("_touched"))


# --- W8 / W1: campaign creation --------------------------------------------

def create_campaigns(t: Tables, requests: DataFrame) -> DataFrame:
    """Append new campaigns with fresh ids and ``CurrentBudget = 0``.

    No check that start <= end or that the platform exists (as in the
    reference). Returns the new campaign snapshot.
    """
    require_columns(requests, ["seq", "PlatformID", "StartDate", "EndDate", "Budget", "Objective"],
                    "create_campaigns requests")
    new = assign_ids(t.campaign.select("CampaignID"), requests, "CampaignID")
    new = new.withColumn("CurrentBudget", F.lit(0))
    return t.campaign.unionByName(conform(new, CAMPAIGN))


# --- W2 ---------------------------------------------------------------------

def update_budgets(t: Tables, requests: DataFrame) -> DataFrame:
    """Overwrite budgets (may go below spend); unknown ids are a silent no-op."""
    require_columns(requests, ["seq", "CampaignID", "Budget"], "update_budgets requests")
    upd = latest_per_key(requests, ["CampaignID"], ["Budget"])
    return conform(_apply_updates(t.campaign, upd, ["CampaignID"], ["Budget"]), CAMPAIGN)


# --- W5 / W4: ad metrics -----------------------------------------------------

def respread(rollup: DataFrame) -> DataFrame:
    """A rollup dealt out anew before it joins its facts. AQE splits a hot key
    of a sort-merge join only where both sides come straight from a shuffle;
    an aggregate that sits on its own shuffle would keep the key in one task.
    The rollup is small, and a rebalance lets AQE choose how few tasks deal it."""
    return rollup.hint("rebalance")


def _campaign_shares(ad: DataFrame, orders: DataFrame) -> DataFrame:
    """Per campaign with clicks: clicks, orders, revenue cents, and what floor shares
    leave over with the ad that gets it. Ads and orders are rolled up together to (campaign, clicks) first, since ads
    of equal clicks have equal shares; totals and floors both come from that rollup."""
    counters = ad.where(F.col("Clicks") > 0).select(
        "CampaignID", "Clicks", F.lit(1).alias("_ads"), "AdID", F.lit(0).alias("_orders"), F.lit(None).cast("decimal(12,2)").alias("_amount"))
    sales = orders.where(F.col("CampaignID").isNotNull()).select(
        "CampaignID", F.lit(0).cast(ad.schema["Clicks"].dataType).alias("Clicks"), F.lit(0).alias("_ads"),
        F.lit(None).cast(ad.schema["AdID"].dataType).alias("AdID"), F.lit(1).alias("_orders"), F.col("TotalAmount").alias("_amount"))
    rolled = counters.unionByName(sales).groupBy("CampaignID", "Clicks").agg(
        F.sum("_ads").alias("_ads"), F.min("AdID").alias("_ad"), F.sum("_orders").alias("_orders"),
        (F.coalesce(F.sum("_amount"), F.lit(0)) * F.lit(100)).cast("decimal(38,0)").alias("_cents"))
    totals = rolled.groupBy("CampaignID").agg(
        F.sum(F.col("Clicks") * F.col("_ads")).alias("_camp_clicks"), F.max_by("_ad", "Clicks").alias("_top_ad"),
        F.sum("_orders").alias("_camp_orders"), F.sum("_cents").cast("decimal(38,0)").alias("_rev_cents"))
    floors = F.sum(F.col("_ads") * share_of("_rev_cents", "Clicks", "_camp_clicks"))
    return rolled.where(F.col("Clicks") > 0).select("CampaignID", "Clicks", "_ads").join(totals, "CampaignID") \
        .groupBy("CampaignID").agg(
            *[F.first(c).alias(c) for c in ("_camp_clicks", "_top_ad", "_camp_orders", "_rev_cents")],
            (F.first("_rev_cents") - floors).cast("bigint").alias("_left_over"))


_RECALCULATED = ("AttributedRevenue", "ConversionRate")


def _ad_values(ad: DataFrame, shares: DataFrame, keep: str | None = None) -> DataFrame:
    """Ads with the recalculated AttributedRevenue and ConversionRate; the old ones go into the struct ``keep``."""
    if keep:
        ad = ad.withColumn(keep, F.struct(*_RECALCULATED))
    j = ad.join(respread(shares), "CampaignID", "left")
    has_clicks = F.coalesce(F.col("_camp_clicks"), F.lit(0)) > 0
    share = share_of(F.coalesce("_rev_cents", F.lit(0)), F.coalesce("Clicks", F.lit(0)), "_camp_clicks")
    share = share + F.when(F.col("AdID") == F.col("_top_ad"), F.col("_left_over")).otherwise(F.lit(0))
    revenue = F.when(has_clicks, from_cents(share, 18)).otherwise(F.lit(0))
    conv = F.when(has_clicks & (F.col("Clicks") > 0),
                  ratio(F.coalesce("_camp_orders", F.lit(0)), "_camp_clicks")).otherwise(F.lit(0.0))
    return j.withColumn("AttributedRevenue", revenue).withColumn("ConversionRate", conv)


#: Ads of a batch up to which it goes to the ads as a broadcast (some 40 bytes each).
BATCH_BROADCAST = 1_000_000


def _recalculated(t: Tables, ad: DataFrame, batch: DataFrame) -> DataFrame:
    """Ads with ``batch`` (AdID, ``_matched`` and new counters) applied and its ads recalculated.

    A batch of up to ``BATCH_BROADCAST`` ads, as counted, meets the ads by broadcast joins: ads and orders of other
    campaigns end at one semi join each, and the snapshot crosses no exchange. A larger batch
    touches most campaigns: all are aggregated, and the values of other ads are kept."""
    batch = checkpointed(batch)
    values = [c for c in batch.columns if c not in ("AdID", "_matched")]
    if batch.count() > BATCH_BROADCAST:
        applied = _apply_updates(ad, batch, ["AdID"], values)
        new = _ad_values(applied, _campaign_shares(applied, t.orders), keep="_old")
        return conform(new.withColumns({c: F.when(F.col("_touched"), F.col(c)).otherwise(F.col(f"_old.{c}")) for c in _RECALCULATED}), AD)
    applied = _apply_updates(ad, F.broadcast(batch), ["AdID"], values)
    touched = checkpointed(applied.where("_touched").drop("_touched"))
    campaigns = F.broadcast(touched.select("CampaignID"))
    shares = _campaign_shares(applied.join(campaigns, "CampaignID", "left_semi"), t.orders.join(campaigns, "CampaignID", "left_semi"))
    changed = _ad_values(touched, shares).select("AdID", F.struct(*values, *_RECALCULATED).alias("_new"))
    j = ad.join(F.broadcast(changed), "AdID", "left")
    return conform(j.withColumns({c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c))
                                  for c in (*values, *_RECALCULATED)}), AD)


def recalc_ad_metrics(t: Tables, ad: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """Recompute ConversionRate and AttributedRevenue from current counters.

    AttributedRevenue = campaign order revenue × the ad's share of campaign
    clicks, in floor cents; the cents the floors leave over go to the ad with
    the most clicks (then the smallest AdID), so a campaign's revenue is
    attributed to the cent. ConversionRate = campaign orders × click share /
    ad clicks = campaign orders / campaign clicks. 0 when there are no clicks.
    ``only``, a DataFrame of AdIDs, restricts the recalculation: other ads keep
    their values, and only the campaigns of those ads are aggregated.

    Everything of campaign grain is joined first; ads meet it once.
    """
    ad = ad if ad is not None else t.ad
    if only is None:
        return conform(_ad_values(ad, _campaign_shares(ad, t.orders)), AD)
    return _recalculated(t, ad, only.select("AdID").distinct().withColumn("_matched", F.lit(True)))


def update_ad_metrics(t: Tables, requests: DataFrame) -> DataFrame:
    """Set (not add) Impressions and Clicks, then recalc the touched ads.

    Batch semantics: all counter updates land first, then each touched ad
    is recalculated against the post-batch counters. Only campaigns of touched ads
    are aggregated.
    """
    require_columns(requests, ["seq", "AdID", "Impressions", "Clicks"], "update_ad_metrics requests")
    return _recalculated(t, t.ad, latest_per_key(requests, ["AdID"], ["Impressions", "Clicks"]))


# --- W6 / W7 / W7a: pricing --------------------------------------------------

def selling_price(mrp: F.Column | str, discount_pct: F.Column | str) -> F.Column:
    """MRP net of a percent discount, half-up to cents, all in decimal."""
    m = F.col(mrp) if isinstance(mrp, str) else mrp
    d = F.col(discount_pct) if isinstance(discount_pct, str) else discount_pct
    return F.round(m * (F.lit(100) - d) / F.lit(100), 2).cast("decimal(12,2)")


def merged(product: DataFrame) -> DataFrame:
    """Products as the side of a sort-merge join. Of a key column Spark reckons a share of the compressed files, and
    would broadcast millions of products through the driver as a few megabytes."""
    return product.hint("merge")


def price(pairs: DataFrame, product: DataFrame) -> DataFrame:
    """Price (CampaignID, ProductID, Discount) rows against Product.MRP."""
    j = pairs.join(merged(product.select("ProductID", "MRP")), "ProductID")
    return conform(j.withColumn("SellingPrice", selling_price("MRP", "Discount")), CAMPAIGN_PRODUCT)


#: Tasks over which the different requests for one pair are dealt.
PARTS_OF_PAIR = 64


def first_and_others(valid: DataFrame, links: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Of requests (keys, ``_row``): the least of each pair, with ``_there`` where ``links`` hold the pair, and all
    others, each as often as it comes.

    Rows alike are counted first; then the least are found within parts of a pair, and among the parts' least and the
    links, in windows over sorted rows. So a pair with many requests is spread over tasks, no row meets its pair's
    least in a join, and a task sorts once."""
    # by number: partitions put together to one size as it is shuffled are six times that when sorted
    n = int(valid.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    alike = valid.groupBy(*keys, "_row").agg(F.count(F.lit(1)).alias("_n")) \
        .withColumn("_part", F.pmod(F.xxhash64("_row"), F.lit(PARTS_OF_PAIR))).repartition(n, *keys, "_part")
    placed = alike.withColumn("_place", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy("_row"))).drop("_part")
    held = links.select(*keys, F.lit(None).cast(valid.schema["_row"].dataType).alias("_row"), F.lit(0).cast("bigint").alias("_n"))
    # links have no row and sort before the requests of their pair
    so_far = Window.partitionBy(*keys).orderBy(F.col("_row").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    least = placed.where(F.col("_place") == 1).drop("_place").unionByName(held).repartition(n, *keys) \
        .withColumns({"_place": F.count("_row").over(so_far), "_there": F.max(F.col("_row").isNull()).over(so_far)}) \
        .where(F.col("_row").isNotNull())
    first = least.where(F.col("_place") == 1).select(*keys, "_row", "_there")
    others = placed.where(F.col("_place") > 1).unionByName(least.drop("_there")) \
        .withColumn("_n", F.col("_n") - F.when(F.col("_place") == 1, F.lit(1)).otherwise(F.lit(0))).where(F.col("_n") > 0)
    return first, others.withColumn("_copy", F.explode(F.expr("sequence(1L, _n)"))).select(*keys, "_row")


def price_campaign_products(t: Tables, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Insert campaign–product links with SellingPrice computed at insert.

    Returns (new snapshot: all links there were and the new ones, rejects:
    every request that made no link, with a Reason). A request needs ``seq``, a
    campaign and a discount from 0 to 100 percent. Of
    requests for one pair the lowest ``seq`` is tried (then the smallest
    discount); the others are duplicates, each of them, also where requests
    are alike in every column.

    Requests and links meet in one aggregate by pair, which yields the request
    that is tried and whether the pair was there; only that goes on to the products.
    """
    keys = ["CampaignID", "ProductID"]
    require_columns(requests, [*keys, "seq", "Discount"], "price_campaign_products requests")
    columns = requests.columns
    row = F.struct("seq", "Discount", *[F.col(c) for c in columns if c not in (*keys, "seq", "Discount")])
    invalid = F.when(F.col("seq").isNull(), F.lit("missing seq")) \
        .when(F.col("CampaignID").isNull(), F.lit("missing campaign")) \
        .when(F.col("Discount").isNull() | ~F.col("Discount").between(0, 100), F.lit("invalid discount"))
    valid = requests.where(invalid.isNull()).select(*keys, row.alias("_row"))
    links = t.campaign_product.select(*keys, F.lit(None).cast(valid.schema["_row"].dataType).alias("_row"), F.lit(True).alias("_there"))
    pairs = valid.withColumn("_there", F.lit(False)).unionByName(links).groupBy(*keys).agg(
        F.min("_row").alias("_first"), F.max("_there").alias("_there")).where(F.col("_first").isNotNull())
    product = merged(t.product.select("ProductID", "MRP", F.lit(True).alias("_known")))
    made = pairs.where(~F.col("_there")).join(product, "ProductID").withColumn("Discount", F.col("_first.Discount"))
    snapshot = t.campaign_product.unionByName(
        conform(made.withColumn("SellingPrice", selling_price("MRP", "Discount")), CAMPAIGN_PRODUCT))

    def rejected(df: DataFrame, reason) -> DataFrame:
        return df.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in columns], reason.alias("Reason"))

    first, others = first_and_others(valid, t.campaign_product, keys)
    refused = F.when(F.col("_there"), F.lit("pair already exists")).when(F.col("_known").isNull(), F.lit("unknown product"))
    tried = first.join(product.drop("MRP"), "ProductID", "left")
    rejects = requests.where(invalid.isNotNull()).select(*columns, invalid.alias("Reason")) \
        .unionByName(rejected(tried.where(refused.isNotNull()), refused)) \
        .unionByName(rejected(others, F.lit("duplicate request in batch")))
    return snapshot, rejects


def update_discounts(t: Tables, requests: DataFrame, reprice: bool = False) -> DataFrame:
    """Change discounts on the composite key. SellingPrice stays as it was
    (the insert-time rule does not fire on update) unless ``reprice``."""
    keys = ["CampaignID", "ProductID"]
    require_columns(requests, ["seq", *keys, "Discount"], "update_discounts requests")
    upd = latest_per_key(requests, keys, ["Discount"])
    out = _apply_updates(t.campaign_product, upd, keys, ["Discount"])
    if reprice:
        out = out.join(t.product.select("ProductID", "MRP"), "ProductID", "left").withColumn(
            "SellingPrice", F.when(F.col("_touched"), selling_price("MRP", "Discount"))
            .otherwise(F.col("SellingPrice")))
    return conform(out, CAMPAIGN_PRODUCT)


def stale_prices(t: Tables) -> DataFrame:
    """Rows breaking "selling price = MRP net of discount" (null-safe)."""
    j = t.campaign_product.join(t.product.select("ProductID", "MRP"), "ProductID")
    expected = selling_price("MRP", "Discount")
    return j.where(~F.col("SellingPrice").eqNullSafe(expected)).select(
        "CampaignID", "ProductID", "Discount", "SellingPrice", expected.alias("ExpectedPrice"))


# --- W9 -----------------------------------------------------------------------

def campaign_spend_ledger(t: Tables, admitted: DataFrame) -> DataFrame:
    """CurrentBudget grows by the cost of every admitted ad (NULL spend is 0)."""
    spent = admitted.groupBy("CampaignID").agg(F.sum("CostPerAd").alias("_add"))
    j = t.campaign.join(spent, "CampaignID", "left")
    return j.select(
        "CampaignID", "Budget",
        (spend_so_far() + F.coalesce("_add", F.lit(0))).cast("decimal(14,2)").alias("CurrentBudget"))


def with_spend(t: Tables, admitted: DataFrame) -> DataFrame:
    """The full campaign snapshot after W9."""
    led = campaign_spend_ledger(t, admitted).select("CampaignID", F.col("CurrentBudget").alias("_cb"))
    return conform(t.campaign.join(led, "CampaignID").withColumn("CurrentBudget", F.col("_cb")), CAMPAIGN)


# --- W3 end to end --------------------------------------------------------------

def create_ads(t: Tables, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Create ads from requests without AdID.

    Returns (new ad snapshot, rejects with Reason, new campaign snapshot).
    Admitted requests get the next AdIDs in request order, as ads whose
    ConversionRate and AttributedRevenue are 0; rejected ones use up no id.
    """
    require_columns(requests, ["seq", "CampaignID", "AdName", "Impressions", "Clicks", "CostPerAd"], "create_ads requests")
    admitted, rejected = admit_ads(requests, t.campaign)
    new = assign_ids(t.ad.select("AdID"), admitted, "AdID", ["seq", "CampaignID", "AdName"])
    new = new.withColumns({"ConversionRate": F.lit(0.0), "AttributedRevenue": F.lit(0)})
    return t.ad.unionByName(conform(new, AD)), rejected, with_spend(t, admitted)
