"""Hand-made edge rows (FIXTURES.md §4) with their expected results."""

from __future__ import annotations

import datetime as dt

import pytest

from conftest import D, ad_row, campaign_row, make_tables
from spendlens.operators import reports as R
from spendlens.operators import views as V
from spendlens.operators import writes as W
from spendlens.operators.admission import admission_decisions
from spendlens.operators.digest import digest_match
from spendlens.operators.ids import assign_ids
from spendlens.operators.text import parse_report_lines, report_lines


def _requests(spark, rows):
    return spark.createDataFrame(rows, "seq long, AdID long, CampaignID long, CostPerAd decimal(12,2)")


def test_admission_rejected_spend_nothing(spark):
    t = make_tables(spark, campaign=[campaign_row(1, 100)])
    req = _requests(spark, [(1, 11, 1, D(60)), (2, 12, 1, D(50)), (3, 13, 1, D(40))])
    d = {r.seq: r.admitted for r in admission_decisions(req, t.campaign).collect()}
    assert d == {1: True, 2: False, 3: True}
    led = W.campaign_spend_ledger(t, admission_decisions(req, t.campaign).where("admitted")).first()
    assert led.CurrentBudget == D("100.00")


def test_admission_exact_fit_and_zero_budget(spark):
    t = make_tables(spark, campaign=[campaign_row(1, 100, spent=40), campaign_row(2, 0)])
    req = _requests(spark, [(1, 1, 1, D(60)), (2, 2, 1, D("0.01")), (3, 3, 2, D(0)), (4, 4, 2, D("0.01")),
                            (5, 5, 9, D(1))])
    d = {r.seq: (r.admitted, r.Reason) for r in admission_decisions(req, t.campaign).collect()}
    assert d[1] == (True, None)            # exactly what is left
    assert d[2][0] is False
    assert d[3] == (True, None)            # budget 0, cost 0
    assert d[4][0] is False
    assert d[5] == (False, "Unknown campaign")


def test_admission_rejects_missing_or_negative_cost(spark):
    t = make_tables(spark, campaign=[campaign_row(1, 100)])
    req = _requests(spark, [(1, 1, 1, None), (2, 2, 1, D(-5)), (3, 3, 1, D(100)), (4, 4, 1, D(1))])
    for limit in (10**6, 0):
        d = {r.seq: (r.admitted, r.Reason) for r in
             admission_decisions(req, t.campaign, tail_group_limit=limit).collect()}
        assert d == {1: (False, "Missing or negative cost"), 2: (False, "Missing or negative cost"),
                     3: (True, None), 4: (False, "Campaign budget exceeded")}


def test_assign_ids_on_empty_table(spark):
    t = make_tables(spark)
    req = spark.createDataFrame([(5,), (3,), (9,)], "seq long")
    ids = {r.seq: r.CampaignID for r in assign_ids(t.campaign, req, "CampaignID").collect()}
    assert ids == {3: 1, 5: 2, 9: 3}


def test_unknown_keys_are_noops(spark):
    t = make_tables(spark, campaign=[campaign_row(1, 100)], ad=[ad_row(1, 1)],
                    product=[(1, "p", D("10.00"))], campaign_product=[(1, 1, D(5), D("9.50"))])
    b = W.update_budgets(t, spark.createDataFrame([(1, 99, D(5))], "seq long, CampaignID long, Budget decimal(14,2)"))
    assert [tuple(r) for r in b.collect()] == [tuple(r) for r in t.campaign.collect()]
    a = W.update_ad_metrics(t, spark.createDataFrame([(1, 99, 5, 5)], "seq long, AdID long, Impressions long, Clicks long"))
    assert a.first().Impressions == 100
    c = W.update_discounts(t, spark.createDataFrame([(1, 1, 99, D(1))], "seq long, CampaignID long, ProductID long, Discount decimal(5,2)"))
    assert c.first().Discount == D("5.00")


def test_budget_below_spend_and_explicit_null(spark):
    t = make_tables(spark, campaign=[campaign_row(1, 100), campaign_row(2, 100)],
                    ad=[ad_row(1, 1, cost=80), ad_row(2, 2, cost=10)])
    req = spark.createDataFrame([(1, 1, D(50)), (2, 2, None)], "seq long, CampaignID long, Budget decimal(14,2)")
    t2 = t.with_(campaign=W.update_budgets(t, req))
    rows = {r.CampaignID: r for r in V.campaign_performance_view(t2).collect()}
    assert rows[1].Budget == D("50.00") and rows[1].BudgetUtilizationPct == 160.0
    assert rows[2].Budget is None and rows[2].BudgetUtilizationPct is None


def test_ad_metrics_set_not_add_latest_wins(spark):
    t = make_tables(spark, campaign=[campaign_row(1, 100)], ad=[ad_row(1, 1, 100, 10), ad_row(2, 1, 100, 10)],
                    orders=[(1, 1, 1, D(300))])
    req = spark.createDataFrame([(1, 1, 500, 20), (2, 1, 700, 30)], "seq long, AdID long, Impressions long, Clicks long")
    rows = {r.AdID: r for r in W.update_ad_metrics(t, req).collect()}
    assert (rows[1].Impressions, rows[1].Clicks) == (700, 30)
    # campaign clicks after the batch: 30 + 10 = 40 → ad 1 gets 30/40 of 300
    assert rows[1].AttributedRevenue == D("225.00")
    assert rows[1].ConversionRate == 1 / 40
    assert rows[2].AttributedRevenue == D("0.00")       # untouched keeps its value


def test_selling_price_and_stale_audit(spark):
    t = make_tables(spark, product=[(1, "p", D("99.99"))])
    req = spark.createDataFrame([(1, 1, 1, D("12.5"))],
                                "seq long, CampaignID long, ProductID long, Discount decimal(5,2)")
    snap, rejects = W.price_campaign_products(t, req)
    assert snap.first().SellingPrice == D("87.49")
    assert rejects.count() == 0
    t2 = t.with_(campaign_product=snap)
    upd = spark.createDataFrame([(1, 1, 1, D(20))], "seq long, CampaignID long, ProductID long, Discount decimal(5,2)")
    t3 = t2.with_(campaign_product=W.update_discounts(t2, upd))
    row = t3.campaign_product.first()
    assert row.SellingPrice == D("87.49") and row.Discount == D("20.00")
    stale = W.stale_prices(t3).first()
    assert stale.ExpectedPrice == D("79.99")
    assert W.update_discounts(t2, upd, reprice=True).first().SellingPrice == D("79.99")


def test_price_rejects_duplicates_and_unknown_products(spark):
    t = make_tables(spark, product=[(1, "p", D(10))], campaign_product=[(1, 1, D(0), D(10))])
    req = spark.createDataFrame([(1, 1, 1, D(5)), (2, 1, 2, D(5))],
                                "seq long, CampaignID long, ProductID long, Discount decimal(5,2)")
    snap, rejects = W.price_campaign_products(t, req)
    assert snap.count() == 1
    assert sorted(r.Reason for r in rejects.collect()) == ["pair already exists", "unknown product"]


def test_price_keeps_the_base_and_accounts_for_every_request(spark):
    t = make_tables(spark, product=[(p, f"p{p}", D(10)) for p in (1, 2, 3)], campaign_product=[(1, 1, D(0), D(10))])
    req = spark.createDataFrame([
        (5, 1, 2, D(5)), (4, 1, 2, D(7)), (4, 1, 2, D(6)),         # one pair: lowest seq, then smallest discount
        (1, 2, 3, D(1)), (1, 2, 3, D(1)), (1, 2, 3, D(1)),         # alike in every column
        (None, 3, 3, D(2)), (1, 1, 1, D(9)), (2, 1, 1, D(9)), (1, 1, 99, D(0))],
        "seq long, CampaignID long, ProductID long, Discount decimal(5,2)")
    snap, rejects = W.price_campaign_products(t, req)
    links = sorted((r.CampaignID, r.ProductID, r.Discount) for r in snap.collect())
    assert links == [(1, 1, D("0.00")), (1, 2, D("6.00")), (2, 3, D("1.00"))]
    why = sorted(r.Reason for r in rejects.collect())
    assert why == sorted(["duplicate request in batch"] * 5 + ["missing seq", "pair already exists", "unknown product"])
    assert rejects.count() + snap.count() - 1 == req.count()


def test_request_without_seq_changes_nothing(spark):
    t = make_tables(spark, campaign=[campaign_row(1, 100)])
    req = spark.createDataFrame([(None, 1, D(5))], "seq long, CampaignID long, Budget decimal(14,2)")
    assert W.update_budgets(t, req).first().Budget == D("100.00")


def test_underperforming_boundary_is_strict_and_unrounded(spark):
    """CTR 33.3 and 100: the mean's half is the first one's CTR exactly, so it is not below it."""
    t = make_tables(spark, ad=[ad_row(1, 1, impressions=3, clicks=1), ad_row(2, 1, impressions=1, clicks=1)])
    assert R.underperforming_ads(t).collect() == []
    t = make_tables(spark, ad=[ad_row(1, 1, impressions=301, clicks=100), ad_row(2, 1, impressions=1, clicks=1)])
    assert [r.AdID for r in R.underperforming_ads(t).collect()] == [1]


def test_campaign_without_budget_and_spend(spark):
    """NULL budget: nothing may be spent. NULL spend: nothing is spent yet."""
    t = make_tables(spark, campaign=[campaign_row(1, 100)])
    none = t.campaign.selectExpr("CampaignID", "PlatformID", "StartDate", "EndDate",
                                 "CAST(NULL AS DECIMAL(14,2)) AS Budget", "CurrentBudget", "Objective")
    req = _requests(spark, [(1, 1, 1, D(60)), (2, 2, 1, D(0))])
    d = [(r.admitted, r.Reason) for r in admission_decisions(req, none).collect()]
    assert d == [(False, "Campaign has no budget")] * 2
    unspent = t.campaign.selectExpr("CampaignID", "PlatformID", "StartDate", "EndDate", "Budget",
                                    "CAST(NULL AS DECIMAL(14,2)) AS CurrentBudget", "Objective")
    t2 = t.with_(campaign=unspent)
    admitted = admission_decisions(req, unspent).where("admitted")
    assert admitted.count() == 2
    assert W.campaign_spend_ledger(t2, admitted).first().CurrentBudget == D("60.00")


def test_create_ads_end_to_end(spark):
    t = make_tables(spark, campaign=[campaign_row(1, 100, spent=10)], ad=[ad_row(7, 1, cost=10, revenue=5, conv=0.5)])
    req = spark.createDataFrame([(1, 1, "a", 5, 1, D(60)), (2, 1, "b", 5, 1, D(50)), (3, 1, "c", 2**60 + 1, 1, D(30)),
                                 (4, 2, "d", 0, 0, D(1))],
                                "seq long, CampaignID long, AdName string, Impressions long, Clicks long, "
                                "CostPerAd decimal(12,2)")
    ads, rejects, campaign = W.create_ads(t, req)
    got = sorted((r.AdID, r.AdName, r.Impressions, r.ConversionRate, r.AttributedRevenue) for r in ads.collect())
    assert got == [(7, "ad7", 100, 0.5, D("5.00")), (8, "a", 5, 0.0, D("0.00")), (9, "c", 2**60 + 1, 0.0, D("0.00"))]
    assert sorted((r.seq, r.Reason) for r in rejects.collect()) == [
        (2, "Campaign budget exceeded"), (4, "Unknown campaign")]
    assert campaign.first().CurrentBudget == D("100.00")


def test_ratio_guards(spark):
    t = make_tables(spark, ad=[ad_row(1, 1, impressions=0, clicks=0, cost=0)])
    r = V.ad_performance_view(t).first()
    assert r.CTR is None and r.CostPerClick is None and r.ROAS is None


def test_campaign_view_no_fanout_and_empty_campaign(spark):
    t = make_tables(
        spark, campaign=[campaign_row(1, 1000), campaign_row(2, 1000)], platform=[(1, "P")],
        ad=[ad_row(1, 1, cost=10), ad_row(2, 1, cost=20)],
        orders=[(1, 1, 1, D(100)), (2, 1, 1, D(100)), (3, 1, 1, D(100))])
    rows = {r.CampaignID: r for r in V.campaign_performance_view(t).collect()}
    assert rows[1].TotalSpend == D("30.00") and rows[1].ActualOrderRevenue == D("300.00")
    assert rows[1].NumAds == 2 and rows[1].ROIPercent == 900.0
    assert rows[2].TotalSpend == 0 and rows[2].ActualOrderRevenue == 0 and rows[2].ROIPercent is None


def test_budget_alert_threshold_edges(spark):
    t = make_tables(spark, campaign=[campaign_row(1, 100), campaign_row(2, 0)], platform=[(1, "P")],
                    ad=[ad_row(1, 1, cost=85), ad_row(2, 2, cost=5)])
    ids = [r.CampaignID for r in R.budget_alerts(t, 85.0).collect()]
    assert ids == [1]


def test_campaigns_ending_soon_boundaries(spark):
    today = dt.date(2001, 7, 20)
    t = make_tables(spark, campaign=[
        campaign_row(1, 1, end=today), campaign_row(2, 1, end=today + dt.timedelta(days=14)),
        campaign_row(3, 1, end=today + dt.timedelta(days=15)), campaign_row(4, 1, end=today - dt.timedelta(days=1)),
        campaign_row(5, 1, end=today + dt.timedelta(days=3), start=today + dt.timedelta(days=1))])
    rows = [(r.CampaignID, r.DaysLeft) for r in R.campaigns_ending_soon(t, 14, today).collect()]
    assert rows == [(1, 0), (5, 3), (2, 14)]


def test_top_ads_zero_null_and_ties(spark):
    t = make_tables(spark, ad=[ad_row(3, 1, cost=10, revenue=20), ad_row(1, 1, cost=10, revenue=20),
                               ad_row(2, 1, cost=0, revenue=5)])
    assert R.top_ads_by_roas(t, 0).count() == 0
    assert [r.AdID for r in R.top_ads_by_roas(t, 5).collect()] == [1, 3]


def test_underperforming_edges(spark):
    t = make_tables(spark, ad=[
        ad_row(1, 1, 100, 10),                                     # one ad alone: never below its own mean
        ad_row(2, 2, 100, 30), ad_row(3, 2, 100, 10), ad_row(4, 2, 100, 20),  # mean 20: ad 3 is exactly half
        ad_row(5, 3, 100, 40), ad_row(6, 3, 100, 2), ad_row(7, 3, 0, 0)])     # NULL CTR: out, not in mean
    rows = [(r.AdID, r.avg_ctr) for r in R.underperforming_ads(t).collect()]
    assert rows == [(6, 21.0)]


def test_affinity_merges_equal_names(spark):
    t = make_tables(
        spark, campaign=[campaign_row(1, 1)], platform=[(1, "P")],
        customer=[(1, 1, 0), (2, 2, 0)], customer_segment=[(1, "SAME", "a", "b"), (2, "SAME", "c", "d")],
        orders=[(1, 1, 1, D(10)), (2, 2, 1, D(5)), (3, 2, None, D(7))])
    rows = [tuple(r) for r in R.segment_platform_affinity(t).collect()]
    assert rows == [("SAME", "P", 2, D("15.00"))]


def test_report_line_parse_edges(spark):
    lines = spark.createDataFrame([("A=1 | B=x=y | plain | C=3",), ("A=2 | B=z",), ("A=3 | B=q | w | C=4 | extra",)],
                                  "line string")
    rows = [tuple(r) for r in parse_report_lines(lines).collect()]
    assert parse_report_lines(lines).columns == ["A", "B", "Col3", "C"]
    assert rows == [("1", "x=y", "plain", "3"), ("2", "z", "", ""), ("3", "q", "w", "4")]


def test_report_lines_round_trip(spark):
    df = spark.createDataFrame([("a", 1, D("2.50")), (None, 2, None)], "S string, N long, M decimal(10,2)")
    back = parse_report_lines(report_lines(df))
    assert sorted(tuple(r) for r in back.collect()) == [("a", "1", "2.50"), ("null", "2", "null")]


def test_digest_known_value_and_rules(spark):
    import hashlib
    h = hashlib.sha256(b"password").hexdigest()
    assert h == "5e884898da28047151d0e56f8dc6292773603d0d6aabbdd62a11ef721d1542d8"
    users = spark.createDataFrame([("alice", h, "MARKETING"), ("bob", h, "OTHER")],
                                  "Username string, PasswordHash string, Role string")
    cand = spark.createDataFrame([(1, "alice", "password"), (2, "alice", "nope"), (3, "bob", "password"),
                                  (4, "carol", "password")], "id long, Username string, Password string")
    got = {r.id: r.matched for r in digest_match(users, cand, keep=["id"]).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False}


def test_case_insensitive_collation_options(spark):
    t = make_tables(
        spark, campaign=[campaign_row(1, 1), campaign_row(2, 1, platform=2)],
        platform=[(1, "Web"), (2, "WEB")],
        customer=[(1, 1, 0)], customer_segment=[(1, "Retail", "a", "b")],
        orders=[(1, 1, 1, D(10)), (2, 1, 2, D(5))])
    assert R.segment_platform_affinity(t).count() == 2
    rows = R.segment_platform_affinity(t, collation="UTF8_LCASE").collect()
    assert len(rows) == 1 and rows[0].Orders == 2 and rows[0].Revenue == D("15.00")
    import hashlib
    h = hashlib.sha256(b"pw").hexdigest()
    users = spark.createDataFrame([("u", h, "marketing")], "Username string, PasswordHash string, Role string")
    cand = spark.createDataFrame([(1, "u", "pw")], "id long, Username string, Password string")
    assert digest_match(users, cand, keep=["id"]).first().matched is False
    assert digest_match(users, cand, keep=["id"], collation="UTF8_LCASE").first().matched is True


def test_price_rejects_in_batch_duplicates_first_request_wins(spark):
    t = make_tables(spark, product=[(1, "p", D("10.00"))])
    req = spark.createDataFrame([(2, 1, 1, D(10)), (1, 1, 1, D(20)), (3, 1, 1, D(30))],
                                "seq long, CampaignID long, ProductID long, Discount decimal(5,2)")
    snap, rejects = W.price_campaign_products(t, req)
    rows = snap.collect()
    assert len(rows) == 1 and rows[0].Discount == D("20.00") and rows[0].SellingPrice == D("8.00")
    assert sorted((r.seq, r.Reason) for r in rejects.collect()) == [
        (2, "duplicate request in batch"), (3, "duplicate request in batch")]


def test_parse_empty_lines_and_top_n_validation(spark):
    empty = spark.createDataFrame([], "line string")
    assert parse_report_lines(empty).count() == 0
    t = make_tables(spark)
    with pytest.raises(ValueError):
        R.top_ads_by_roas(t, -1)


def test_region_spend_allocation_by_hand(spark):
    """Spend 100.00 split over regions by revenue 1.00 : 2.00 (floor cents:
    33.33 + 66.66, the last cent to the larger share); an organic order adds revenue and
    orders to its region but no spend."""
    t = make_tables(
        spark, campaign=[campaign_row(1, 1000)], ad=[ad_row(1, 1, cost=100)],
        region=[(1, "A"), (2, "B")], customer=[(1, 1, 1), (2, 1, 2)],
        orders=[(1, 1, 1, D("1.00")), (2, 2, 1, D("2.00")), (3, 1, None, D("5.00"))])
    rows = {r.RegionName: r for r in V.region_performance_view(t).collect()}
    assert (rows["A"].TotalOrders, rows["A"].TotalRevenue, rows["A"].TotalSpend) == (2, D("6.00"), D("33.33"))
    assert (rows["B"].TotalOrders, rows["B"].TotalRevenue, rows["B"].TotalSpend) == (1, D("2.00"), D("66.67"))
    assert rows["B"].ROIPercent == (2.00 - 66.67) * 100.0 / 66.67


def test_missing_request_columns_fail_early(spark):
    t = make_tables(spark, campaign=[campaign_row(1, 100)])
    bad = spark.createDataFrame([(1, 1)], "seq long, CampaignID long")
    for call in (lambda: admission_decisions(bad, t.campaign), lambda: W.update_budgets(t, bad)):
        with pytest.raises(ValueError, match="needs column"):
            call()


def test_request_text_is_typed_or_rejected(spark):
    from pyspark.sql.types import DateType, DecimalType, LongType, StringType, StructField, StructType
    from spendlens.operators.requests import typed_requests
    schema = StructType([StructField("seq", LongType(), False), StructField("day", DateType()),
                         StructField("Budget", DecimalType(6, 2)), StructField("Name", StringType())])
    text = spark.createDataFrame([
        (" 1 ", "2001-02-03", " 12.50", " a ", "x"), ("2", "", None, "", "x"), ("3", "2001-02-30", "1", "b", "x"),
        ("4", "2001-02-03", "1e99", "b", "x"), (None, "2001-02-03", "1", "b", "x"), ("five", None, None, None, None)],
        "seq string, day string, Budget string, Name string, typed string")
    rows, rejects = typed_requests(text, schema)
    assert rows.schema.simpleString() == "struct<seq:bigint,day:date,Budget:decimal(6,2),Name:string>"
    assert sorted(map(tuple, rows.collect())) == [(1, dt.date(2001, 2, 3), D("12.50"), "a"), (2, None, None, None)]
    assert rejects.columns == [*text.columns, "Reason"]
    assert sorted(r.Reason for r in rejects.collect()) == [
        "Budget does not parse", "day does not parse", "seq does not parse", "seq is missing"]
    assert typed_requests(text.limit(0), schema)[0].collect() == []


def test_invalid_discounts_and_campaigns_are_rejected_and_leave_the_pair_to_the_next(spark):
    t = make_tables(spark, product=[(1, "p", D(50)), (2, "q", D(10))])
    req = spark.createDataFrame([(1, 1, 1, D(150)), (2, 1, 1, D(10)), (3, 1, 2, None), (4, None, 1, D(5)), (5, 1, 2, D(-1)), (6, 1, 2, D(100)),
                                 (6, 1, 2, D(100)), (7, 1, None, D(1))],
                                "seq long, CampaignID long, ProductID long, Discount decimal(5,2)")
    made, rejects = W.price_campaign_products(t, req)
    assert sorted((r.ProductID, r.SellingPrice) for r in made.collect()) == [(1, D("45.00")), (2, D("0.00"))]
    assert sorted((r.seq, r.Reason) for r in rejects.collect()) == [
        (1, "invalid discount"), (3, "invalid discount"), (4, "missing campaign"), (5, "invalid discount"),
        (6, "duplicate request in batch"), (7, "unknown product")]


def test_price_rejects_of_crowded_pairs_need_no_join_with_themselves(spark):
    """Each request is in the snapshot or the rejects, as a plain loop decides; requests meet no aggregate of themselves in a join."""
    import random
    from collections import Counter, defaultdict
    rnd = random.Random(3)
    rows = [(rnd.randint(1, 4), rnd.randint(1, 2), rnd.choice([1, 2, 3, 9, None]), D(rnd.choice([1, 2]))) for _ in range(150)]
    rows += [(s, 1, 1, D(5)) for s in range(300)] + [(7, 2, 2, D(3))] * 40
    there = [(2, 3, D(0), D(10)), (2, 3, D(0), D(10)), (8, 1, D(0), D(10))]
    t = make_tables(spark, product=[(p, f"p{p}", D(10)) for p in (1, 2, 3)], campaign_product=there)
    _, rejects = W.price_campaign_products(t, spark.createDataFrame(rows, "seq long, CampaignID long, ProductID long, Discount decimal(5,2)"))
    pairs, want = defaultdict(list), Counter()
    for s, c, p, d in rows:
        pairs[c, p].append((s, c, p, d))
    for (c, p), asked in pairs.items():
        first, *others = sorted(asked, key=lambda r: (r[0], r[3]))
        want.update((*r, "duplicate request in batch") for r in others)
        if (c, p) in {(x[0], x[1]) for x in there}:
            want[(*first, "pair already exists")] += 1
        elif p not in (1, 2, 3):
            want[(*first, "unknown product")] += 1
    assert Counter(tuple(r) for r in rejects.select("seq", "CampaignID", "ProductID", "Discount", "Reason").collect()) == want
    plan = rejects._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and sum(plan.count(j + " [") for j in ("SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin")) == 1


def test_products_are_not_broadcast_by_the_estimate_of_their_key(spark, tmp_path):
    """A key column is estimated at a share of the compressed files: millions of products would go through the driver."""
    t = make_tables(spark, product=[(p, f"p{p}", D(10)) for p in (1, 2, 3)], campaign_product=[(2, 3, D(0), D(10))])
    t.product.write.parquet(f"{tmp_path}/product")
    t = t.with_(product=spark.read.schema(t.product.schema).parquet(f"{tmp_path}/product"))
    asked = spark.createDataFrame([(1, 1, 1, D(5)), (2, 1, 1, D(6)), (3, 1, 9, D(5)), (4, 2, 3, D(5))],
                                  "seq long, CampaignID long, ProductID long, Discount decimal(5,2)")
    made, rejects = W.price_campaign_products(t, asked)
    for df in (made, rejects, W.price(asked, t.product), W.price(asked, t.product).select("ProductID")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan, plan
    assert sorted((r.seq, r.Reason) for r in rejects.collect()) == [
        (2, "duplicate request in batch"), (3, "unknown product"), (4, "pair already exists")]
    assert sorted((r.CampaignID, r.ProductID, r.SellingPrice) for r in made.collect()) == [(1, 1, D("9.50")), (2, 3, D("10.00"))]
