"""The mapping pinned to the values FIXTURES.md reports for sf0.001 — numbers
observed independently of this code, so a misreading shared by the Spark
mapping and the DuckDB oracle would still be caught."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from spendlens.operators import reports as R
from spendlens.operators import views as V
from spendlens.plans import registry as REG
from spendlens.sources.driver import model_from_driver


@pytest.fixture(scope="module")
def t(spark):
    return model_from_driver(spark, SF_SMALL)


def test_ads(t):
    a = t.ad.agg(F.count(F.lit(1)), F.count_if(F.col("CostPerAd") == 0), F.count_if(F.col("Impressions") == 0),
                 F.sum("CostPerAd"), F.sum("Impressions"), F.sum("Clicks")).first()
    assert tuple(a) == (200, 3, 2, Decimal("418070.92"), 150406, 1945)


def test_campaigns_and_orders(t):
    c = t.campaign.agg(F.count(F.lit(1)), F.count_if(F.col("Budget") == 0), F.sum("Budget")).first()
    assert tuple(c) == (10, 1, Decimal("237205.53"))
    f = V.campaign_facts(t).agg(F.count_if(F.col("TotalOrders") == 0), F.sum("ActualOrderRevenue")).first()
    assert tuple(f) == (1, Decimal("304999864.41"))


def test_reports(spark, t):
    assert R.budget_alerts(t, 85.0).count() == 9
    assert R.campaigns_ending_soon(t, 14, dt.date(2001, 7, 20)).count() == 3
    r5 = R.campaign_by_segment(t, 4).agg(F.count(F.lit(1)), F.sum("Orders"), F.sum("Revenue")).first()
    assert tuple(r5) == (5, 128, Decimal("31938972.32"))
    r1 = R.region_performance(t).first()
    assert (r1.RegionName, r1.TotalOrders, r1.TotalRevenue) == ("AMERICA", 339, Decimal("87407488.51"))
    assert V.product_performance_view(t).agg(F.sum("RevenueGenerated")).first()[0] == Decimal("301270840.1572")
    assert R.campaign_products(t, 4).count() == 186


def test_pricing_and_admission(spark, t):
    cp = t.campaign_product.agg(F.count(F.lit(1)), F.sum("SellingPrice")).first()
    assert tuple(cp) == (1905, Decimal("1607563.42"))
    w3 = REG.admitted_ads(spark, t).agg(F.count(F.lit(1)), F.sum("AdID")).first()
    assert tuple(w3) == (129, 9625)
