"""S4–S6 text sinks and the S5 source over every report format."""

from __future__ import annotations

import re

import pytest

from conftest import SF_SMALL
from spendlens.operators import reports as R
from spendlens.operators.text import (REPORT_FORMATS, first_line, formatted_lines, parse_report_lines,
                                      parse_stored_lines, read_ordered_lines, report_lines, write_ordered_lines)
from spendlens.sources.driver import AS_OF, model_from_driver

REPORTS = {
    "list_campaigns": lambda t: R.list_campaigns(t),
    "campaign_performance": lambda t: R.campaign_performance(t),
    "ad_performance": lambda t: R.ad_performance(t),
    "campaign_products": lambda t: R.campaign_products(t, 4),
    "campaign_by_segment": lambda t: R.campaign_by_segment(t, 4),
    "budget_alerts": lambda t: R.budget_alerts(t, 85.0),
    "campaigns_ending_soon": lambda t: R.campaigns_ending_soon(t, 14, AS_OF),
    "top_ads_by_roas": lambda t: R.top_ads_by_roas(t, 10),
    "underperforming_ads": lambda t: R.underperforming_ads(t),
    "segment_platform_affinity": lambda t: R.segment_platform_affinity(t),
}


@pytest.fixture(scope="module")
def model(spark):
    return model_from_driver(spark, SF_SMALL)


def _java_like(fmt: str, row) -> str:
    """Python's % agrees with Java's Formatter for these values; %s gets str(),
    a ratio its plain decimals."""
    from decimal import ROUND_HALF_UP, Decimal
    specs = [sp for sp in re.findall(r"%(%|s|d|\.\d+f)", fmt) if sp != "%"]

    def text(sp, v):
        if sp == "d":
            return v or 0
        if v is None:
            return "null"
        if isinstance(v, float) or sp != "s":
            places = "0.0001" if sp == "s" else "1." + "0" * int(sp[1:-1])
            return str(Decimal(str(v)).quantize(Decimal(places), ROUND_HALF_UP))
        return str(v)
    plain = re.sub(r"%(s|\.\d+f)", "%s", fmt)
    return plain % tuple(text(sp, v) for sp, v in zip(specs, row))


@pytest.mark.parametrize("report", sorted(REPORT_FORMATS))
def test_every_format_renders(spark, model, report):
    fmt, cols = REPORT_FORMATS[report]
    df = REPORTS[report](model)
    lines = [r.line for r in formatted_lines(df, report).collect()]
    rows = df.select(*cols).collect()
    assert len(lines) == len(rows) > 0
    for line, row in zip(lines, rows):
        assert line == _java_like(fmt, row)


def test_small_ratios_and_nulls_print_plainly(spark):
    df = spark.createDataFrame([(1, "a", 2, 0.0001, 0.0005, None, 12345678.5, None)],
                               "AdID long, AdName string, CampaignID long, CTR double, ConversionRate double, "
                               "CostPerClick double, ROAS double, AttributedRevenue decimal(18,2)")
    assert formatted_lines(df, "ad_performance").first().line == (
        "AdID=1 | a | CampaignID=2 | CTR=0.0001% | ConvRate=0.0005 | CPC=null | ROAS=12345678.5000 | Revenue=null")
    df = spark.createDataFrame([(None, None, None, None)], "CampaignID long, Objective string, EndDate date, DaysLeft int")
    assert formatted_lines(df, "campaigns_ending_soon").first().line == "CampaignID=0 | null | Ends=null | DaysLeft=0"


def test_generic_lines_round_trip(model):
    df = R.segment_platform_affinity(model)
    back = parse_report_lines(report_lines(df))
    assert back.columns == df.columns
    want = sorted(tuple(str(v) for v in r) for r in df.collect())
    assert sorted(tuple(r) for r in back.collect()) == want


PARAMS = {"campaign_products": (4,), "campaign_by_segment": (4,), "budget_alerts": (85.0,),
          "campaigns_ending_soon": (14, AS_OF), "top_ads_by_roas": (10,)}


def test_every_report_as_text(model):
    from spendlens.operators.reports import REPORTS
    from spendlens.operators.text import report_text
    for name in REPORTS:
        lines = [r.line for r in report_text(model, name, *PARAMS.get(name, ())).collect()]
        assert lines, name
        if name == "region_performance":
            assert lines[0].startswith("RegionName=") and " | TotalOrders=" in lines[0]
        if name == "budget_alerts":
            assert lines[0].startswith("CampaignID=") and lines[0].endswith("%")


def test_ordered_lines_come_back_in_order_from_several_parts_and_splits(spark, tmp_path):
    path = str(tmp_path / "lines")
    rows = spark.range(3000).selectExpr("id AS n", "concat('N=', id, ' | Text=', repeat('x', 40)) AS line")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes",
                                             "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        write_ordered_lines(rows, path, [rows.n.desc()])
        spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        assert len(spark.read.text(path).inputFiles()) > 3
        assert spark.read.text(path).rdd.getNumPartitions() > 8
        assert [r.line.split(" ")[0] for r in read_ordered_lines(spark, path).collect()] == \
            [f"N={n}" for n in range(2999, -1, -1)]
        assert first_line(spark, path).startswith("N=2999 ")
        assert [int(r.N) for r in parse_stored_lines(spark, path).collect()] == list(range(2999, -1, -1))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_stored_lines_of_an_empty_report(spark, tmp_path):
    path = str(tmp_path / "none")
    rows = spark.range(0).selectExpr("id AS n", "cast(id AS string) AS line")
    write_ordered_lines(rows, path, [rows.n.asc()])
    assert first_line(spark, path) is None
    assert parse_stored_lines(spark, path).columns == ["Result"]
