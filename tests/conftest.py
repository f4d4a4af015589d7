from __future__ import annotations

import datetime as dt
import os
import sys
import tempfile
from decimal import Decimal

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from spendlens.session import get_spark
    s = get_spark("local[*]", 8, extra={"spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="spendlens-wh-")})
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spendlens-test-ckpt-"))
    yield s
    s.stop()


def D(x) -> Decimal:
    return Decimal(str(x))


def make_tables(spark, **rows):
    """A Tables bundle from Python rows (missing tables are empty)."""
    from spendlens.schema import MODEL
    from spendlens.tables import Tables
    dfs = {}
    for name, schema in MODEL.items():
        data = rows.get(name, [])
        dfs[name] = spark.createDataFrame(data, schema)
    return Tables(**dfs)


def campaign_row(cid, budget, spent=0, platform=1, end=dt.date(2001, 7, 30), objective="Leads",
                 start=dt.date(2001, 5, 1)):
    return (cid, platform, start, end, D(budget), D(spent), objective)


def ad_row(ad_id, cid, impressions=100, clicks=10, cost=10, revenue=0, conv=0.0, name=None):
    return (ad_id, cid, name or f"ad{ad_id}", impressions, clicks, conv, D(cost), D(revenue))
