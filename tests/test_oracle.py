"""Every registered query against its DuckDB oracle text (sf0.001)."""

from __future__ import annotations

import pytest

import __spark_entry__ as E
from spendlens.plans.registry import QUERIES
from conftest import SF_SMALL
from oracle_compare import compare

KEYS = sorted(QUERIES)


def test_every_query_has_an_oracle():
    assert set(KEYS) <= set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, key):
    res = compare(spark, SF_SMALL, [key], verbose=False)[key]
    assert res.startswith("OK"), res


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["SegmentName", "PlatformName", "Orders", "Revenue"]
    assert df.count() > 0


@pytest.mark.parametrize("key", ["list_campaigns", "campaigns_ending_soon", "segment_platform_affinity",
                                 "campaign_products", "vw_product_performance"])
def test_same_frames_through_pandas(spark, key):
    """Money and dates reach pandas identically from Spark and from DuckDB."""
    from oracle_compare import duck
    a = E.queries()[key](spark, SF_SMALL).toPandas()
    b = duck(SF_SMALL).execute(E.oracle_sql()[key]).df()
    a, b = a[sorted(a.columns)], b[sorted(b.columns)]
    a = a.sort_values(list(a.columns)).reset_index(drop=True)
    b = b.sort_values(list(b.columns)).reset_index(drop=True)
    assert list(a.dtypes.astype(str)) == list(b.dtypes.astype(str))
    assert a.equals(b)
