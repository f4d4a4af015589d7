"""Explicit schemas of the marketing model (campaign / ad / order star).

Money is decimal so sums are exact and independent of partitioning; ratios
are double. Keys are bigint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import (
    DateType, DecimalType, DoubleType, LongType, StringType, StructField, StructType,
)

MONEY = DecimalType(12, 2)       # one price or cost
BUDGET = DecimalType(14, 2)      # a campaign budget / spend to date
REVENUE = DecimalType(18, 2)     # attributed revenue of one ad
MONEY_SUM = DecimalType(38, 2)   # any aggregated money
PERCENT = DecimalType(5, 2)      # a discount in percent
RATE = DecimalType(4, 2)         # a discount as a fraction (order lines)


def _schema(*fields: tuple[str, object, bool]) -> StructType:
    return StructType([StructField(n, t, nullable) for n, t, nullable in fields])


CAMPAIGN = _schema(
    ("CampaignID", LongType(), False),
    ("PlatformID", LongType(), True),
    ("StartDate", DateType(), True),
    ("EndDate", DateType(), True),
    ("Budget", BUDGET, True),
    ("CurrentBudget", BUDGET, True),
    ("Objective", StringType(), True),
)

AD = _schema(
    ("AdID", LongType(), False),
    ("CampaignID", LongType(), True),
    ("AdName", StringType(), True),
    ("Impressions", LongType(), True),
    ("Clicks", LongType(), True),
    ("ConversionRate", DoubleType(), True),
    ("CostPerAd", MONEY, True),
    ("AttributedRevenue", REVENUE, True),
)

CAMPAIGN_PRODUCT = _schema(
    ("CampaignID", LongType(), False),
    ("ProductID", LongType(), False),
    ("Discount", PERCENT, True),
    ("SellingPrice", MONEY, True),
)

PRODUCT = _schema(
    ("ProductID", LongType(), False),
    ("ProductName", StringType(), True),
    ("MRP", MONEY, True),
)

ORDERS = _schema(
    ("OrderID", LongType(), False),
    ("CustomerID", LongType(), True),
    ("CampaignID", LongType(), True),
    ("TotalAmount", MONEY, True),
)

CUSTOMER = _schema(
    ("CustomerID", LongType(), False),
    ("SegmentID", LongType(), True),
    ("RegionID", LongType(), True),
)

CUSTOMER_SEGMENT = _schema(
    ("SegmentID", LongType(), False),
    ("SegmentName", StringType(), True),
    ("AgeGroup", StringType(), True),
    ("IncomeCategory", StringType(), True),
)

PLATFORM = _schema(
    ("PlatformID", LongType(), False),
    ("PlatformName", StringType(), True),
)

REGION = _schema(
    ("RegionID", LongType(), False),
    ("RegionName", StringType(), True),
)

ORDER_LINE = _schema(
    ("OrderID", LongType(), False),
    ("ProductID", LongType(), True),
    ("Price", MONEY, True),
    ("Discount", RATE, True),
)

MARKETING_USER = _schema(
    ("Username", StringType(), False),
    ("PasswordHash", StringType(), True),
    ("Role", StringType(), True),
)

MODEL = {
    "campaign": CAMPAIGN,
    "ad": AD,
    "campaign_product": CAMPAIGN_PRODUCT,
    "product": PRODUCT,
    "orders": ORDERS,
    "customer": CUSTOMER,
    "customer_segment": CUSTOMER_SEGMENT,
    "platform": PLATFORM,
    "region": REGION,
    "order_line": ORDER_LINE,
    "marketing_user": MARKETING_USER,
}


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Select and cast ``df`` to ``schema`` (by name, in schema order).

    One ``selectExpr`` call: the casts are parsed JVM-side, which keeps
    plan construction to a single round trip per table.
    """
    return df.selectExpr(*[f"CAST(`{f.name}` AS {f.dataType.simpleString()}) AS `{f.name}`"
                           for f in schema.fields])
