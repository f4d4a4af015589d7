"""Report lines: text sinks (S4, S6) and the text source that reads them back."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..functions.text import fixed, java_trim, key_value_line, plain, template_line, whole


def report_lines(df: DataFrame, columns: list[str] | None = None, keep: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """Every row as ``Label=value | Label=value``; NULL prints ``null``. ``keep`` names columns to go along."""
    return df.select(key_value_line(df, columns).alias("line"), *keep)


# The reference's per-report row formats (Java format strings)
# and the columns they print, in order. These must stay exactly as written.
REPORT_FORMATS = {
    "list_campaigns": (
        "CampaignID=%d | PlatformID=%d | %s to %s | Budget=%.2f | Spent=%.2f | Objective=%s",
        ["CampaignID", "PlatformID", "StartDate", "EndDate", "Budget", "CurrentBudget", "Objective"]),
    "campaign_performance": (
        "CampaignID=%d | %s | Platform=%s | Budget=%.2f | Spend=%.2f (%.1f%%) | Revenue=%.2f | ROI=%s%% | Ads=%d",
        ["CampaignID", "Objective", "PlatformName", "Budget", "TotalSpend", "BudgetUtilizationPct",
         "ActualOrderRevenue", "ROIPercent", "NumAds"]),
    "ad_performance": (
        "AdID=%d | %s | CampaignID=%d | CTR=%s%% | ConvRate=%s | CPC=%s | ROAS=%s | Revenue=%.2f",
        ["AdID", "AdName", "CampaignID", "CTR", "ConversionRate", "CostPerClick", "ROAS", "AttributedRevenue"]),
    "campaign_products": (
        "ProductID=%d | %s | MRP=%.2f | Discount=%s%% | SellingPrice=%.2f",
        ["ProductID", "ProductName", "MRP", "Discount", "SellingPrice"]),
    "campaign_by_segment": (
        "Segment=%s (%s, %s) | Orders=%d | Revenue=%.2f",
        ["SegmentName", "AgeGroup", "IncomeCategory", "Orders", "Revenue"]),
    "budget_alerts": (
        "CampaignID=%d | %s | Budget=%.2f | Spent=%.2f | Utilization=%s%%",
        ["CampaignID", "Objective", "Budget", "TotalSpend", "BudgetUtilizationPct"]),
    "campaigns_ending_soon": (
        "CampaignID=%d | %s | Ends=%s | DaysLeft=%d",
        ["CampaignID", "Objective", "EndDate", "DaysLeft"]),
    "top_ads_by_roas": (
        "AdID=%d | %s | CampaignID=%d | ROAS=%s | Spend=%.2f | Revenue=%.2f",
        ["AdID", "AdName", "CampaignID", "ROAS", "CostPerAd", "AttributedRevenue"]),
    "underperforming_ads": (
        "AdID=%d | %s | CampaignID=%d | CTR=%s%% (campaign avg %.4f%%)",
        ["AdID", "AdName", "CampaignID", "CTR", "avg_ctr"]),
    "segment_platform_affinity": (
        "Segment=%s | Platform=%s | Orders=%d | Revenue=%.2f",
        ["SegmentName", "PlatformName", "Orders", "Revenue"]),
}

_SPEC = re.compile(r"%(%|s|d|\.(\d+)f)")


def format_line(fmt: str, columns: list[str], schema: StructType) -> F.Column:
    """A Java-style format string over columns, as one Column expression.

    ``%s`` prints the value as plain text (NULL → ``null``, ratios with four
    decimals), ``%d`` an integer (NULL → 0), ``%.Nf`` N fixed decimals
    (half-up, via a decimal cast), ``%%`` is ``%``.
    """
    pieces: list = []
    pos, i = 0, 0
    for m in _SPEC.finditer(fmt):
        pieces.append(fmt[pos:m.start()])
        pos = m.end()
        if m.group(1) == "%":
            pieces.append("%")
            continue
        col = columns[i]
        i += 1
        if m.group(2):
            pieces.append(fixed(col, int(m.group(2))))
        else:
            pieces.append(whole(col) if m.group(1) == "d" else plain(col, schema[col].dataType))
    pieces.append(fmt[pos:])
    if i != len(columns):
        raise ValueError(f"format takes {i} values, got {len(columns)} columns")
    return template_line(*[p for p in pieces if not (isinstance(p, str) and p == "")])


def formatted_lines(df: DataFrame, report: str) -> DataFrame:
    """One report's rows in its fixed format."""
    fmt, cols = REPORT_FORMATS[report]
    return df.select(format_line(fmt, cols, df.schema).alias("line"))


def write_lines(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Text sink: one line per row (``line`` column)."""
    lines.select("line").write.mode(mode).text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")


def write_ordered_lines(lines: DataFrame, path: str, order: list[Column], mode: str = "errorifexists") -> None:
    """Text sink that keeps an order: rows dealt by range of ``order``, sorted within each part, and parts
    numbered in that order. ``lines`` holds ``line`` and what ``order`` needs."""
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.mode(mode).text(path)


def read_ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a folder of numbered parts in their order: by part number, place of the split in its file,
    and place in the split."""
    name = F.col("_metadata.file_name")
    return spark.read.text(path).select(
        F.col("value").alias("line"), F.regexp_extract(name, r"^part-(\d+)", 1).cast("long").alias("_part"),
        name.alias("_file"), F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_row")).orderBy("_part", "_file", "_split", "_row").select("line")


def first_line(spark: SparkSession, path: str) -> str | None:
    """The first line of a folder of numbered parts, read from its first part with a line; None if there is none."""
    def number(file: str) -> tuple[int, str]:
        name = file.rsplit("/", 1)[-1]
        found = re.match(r"part-(\d+)", name)
        return int(found[1]) if found else -1, name
    for file in sorted(spark.read.text(path).inputFiles(), key=number):
        row = spark.read.text(file).where(F.col("_metadata.file_block_start") == 0).first()
        if row is not None:
            return row["value"]
    return None


def parse_stored_lines(spark: SparkSession, path: str) -> DataFrame:
    """S5 from a folder: the header is its first line, and rows come in the order of the lines."""
    header = first_line(spark, path)
    if header is None:
        return spark.createDataFrame([], "Result string")
    return parse_report_lines(read_ordered_lines(spark, path), header)


def parse_report_lines(lines: DataFrame, header_line: str | None = None) -> DataFrame:
    """Lines back to a table of strings.

    The header comes from the first line, which the caller gives
    (``header_line``) where the lines have lost their order, as files read in
    parallel have: split on ``|``, trim, cut at the
    first ``=``; a part without ``=`` is named ``Col{i}``. Each line's parts
    fill the header's columns (value after the first ``=``, or the whole
    part); missing parts are ``""``; extra parts are dropped. As with Java's
    ``split``, trailing empty parts do not count.
    """
    if header_line is None:
        first = lines.select("line").first()
        if first is None:
            return lines.sparkSession.createDataFrame([], "Result string")
        header_line = first["line"]
    header = []
    for i, part in enumerate(_java_split(header_line)):
        p = part.strip(_JAVA_WS)
        eq = p.find("=")
        header.append(p[:eq].strip(_JAVA_WS) if eq >= 0 else f"Col{i + 1}")

    parts = F.split(F.regexp_replace(F.col("line"), r"\|+$", ""), r"\|")
    cols = []
    for i, name in enumerate(header):
        p = java_trim(F.element_at(parts, i + 1))
        eq = F.instr(p, "=")
        value = F.when(eq > 0, java_trim(F.substring(p, eq + 1, 1 << 30))).otherwise(p)
        cols.append(F.when(F.size(parts) > i, value).otherwise(F.lit("")).alias(name))
    return lines.select(*cols)


_JAVA_WS = "".join(chr(c) for c in range(0x21))


def _java_split(s: str) -> list[str]:
    out = s.split("|")
    while out and out[-1] == "" and len(out) > 1:
        out.pop()
    return out


def report_text(t, name: str, *params) -> DataFrame:
    """A report as the text lines a dashboard prints: the report's fixed
    format where it has one, else the generic ``Label=value`` form."""
    from .reports import run_report
    df = run_report(t, name, *params)
    return formatted_lines(df, name) if name in REPORT_FORMATS else report_lines(df)
