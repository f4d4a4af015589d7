"""Exact dedup by content sort.

Sampled splitters range-partition the normalised texts, each partition sorts
them externally, and neighbours are compared in full (a window's group ends
where the next sorted text differs). Of equal texts the row with the most code
points in the original text stays, then the smallest identifier.

A text that holds many rows would fall between two splitters as one block. The
bounded splitter sample shows such texts: whoever occurs often in it is dealt
on under (text, salt) instead, and only the salts' bests (a few rows for each
such text) are merged by digest. No row is dropped on the way.

Everything is DataFrame functions; no Python runs in tasks.

Defined results: null text counts as empty; empty texts are equal to each
other and to texts of white space only; rows repeated in full are members of
the group like any other (one of them, and only one, has ``kept`` true); a
null identifier sorts first; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import session, shuffle_partitions, without_spaces

#: Rows of the splitter sample, and how often a text occurs in it to be salted.
SAMPLE_ROWS, HOT_IN_SAMPLE = 20_000, 6
#: Code points of a text in a splitter, which go to the driver; texts alike so far are dealt by digest.
LEAD = 64


def content_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False,
                   sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row for each row of ``docs``: its identifier, keep_id, group_size,
    kept, text_sha256 (of the normalised text), and with ``carry`` the whole
    row as a struct ``row``."""
    spark = session(docs)
    salts = 4 * shuffle_partitions(spark)
    text = F.coalesce(F.col(f"row.{text_col}") if carry else F.col(text_col), F.lit(""))
    hot = _hot_digests(docs, text_col, sample_rows)
    is_hot = F.xxhash64("_norm").isin(hot) if hot else F.lit(False)
    rows = (docs.select(F.struct("*").alias("row")) if carry else docs).select(
        (F.col(f"row.{id_col}") if carry else F.col(id_col)).alias("_id"),
        F.length(text).alias("_len"), without_spaces(text).alias("_norm"), *(["row"] if carry else []))
    dealt = rows.withColumn("_hot", is_hot).withColumn("_salt", F.when(
        F.col("_hot"), F.pmod(F.xxhash64("_id", "_len"), F.lit(salts))).otherwise(F.lit(0).cast("long"))) \
        .withColumn("_lead", F.left("_norm", F.lit(LEAD))).withColumn("_digest", F.xxhash64("_norm")) \
        .repartitionByRange("_lead", "_digest", "_salt")
    # sorted by the whole text; the range keys follow from it, so that no further exchange is needed
    group = Window.partitionBy("_norm", "_lead", "_digest", "_salt")
    first = group.orderBy(F.col("_len").desc(), F.col("_id").asc())
    marked = dealt.select(
        "_id", "_len", "_salt", "_hot", F.sha2("_norm", 256).alias("text_sha256"),
        F.row_number().over(first).alias("_rank"), F.first("_id").over(first).alias("_first"),
        F.count(F.lit(1)).over(group).alias("_size"), *(["row"] if carry else []))
    keep, size, best = F.col("_first"), F.col("_size"), F.col("_rank") == 1
    if hot:
        # of each salt of a hot text: its best row and its size
        bests = marked.where("_hot AND _rank = 1").groupBy("text_sha256").agg(
            F.min_by(F.struct("_id", "_salt"), F.struct((-F.col("_len")).alias("n"), "_id", "_salt")).alias("_best"),
            F.sum("_size").alias("_total"))
        # at most sample_rows / HOT_IN_SAMPLE rows
        marked = marked.join(F.broadcast(bests), "text_sha256", "left")
        keep = F.when(F.col("_hot"), F.col("_best._id")).otherwise(keep)
        size = F.when(F.col("_hot"), F.col("_total")).otherwise(size)
        best = best & (~F.col("_hot") | (F.col("_salt") == F.col("_best._salt")))
    return marked.select(F.col("_id").alias(id_col), keep.alias("keep_id"), size.cast("long").alias("group_size"),
                         best.alias("kept"), "text_sha256", *(["row"] if carry else []))


def _hot_digests(docs: DataFrame, text_col: str, sample_rows: int) -> list[int]:
    """64-bit digests of the texts that occur HOT_IN_SAMPLE times or more in
    the splitter sample. Which texts are salted changes no result."""
    total = docs.count()
    if total == 0:
        return []
    norm = without_spaces(F.coalesce(F.col(text_col), F.lit("")))
    found = docs.sample(fraction=min(1.0, sample_rows / total), seed=4) \
        .select(F.xxhash64(norm).alias("d")).groupBy("d").count() \
        .where(F.col("count") >= HOT_IN_SAMPLE).collect()
    return sorted(r["d"] for r in found)


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    return content_groups(docs, id_col, text_col, carry=True).where("kept").select("row.*")


ORACLE = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS len,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm ORDER BY len DESC, doc_id)
"""
