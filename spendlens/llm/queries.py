"""The operators over the driver's tables: op1 to op13 and the pipeline.

Parameters here are the production ones; every query reads its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, collocations, exact_dedup, html_extract, langid, packing, pii, repair_store, repeats, secret_scan, simhash, \
    source_audit, topk_search


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_store.through_files(_table(spark, sf_dir, "documents"),
                                      public_tokenizers.path("word_bpe_49k.json"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.content_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk_search.quantised(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk_search.top_k(vectors, vectors.where("id % 50 = 0"), 5)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "end", F.sha2("value", 256).alias("value_sha256"), "probability", "is_secret")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(_table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"),
                          public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(_table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), simhash.hex_digits(F.col("fp")).alias("fingerprint"),
                         "component_id")


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removal_report(_table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations.collocations(_table(spark, sf_dir, "documents"))
    return collocations.ranked(found).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(_table(spark, sf_dir, "documents"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.personal_data(_table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_main_text, op2_packing, op3_token_store, op4_exact_dedup, op5_topk, op6_secret_scan, op7_language_id, op8_byte_bpe,
                            op9_simhash, op10_repeats, op11_collocations, op12_source_audit,
                            op13_personal_data)}

ORACLE: dict[str, str] = {
    "op4_exact_dedup": exact_dedup.ORACLE,
    "op5_topk": topk_search.ORACLE,
    "op11_collocations": collocations.ORACLE,
    "op12_source_audit": source_audit.ORACLE,
}
