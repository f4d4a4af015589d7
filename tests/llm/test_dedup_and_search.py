from __future__ import annotations

import math

from brute import exact_groups, simhash_components, top_k
from oracle_compare import duck

from spendlens.llm import exact_dedup, queries, simhash, topk_search
from pyspark.sql import functions as F


def rows(df):
    return sorted(map(tuple, df.collect()))


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_exact_dedup_matches_sql(spark, sf):
    want = sorted(duck(sf).execute(exact_dedup.ORACLE).fetchall())
    assert rows(queries.op4_exact_dedup(spark, sf)) == want


def test_exact_dedup_edges(spark, edge_docs, no_docs):
    got = exact_dedup.content_groups(edge_docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert rows(got) == exact_groups(texts(edge_docs))
    assert exact_dedup.content_groups(no_docs).collect() == []
    stay = exact_dedup.kept_rows(edge_docs)
    assert stay.columns == edge_docs.columns
    assert sorted(r.doc_id for r in stay.collect()) == sorted(x[0] for x in exact_groups(texts(edge_docs)) if x[3])
    assert exact_dedup.kept_rows(no_docs).collect() == []


def test_exact_dedup_hot_text(spark):
    """A third of the rows hold one text (with varied white space): it is salted, and merged again."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(
        F.col("id") % 3 == 0, F.concat(F.lit("hot"), F.repeat(F.lit(" "), (F.col("id") % 7).cast("int")), F.lit("text")))
        .otherwise(F.concat(F.lit("t"), (F.col("id") % 500).cast("string"))).alias("text"))
    assert exact_dedup._hot_digests(docs, "text", 20_000)
    got = exact_dedup.content_groups(docs)
    assert rows(got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")) == exact_groups(texts(docs))
    assert exact_dedup.kept_rows(docs).count() == sum(x[3] for x in exact_groups(texts(docs)))


def test_simhash_query(spark, sf):
    docs = texts(spark.read.parquet(f"{sf}/documents.parquet"))
    assert rows(queries.op9_simhash(spark, sf)) == simhash_components(docs)


def test_simhash_edges(spark, edge_docs, no_docs):
    got = simhash.near_groups(edge_docs).select("id", simhash.hex_digits(F.col("fp")), "component_id")
    assert rows(got) == simhash_components(texts(edge_docs))
    assert simhash.near_groups(no_docs).collect() == []
    assert simhash.one_of_each(edge_docs).columns == edge_docs.columns


def test_one_of_each_loses_no_text(spark):
    """Repeated identifiers with other texts, repeated rows and clashing columns: one row of each component stays."""
    t, u = "one two three four five six", "entirely other words stand in this one here"
    rows = [(3, t, 1), (5, t + " ", 2), (5, u, 3), (5, u, 3), (5, u, 4), (7, None, 5), (6, "", 6), (None, "null identifier text of its own", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone long")
    got = simhash.one_of_each(docs)
    assert got.columns == docs.columns
    kept = sorted((r.doc_id is not None, r.doc_id or 0, r.text) for r in got.collect())
    assert kept == [(False, 0, "null identifier text of its own"), (True, 3, t), (True, 5, u), (True, 6, "")]


def test_one_of_each_over_a_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    both = docs.unionByName(docs.limit(20)).repartition(3)
    groups = simhash_components(texts(docs))
    assert sorted(r.doc_id for r in simhash.one_of_each(both).collect()) == sorted({g[2] for g in groups})


def test_links_up_to_three_bits_only(spark):
    base = 0x0123456789ABCDEF
    flips = [(), (0,), (63,), (0, 32), (31, 63), (5, 40, 41), (1, 2, 33), (61, 62, 63), (0, 1, 2), (0, 1, 2, 3),
             (0, 1, 32, 33), (10, 20, 30, 40, 50)]
    fps = {base ^ sum(1 << b for b in f) for f in flips}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    found = [frozenset((r.a, r.b)) for r in got]
    want = {frozenset((a, b)) for a in signed for b in signed
            if a != b and bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 3}
    assert len(found) == len(set(found)) and set(found) == want


def test_links_broadcast_neither_probes_nor_table(spark, tmp_path):
    """Spark estimates exploded rows at the size of what they came from; few or many classes, both sides are sorted and merged."""
    spark.createDataFrame([(0b1,), (0b0,), (1 << 40,), ((1 << 50) - 1,)], "fp long").write.parquet(f"{tmp_path}/classes")
    found = simhash.links(spark.read.schema("fp long").parquet(f"{tmp_path}/classes"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan, plan
    assert {frozenset(r) for r in found.collect()} == {frozenset(x) for x in ((0, 1), (0, 1 << 40), (1, 1 << 40))}


def test_pipeline_near_dedup_broadcasts_no_exploded_side(spark, tmp_path, monkeypatch):
    import corpus_pipeline
    plans, keep = [], simhash.stored

    def noted(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return keep(df, name)

    monkeypatch.setattr(simhash, "stored", noted)
    texts = ["one two three four five six seven", "one two three four five six seven ", "other words that stand alone in here", None]
    spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents")
    docs = spark.read.schema("doc_id long, text string").parquet(f"{tmp_path}/documents")
    assert sorted(r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()) == [0, 2, 3]
    first = next(plan for name, plan in plans if name == "links")
    assert "Generate" in first and "SortMergeJoin" in first and "Broadcast" not in first, first


def test_components_of_a_long_chain(spark):
    n = 300
    edges = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    roots = simhash.components(spark.range(n).select(F.col("id").alias("fp")), edges).collect()
    assert len(roots) == n and len({r.root for r in roots}) == 1


def test_top_k_query(spark, sf):
    want = sorted(duck(sf).execute(topk_search.ORACLE).fetchall())
    assert rows(queries.op5_topk(spark, sf)) == want


def test_top_k_edges(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "SHARD", 60)
    monkeypatch.setattr(topk_search, "BLOCK", 2)
    vectors = [(i, [math.sin(i * k) for k in range(1, 6)], i) for i in range(300)]
    vectors += [(300, None, 0), (301, [], 0), (302, [1.0, None, 0.0, 0.0, 0.0], 0), (303, [float("nan")] * 5, 0),
                (304, [float("inf")] * 5, 0), (350, [1.0, 2.0], 0), (351, [0.5, 2.0], 0)]
    vectors += [(i, [0.5, 0.5, 0.5, 0.5, 0.5], 0) for i in range(400, 480)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, id long")
    own = topk_search.quantised(df, "vec_id", "embedding")
    got = topk_search.top_k(own, own.where("id % 50 = 0"), 5)
    import numpy as np
    as_float = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v])
                for i, v, _ in vectors]
    assert rows(got) == top_k(as_float)
    none = topk_search.quantised(df.limit(0), "vec_id", "embedding")
    assert topk_search.top_k(none, none, 5).collect() == []
