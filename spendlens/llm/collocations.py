"""Phrase collocations by multikey three-way quicksort of suffix pointers.

A suffix pointer is a word's place in a piece of text; its key is the words
from there on, ``MAX_WORDS`` at most. Counting phrases is sorting pointers: all
pointers that share their first m words are the occurrences of that phrase.

1. Blocks of text become word numbers; a word's counts are added up over all
   blocks, and words below the threshold end a suffix (no frequent phrase
   holds them). Only a block's own distinct words are shuffled, once each, packed by
   the hash bucket that counts them; ids of the frequent ones go back the same way.
2. Suffixes are routed globally by their leading words: sampled splitters cut
   the order of all suffixes into buckets, so that a phrase of any frequency
   spreads over as many buckets as it needs. Equal suffixes of a block travel once, with their number.
3. Each bucket is sorted by multikey three-way quicksort to the maximum depth
   (``collocations_kernel.frequent_prefixes``); sizes of equal parts are counts,
   parts below the threshold are abandoned. Prefixes of a bucket's two
   splitters may go on in its neighbours: their counts are added up after.
4. Cuts, scores and containment are joins over the frequent phrases alone.

Defined results: null text counts as empty, null language as ``und``; repeated
rows count as often as they stand; an empty table gives no phrases; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .collocations_kernel import as_bytes, frequent_prefixes, merged_windows, numbered_words, packed, unpacked, windows_at
from .common import session, shuffle_partitions, stored

MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2000
#: Bytes of text in a block (a longer text is a block of its own).
BLOCK_BYTES = 16_000_000
#: Suffixes that a bucket is meant to hold, and sampled suffixes per splitter.
BUCKET, SAMPLED = 1_000_000, 16
#: Splitters at most (40 bytes each); beyond 2**20 buckets they grow instead.
MOST_BUCKETS = 1 << 20

_BLOCKS = "block long, lang string, n long, size long, words array<struct<bucket: int, pos: binary, n: binary, words: array<binary>>>, seq binary"
_NUMBERED = "block long, pos binary, ids binary, words array<struct<lang: string, word: binary, a: long, id: long>>"
_READY = "block long, uniq binary, seq binary, sample array<array<long>>"
_ROUTED = "bucket long, parts array<binary>, weight binary"


def _blocks(buckets: int):
    """Texts of a language, about ``BLOCK_BYTES`` at a time, as word numbers, and the words by bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        held: dict[str, list[bytes]] = {}
        size = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            nonlocal made
            for lang, texts in held.items():
                words, counts, seq = numbered_words(texts)
                bucket = np.fromiter(map(crc32, words), np.int64, len(words)) % buckets
                order = np.argsort(bucket, kind="stable")
                edges = np.flatnonzero(np.diff(bucket[order], prepend=-1)).tolist() + [order.size]
                parts = [{"bucket": int(bucket[order[i]]), "pos": packed(order[i:j].astype(np.int32)), "n": packed(counts[order[i:j]]),
                          "words": [words[k] for k in order[i:j]]} for i, j in zip(edges, edges[1:])]
                row = {"block": (task << 32) + made, "lang": lang, "n": int(counts.sum()), "size": len(words),
                       "words": parts, "seq": packed(seq)}
                yield pa.RecordBatch.from_pylist([row], schema=_BLOCK_SCHEMA)
                made += 1

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py()
                if held and size + len(text) > BLOCK_BYTES:
                    yield from flushed()
                    held, size = {}, 0
                held.setdefault(lang, []).append(text)
                size += len(text)
        if held:
            yield from flushed()
    return run


_BLOCK_SCHEMA = pa.schema([
    ("block", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), ("size", pa.int64()),
    ("words", pa.list_(pa.struct([("bucket", pa.int32()), ("pos", pa.binary()), ("n", pa.binary()), ("words", pa.list_(pa.binary()))]))),
    ("seq", pa.binary())])
_NUMBERED_SCHEMA = pa.schema([
    ("block", pa.int64()), ("pos", pa.binary()), ("ids", pa.binary()),
    ("words", pa.list_(pa.struct([("lang", pa.string()), ("word", pa.binary()), ("a", pa.int64()), ("id", pa.int64())])))])


def _numbered(least: int):
    """Counts of a bucket's words over all blocks: ids of the frequent ones for each block that
    holds them, and one row without a block that lists them. An id holds for one language."""
    def run(bucket: pa.Table) -> pa.Table:
        bucket = bucket.combine_chunks()
        parts = [unpacked(n, np.int64) for n in bucket.column("n").to_pylist()]
        lengths = np.array([p.size for p in parts])
        lang = pc.dictionary_encode(bucket.column("lang")).combine_chunks()
        word = pc.dictionary_encode(pc.list_flatten(bucket.column("words"))).combine_chunks()
        width = len(word.dictionary)
        key, entry = np.unique(np.repeat(lang.indices.to_numpy(), lengths).astype(np.int64) * width + word.indices.to_numpy(),
                               return_inverse=True)
        counts = np.zeros(key.size, np.int64)
        np.add.at(counts, entry, np.concatenate(parts))
        ids = np.where(counts >= least, (bucket.column("bucket")[0].as_py() << 32) + np.arange(1, key.size + 1), 0)[entry]
        out, at = [], 0
        for block, pos, size in zip(bucket.column("block").to_pylist(), bucket.column("pos").to_pylist(), lengths.tolist()):
            own = ids[at:at + size]
            if own.any():
                out.append({"block": block, "pos": packed(unpacked(pos, np.int32)[own > 0]), "ids": packed(own[own > 0])})
            at += size
        frequent = np.flatnonzero(counts >= least)
        if frequent.size:
            first = (bucket.column("bucket")[0].as_py() << 32) + 1
            out.append({"words": [{"lang": lang.dictionary[int(key[k] // width)].as_py(), "word": word.dictionary[int(key[k] % width)].as_py(),
                                   "a": int(counts[k]), "id": int(first + k)} for k in frequent]})
        return pa.Table.from_pylist(out, schema=_NUMBERED_SCHEMA)
    return run


def _ready(depth: int, step: int):
    """Blocks in global word ids, kept as ranks of their own sorted ids, with a sample of their suffixes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                local = unpacked(row["seq"], np.int32)
                ids = np.zeros(row["size"] + 1, np.int64)
                for x in row["ids"]:
                    ids[unpacked(x["pos"], np.int32) + 1] = unpacked(x["ids"], np.int64)
                uniq, rank = np.unique(ids, return_inverse=True)   # 0 is always there and first
                seq = rank.astype(np.int32)[local]
                at = np.arange(row["block"] % step, seq.size, step)
                at = at[seq[at] != 0]
                cols = windows_at(seq, at, depth)
                sample = np.unique(uniq[np.stack(cols, axis=1)][cols[1] != 0], axis=0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["block"]], pa.int64()), pa.array([packed(uniq)], pa.binary()), pa.array([packed(seq)], pa.binary()),
                     pa.array([sample.tolist()], pa.list_(pa.list_(pa.int64())))], ["block", "uniq", "seq", "sample"])
    return run


def _routed(depth: int, splitters):
    """A block's distinct suffixes, one packed row for each bucket that they reach."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = splitters.value
        for b in batches:
            for row in b.to_pylist():
                uniq, seq = unpacked(row["uniq"], np.int64), unpacked(row["seq"], np.int32)
                cols, weight = merged_windows(seq, depth)
                cols = [uniq[c] for c in cols]
                cuts = np.searchsorted(as_bytes(cols), as_bytes(list(bounds.T))) if len(bounds) else np.zeros(0, np.int64)
                edges = np.concatenate([[0], cuts, [weight.size]])
                full = np.flatnonzero(np.diff(edges))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full, pa.int64()),
                     pa.array([[packed(c[edges[k]:edges[k + 1]]) for c in cols] for k in full], pa.list_(pa.binary())),
                     pa.array([packed(weight[edges[k]:edges[k + 1]]) for k in full], pa.binary())], ["bucket", "parts", "weight"])
    return run


def _counted(depth: int, least: int, splitters):
    """Frequent prefixes of a bucket; those that may go on in a neighbour with any count."""
    names = [f"w{d}" for d in range(depth)] + ["a"]

    def run(bucket: pa.Table) -> pa.Table:
        bounds, k = splitters.value, bucket.column("bucket")[0].as_py()
        parts = bucket.column("parts").to_pylist()
        cols = [np.concatenate([unpacked(p[d], np.int64) for p in parts]) for d in range(depth)]
        weight = np.concatenate([unpacked(w, np.int64) for w in bucket.column("weight").to_pylist()])
        out: list[list[int]] = []
        shared = {tuple(edge[:m]) for j in (k - 1, k) if 0 <= j < len(bounds) for edge in [bounds[j].tolist()]
                  for m in range(2, depth + 1) if edge[m - 1]}
        for prefix in sorted(shared):
            same = np.ones(weight.size, bool)
            for c, w in zip(cols, prefix):
                same &= c == w
            if count := int(weight[same].sum()):
                out.append([*prefix, *[0] * (depth - len(prefix)), count])
        for i, m, count in frequent_prefixes(cols, weight, least):
            prefix = tuple(int(c[i]) for c in cols[:m])
            if prefix not in shared:
                out.append([*prefix, *[0] * (depth - m), count])
        a = np.array(out, np.int64).reshape(-1, depth + 1)
        return pa.table([pa.array(a[:, d]) for d in range(depth + 1)], names)
    return run


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT,
                     max_words: int = MAX_WORDS, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, a) of every phrase of one to ``max_words`` words that a language holds ``min_count``
    times or more, and (lang, n) with each language's number of words."""
    spark = session(docs)
    texts = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"),
                        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    blocks = stored(texts.mapInArrow(_blocks(shuffle_partitions(spark)), _BLOCKS), "collocation-blocks")
    sizes = blocks.groupBy("lang").agg(F.sum("n").alias("n"))
    numbered = stored(blocks.select("block", "lang", F.explode("words").alias("w")).select("block", "lang", "w.*")
                      .groupBy("bucket").applyInArrow(_numbered(min_count), _NUMBERED), "collocation-words")
    vocabulary = numbered.select(F.explode("words").alias("w")).select("w.*")

    total = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_buckets = min(MOST_BUCKETS, max(shuffle_partitions(spark), -(-total // bucket)))
    step = max(1, total // (n_buckets * SAMPLED))
    ids = numbered.where("block is not null").groupBy("block").agg(F.collect_list(F.struct("pos", "ids")).alias("ids"))
    ready = stored(blocks.select("block", "size", "seq").join(ids, "block")
                   .mapInArrow(_ready(max_words, step), _READY), "collocation-suffixes")
    cols = [f"w{d}" for d in range(max_words)]
    splitters = spark.sparkContext.broadcast(_splitters(spark, ready, cols))

    counted = ready.select("uniq", "seq").mapInArrow(_routed(max_words, splitters), _ROUTED) \
        .groupBy("bucket").applyInArrow(_counted(max_words, min_count, splitters),
                                        ", ".join(f"{c} long" for c in [*cols, "a"]))
    grams = stored(counted.groupBy(*cols).agg(F.sum("a").alias("a")).where(F.col("a") >= min_count)
                   .withColumn("gram", F.monotonically_increasing_id()), "collocation-grams")
    spelled = grams.select("gram", "a", F.posexplode(F.array(*cols)).alias("pos", "id")).where("id > 0") \
        .join(vocabulary.select("id", "lang", F.col("word").cast("string").alias("word")), "id") \
        .groupBy("gram").agg(F.first("a").alias("a"), F.first("lang").alias("lang"),
                             F.expr("transform(array_sort(collect_list(struct(pos, word))), x -> x.word)").alias("words"))
    single = vocabulary.select("lang", F.array(F.col("word").cast("string")).alias("words"), "a")
    phrases = spelled.select("lang", "words", "a").unionByName(single) \
        .select("lang", "words", F.concat_ws(" ", "words").alias("phrase"), "a")
    return stored(phrases, "collocation-phrases"), sizes


def _splitters(spark: SparkSession, ready: DataFrame, cols: list[str]) -> np.ndarray:
    """Every ``SAMPLED``th of the sorted sampled suffixes."""
    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for b in batches:
            yield b.take(pa.array(np.arange(-(seen + 1) % SAMPLED, b.num_rows, SAMPLED)))
            seen += b.num_rows
    sample = ready.select(F.explode("sample").alias("s")).select(*[F.col("s")[d].alias(c) for d, c in enumerate(cols)])
    rows = sample.repartitionByRange(*cols).sortWithinPartitions(*cols) \
        .mapInArrow(every, ", ".join(f"{c} long" for c in cols)).distinct().collect()
    return np.array(sorted(tuple(r) for r in rows), np.int64).reshape(-1, len(cols))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT,
                 max_words: int = MAX_WORDS, absorbed_percent: int = 100, bucket: int = BUCKET) -> DataFrame:
    """(lang, phrase, words, cut, a, l, r, n, score) of every frequent phrase of two words or more that no frequent
    phrase one word longer holds in at least ``absorbed_percent`` of its occurrences.

    ``score`` is floor(1000 a n / (l r)) at the cut that scores least (of equal ones the first): l and r count
    the parts before and after it. Numbers are exact (decimal products). A longer phrase of any length that
    absorbs a phrase has a phrase just one word longer inside it that is as frequent, so one step suffices."""
    phrases, sizes = frequent_phrases(docs, text, lang, min_count, max_words, bucket)
    counts = phrases.select("lang", "phrase", "a")
    longer = phrases.where(F.size("words") >= 3)
    inner = longer.select("lang", "a", F.explode(F.array(F.expr("slice(words, 1, size(words) - 1)"),
                                                         F.expr("slice(words, 2, size(words) - 1)"))).alias("w")) \
        .groupBy("lang", F.concat_ws(" ", "w").alias("phrase")).agg(F.max("a").alias("most"))
    kept = phrases.where(F.size("words") >= 2).join(inner, ["lang", "phrase"], "left") \
        .where(F.col("most").isNull() | (100 * F.col("most") < absorbed_percent * F.col("a"))).drop("most")
    cuts = kept.withColumn("cut", F.explode(F.expr("sequence(1, size(words) - 1)"))) \
        .withColumn("left", F.expr("concat_ws(' ', slice(words, 1, cut))")) \
        .withColumn("right", F.expr("concat_ws(' ', slice(words, cut + 1, size(words) - cut))"))
    scored = cuts.join(counts.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l")), ["lang", "left"]) \
        .join(counts.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r")), ["lang", "right"]) \
        .join(sizes, "lang") \
        .withColumn("score", F.expr("(cast(1000 * cast(a as decimal(18,0)) * n as decimal(38,0))) "
                                    "div cast(cast(l as decimal(19,0)) * r as decimal(38,0))"))
    best = scored.groupBy("lang", "phrase").agg(
        F.first("words").alias("words"), F.first("a").alias("a"), F.first("n").alias("n"),
        F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "words", F.col("best.cut").alias("cut"), "a", F.col("best.l").alias("l"),
                       F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"))


def ranked(found: DataFrame, top: int = TOP) -> DataFrame:
    """Each language's first ``top`` phrases by score, count and phrase."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)


ORACLE = """
WITH d AS (SELECT coalesce(lang, 'und') AS lang, doc_id, row_number() OVER () AS d,
       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, d, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
q AS (SELECT lang, row_number() OVER () AS p, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
g AS (SELECT lang, ws, i, unnest(range(i, least(i + 4, len(ws)) + 1)) AS j
      FROM (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM q)),
f AS (SELECT lang, ws[i:j] AS w, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM q GROUP BY lang),
x AS (SELECT lang, w, max(a) AS most FROM (SELECT lang, w[1:len(w)-1] AS w, a FROM f WHERE len(w) >= 3
      UNION ALL SELECT lang, w[2:len(w)], a FROM f WHERE len(w) >= 3) GROUP BY lang, w),
c AS (SELECT f.lang, f.w, f.a, unnest(range(1, len(f.w))) AS k FROM f LEFT JOIN x ON f.lang = x.lang AND f.w = x.w
      WHERE len(f.w) >= 2 AND (x.most IS NULL OR 100 * x.most < 100 * f.a)),
s AS (SELECT c.lang, c.w, c.a, c.k, l.a AS l, r.a AS r, n.n,
      ((1000::HUGEINT * c.a * n.n) // (l.a::HUGEINT * r.a))::BIGINT AS score
      FROM c JOIN f l ON l.lang = c.lang AND l.w = c.w[1:c.k]
      JOIN f r ON r.lang = c.lang AND r.w = c.w[c.k+1:len(c.w)] JOIN n ON n.lang = c.lang),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, w ORDER BY score, k) AS nth FROM s),
o AS (SELECT lang, array_to_string(w, ' ') AS phrase, a, l, r, n, score FROM b WHERE nth = 1)
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a, l, r, n, score FROM o) WHERE rank <= 2000
"""
