"""SimHash near-dedup by multi-index hashing.

A fingerprint is cut into two 32-bit segments. Fingerprints that differ in at
most three bits agree in one segment up to one bit, so each distinct
fingerprint fetches, for either segment, the table rows of the Hamming ball of
radius one around its segment, and complete distances are verified. Of two
segments that differ in one bit only the one with that bit clear asks for the
other, which halves the ball. Links join distinct fingerprints; documents of
equal fingerprint are members of one class and never paired.

Components are found by contraction: in each round every class moves to the
neighbour (or itself) of smallest hash, links are taken over to the new
classes, and inner ones fall away; a constant share of the classes goes in each
round, whatever the components' diameter.

Defined results: null and empty texts and those of white space only have
fingerprint zero, which links like any other; null identifiers are carried but
never name a component; repeated rows are one class; an empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import in_pieces, session, stored

WORDS, MAX_BITS, SEED = 3, 3, 42


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The 64-bit SimHash of one text as an unsigned integer."""
    import xxhash
    own = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and [\x20\x09-\x0D] only
    if not own:
        return 0
    joined = b" ".join(own)
    if len(own) <= words:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        length = np.fromiter(map(len, own), np.int64, len(own))
        start = np.cumsum(length + 1) - length - 1
        end = (start + length)[words - 1:].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[i:k], SEED) for i, k in zip(start.tolist(), end)]
    ones = np.zeros(64, np.int64)
    # hashes in stretches, so that a very long text needs little more memory than its words
    for i in range(0, len(hashes), 1 << 16):
        h = np.array(hashes[i:i + (1 << 16)], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = ones * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """id and fp (the fingerprint as a signed 64-bit integer) of each row; an
    identifier is a number, or a struct that orders the rows."""
    session(docs)
    kind = docs.schema[id_col].dataType.simpleString()
    kind = kind if kind.startswith("struct") else "bigint"

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_pieces(batches, "text"):
            own = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own)], names=["id", "fp"])

    return docs.select(F.col(id_col).cast(kind).alias("id"), F.col(text_col).alias("text")) \
        .mapInArrow(mark, f"id {kind}, fp bigint")


def _segment(fp: Column, s: int) -> Column:
    return F.shiftrightunsigned(fp, 32) if s else fp.bitwiseAND(F.lit(0xFFFFFFFF))


def links(classes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """a, b: pairs of distinct fingerprints (column fp) up to ``max_bits`` apart."""
    if max_bits > 3:
        raise ValueError("two segments searched to one bit find distances up to 3")
    table = classes.select("fp", F.explode(F.array(*[
        F.struct(F.lit(s).alias("s"), _segment(F.col("fp"), s).alias("key")) for s in (0, 1)])).alias("t")) \
        .select(F.col("fp").alias("a"), "t.s", "t.key")
    bits = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: F.getbit(F.col("key"), i) == 0)
    ball = F.concat(F.array(F.col("key")), F.transform(
        bits, lambda i: F.col("key") + F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    probes = table.select(F.col("a").alias("b"), "s", F.explode(ball).alias("key"), F.col("key").alias("own"))
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    # an exact match of a segment is found from both sides: one of them counts
    once = (F.col("key") != F.col("own")) | (F.col("a") < F.col("b"))
    # a pair close in both segments is found in both: the low one counts if it is within reach
    low = F.bit_count(_segment(F.col("a"), 0).bitwiseXOR(_segment(F.col("b"), 0)))
    # Spark takes what an explode yields for no larger than its input, and would broadcast a side through the driver
    found = table.join(probes.hint("merge"), ["s", "key"]).where((apart <= max_bits) & once & ((F.col("s") == 0) | (low > 1)))
    return found.select("a", "b")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (a, b); root is a node of its component."""
    edges = stored(edges, "links")
    moved = None
    for turn in range(64):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if both.isEmpty():
            break
        order = F.xxhash64(F.lit(turn), F.col("b"))
        least = both.groupBy("a").agg(F.min_by("b", F.struct(order.alias("h"), "b")).alias("b"),
                                      F.min(F.struct(order.alias("h"), "b")).alias("hb"))
        own = F.struct(F.xxhash64(F.lit(turn), F.col("a")).alias("h"), F.col("a").alias("b"))
        step = stored(least.select(F.col("a").alias("node"), F.when(F.col("hb") < own, F.col("b"))
                                   .otherwise(F.col("a")).alias("to")), "step")
        if moved is None:
            moved = step.select("node", F.col("to").alias("root"))
        else:
            moved = stored(moved.join(step, moved["root"] == step["node"], "left").select(
                moved["node"], F.coalesce(step["to"], moved["root"]).alias("root")), "roots")
        s1 = step.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        s2 = step.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        edges = stored(edges.join(s1, "a").join(s2, "b").where("ta <> tb").select(
            F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "links")
    else:
        raise RuntimeError("contraction didn't end")
    return moved if moved is not None else nodes.select("fp").limit(0).select(
        F.col("fp").alias("node"), F.col("fp").alias("root"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                max_bits: int = MAX_BITS) -> DataFrame:
    """id, fp, component_id (smallest identifier reachable) of each row of ``docs``."""
    marked = stored(fingerprints(docs, id_col, text_col, words), "fingerprints")
    classes = stored(marked.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    roots = components(classes, links(classes, max_bits))
    rooted = classes.join(roots, classes["fp"] == roots["node"])
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    linked = rooted.select("fp", "root").join(least, "root").select("fp", "component")
    named = classes.join(linked, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id"))
    return marked.join(named, "fp").select("id", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component, all columns as they were: the one of smallest identifier, of
    rows that share it the one of smallest digests of the text and of the whole row.

    Rows are told apart by identifier and content, so a repeated identifier with another text loses nothing; of rows alike
    in every column one stays. Null texts and texts without words are one component (fingerprint zero)."""
    keyed = docs.select(F.struct("*").alias("row"), F.struct(
        F.col(id_col).alias("id"), F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256).alias("text"),
        F.xxhash64(F.to_json(F.struct("*"))).alias("all")).alias("key"), F.col(text_col).alias("text"))
    groups = near_groups(keyed.select("key", "text"), "key", "text")
    stays = groups.where(F.col("id") == F.col("component_id")).select(F.col("id").alias("key")).distinct()
    return keyed.join(stays, "key", "left_semi").dropDuplicates(["key"]).select("row.*")
