"""Packing by minimum bin slack.

Documents are cut into pieces of at most one window; what counts for packing is
the histogram of piece lengths (at most ``capacity`` rows, however many
documents). A window is filled around the longest length left: a bitset
subset-sum dynamic programme over the remaining multiset finds the total
closest to capacity, is backtracked into counts per length, and is repeated for
as long as its lengths last. Pieces then take their places by their rank among
the pieces of equal length, which is a salted window over light rows, so that
one length may hold any share of them.

Defined results: null text is empty and gives the end id alone; an empty table
gives an empty table; repeated rows are packed like others (each is a piece of
its own); ties in length are ranked by all identifying columns, so that equal
inputs give equal places.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import in_pieces, session, shuffle_partitions, stored
from .tokens import word_encoder

CAPACITY, END_ID = 2048, 1

PIECE = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType(), False),
    T.StructField("length", T.LongType(), False), T.StructField("doc_tokens", T.LongType(), False),
    T.StructField("ids", T.BinaryType(), False)])


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """Each document's ids and ``end_id``, cut every ``capacity`` ids: doc_id,
    start, length, doc_tokens, ids (little-endian unsigned 32 bits)."""
    session(docs)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = word_encoder(vocabulary)
        for b in in_pieces(batches, "text"):
            doc, start, length, total, ids = [], [], [], [], []
            for d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = np.append(enc.ids(text or ""), np.uint32(end_id)).astype("<u4")
                for s in range(0, len(own), capacity):
                    piece = own[s:s + capacity]
                    doc.append(d)
                    start.append(s)
                    length.append(len(piece))
                    total.append(len(own))
                    ids.append(piece.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                 pa.array(total, pa.int64()), pa.array(ids, pa.binary())], names=PIECE.names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECE)


def fill_windows(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """[(lengths and their counts in one window, windows filled so), ...] that
    use up ``counts`` ({length: pieces})."""
    left = {n: c for n, c in counts.items() if c}
    out = []
    while left:
        seed = max(left)
        room = capacity - seed
        # reach[i]: the totals that the first i lengths (longest first) can give
        lengths = sorted((n for n in left if n <= room), reverse=True)
        mask, reach = (1 << (room + 1)) - 1, [1]
        for n in lengths:
            bits, have, step = reach[-1], min(left[n] - (n == seed), room // n), 1
            while have > 0:  # counts in binary parts
                take = min(step, have)
                bits |= (bits << (n * take)) & mask
                have -= take
                step *= 2
            reach.append(bits)
            if bits >> room & 1:
                break
        best = reach[-1].bit_length() - 1
        combo, total = {seed: 1}, best
        for i in range(len(reach) - 1, 0, -1):
            n, used = lengths[i - 1], 0
            while not reach[i - 1] >> total & 1:
                total -= n
                used += 1
            if used:
                combo[n] = combo.get(n, 0) + used
        times = min(left[n] // m for n, m in combo.items())
        for n, m in combo.items():
            left[n] -= m * times
            if not left[n]:
                del left[n]
        out.append((sorted(combo.items(), reverse=True), times))
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, keys: tuple[str, ...] = ("doc_id", "start")) -> DataFrame:
    """``pieces`` (a stored frame with a column ``length``) with sequence_id
    and offset. ``keys`` rank pieces of equal length."""
    spark = session(pieces)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places, base = [], 0
    seen = dict.fromkeys(counts, 0)
    for combo, times in fill_windows(counts, capacity):
        offset = 0
        for n, m in combo:
            places.append((n, seen[n], m, base, offset))
            seen[n] += m * times
            offset += n * m
        base += times
    schema = "length long, lo long, m long, base long, offset long"
    table = spark.createDataFrame(places, schema).coalesce(1).groupBy("length").agg(
        F.sort_array(F.collect_list(F.struct("lo", "m", "base", "offset"))).alias("_places"))
    salts = 4 * shuffle_partitions(spark)
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(salts)))
    own = Window.partitionBy("length", "_salt")
    sizes = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = salted.withColumn("_own", F.row_number().over(own.orderBy(*keys)) - 1) \
        .join(starts, ["length", "_salt"]) \
        .join(F.broadcast(table), "length")  # at most `capacity` rows
    at = F.col("_own") + F.col("_before")
    placed = ranked.withColumn("_at", at) \
        .withColumn("_p", F.expr("element_at(filter(_places, p -> p.lo <= _at), -1)")) \
        .withColumn("_in", F.col("_at") - F.col("_p.lo"))
    return placed.select(
        *pieces.columns,
        (F.col("_p.base") + F.floor(F.col("_in") / F.col("_p.m"))).cast("long").alias("sequence_id"),
        (F.col("_p.offset") + F.pmod("_in", F.col("_p.m")) * F.col("length")).cast("long").alias("offset"))


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """The padded windows themselves: sequence_id, ids (array), n_tokens. A
    window holds at most ``capacity`` ids, so its group is bounded."""
    def word(i):  # the i-th four bytes, little-endian
        digits = F.hex(F.substring(F.col("ids"), (i * 4 - 3).cast("int"), F.lit(4)))
        return F.conv(F.concat(*[F.substring(digits, k, 2) for k in (7, 5, 3, 1)]), 16, 10).cast("long")

    words = F.transform(F.sequence(F.lit(1), F.col("length")), word)
    parts = packed.select("sequence_id", F.struct("offset", words.alias("ids")).alias("part"))
    joined = parts.groupBy("sequence_id").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    ids = F.flatten(F.col("parts.ids"))
    n = F.size(ids)
    pad = F.when((n == capacity) | (F.bit_count(n) == 1), F.lit(0)).otherwise(F.lit(capacity) - n)
    return joined.select("sequence_id", n.alias("n_tokens"),
                         F.concat(ids, F.array_repeat(F.lit(pad_id).cast("long"), pad)).alias("ids"))


def packed_pieces(docs: DataFrame, vocabulary: str) -> DataFrame:
    """The pieces of ``docs`` with their places; ids as a digest."""
    light = token_pieces(docs, vocabulary).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return pack(stored(light, "pieces"))
