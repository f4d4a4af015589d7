"""Token ids in binary files, compressed by Re-Pair grammars.

Documents in ascending identifier order are dealt by range; each shard of that
order is one file (a Parquet part) of blocks. A block holds a bounded number
of whole documents' ids as a grammar of its own: the most frequent pairs of
neighbouring symbols are replaced by new symbols, again and again, until no
pair is frequent. A round takes many pairs at once, the most frequent first,
such that no symbol is the left of one pair and the right of another: their
occurrences then never overlap, and the round is a few vector operations.

Beside its rules a block stores the length every rule expands to, so that any
stretch of ids is found by a running sum over the sequence and expanded alone
(``ids_between``).

Defined results: null text is empty and gives the end id alone; rows that share
an identifier are neighbours in order of their text's hash; null identifiers
come first; an empty table gives a store without blocks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import scratch_path
from .common import in_pieces, session
from .tokens import word_encoder

END_ID = 2
#: Ids in a block (a longer document makes a block of its own), pairs looked at in a round, and
#: occurrences below which a pair is left alone.
BLOCK, PAIRS, LEAST = 1 << 19, 4096, 8
#: Pairs are counted in 2 ** BITS buckets; rules for which two bytes must leave room.
BITS, ROOM = 18, 1 << 13

STORED = ("shard int, block int, before long, n_tokens long, doc_ids array<long>, doc_lengths array<int>, "
          "terminals int, rules binary, expansions binary, width int, body binary")


def _symbols(terminals: int) -> int:
    """How many symbols a grammar may have: two bytes' worth where that leaves room for rules, else four bytes'."""
    return 1 << 16 if terminals <= (1 << 16) - ROOM else 1 << 32


def _idle(seq: np.ndarray) -> np.ndarray:
    """Places that begin no pair: of a run of one symbol only every other place does."""
    run = np.flatnonzero(seq[:-1] == seq[1:])
    begin = np.concatenate([[True], run[1:] != run[:-1] + 1])[:len(run)]
    return run[(run - np.maximum.accumulate(np.where(begin, run, 0))) % 2 == 1]


def compress(ids: np.ndarray, terminals: int) -> tuple[np.ndarray, np.ndarray]:
    """(rules, sequence): rules[k] is the pair that symbol ``terminals + k`` stands for. Rounds end when no pair
    occurs ``LEAST`` times any more, or all of ``_symbols(terminals)`` are given away.

    A pair's count never grows, so places whose pair is rare are not looked at again until a neighbour is replaced."""
    most = _symbols(terminals)
    kind, half = (np.uint32, 16) if most <= 1 << 16 else (np.uint64, 32)
    factor, low = kind(2654435761 if half == 16 else 11400714819323198485), kind((1 << half) - 1)
    seq = ids.astype(kind)
    live = np.ones(len(seq), bool)
    rules, total = [np.empty((0, 2), np.uint32)], terminals
    symbol_of, pair_of = np.zeros(1 << BITS, kind), np.zeros(1 << BITS, kind)
    while total < most:
        live[-1:] = False
        idle = _idle(seq)
        spare = live[idle]
        live[idle] = False
        at = np.flatnonzero(live)
        code = (seq.take(at) << kind(half)) | seq.take(at + 1)
        bucket = ((code * factor) >> kind(2 * half - BITS)).astype(np.int64)
        full = np.flatnonzero(np.bincount(bucket, minlength=1 << BITS).take(bucket) >= LEAST)
        at, code, bucket = at.take(full), code.take(full), bucket.take(full)
        # each bucket speaks for the pair at its last place; only if none of those is frequent are all counted
        pair_of[bucket] = code
        heard = pair_of.take(bucket) == code
        seen = np.bincount(bucket.take(np.flatnonzero(heard)), minlength=1 << BITS)
        live[:] = False
        live[at.take(np.flatnonzero(~heard | (seen.take(bucket) >= LEAST)))] = True
        live[idle] = spare
        home = np.flatnonzero(seen >= LEAST)
        if not len(home):
            pairs, one, many = np.unique(code, return_index=True, return_counts=True)
            one, pairs = one[many >= LEAST], pairs[many >= LEAST]
            if not len(one):
                break
            home = bucket[one]
            pair_of[home], seen[home] = pairs, LEAST
            home = np.unique(home)
        home = home[np.argsort(-seen[home], kind="stable")[:PAIRS]]
        pairs = pair_of[home]
        left, right, chosen = set(), set(), []
        for k, (a, b) in enumerate(zip((pairs >> kind(half)).tolist(), (pairs & low).tolist())):
            if a in right or b in left or (a == b and (a in left or b in right)):
                continue
            left.add(a)
            right.add(b)
            chosen.append(k)
        chosen = chosen[:most - total]
        pairs, home = pairs[chosen], home[chosen]
        symbol_of[home] = np.arange(total, total + len(home), dtype=kind)
        # only pairs now in pair_of were chosen, so a bucket's other pairs are told from them by the code
        symbol = symbol_of.take(bucket)
        hit = np.flatnonzero((symbol > 0) & (pair_of.take(bucket) == code))
        symbol_of[home] = 0
        at = at.take(hit)
        seq[at] = symbol.take(hit)
        live[at] = True
        live[at[at > 0] - 1] = True
        kept = np.ones(len(seq), bool)
        kept[at + 1] = False
        # the place before a replaced one may itself have been swallowed; then its left neighbour stands there
        swallowed = at[at > 1]
        live[swallowed[~kept[swallowed - 1]] - 2] = True
        kept = np.flatnonzero(kept)
        seq, live = seq.take(kept), live.take(kept)
        rules.append(np.stack([pairs >> kind(half), pairs & low], axis=1).astype(np.uint32))
        total += len(home)
    return np.concatenate(rules), seq.astype(np.uint32)


def expansion_lengths(rules: np.ndarray, terminals: int) -> np.ndarray:
    """How many ids each rule's symbol stands for."""
    out: list[int] = []
    for a, b in rules.tolist():
        out.append((1 if a < terminals else out[a - terminals]) + (1 if b < terminals else out[b - terminals]))
    return np.array(out, np.int64)


def _sizes(seq: np.ndarray, expansions: np.ndarray, terminals: int) -> np.ndarray:
    table = np.concatenate([np.ones(terminals, np.int64), expansions])
    return table[seq]


def _expand(seq: np.ndarray, rules: np.ndarray, terminals: int) -> np.ndarray:
    own = np.arange(terminals, dtype="<u4").tobytes()
    words: list[bytes] = []
    for a, b in rules.tolist():
        words.append((own[4 * a:4 * a + 4] if a < terminals else words[a - terminals])
                     + (own[4 * b:4 * b + 4] if b < terminals else words[b - terminals]))
    flat = np.frombuffer(own + b"".join(words), "<u4")
    size = np.concatenate([np.ones(terminals, np.int64), np.fromiter(map(len, words), np.int64, len(words)) // 4])
    begin = np.cumsum(size) - size
    many = size.take(seq)
    stop = np.cumsum(many)
    total = int(stop[-1]) if len(stop) else 0
    return flat.take(np.arange(total) + np.repeat(begin.take(seq) - (stop - many), many))


class StoredBlock:
    """One block as read back."""

    def __init__(self, terminals: int, rules: bytes, expansions: bytes, width: int, body: bytes):
        self.terminals = terminals
        self.rules = np.frombuffer(rules, "<u4").reshape(-1, 2)
        self.expansions = np.frombuffer(expansions, "<u4").astype(np.int64)
        self.seq = np.frombuffer(body, f"<u{width}")

    def ids(self) -> np.ndarray:
        return _expand(self.seq, self.rules, self.terminals)

    def ids_between(self, start: int, end: int) -> np.ndarray:
        """Ids start to end, without expanding the rest."""
        stop = np.cumsum(_sizes(self.seq, self.expansions, self.terminals))
        lo, hi = np.searchsorted(stop, start, "right"), np.searchsorted(stop, end, "left")
        before = int(stop[lo - 1]) if lo else 0
        return _expand(self.seq[lo:hi + 1], self.rules, self.terminals)[start - before:end - before]


def write_store(docs: DataFrame, vocabulary: str, path: str, end_id: int = END_ID) -> None:
    """Encode every text of ``docs`` and write the store to ``path``."""
    session(docs)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = word_encoder(vocabulary)
        terminals = enc.tok.get_vocab_size()
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        doc_ids, parts, held = [], [], 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            rules, seq = compress(ids, terminals)
            width = 2 if terminals + len(rules) <= 65536 else 4
            row = [shard, block, before, len(ids), doc_ids, [len(p) for p in parts], terminals,
                   rules.astype("<u4").tobytes(), expansion_lengths(rules, terminals).astype("<u4").tobytes(), width,
                   seq.astype(f"<u{width}").tobytes()]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()),
                     pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)],
                                              names=[x.split()[0] for x in STORED.split(", ")])

        for b in in_pieces(batches, "text", 8_000_000):
            texts = [t or "" for t in b.column(1).to_pylist()]
            for d, ids in zip(b.column(0).to_pylist(), enc.many(texts)):
                own = np.append(ids, ids.dtype.type(end_id))
                if parts and held + len(own) > BLOCK:
                    yield close()
                    block, before, doc_ids, parts, held = block + 1, before + held, [], [], 0
                doc_ids.append(d)
                parts.append(own)
                held += len(own)
        if parts:
            yield close()

    order = [F.col("doc_id"), F.xxhash64("text")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(encode, STORED).write.parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids
    (little-endian unsigned 32 bits) of each document, from the files."""
    blocks = spark.read.schema(STORED).parquet(path)
    session(blocks)
    # one row a shard, and there are no more shards than the writer had partitions
    totals = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def expand(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for base, before, doc_ids, lengths, *own in zip(*(c.to_pylist() for c in b.columns)):
                ids = StoredBlock(*own).ids().astype("<u4")
                n = np.array(lengths, np.int64)
                ends = np.cumsum(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(base + before + ends - n), pa.array(n),
                     pa.array([ids[e - k:e].tobytes() for e, k in zip(ends.tolist(), lengths)], pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"])

    rows = blocks.join(F.broadcast(bases), "shard").select(
        "base", "before", "doc_ids", "doc_lengths", "terminals", "rules", "expansions", "width", "body")
    return rows.mapInArrow(expand, "doc_id long, start long, n_tokens long, ids binary")


def through_files(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Write ``docs`` to a new store in the shared folder and read it back; ids as a digest."""
    spark = session(docs)
    path = scratch_path(spark, "token-store")
    write_store(docs, vocabulary, path)
    return read_store(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
