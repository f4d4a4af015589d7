"""Byte-level BPE by a global distinct-word shuffle.

Texts are cut into pre-tokens. Each block of documents sends its distinct
words, once each, to the word's bucket, where equal words of all blocks meet
and are encoded once; ids go back to the blocks they came from, where the
documents' positions (numbers of the block's words) are joined with them and
read off in order. Decoding joins ids with the token-byte table.

Rows that cross a shuffle are packed: one row for the words of a block that
fall into one bucket. A word that every document holds is one entry a block. A
block is a bounded stretch of a task's input; its number is the task's
partition and a count, and both sides of the join derive it from the same
stored scan. Each side carries a checksum of the block's words; were they ever
to differ, the query fails rather than mixing words up.

Defined results: null and empty texts have no ids (n_tokens 0, the digests of
the empty string); repeated rows each get their answer; an empty table gives an
empty table; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import in_pieces, session, shuffle_partitions

#: Bytes of text in a block.
BLOCK = 8_000_000
#: Words a task of the encoding stage remembers.
REMEMBERED = 500_000
LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")

_KEPT: dict[tuple, object] = {}


def pre_tokens(pattern: str):
    import regex
    return regex.compile(pattern).findall


def encoding(path: str, pattern: str):
    """The worker's tiktoken encoding for a rank file; kept across tasks."""
    key = ("encoding", path, pattern)
    if key not in _KEPT:
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _KEPT[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _KEPT[key]


def token_bytes(path: str) -> list[bytes]:
    """The token-byte table: the bytes of each id."""
    key = ("bytes", path)
    if key not in _KEPT:
        with open(path, "rb") as f:
            ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
        _KEPT[key] = [ranks.get(i, b"") for i in range(max(ranks) + 1)]
    return _KEPT[key]


class Block:
    """The distinct words of some texts and each text as numbers of words."""

    def __init__(self, pattern: str):
        self.find = pre_tokens(pattern)
        self.numbers: dict[str, int] = {}
        self.parts: dict[str, bytes] = {}
        self.doc_ids: list = []
        self.texts: list[bytes] = []

    def _of(self, part: str) -> bytes:
        numbers = self.numbers
        return np.array([numbers.setdefault(w, len(numbers)) for w in self.find(part)], "<u4").tobytes()

    def add(self, doc_id, text: str) -> None:
        # a lone space between two others always begins a pre-token, so stretches between them are cut once each
        pieces = text.split(" ")
        parts = self.parts
        out = []
        for p in pieces[1:]:
            got = parts.get(p)
            if got is None:
                if not p or p[0].isspace() or p[-1].isspace():
                    out = None
                    break
                got = parts[p] = self._of(" " + p)
            out.append(got)
        if out is None or not pieces[0] or pieces[0][-1].isspace():
            cut = LONE_SPACE.split(text)
            done = self._of(cut[0]) + b"".join([self._of(" " + p) for p in cut[1:]])
        else:
            done = self._of(pieces[0]) + b"".join(out)
        self.doc_ids.append(doc_id)
        self.texts.append(done)

    def ranked(self) -> tuple[list[bytes], np.ndarray]:
        """The distinct words, most frequent first, and the texts as their ranks."""
        at = np.frombuffer(b"".join(self.texts), "<u4")
        seen = np.bincount(at, minlength=len(self.numbers))
        by_use = np.argsort(-seen, kind="stable")
        rank = np.empty(len(by_use), "<u4")
        rank[by_use] = np.arange(len(by_use), dtype="<u4")
        words = [w.encode("utf-8") for w in self.numbers]
        return [words[i] for i in by_use.tolist()], rank[at] if len(at) else at

    def checksum(self) -> int:
        return zlib.crc32("\x00".join(self.numbers).encode("utf-8"))


def _blocks(batches: Iterable[pa.RecordBatch], pattern: str) -> Iterator[tuple[int, Block]]:
    for k, b in enumerate(in_pieces(batches, "text", BLOCK)):
        part = b.column(2)[0].as_py()  # of the scan: within a union a task has another number
        block = Block(pattern)
        for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            block.add(d, t or "")
        yield (part << 32) | k, block


def _packed(words: list[bytes]) -> bytes:
    return _squeeze(np.array([len(words), *map(len, words)], "<u4").tobytes() + b"".join(words))


def _squeeze(blob: bytes) -> bytes:
    import zstandard
    return zstandard.compress(blob, 3)


def _spread(blob: bytes) -> bytes:
    import zstandard
    return zstandard.decompress(blob)


def _unpacked(blob: bytes) -> list[bytes]:
    blob = _spread(blob)
    n = int(np.frombuffer(blob, "<u4", 1)[0])
    ends = (np.cumsum(np.frombuffer(blob, "<u4", n, 4)) + 4 * (n + 1)).tolist()
    return [blob[i:k] for i, k in zip([4 * (n + 1), *ends], ends)]


WORDS = "bucket int, block long, checksum long, words binary"
IDS = "block long, bucket int, checksum long, doc_ids binary, lengths binary, body binary"


def _buckets_of(words: list[bytes], buckets: int) -> np.ndarray:
    return (np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % np.uint32(buckets)).astype("<u2")


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           buckets: int | None = None) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32 bits, in order) of each row of
    ``docs``, which must be a scan (or a stored frame): it is read twice."""
    return _together(docs, ranks, pattern, id_col, text_col, buckets, lambda x: x, "doc_id long, ids binary")


def _together(docs, ranks, pattern, id_col, text_col, buckets, then, schema) -> DataFrame:
    """``then`` over the batches of doc_id and ids that each task reassembles."""
    spark = session(docs)
    buckets = min(buckets or shuffle_partitions(spark), 65536)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       F.spark_partition_id().cast("long").alias("part"))
    width = "<u2" if len(token_bytes(ranks)) <= 65536 else "<u4"

    def send_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in _blocks(batches, pattern):
            words, _ = block.ranked()
            to = _buckets_of(words, buckets)
            order = np.argsort(to, kind="stable")
            ends = np.searchsorted(to[order], np.arange(buckets + 1)).tolist()
            own = [(k, _packed([words[i] for i in order[a:e].tolist()]))
                   for k, (a, e) in enumerate(zip(ends, ends[1:])) if e > a]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in own], pa.int32()), pa.array([number] * len(own), pa.int64()),
                 pa.array([block.checksum()] * len(own), pa.int64()), pa.array([w for _, w in own], pa.binary())],
                names=["bucket", "block", "checksum", "words"])

    def encode_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single = encoding(ranks, pattern)._core_bpe.encode_single_piece
        known: dict[bytes, bytes] = {}
        for b in batches:
            for bucket, block, checksum, blob in zip(*(c.to_pylist() for c in b.columns)):
                if len(known) > REMEMBERED:  # bounds memory; a word met later is encoded anew
                    known.clear()
                ids = []
                for w in _unpacked(blob):
                    got = known.get(w)
                    if got is None:
                        got = known[w] = np.array(single(w), width).tobytes()
                    ids.append(got)
                size = (np.fromiter(map(len, ids), np.int64, len(ids)) // int(width[-1])).astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int64()), pa.array([bucket], pa.int32()), pa.array([checksum], pa.int64()),
                     pa.nulls(1, pa.binary()), pa.array([_squeeze(size.tobytes())], pa.binary()),
                     pa.array([_squeeze(b"".join(ids))], pa.binary())],
                    names=["block", "bucket", "checksum", "doc_ids", "lengths", "body"])

    def send_positions(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in _blocks(batches, pattern):
            words, at = block.ranked()
            # of the words their buckets, by rank: that places each among what comes back; of the
            # texts the ranks, byte plane by byte plane
            head = np.array([len(words), len(at)], "<u4").tobytes()
            planes = np.ascontiguousarray(at.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
            body = head + _buckets_of(words, buckets).tobytes() + planes
            n = np.array([len(t) // 4 for t in block.texts], "<u4")
            doc = np.array([0 if d is None else d for d in block.doc_ids], "<i8")
            null = np.array([d is None for d in block.doc_ids], "u1")
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([-1], pa.int32()), pa.array([block.checksum()], pa.int64()),
                 pa.array([null.tobytes() + doc.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary()),
                 pa.array([_squeeze(body)], pa.binary())],
                names=["block", "bucket", "checksum", "doc_ids", "lengths", "body"])

    def reassemble(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # sorted by block, then bucket: a block's positions (bucket -1) lead its ids
        current, held, sums, lengths, bodies = None, None, set(), [], []
        for b in batches:
            for block, bucket, checksum, doc_ids, n, body in zip(*(c.to_pylist() for c in b.columns)):
                if block != current:
                    if held:
                        yield from _read_off(held, sums, lengths, bodies, width)
                    current, held, sums, lengths, bodies = block, None, set(), [], []
                sums.add(checksum)
                if bucket < 0:
                    held = (doc_ids, n, body)
                else:
                    lengths.append(n)
                    bodies.append(body)
        if held:
            yield from _read_off(held, sums, lengths, bodies, width)

    parts = shuffle_partitions(spark)
    words = rows.mapInArrow(send_words, WORDS).repartition(parts, "bucket").mapInArrow(encode_words, IDS)
    positions = rows.mapInArrow(send_positions, IDS)
    together = words.unionByName(positions).repartition(parts, "block").sortWithinPartitions("block", "bucket")
    return together.mapInArrow(lambda batches: then(reassemble(batches)), schema)


def _read_off(held, sums, lengths, bodies, width: str) -> Iterator[pa.RecordBatch]:
    """A block's documents: each word's ids in the order of the positions."""
    if len(sums) != 1:
        raise RuntimeError("a block was read in two ways; encode() needs a scan or a stored frame")
    doc_blob, n_blob, body = held[0], held[1], _spread(held[2])
    n = np.frombuffer(n_blob, "<u4").astype(np.int64)
    rows = len(n)
    words, total = (int(x) for x in np.frombuffer(body, "<u4", 2))
    to = np.frombuffer(body, "<u2", words, 8)
    at = np.ascontiguousarray(np.frombuffer(body, np.uint8, 4 * total, 8 + 2 * words).reshape(4, total).T)
    at = at.view("<u4").ravel()
    size = np.frombuffer(b"".join(map(_spread, lengths)), "<u4").astype(np.int64)
    if len(size) != words:
        raise RuntimeError("a block's words and their ids don't match")
    ids = np.frombuffer(b"".join(map(_spread, bodies)), width)
    order = np.argsort(to, kind="stable")
    begin, many_of = np.empty(words, np.int64), np.empty(words, np.int64)
    begin[order], many_of[order] = np.cumsum(size) - size, size
    null = np.frombuffer(doc_blob, "u1", rows).astype(bool)
    doc = np.frombuffer(doc_blob, "<i8", rows, rows)
    ends = np.cumsum(n)
    for lo in range(0, rows, 256):
        hi = min(rows, lo + 256)
        first = int(ends[lo] - n[lo])
        own = at[first:int(ends[hi - 1])]
        many = many_of[own]
        stop = np.cumsum(many)
        flat = ids[np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(begin[own] - (stop - many), many)]
        cuts = np.concatenate([[0], stop])[np.concatenate([[0], ends[lo:hi] - first])]
        flat = flat.astype("<u4")
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc[lo:hi], pa.int64(), mask=null[lo:hi]),
             pa.array([flat[a:e].tobytes() for a, e in zip(cuts.tolist(), cuts[1:].tolist())], pa.binary())],
            names=["doc_id", "ids"])


def decoded(batches: Iterable[pa.RecordBatch], ranks: str) -> Iterator[pa.RecordBatch]:
    """Batches of doc_id and ids with ``bytes``: ids joined with the token-byte table."""
    table = token_bytes(ranks)
    for b in batches:
        own = [b"".join([table[i] for i in np.frombuffer(x, "<u4").tolist()]) for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.binary())], names=["doc_id", "ids", "bytes"])


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """``encoded`` (doc_id, ids) with ``bytes``."""
    session(encoded)
    return encoded.select("doc_id", "ids").mapInArrow(
        lambda batches: decoded(batches, ranks), "doc_id long, ids binary, bytes binary")


def round_trip(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row: encoded, then decoded from the ids."""
    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [str(i) for i in range(len(token_bytes(ranks)))]
        for b in decoded(batches, ranks):
            n, sha, back = [], [], []
            for x, raw in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                ids = np.frombuffer(x, "<u4").tolist()
                n.append(len(ids))
                sha.append(hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest())
                back.append(hashlib.sha256(raw).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(sha), pa.array(back)],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    # one Python stage: executors hold one worker a task
    return _together(docs, ranks, pattern, "doc_id", "text", None, digest,
                     "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
