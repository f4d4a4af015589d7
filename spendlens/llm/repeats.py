"""Repeated byte strings by a depth-limited radix sort of suffixes.

Wanted are all bytes covered by a ``LENGTH``-byte string that also starts
earlier (smaller identifier, or earlier in the same document). Suffixes count
only to that depth, so equal groups of the sort are exactly the repeated
windows. The sort's passes go from one digit to the next and only groups of
two or more go on; neighbouring suffixes whose digit is at the same place
travel as one run:

1. First digit: a window's anchor, the ``GRAM``-byte string of least hash in
   it. Equal windows have equal anchors at equal places, so a run of windows
   whose anchor occurs nowhere else ends here.
2. Second digit: the whole stretch a run covers. Of runs with equal stretches
   all but the first are repeated, every window of them; only the first goes
   on, and only if its anchor has other stretches beside it.
3. Last digit: the windows themselves, to full depth. All but the first of
   equal windows are repeated.

Digits are 64-bit hashes; two differ in one of 2^64 cases at most where they
should not. What a task can settle within its block of documents it settles
before the shuffle, so a passage that fills a third of all documents is one
entry a block in pass 1 and 2. An anchor with many different stretches in one
block (a common line) is not gathered at its anchor: its runs go by their
stretch in pass 2 and window by window in pass 3.

Defined results: null and empty texts have no bytes; null identifiers sort
first; rows that share an identifier are ordered by their text's hash, and of
rows repeated in full the later ones repeat the first; documents shorter than
``LENGTH`` lose nothing; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import in_pieces, session, shuffle_partitions
from .repeats_kernel import Hashes, U, mixed, runs

LENGTH, GRAM = 100, 32
#: Bytes of text in a block, and stretches of one anchor in a block that make it a common one.
BLOCK, COMMON = 2_000_000, 16
NULL_ID = -(1 << 63)

#: A run in pass 1: anchor, stretch, document, first window, place of the anchor, windows, and
#: whether the row stands for a common anchor (2: only tells that it is one).
RUN = np.dtype([("h", "<u8"), ("c", "<u8"), ("doc", "<i8"), ("th", "<i4"), ("p", "<u4"), ("dl", "u1"), ("n", "u1"),
                ("common", "u1")])
#: Repeated windows p to p + n - 1 of a document.
COVER = np.dtype([("doc", "<i8"), ("th", "<i4"), ("p", "<u4"), ("n", "<u4")])
#: A run for pass 3.
OPEN = np.dtype([("doc", "<i8"), ("th", "<i4"), ("p", "<u4"), ("n", "u1"), ("h", "<u8"), ("common", "u1")])
#: A window in pass 3.
WINDOW = np.dtype([("w", "<u8"), ("h", "<u8"), ("doc", "<i8"), ("th", "<i4"), ("p", "<u4")])

ROWS = "bucket int, kind int, body binary"
RUNS, COVERS, OPENS, STRETCHES, WINDOWS = range(5)


def _columns(table: np.ndarray) -> bytes:
    """A structured array field by field, byte plane by byte plane, which compresses well."""
    out = []
    for name in table.dtype.names:
        col = np.ascontiguousarray(table[name])
        out.append(np.ascontiguousarray(col.view(np.uint8).reshape(len(col), -1).T).tobytes())
    return b"".join(out)


def _table(blobs: Iterable[bytes], dtype: np.dtype) -> np.ndarray:
    parts = []
    for blob in blobs:
        n = len(blob) // dtype.itemsize
        out, at = np.empty(n, dtype), 0
        for name in dtype.names:
            kind = dtype[name]
            planes = np.frombuffer(blob, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
            out[name] = np.ascontiguousarray(planes.T).view(kind).ravel()
            at += n * kind.itemsize
        parts.append(out)
    return np.concatenate(parts) if parts else np.empty(0, dtype)


def _dealt(table: np.ndarray, bucket: np.ndarray, kind: int) -> list[tuple[int, int, bytes]]:
    """One packed row for each bucket that has entries."""
    order = np.argsort(bucket, kind="stable")
    table, bucket = table[order], bucket[order]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else []
    return [(int(bucket[a]), kind, _columns(table[a:e])) for a, e in zip(cuts, [*cuts[1:], len(bucket)])]


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
         pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "kind", "body"])


#: A document's bucket: (id * STEP + text hash) mod PRIME mod buckets, alike in numpy and in Spark.
PRIME, STEP = (1 << 31) - 1, 48271


def _doc_bucket(doc: np.ndarray, th: np.ndarray, buckets: int) -> np.ndarray:
    return (doc.astype(np.int64) % PRIME * STEP + th.astype(np.int64) % PRIME) % PRIME % buckets


def _with_bucket(rows: DataFrame, buckets: int) -> DataFrame:
    prime = F.lit(PRIME).cast("long")
    key = F.pmod(F.pmod("doc", prime) * F.lit(STEP).cast("long") + F.pmod(F.col("th").cast("long"), prime), prime)
    return rows.withColumn("bucket", F.pmod(key, F.lit(buckets)).cast("int"))


def _first_of(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where equal keys (sorted together) begin, and the group of each row."""
    new = np.zeros(len(keys[0]), bool)
    if len(new):
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def _later(t: np.ndarray, *keys: str) -> np.ndarray:
    """For ``t`` sorted by keys, then doc, th, p: whether a row's group has an earlier place than its own."""
    begin, group = _first_of(*[t[k] for k in keys])
    first = begin[group]
    return (t["doc"] != t["doc"][first]) | (t["th"] != t["th"][first]) | (t["p"] != t["p"][first])


def _find_runs(rows: list[tuple[int, int, bytes]]) -> np.ndarray:
    """All runs of the windows of (doc, th, bytes) rows, sorted by anchor, stretch, document and place."""
    rows = sorted(rows, key=lambda r: (r[0], r[1]))
    raw = np.frombuffer(b"".join([r[2] for r in rows]), np.uint8)
    ends = np.cumsum([len(r[2]) for r in rows])
    hashes = Hashes(raw)
    start, count, anchor = runs(raw, ends, hashes, LENGTH, GRAM)
    at = np.searchsorted(ends, start, "right")
    t = np.empty(len(start), RUN)
    t["h"] = hashes.of(anchor, anchor + GRAM)
    t["c"] = mixed(hashes.of(start, start + count + (LENGTH - 1)) + ((anchor - start) << 8 | count).astype(U))
    t["doc"] = np.array([r[0] for r in rows], np.int64)[at]
    t["th"] = np.array([r[1] for r in rows], np.int32)[at]
    t["p"] = start - (ends - [len(r[2]) for r in rows])[at]
    t["dl"], t["n"], t["common"] = anchor - start, count, 0
    return t[np.lexsort((t["p"], t["th"], t["doc"], t["c"], t["h"]))]


def _pass_one(buckets: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_pieces(batches, "text", BLOCK):
            texts = b.column(2).cast(pa.binary()).to_pylist()
            t = _find_runs(list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts)))
            again = _later(t, "h", "c")
            begin, _ = _first_of(t["h"], t["c"])
            first = t[begin]
            anchors, group = _first_of(first["h"])
            first["common"] = np.bincount(group, minlength=len(anchors))[group] >= COMMON
            common = first["common"] == 1
            tell = first[anchors][common[anchors]]
            tell["common"] = 2
            sent = np.concatenate([first, tell])
            by = np.concatenate([np.where(common, first["c"], first["h"]), tell["h"]])
            rows = _dealt(sent, (by % U(buckets)).astype(np.int64), RUNS)
            yield _batch(rows + _covers(t[again], buckets))
    return run


def _covers(t: np.ndarray, buckets: int) -> list[tuple[int, int, bytes]]:
    """Repeated windows (each row's p and the n - 1 after it), joined where they touch."""
    if not len(t):
        return []
    t = t[np.lexsort((t["p"], t["th"], t["doc"]))]
    p = t["p"].astype(np.int64)
    stop = p + (t["n"] if "n" in t.dtype.names else 1)
    new = np.ones(len(t), bool)
    new[1:] = (t["doc"][1:] != t["doc"][:-1]) | (t["th"][1:] != t["th"][:-1]) | (p[1:] > stop[:-1])
    at = np.flatnonzero(new)
    out = np.empty(len(at), COVER)
    out["doc"], out["th"], out["p"] = t["doc"][at], t["th"][at], p[at]
    out["n"] = np.maximum.reduceat(stop, at) - p[at]
    return _dealt(out, _doc_bucket(out["doc"], out["th"], buckets), COVERS)


def _by_bucket(settle, buckets: int):
    """``settle`` over each bucket's packed rows, which come sorted by bucket; covers pass through."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, defaultdict(list)
        for b in batches:
            through = []
            for bucket, kind, body in zip(*(c.to_pylist() for c in b.columns)):
                if kind == COVERS:
                    through.append((bucket, kind, body))
                    continue
                if bucket != current:
                    if held:
                        yield _batch(settle(held, buckets))
                    current, held = bucket, defaultdict(list)
                held[kind].append(body)
            if through:
                yield _batch(through)
        if held:
            yield _batch(settle(held, buckets))
    return run


def _settle_runs(held: dict[int, list[bytes]], buckets: int) -> list[tuple[int, int, bytes]]:
    t = _table(held[RUNS], RUN)
    told = np.unique(t["h"][t["common"] == 2])
    t = t[t["common"] != 2]
    t = t[np.lexsort((t["p"], t["th"], t["doc"], t["c"], t["h"]))]
    again = _later(t, "h", "c")
    begin, _ = _first_of(t["h"], t["c"])
    first = t[begin]
    anchors, group = _first_of(first["h"])
    common = (first["common"] == 1) | np.isin(first["h"], told)
    goes_on = common | (np.bincount(group, minlength=len(anchors))[group] > 1)
    out = np.empty(int(goes_on.sum()), OPEN)
    for name in ("doc", "th", "p", "n", "h"):
        out[name] = first[name][goes_on]
    out["common"] = common[goes_on]
    return _covers(t[again], buckets) + _dealt(out, _doc_bucket(out["doc"], out["th"], buckets), OPENS)


def _open_runs(buckets: int):
    def run(docs: pa.Table, opened: pa.Table) -> pa.Table:
        t = _table(opened.column("body").to_pylist(), OPEN)
        rows: list[tuple[int, int, bytes]] = []
        if len(t) and docs.num_rows:
            t = t[np.lexsort((t["p"], t["th"], t["doc"]))]
            begin, _ = _first_of(t["doc"], t["th"])
            where = {(d, h): (a, e) for d, h, a, e in zip(
                t["doc"][begin].tolist(), t["th"][begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(t)])}
            windows, runs_out, bytes_out = [], [], []
            for d, h, text in zip(docs.column("doc").to_pylist(), docs.column("th").to_pylist(),
                                  docs.column("text").cast(pa.binary()).to_pylist()):
                a, e = where.pop((d, h), (0, 0))  # of rows repeated in full the first will do
                if a == e:
                    continue
                own = t[a:e]
                wide = own[own["common"] == 1]
                if len(wide):
                    windows.append(_windows(np.frombuffer(text, np.uint8), wide, wide["p"].astype(np.int64)))
                narrow = own[own["common"] == 0]
                runs_out.append(narrow)
                bytes_out += [text[p:p + n + LENGTH - 1] for p, n in zip(narrow["p"].tolist(), narrow["n"].tolist())]
            if windows:
                w = np.concatenate(windows)
                w = w[np.lexsort((w["p"], w["th"], w["doc"], w["h"], w["w"]))]
                again = _later(w, "w", "h")
                rows += _covers(w[again], buckets)
                first = w[_first_of(w["w"], w["h"])[0]]
                rows += _dealt(first, (first["w"] % U(buckets)).astype(np.int64), WINDOWS)
            if runs_out:
                rows += _stretches(np.concatenate(runs_out), bytes_out, buckets)
        return pa.Table.from_batches([_batch(rows)])
    return run


def _stretches(t: np.ndarray, own: list[bytes], buckets: int) -> list[tuple[int, int, bytes]]:
    """Runs of one anchor's bucket side by side with their bytes."""
    bucket = (t["h"] % U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    t, bucket = t[order], bucket[order]
    begin, _ = _first_of(bucket)
    rows = []
    for a, e in zip(begin.tolist(), [*begin[1:].tolist(), len(t)]):
        body = np.uint32(e - a).tobytes() + _columns(t[a:e]) + b"".join([own[k] for k in order[a:e].tolist()])
        rows.append((int(bucket[a]), STRETCHES, body))
    return rows


def _windows(raw: np.ndarray, t: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Every window of runs ``t``, whose first windows stand at places ``at`` of ``raw``."""
    n = t["n"].astype(np.int64)
    stop = np.cumsum(n)
    step = np.arange(int(stop[-1])) - np.repeat(stop - n, n)
    start = np.repeat(at, n) + step
    out = np.empty(len(start), WINDOW)
    out["w"] = Hashes(raw).of(start, start + LENGTH)
    for name in ("h", "doc", "th"):
        out[name] = np.repeat(t[name], n)
    out["p"] = np.repeat(t["p"].astype(np.int64), n) + step
    return out


def _settle_windows(held: dict[int, list[bytes]], buckets: int) -> list[tuple[int, int, bytes]]:
    parts = [_table(held[WINDOWS], WINDOW)] if held[WINDOWS] else []
    for body in held[STRETCHES]:
        n = int(np.frombuffer(body, "<u4", 1)[0])
        t = _table([body[4:4 + n * OPEN.itemsize]], OPEN)
        raw = np.frombuffer(body, np.uint8, -1, 4 + n * OPEN.itemsize)
        size = t["n"].astype(np.int64) + LENGTH - 1
        parts.append(_windows(raw, t, np.cumsum(size) - size))
    w = np.concatenate(parts)
    w = w[np.lexsort((w["p"], w["th"], w["doc"], w["h"], w["w"]))]
    return _covers(w[_later(w, "w", "h")], buckets)


CUT = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"


def _cut(docs: pa.Table, covers: pa.Table) -> pa.Table:
    t = _table(covers.column("body").to_pylist(), COVER)
    t = t[np.lexsort((t["p"], t["th"], t["doc"]))]
    begin, _ = _first_of(t["doc"], t["th"])
    where = {(d, h): (a, e) for d, h, a, e in zip(
        t["doc"][begin].tolist(), t["th"][begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(t)])}
    seen: set[tuple[int, int]] = set()
    size, offsets, starts, ends, kept = [], [0], [], [], []
    for d, h, text in zip(docs.column("doc").to_pylist(), docs.column("th").to_pylist(),
                          docs.column("text").cast(pa.binary()).to_pylist()):
        if (d, h) in seen and len(text) >= LENGTH:  # a row repeated in full
            spans = [(0, len(text))]
        else:
            a, e = where.get((d, h), (0, 0))
            spans = _joined(t["p"][a:e].astype(np.int64), t["n"][a:e].astype(np.int64)) if e > a else []
        seen.add((d, h))
        at, left = 0, []
        for x, y in spans:
            left.append(text[at:x])
            at = y
        left.append(text[at:])
        size.append(len(text))
        starts += [x for x, _ in spans]
        ends += [y for _, y in spans]
        offsets.append(len(starts))
        kept.append(b"".join(left))
    spans = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(
        [pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["start", "end"]))
    ids = pa.array([None if d == NULL_ID else d for d in docs.column("doc").to_pylist()], pa.int64())
    return pa.Table.from_arrays([ids, pa.array(size, pa.int64()), spans, pa.array(kept, pa.binary())],
                                names=["doc_id", "n_bytes", "spans", "kept"])


def _joined(p: np.ndarray, n: np.ndarray) -> list[tuple[int, int]]:
    """Byte spans of windows p to p + n - 1 (sorted by p), joined where they meet."""
    stop = np.maximum.accumulate(p + n + (LENGTH - 1))
    new = np.ones(len(p), bool)
    new[1:] = p[1:] > stop[:-1]
    at = np.flatnonzero(new)
    return list(zip(p[at].tolist(), stop[np.append(at[1:] - 1, len(p) - 1)].tolist()))


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of ``docs``: doc_id, n_bytes, the repeated spans (an array
    of structs start, end in bytes) and kept (the bytes that remain)."""
    spark = session(docs)
    parts = shuffle_partitions(spark)
    # rows between two passes are packed by bucket: a few times buckets x buckets of them at most
    buckets = parts
    text = F.coalesce(F.col(text_col), F.lit(""))
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))
    # identifiers are unique or rows are told apart by their text as well
    twice = docs.groupBy(F.col(id_col)).count().where("count > 1").limit(1).count() > 0
    th = F.hash(text) if twice else F.lit(0)
    rows = docs.select(doc.alias("doc"), th.cast("int").alias("th"), text.alias("text"))

    found = rows.mapInArrow(_pass_one(buckets), ROWS).repartition(parts, "bucket").sortWithinPartitions("bucket") \
        .mapInArrow(_by_bucket(_settle_runs, buckets), ROWS)
    by_bucket = _with_bucket(rows, buckets)
    opened = by_bucket.groupBy("bucket").cogroup(found.where(F.col("kind") == OPENS).groupBy("bucket")) \
        .applyInArrow(_open_runs(buckets), ROWS)
    windows = opened.repartition(parts, "bucket").sortWithinPartitions("bucket") \
        .mapInArrow(_by_bucket(_settle_windows, buckets), ROWS)
    covers = found.where(F.col("kind") == COVERS).unionByName(windows)
    return by_bucket.groupBy("bucket").cogroup(covers.groupBy("bucket")).applyInArrow(
        _cut, CUT)


def removal_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row."""
    cut = repeated(docs)
    return cut.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
