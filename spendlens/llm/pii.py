"""Personal data: rule-made base spans, and further spans by a semi-Markov
conditional random field (``pii_kernel``).

The field scores whole candidate segments (digit count and grouping, check digit, separators, an address's
parts, the characters and the cue word beside it) and a dynamic program over an island (a run
of words that hold a digit or an at sign, with their neighbours) chooses boundaries and kinds together; an entity has ``MAX_TOKENS`` tokens at
most, all else is outside. It is trained on a bounded sample of islands labelled by the
base rules, with the labelled spans also written in forms that those rules miss (no plus sign,
other separators, a spelled at sign) and as near misses (a wrong check digit, an address part over 255, dates, amounts, book numbers).

Base spans are always kept. A segment is added where its posterior is at least
``MIN_POSTERIOR`` and no base span overlaps it.

Defined results: null and empty texts have no spans; repeated rows are found
each for itself; an empty table gives no rows, and a corpus without base spans no added ones;
offsets are code points, the end is exclusive; further columns are not read. A very long text is read whole, in time
linear in its length, by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import pii_kernel as K
from .common import in_pieces, session

MIN_POSTERIOR = 0.9
#: Islands that the fit reads at most for each set of kinds (16 sets), those of smallest hash; and their longest.
FIT_ISLANDS, ISLAND_CHARS = 250, 300
_LEFT = 24      # characters before an island that its features may see

_SPANS = "array<struct<kind: string, start: long, end: long, base: boolean, posterior: double, value: string>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()),
                                 ("posterior", pa.float64()), ("value", pa.string())]))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Islands with the base spans inside them, as offsets in the snippet."""
    for b in batches:
        snippets, begins, sizes, labels = [], [], [], []
        for text in b.column(0).to_pylist():
            if not text or not (found := K.islands(text)):
                continue
            base = K.base_spans(text)
            for start, end in found:
                if end - start > ISLAND_CHARS:
                    continue
                left = max(0, start - _LEFT)
                snippets.append(text[left:end + 1])
                begins.append(start - left)
                sizes.append(end - left)
                labels.append(",".join(f"{k}:{s - left}:{e - left}" for s, k, e in base if start <= s and e <= end))
        yield pa.RecordBatch.from_arrays([pa.array(snippets, pa.string()), pa.array(begins, pa.int64()),
                                          pa.array(sizes, pa.int64()), pa.array(labels, pa.string())],
                                         ["snippet", "begin", "stop", "labels"])


def _kinds(labels: str) -> str:
    return f"array_join(array_sort(array_distinct(transform(split({labels}, ','), x -> split_part(x, ':', 1)))), '')"


def training_islands(docs: DataFrame, text: str = "text", islands: int = FIT_ISLANDS) -> list[tuple]:
    """Distinct islands of the corpus, ``islands`` at most for each set of kinds
    in them (the four kinds make 16 sets), as (snippet, begin, stop, labels)."""
    session(docs)
    found = docs.select(F.col(text).alias("text")).where("text rlike '[0-9@]|[(\\\\[]at[)\\\\]]'") \
        .mapInArrow(_sampled, "snippet string, begin long, stop long, labels string").distinct() \
        .withColumn("kinds", F.expr(_kinds("labels"))).withColumn("h", F.xxhash64("snippet", "begin"))
    order = Window.partitionBy("kinds").orderBy("h", "snippet", "begin", "stop", "labels")
    rows = found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= islands).collect()
    return sorted((r["snippet"], r["begin"], r["stop"], r["labels"]) for r in rows)


def _variants(kind: int, s: str) -> tuple[list[str], list[str]]:
    """Other ways to write a span, and strings near to it that are none."""
    digits = "".join(c for c in s if c.isdigit())
    if kind == 0:
        name, _, host = s.partition("@")
        return [f"{name}{at}{host}" for at in (" @ ", " (at) ", "(at)", "[at]", " [at] ")], [host, f"{name}@{host.split('.')[0]}"]
    if kind == 1:
        parts = s.split(".")
        return [], [".".join(parts[:3]), ".".join(["3" + parts[0].zfill(2)[-2:], "987", *parts[2:]]), s + ".1"]
    if kind == 2:
        fours = [digits[k:k + 4] for k in range(0, len(digits), 4)]
        wrong = digits[:-1] + str((int(digits[-1]) + 1) % 10)
        return [".".join(fours), "  ".join(fours), "/".join(fours)], [wrong, " ".join(wrong[k:k + 4] for k in range(0, len(wrong), 4)), digits[:9]]
    local = digits[-10:]
    a, b, c = local[:-7], local[-7:-4], local[-4:]
    return [s.lstrip("+"), f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{digits[:-7]} {b} {c}"], \
        [f"20{b[:2]}-0{b[2]}-1{c[0]}", f"{b}-{c}", f"1{a[:2]},{b},{c[:3]}.{c[3]}0", f"{b}.{c}", f"19{c[:2]}-20{c[2:]}", f"1{b[0]}:{c[:2]}-1{b[1]}:{c[2:]}", local,
         f"978-{b[0]}-{a[:2]}-{b}{a}-{c[0]}", f"978-{a}-{b}-{c[:2]}-{c[2]}", f"{a}{b[:1]}-{c}", f"{b}/{c}/{a}"]


def examples(rows: list[tuple]) -> list[tuple]:
    """Training examples (tokens, segments, gold segments) from sampled islands and their variants."""
    out = []

    def one(text: str, begin: int, stop: int, spans: list[tuple[int, int, int]]) -> None:
        at, found = K.segments(text, begin, stop)
        if len(at) - 1 > K.FIT_TOKENS:
            return
        place = {p: k for k, p in enumerate(at)}
        gold = {}
        for kind, s, e in spans:
            if s not in place or e not in place or place[e] - place[s] > K.MAX_TOKENS:
                return
            gold[place[s], place[e] - place[s]] = kind
        if gold.keys() <= {(i, d) for i, d, _ in found}:
            out.append((len(at) - 1, found, gold))

    for snippet, begin, stop, labels in rows:
        spans = [tuple(map(int, x.split(":"))) for x in labels.split(",") if x]
        kept = [s for s in spans if not any(o[1] < s[2] and s[1] < o[2] and o != s for o in spans)]
        if len(kept) < len(spans):
            continue
        one(snippet, begin, stop, spans)
        if len(spans) == 1:
            kind, s, e = spans[0]
            good, bad = _variants(kind, snippet[s:e])
            for new in good + bad:
                text = snippet[:s] + new + snippet[e:]
                one(text, begin, stop + len(new) - (e - s), [(kind, s, s + len(new))] if new in good else [])
    return out


def fitted(docs: DataFrame, text: str = "text", islands: int = FIT_ISLANDS) -> np.ndarray:
    """The field's weights, trained on the driver from ``training_islands``."""
    return K.fit(examples(training_islands(docs, text, islands)))


def spans_of(text: str | None, weights: np.ndarray | None, least: float = MIN_POSTERIOR) -> list[tuple[int, int, int, bool, float]]:
    """(start, kind, end, base, posterior) of one text, in order of start and kind."""
    if not text:
        return []
    base = K.base_spans(text)
    out = [(s, k, e, True, 1.0) for s, k, e in base]
    if weights is not None and weights.any():
        held = sorted((s, e) for s, _, e in base)
        for start, end in K.islands(text):
            at, found = K.segments(text, start, end)
            if not found:
                continue
            for i, d, kind, p in K.decode(len(at) - 1, found, weights):
                s, e = at[i], at[i + d]
                if p >= least and not any(a < e and s < b for a, b in _near(held, s, e)):
                    out.append((s, kind, e, False, p))
    return sorted(out)


def _near(held: list[tuple[int, int]], start: int, end: int) -> list[tuple[int, int]]:
    """Base spans that begin before ``end``, back to those that cannot reach ``start``."""
    from bisect import bisect_left
    k = bisect_left(held, (end, 0))
    return held[max(0, k - 8):k]


def find(docs: DataFrame, weights: np.ndarray | None = None, doc_id: str = "doc_id", text: str = "text",
         min_posterior: float = MIN_POSTERIOR) -> DataFrame:
    """(doc_id, spans) of every row; spans in order of start and kind, each with its text. Without weights, base spans alone."""
    session(docs)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_pieces(batches, "text"):
            out = []
            for t in b.column(1).to_pylist():
                out.append([{"kind": K.KINDS[k], "start": s, "end": e, "base": base, "posterior": p, "value": t[s:e]}
                            for s, k, e, base, p in spans_of(t, weights, min_posterior)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, _SPAN_TYPE)], ["doc_id", "spans"])
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, spans {_SPANS}")


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): counts and digest of the base spans, all spans as text."""
    def listed(spans: Column) -> Column:
        return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))
    base = F.filter("spans", lambda x: x["base"])
    counts = [F.expr(f"cast(size(filter(spans, x -> x.base and x.kind = '{k}')) as long)").alias(f"n_{k}") for k in K.KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", islands: int = FIT_ISLANDS) -> DataFrame:
    """``find`` over every row, with a field trained on the same documents."""
    return find(docs, fitted(docs, text, islands), doc_id, text)
