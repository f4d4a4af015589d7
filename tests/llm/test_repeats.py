from __future__ import annotations

import random

import numpy as np
from brute import repeated_bytes
from hypothesis import given, settings, strategies as st

from spendlens.llm import queries, repeats
from spendlens.llm.repeats_kernel import Hashes, runs, window_minima


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert rows(queries.op10_repeats(spark, sf)) == repeated_bytes(docs)


def test_edges(spark, edge_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in edge_docs.collect()]
    assert rows(repeats.removal_report(edge_docs)) == repeated_bytes(docs)
    assert repeats.removal_report(no_docs).collect() == []


def test_passages_lines_copies_and_edges(spark, monkeypatch):
    """Shared passages between differing neighbours, common lines, edited copies, periodic texts, several blocks."""
    monkeypatch.setattr(repeats, "COMMON", 3)
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(2, 7)))
    words = lambda n: " ".join(word() for _ in range(n))
    passages = [words(n) for n in (15, 17, 20, 30, 60, 120)]
    line = words(12)  # shorter than a window: repeats only with its neighbours
    docs = []
    for i in range(160):
        parts = []
        for _ in range(rnd.randint(1, 5)):
            parts.append(rnd.choice([words(rnd.randint(1, 40)), rnd.choice(passages), line, line + " " + line,
                                     rnd.choice(passages)[rnd.randint(0, 40):]]))
        docs.append((i * 7 % 160, " ".join(parts)))
    base = words(200)
    for i in range(200, 260):
        own = base.split(" ")
        own[rnd.randrange(len(own))] = word()
        docs.append((i, " ".join(own)))
    docs += [(300 + i, "ab" * 150 + str(i)) for i in range(5)] + [(400, "z" * 99), (401, "z" * 100), (402, "z" * 101)]
    docs += [(500, base), (500, base), (500, words(50)), (-3, base)]
    for partitions in (1, 7):
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(partitions)
        got = rows(repeats.removal_report(df))
        want = repeated_bytes(docs)
        once = lambda x: [r for r in x if r[0] != 500]
        assert once(got) == once(want)
        # rows that share an identifier have no order but their text's hash: the same in sum
        assert sum(r[2] for r in got) == sum(r[2] for r in want)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=60), st.integers(1, 9))
def test_minima(values, w):
    v = np.array(values, np.uint64)
    assert window_minima(v, w).tolist() == [min(values[i:i + w]) for i in range(len(values) - w + 1)]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(alphabet="ab", max_size=60), max_size=8))
def test_runs_hold_every_window_once(texts):
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.cumsum([len(t) for t in texts]).astype(np.int64) if texts else np.empty(0, np.int64)
    start, count, anchor = runs(raw, ends, Hashes(raw), 12, 4)
    windows = [p for s, n in zip(start.tolist(), count.tolist()) for p in range(s, s + n)]
    want, at = [], 0
    for t in texts:
        want += range(at, at + len(t) - 11)
        at += len(t)
    assert windows == want
    assert all(s + n - 1 <= a <= s + 8 for s, n, a in zip(start.tolist(), count.tolist(), anchor.tolist()))
