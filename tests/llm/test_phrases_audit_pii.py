"""Collocations, the source audit and personal data against plain versions."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from spendlens.llm import collocations, collocations_kernel as CK, k2_tree, pii, pii_kernel as PK, source_audit

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_phrases(rows, least, top, absorbed=100):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 6):
                f[lang].update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        frequent = {w: a for w, a in counts.items() if a >= least}
        longer = defaultdict(list)
        for w, a in frequent.items():
            for i, j in itertools.combinations(range(len(w) + 1), 2):
                if j - i < len(w):
                    longer[w[i:j]].append(a)
        found = []
        for w, a in frequent.items():
            if len(w) < 2 or any(100 * b >= absorbed * a for b in longer[w]):
                continue
            score, k = min((1000 * a * n[lang] // (counts[w[:k]] * counts[w[k:]]), k) for k in range(1, len(w)))
            found.append((-score, -a, " ".join(w).encode(), counts[w[:k]], counts[w[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def phrase_rows(df, top=2000):
    cols = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in collocations.ranked(df, top).select(*cols).collect())


def phrase_docs(seed, n=60):
    rng = random.Random(seed)
    words = ["the", "The", "of", "a", "Ärger", "ñ", "new", "york", "city", "x\x01", "b" * 40, "日本"]
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", " "])
                       for _ in range(rng.randrange(120)))
        rows.append((rng.choice(["en", "en", "de", None]), text))
    rows += [("en", "new york city of the new york city, a a a a a a")] * 40       # copies
    rows += [("en", None), ("en", ""), (None, "..."), ("xx", " \t "), ("de", "A a " * 5000)]
    return rows


@pytest.mark.parametrize("bucket, seed", [(1_000_000, 1), (40, 2)])
def test_collocations_equal_brute_force(spark, bucket, seed):
    rows = phrase_docs(seed)
    docs = spark.createDataFrame([(l, t, 1, "k") for l, t in rows], "lang string, text string, a long, phrase string")
    got = phrase_rows(collocations.collocations(docs.repartition(5), min_count=10, bucket=bucket), 50)
    assert got == brute_phrases(rows, 10, 50)
    assert any(r[3] > 4000 for r in got)


def test_collocations_absorbed_percent(spark):
    rows = phrase_docs(3)
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert phrase_rows(collocations.collocations(docs, min_count=10, absorbed_percent=40)) == brute_phrases(rows, 10, 2000, 40)


def test_collocations_of_no_rows(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(empty).count() == 0
    assert collocations.collocations(spark.createDataFrame([(None, None)], "lang string, text string")).count() == 0


def test_collocations_scores_past_64_bits(spark):
    phrases = spark.createDataFrame([(10**15, 10**13, 2 * 10**13, 10**16)], "a long, l long, r long, n long")
    score = "(cast(1000 * cast(a as decimal(18,0)) * n as decimal(38,0))) div cast(cast(l as decimal(19,0)) * r as decimal(38,0))"
    assert phrases.selectExpr(score).first()[0] == 1000 * 10**15 * 10**16 // (2 * 10**26)


def test_multikey_quicksort_equals_counting():
    rng = np.random.default_rng(5)
    for least in (1, 2, 7):
        seq = np.where(rng.random(800) < 0.15, 0, rng.integers(1, 6, 800)).astype(np.int32)
        cols, weight = CK.merged_windows(seq, 5)
        keys = CK.as_bytes([c.astype(np.int64) for c in cols])
        assert (keys[1:] > keys[:-1]).all()
        got = {tuple(int(c[i]) for c in cols[:m]): n for i, m, n in CK.frequent_prefixes(cols, weight, least)}
        want = Counter()
        for i in range(seq.size):
            for m in range(2, 6):
                w = tuple(seq[i:i + m].tolist())
                if len(w) == m and 0 not in w:
                    want[w] += 1
        assert got == {w: n for w, n in want.items() if n >= least}


def test_byte_planes_round_trip():
    for a in (np.arange(1000, dtype=np.int64) << 33, np.zeros(0, np.int32), np.array([2**31 - 1, 0, 5], np.int32)):
        assert (CK.unpacked(CK.packed(a), a.dtype.type) == a).all()


# --- source audit -------------------------------------------------------------------

def brute_audit(rows, min_docs, top):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        g = (lang or "", source or "")
        groups.add(g)
        terms = re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        counts[g].update(terms)
        docs[g[0]].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, d in docs[lang].items() if d >= min_docs]
        sources = sorted(s for l, s in groups if l == lang)
        v = len(kept)

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * v) for t in kept}
        p = {s: shares(counts[lang, s]) for s in sources}
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])
        q = shares(whole)
        for s in sources:
            pair = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            out += [(lang, s, "pair", o.decode(), -f, k) for k, (f, o) in enumerate(pair, 1)]
            term = sorted((q[t] - p[s][t], t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, "term", t.decode(), -f, k) for k, (f, t) in enumerate(term, 1)]
    return sorted(out)


def audit_rows(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("tiles, block", [(8192, 256), (4, 3)])
def test_audit_equals_brute_force(spark, tiles, block):
    rng = random.Random(tiles)
    words = [f"{c}{d}" for c in "abcÉß" for d in "xyzwXY"] + ["don't", "a1b", "　日本"]
    rows = [(rng.choice(["en", "de", None]), rng.choice(["s0"] * 6 + ["s1", "s2", "s3", "S4", None, "é", "q"]),
             " ".join(rng.choices(words, k=rng.randrange(25)))) for _ in range(150)]
    rows += [("en", "s0", "hot hot hot")] * 30 + [("fr", "alone", "x y z"), ("fr", "both", None), ("en", "bare", "12 34"), ("en", "s1", "ax " * 20000)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, source string, text string, idx long, n long")
    got = audit_rows(source_audit.audit(docs.repartition(4), 8, 5, tiles, block))
    assert got == brute_audit(rows, 8, 5)
    assert ("fr", "alone", "pair", "both", 0, 1) in got


def test_audit_of_no_rows(spark):
    empty = spark.createDataFrame([], "lang string, source string, text string")
    assert source_audit.audit(empty).count() == 0


def test_joint_traversal_equals_dense_sums(monkeypatch):
    rng = np.random.default_rng(3)
    for frontier in (200_000, 5):
        monkeypatch.setattr(k2_tree, "FRONTIER", frontier)
        for rows, width, cells in ((1, 5, 3), (2, 1, 1), (3, 17, 0), (7, 40, 60), (20, 9, 100)):
            at = rng.choice(rows * width, min(cells, rows * width), replace=False)
            value, zero = rng.integers(-9, 10**12, at.size), rng.integers(0, 50, rows)
            dense = np.repeat(zero[:, None], width, axis=1)
            dense[at // width, at % width] = value
            want = np.triu(np.abs(dense[:, None] - dense[None]).sum(axis=2), 1)
            assert (k2_tree.row_distances(at // width, at % width, value, zero, width) == want).all()


# --- personal data ------------------------------------------------------------------

def brute_base(t):
    """The base rules as plain regular expressions."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 12 <= len(d) <= 19 and sum(x if k % 2 == 0 else (2 * x) % 10 + (2 * x) // 10 for k, x in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_base_spans_equal_plain_patterns():
    rng = random.Random(11)
    bits = ["a", "b.c", "@", "x@y.z", "1", "25", "256", "0012", ".", "-", " ", "+", "(", ")", "4111111111111111", "é", "\n", "٣",
            "+1 (487) 555-7209", "1.2.3.4", "%", "_", "@@"]
    for _ in range(4000):
        t = "".join(rng.choices(bits, k=rng.randrange(14)))
        assert PK.base_spans(t) == brute_base(t), t


def test_base_spans_of_hostile_texts_are_fast():
    import time
    for unit in ("a", "1", "+1", "a@", "1.", "@", "(", "1 ", "a.b@c", "+1(((", "a@b."):
        began = time.time()
        PK.base_spans(unit * (400_000 // len(unit)))
        list(PK.islands(unit * (400_000 // len(unit))))
        assert time.time() - began < 5, unit


def all_segmentations(n, found):
    by_start = defaultdict(list)
    for i, d, f in found:
        by_start[i].append((d, f))

    def go(t):
        if t == n:
            yield []
            return
        yield from go(t + 1)
        for d, f in by_start[t]:
            for k in range(len(PK.KINDS)):
                for rest in go(t + d):
                    yield [(t, d, k, f), *rest]
    return go(0)


def test_decoding_equals_all_segmentations():
    rng = np.random.default_rng(2)
    for _ in range(20):
        weights = rng.normal(size=(PK.N_FEATURES, len(PK.KINDS)))
        n = 6
        found = [(i, d, rng.choice(PK.N_FEATURES, 3, replace=False).tolist())
                 for i in range(n) for d in range(1, 4) if i + d <= n and rng.random() < 0.5]
        score = lambda s: sum(weights[f][:, k].sum() for _, _, k, f in s)
        ways = list(all_segmentations(n, found))
        z = sum(np.exp(score(s)) for s in ways)
        best = max(ways, key=score)
        got = PK.decode(n, found, weights)
        assert [x[:3] for x in got] == [x[:3] for x in best]
        for i, d, k, p in got:
            assert p == pytest.approx(sum(np.exp(score(s)) for s in ways if (i, d, k) in [x[:3] for x in s]) / z)


def test_fit_raises_the_likelihood_of_gold_segmentations():
    rows = [(f"call +1 (48{a}) 555-72{b:02d} or", 0, 25, "3:5:22") for a in range(10) for b in range(4)]
    rows += [(f"see 12{a}.7.8.{b} now", 0, len(f"see 12{a}.7.8.{b} now"), f"1:4:{4 + len(f'12{a}.7.8.{b}')}") for a in range(10) for b in range(4)]
    weights = PK.fit(pii.examples(rows))
    assert (weights != 0).any()
    spans = pii.spans_of("dial (212) 555-0100 today", weights)
    assert [(s, PK.KINDS[k], e, base) for s, k, e, base, _ in spans] == [(5, "phone", 19, False)]
    assert pii.spans_of("on 2021-05-17 at 10:30", weights) == []


def test_personal_data_over_edge_rows(spark, edge_docs, no_docs):
    more = spark.createDataFrame(
        [(900 + i, f"mail des.3{i}@mail{i}.example.com or 4111 1111 1111 1111 10.0.0.{i} call +1 (48{i}) 555-720{i}", None, None, 0, 0, "k", 0)
         for i in range(9)] + [(950, "9" * 5000 + " " + "1 2 " * 3000, None, None, 0, 0, "k", 0),
                               (951, "two 4111111111111111 4111111111111111 in a row", None, None, 0, 0, "k", 0)], edge_docs.schema)
    docs = edge_docs.unionByName(more).repartition(3)
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = pii.digest(pii.personal_data(docs)).collect()
    assert len(got) == len(texts)
    by_id = {r["doc_id"]: r for r in got}
    for i, t in texts:
        base = brute_base(t or "")
        listed = [f"{PK.KINDS[k]}:{s}:{e}" for s, k, e in base]
        r = by_id[i]
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PK.KINDS] == [sum(x.startswith(k + ":") for x in listed) for k in PK.KINDS]
        assert set(listed) <= set(r["spans"].split(",")) | set([""] if not listed else [])
    assert by_id[951]["n_card"] == 0       # one run of 32 digits to the base rule
    assert pii.personal_data(no_docs).count() == 0
    assert pii.digest(pii.find(edge_docs)).count() == edge_docs.count()


def test_held_out_rule_spans_are_found(spark, sf):
    """Trained on half of the islands, the field finds the other half's rule-made spans without the rules."""
    rows = pii.training_islands(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    weights = PK.fit(pii.examples(rows[::2]))
    hit = want = wrong = 0
    for snippet, begin, stop, labels in rows[1::2]:
        gold = {tuple(map(int, x.split(":"))) for x in labels.split(",") if x}
        at, found = PK.segments(snippet, begin, stop)
        got = {(k, at[i], at[i + d]) for i, d, k, p in PK.decode(len(at) - 1, found, weights) if p >= 0.5}
        hit, want, wrong = hit + len(gold & got), want + len(gold), wrong + len(got - gold)
    assert want > 200 and hit >= 0.9 * want and wrong <= 0.05 * want, (hit, want, wrong)
