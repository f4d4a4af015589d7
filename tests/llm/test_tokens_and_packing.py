from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import brute
from brute import crc, tiktoken_encoding, token_ids
from hypothesis import given, settings, strategies as st

from spendlens.llm import bpe, packing, queries, repair_store
from spendlens.llm.tokens import WordEncoder, word_encoder

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"
ODD = st.text(alphabet=st.sampled_from("ab'sS .,\n\t\r  ́\x1c1٣é日Σ🙂<|>"), max_size=40)


@settings(max_examples=400, deadline=None)
@given(ODD)
def test_word_encoder_gives_the_librarys_ids(text):
    for name in (BYTE, WORD):
        enc = _encoder(name)
        assert enc.ids(text).tolist() == token_ids(text, name, 0)[:-1]


def test_every_plain_letter_gives_the_librarys_ids():
    letters = [chr(c) for c in range(0x250) if chr(c).isalpha()]
    for name in (BYTE, WORD):
        enc = _encoder(name)
        for text in ["İstanbul, İ aİb", *(f"{c} {c}stan a{c}b, x{c}{c}! {c}." for c in letters)]:
            assert enc.ids(text).tolist() == token_ids(text, name, 0)[:-1], text


_ENC = {}


def _encoder(name):
    if name not in _ENC:
        _ENC[name] = WordEncoder(public_tokenizers.path(name))
    return _ENC[name]


@settings(max_examples=400, deadline=None)
@given(ODD)
def test_pre_tokens_are_the_librarys(text):
    block = bpe.Block(public_tokenizers.PATTERN)
    block.add(1, text)
    words = list(block.numbers)
    ids = []
    for k in np.frombuffer(block.texts[0], "<u4"):
        ids += tiktoken_encoding()._core_bpe.encode_single_piece(words[k].encode()) if words[k] else []
    assert ids == tiktoken_encoding().encode_ordinary(text)


def check_packing(rows, docs):
    own = {}
    for d, t in docs:
        own.setdefault(d, []).append(token_ids(t, BYTE, 1))
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        assert 0 < r.length <= 2048
        ids = [x for x in own[r.doc_id] if len(x) == r.doc_tokens and crc(x[r.start:r.start + r.length]) == r.ids_crc32]
        assert ids
        by_seq[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append((r.start, r.length))
    for d, all_ids in own.items():
        assert sum(n for _, n in by_doc[d]) == sum(map(len, all_ids))
    padding = 0
    for parts in by_seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding, len(by_seq)


def test_packing_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    padding, n = check_packing(queries.op2_packing(spark, sf).collect(), docs)
    # the method pads only its last windows, for which too few lengths are left: less than two windows' worth
    assert padding < 2 * 2048 and n > 10


def test_packing_edges(spark, edge_docs, no_docs):
    path = public_tokenizers.path(BYTE)
    rows = packing.packed_pieces(edge_docs, path).collect()
    check_packing(rows, [(r.doc_id, r.text) for r in edge_docs.collect()])
    assert packing.packed_pieces(no_docs, path).collect() == []


def test_packed_sequences_hold_the_ids(spark, edge_docs):
    path = public_tokenizers.path(BYTE)
    from spendlens.llm.common import stored
    packed = stored(packing.pack(stored(packing.token_pieces(edge_docs, path), "p")), "packed")
    pieces = defaultdict(list)
    for r in packed.collect():
        pieces[r.sequence_id].append((r.offset, np.frombuffer(r.ids, "<u4").tolist()))
    for r in packing.sequences(packed).collect():
        flat = sum((ids for _, ids in sorted(pieces[r.sequence_id])), [])
        assert r.ids[:r.n_tokens] == flat and not any(r.ids[r.n_tokens:])
        assert len(r.ids) == 2048 or len(r.ids) & (len(r.ids) - 1) == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 9), max_size=20))
def test_windows_use_every_piece_once(counts):
    used = defaultdict(int)
    for combo, times in packing.fill_windows(counts, 64):
        assert times > 0 and sum(n * m for n, m in combo) <= 64
        for n, m in combo:
            used[n] += m * times
    assert used == counts


def test_first_window_is_the_closest_to_capacity():
    # 60 + 3 + 1 fills 64 exactly; first-fit would take 60 + 4 only if it had a 4
    assert packing.fill_windows({60: 1, 3: 1, 1: 1, 2: 0}, 64)[0] == ([(60, 1), (3, 1), (1, 1)], 1)


def expected_store(docs):
    out, start = [], 0
    for d, t in docs:
        ids = token_ids(t, WORD, 2)
        out.append((d, start, len(ids), crc(ids)))
        start += len(ids)
    return out


def test_token_store_query(spark, sf):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert sorted(map(tuple, queries.op3_token_store(spark, sf).collect())) == expected_store(docs)


def test_token_store_edges(spark, edge_docs, no_docs):
    path = public_tokenizers.path(WORD)
    docs = sorted(((r.doc_id, r.text) for r in edge_docs.collect()), key=lambda x: x[0])
    assert sorted(map(tuple, repair_store.through_files(edge_docs, path).collect())) == expected_store(docs)
    assert repair_store.through_files(no_docs, path).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=400), st.integers(0, 400), st.integers(0, 400))
def test_grammar_round_trip_and_random_access(ids, a, b):
    ids = np.array(ids * 5, np.uint32)
    rules, seq = repair_store.compress(ids, 6)
    block = repair_store.StoredBlock(6, rules.astype("<u4").tobytes(),
                                     repair_store.expansion_lengths(rules, 6).astype("<u4").tobytes(), 4,
                                     seq.astype("<u4").tobytes())
    assert (block.ids() == ids).all()
    a, b = sorted((min(a, len(ids)), min(b, len(ids))))
    assert block.ids_between(a, b).tolist() == ids[a:b].tolist()
    assert len(seq) <= len(ids)


def test_grammar_is_smaller_on_repeats():
    ids = np.tile(np.arange(50, dtype=np.uint32), 400)
    rules, seq = repair_store.compress(ids, 50)
    assert len(seq) + 2 * len(rules) < len(ids) / 10


def expected_bpe(docs):
    import hashlib
    out = []
    for d, t in docs:
        ids = tiktoken_encoding().encode_ordinary(t or "")
        raw = tiktoken_encoding().decode_bytes(ids)
        assert raw == (t or "").encode()
        out.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                    hashlib.sha256(raw).hexdigest()))
    return sorted(out)


def test_bpe_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op8_byte_bpe(spark, sf).collect())) == expected_bpe(docs)


def test_bpe_edges(spark, edge_docs, no_docs):
    args = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = [(r.doc_id, r.text) for r in edge_docs.collect()]
    assert sorted(map(tuple, bpe.round_trip(edge_docs, *args).collect())) == expected_bpe(docs)
    assert bpe.round_trip(no_docs, *args).collect() == []


def test_spark_crc_is_zlibs(spark):
    from pyspark.sql import functions as F
    got = spark.range(1).select(F.crc32(F.lit(b"abc"))).first()[0]
    assert got == zlib.crc32(b"abc")


def test_special_tokens_are_the_library_s():
    for name in (BYTE, "word_bpe_49k.json"):
        enc = word_encoder(public_tokenizers.path(name))
        for t in ("a <|endoftext|> b", "<|startoftext|>x y", " a<|endoftext|>  b\n", "<|EndOfText|> a", "< |endoftext|>"):
            assert enc.ids(t).tolist() == brute.tokenizer(name).encode(t, add_special_tokens=False).ids


def test_a_short_rest_goes_into_one_window():
    assert packing.fill_windows({700: 1, 500: 1, 324: 1, 3: 1}) == [([(700, 1), (500, 1), (324, 1), (3, 1)], 1)]
    assert packing.fill_windows({1000: 1, 900: 1, 24: 1}) == [([(1000, 1), (900, 1), (24, 1)], 1)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=11))
def test_windows_equal_plain_minimum_bin_slack(lengths):
    """Each window's total is the largest that any subset with the longest piece left can give."""
    import itertools
    left = sorted(lengths, reverse=True)
    for combo, times in packing.fill_windows({n: lengths.count(n) for n in set(lengths)}, 64):
        for _ in range(times):
            own = [n for n, m in combo for _ in range(m)]
            rest = left[1:]
            best = max(left[0] + sum(s) for k in range(len(rest) + 1) for s in itertools.combinations(rest, k) if left[0] + sum(s) <= 64)
            assert sum(own) == best and own[0] == left[0]
            for n in own:
                left.remove(n)
    assert not left


@settings(max_examples=150, deadline=None)
@given(st.lists(ODD, max_size=6), st.lists(st.sampled_from(
    ["It's", "ÉTÉ,", "été", "a,.b", "NBSP\xa0x", "<|ENDOFTEXT|>", "J̌", "Straße!", ",", "x\ny", ""]), max_size=8))
def test_texts_encoded_together_give_the_librarys_ids(texts, words):
    texts = [*texts, " ".join(words)]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        got = [ids.tolist() for ids in word_encoder(public_tokenizers.path(name)).many(texts)]
        assert got == [brute.tokenizer(name).encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=300), st.sampled_from([4, 49_408, 60_000, 70_000]))
def test_grammar_ends_only_when_no_pair_is_frequent(ids, terminals):
    rules, seq = repair_store.compress(np.array(ids, np.uint32), terminals)
    assert repair_store._expand(seq, rules, terminals).tolist() == ids
    left, last = {}, {}
    for k, pair in enumerate(zip(seq.tolist(), seq.tolist()[1:])):
        if last.get(pair) != k - 1 or pair[0] != pair[1]:
            left[pair], last[pair] = left.get(pair, 0) + 1, k
    assert max(left.values(), default=0) < repair_store.LEAST
