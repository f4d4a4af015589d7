"""Language ID by rank-order profiles.

A text's n-grams (one to three letters of its lower-cased words, word ends
marked) are ranked by frequency, ties by n-gram; a language's profile is the
ranking of the n-grams of all its training texts. A text goes to the language
whose profile is least out of place: the sum over the text's most frequent
n-grams of the difference in rank, or the profile's length where the n-gram is
not in it.

Training counts cover all training rows (counted per batch, then summed by
n-gram); the model is the profiles, ``PROFILE`` rows a language, whatever the
input's size.

Defined results: a text that is null or has no letter is ``und`` with score 0;
so is every text if there is nothing to learn from; equal distances go to the
language that sorts first; rows are independent of each other, so repeated
rows get equal answers; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import in_pieces, session

#: n-grams in a language's profile, and of a text that are compared.
PROFILE, COMPARED = 1000, 400
UNKNOWN = "und"

_FOLDED: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """Code point -> its lower-case letter, or a space if it is no letter."""
    if not _FOLDED:
        table = np.full(0x110000, 32, np.int64)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _FOLDED.append(table)
    return _FOLDED[0]


def ngram_codes(text: str) -> np.ndarray:
    """All n-grams of a text as sorted integers (21 bits a letter; 32 marks a word's end)."""
    x = _fold()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    x = np.concatenate([[32], x, [32]])
    x = x[np.concatenate([[True], (x[1:] != 32) | (x[:-1] != 32)])]  # runs of no letter are one word end
    letter = x != 32
    two = (x[:-1] << 21) | x[1:]
    three = (two[:-1] << 21) | x[2:]
    codes = np.concatenate([x[letter], two, three[letter[1:-1]]])
    codes.sort()
    return codes


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    codes = ngram_codes(text)
    if not len(codes):
        return codes, codes
    edge = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[edge], np.diff(np.append(edge, len(codes)))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", profile: int = PROFILE) -> dict[str, list[int]]:
    """{language: its n-grams, most frequent first}, from every row of ``docs``
    with a language and a text. The result has ``profile`` n-grams a language."""
    session(docs)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_pieces(batches, "text"):
            by_lang: dict[str, list[str]] = defaultdict(list)
            for t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by_lang[lang].append(t)
            for lang, texts in by_lang.items():
                codes, n = ngram_counts(" ".join(texts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n.astype(np.int64))],
                    names=["lang", "code", "n"])

    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()) \
        .select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")) \
        .mapInArrow(count, "lang string, code long, n long")
    counts = rows.groupBy("lang", "code").agg(F.sum("n").alias("n")).where(F.col("code") != 32)
    w = Window.partitionBy("lang").orderBy(F.col("n").desc(), F.col("code"))
    best = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= profile)
    model: dict[str, list[int]] = {}
    for r in best.orderBy("lang", "rank").toLocalIterator():
        model.setdefault(r["lang"], []).append(r["code"])
    return model


class Profiles:
    def __init__(self, model: dict[str, list[int]], compared: int = COMPARED):
        self.langs = sorted(model)
        self.compared = compared
        self.worst = max((len(v) for v in model.values()), default=0)
        self.codes = np.unique(np.concatenate([np.array(v, np.int64) for v in model.values()] or [np.empty(0, np.int64)]))
        self.ranks = np.full((len(self.codes) + 1, len(self.langs)), -1, np.int64)
        for k, lang in enumerate(self.langs):
            own = np.array(model[lang], np.int64)
            self.ranks[np.searchsorted(self.codes, own), k] = np.arange(len(own))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs:
            return UNKNOWN, 0.0
        codes, n = ngram_counts(text)
        if not len(codes) or codes[-1] < 64:
            return UNKNOWN, 0.0
        top = codes[np.argsort(-n, kind="stable")[:self.compared]]
        at = np.searchsorted(self.codes, top)
        at[at == len(self.codes)] = 0
        known = self.codes[at] == top if len(self.codes) else np.zeros(len(top), bool)
        ranks = self.ranks[np.where(known, at, len(self.codes))]
        apart = np.abs(ranks - np.arange(len(top))[:, None])
        apart = np.where(ranks < 0, self.worst, np.minimum(apart, self.worst)).sum(axis=0)
        k = int(np.argmin(apart))
        return self.langs[k], 1.0 - float(apart[k]) / (self.worst * len(top))


def identify(docs: DataFrame, model: dict[str, list[int]], text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1; 1 is no n-gram out of place), in
    place of columns of these names that were there."""
    from pyspark.sql import types as T
    spark = session(docs)
    docs = docs.drop("lang_pred", "score") if text_col not in ("lang_pred", "score") else docs
    shared = spark.sparkContext.broadcast(model)  # PROFILE n-grams a language
    names = docs.columns
    at = names.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(shared.value)
        for b in in_pieces(batches, text_col):
            found = [profiles.predict(t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                names=[*names, "lang_pred", "score"])

    return docs.mapInArrow(mark, schema)


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from training: crc32 of its identifier as text, mod 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row; learnt from the rows not held out."""
    model = train(docs.where(~held_out()))
    marked = identify(docs.select("doc_id", "text"), model)
    return marked.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


#: Score below which a language does not count as recognised: foreign scripts score 0, strings of random letters up to 0.2,
#: the documents of the training languages 0.6 and more.
MIN_SCORE = 0.3


def recognised(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` with a recognised language, all columns as they
    were. Rejected are null and empty texts, texts without a letter and those whose score is below
    ``min_score``, such as texts in a language or script that was not learned."""
    model = train(docs.where(~held_out()))
    plain = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))
    marked = identify(plain, model)
    return marked.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)).select("row.*")
