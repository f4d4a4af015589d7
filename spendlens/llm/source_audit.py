"""Source divergence audit: how far the term shares of a language's sources lie apart.

The matrix of sources by terms is cut into tiles: term columns by hash, source rows by block, every pair of row
blocks of a tile is one task. There it becomes a K-squared tree (``k2_tree``): all-zero
quadrants are priced from the sources' shares of an absent term, the others are walked for both
sources at once. The tiles' sums are added up by pair.

Shares are integers, p = 1 + floor(SCALE (count + SMOOTH) / (N + SMOOTH V)), computed in decimals.

Defined results: null text, language and source are ''; a source without terms has N = 0 and
takes part in pairs; a language of one source has no pairs; repeated rows count as often as
they stand, as documents too; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .collocations_kernel import Numbered
from .common import session, stored
from .k2_tree import row_distances

MIN_DOCS = 30
SMOOTH, SCALE = 5, 1_000_000_000
TOP_TERMS = 50
#: Words of a block before its counts are passed on, term columns of a tile and sources of a row block.
BLOCK_WORDS, TILE_TERMS, ROW_BLOCK = 4_000_000, 8192, 256


def _folding() -> bytes:
    """A-Z to a-z; every other ASCII character but a-z ends a term."""
    table = bytearray(b" " * 128 + bytes(range(128, 256)))
    for c in range(ord("a"), ord("z") + 1):
        table[c] = table[c - 32] = c
    return bytes(table)


_FOLD = _folding()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of blocks of documents, and a row with a null term for each group."""
    groups: dict[tuple[str, str], int] = {}
    number, seqs, owners = Numbered(), [], []
    held = 0

    def flushed() -> Iterator[pa.RecordBatch]:
        nonlocal groups, number, seqs, owners, held
        terms = pa.array([*number, None], pa.binary())
        lengths = np.array([s.size for s in seqs], np.int64)
        seq = np.concatenate(seqs) if seqs else np.zeros(0, np.int64)
        width, owner = len(number) + 1, np.array(owners, np.int64)
        pair, n = np.unique(np.repeat(owner, lengths) * width + seq, return_counts=True)
        # a term once a document: sort (document, term) and keep one each
        once = np.unique(np.repeat(np.arange(lengths.size), lengths) * width + seq)
        docs = np.unique(owner[once // width] * width + once % width, return_counts=True)[1]
        marks = np.arange(len(groups), dtype=np.int64) * width + width - 1
        pair = np.concatenate([pair, marks])
        zeros = np.zeros(marks.size, np.int64)
        langs, sources = pa.array([k[0] for k in groups]), pa.array([k[1] for k in groups])
        at = pa.array(pair // width)
        yield pa.RecordBatch.from_arrays(
            [langs.take(at), sources.take(at), terms.take(pa.array(pair % width)),
             pa.array(np.concatenate([n, zeros])), pa.array(np.concatenate([docs, zeros]))], ["lang", "source", "term", "n", "docs"])
        groups, number, seqs, owners, held = {}, Numbered(), [], [], 0

    for b in batches:
        for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            words = text.as_py().translate(_FOLD).split()
            seqs.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
            owners.append(groups.setdefault((lang, source), len(groups)))
            held += len(words) + 1
            if held >= BLOCK_WORDS:
                yield from flushed()
    if groups:
        yield from flushed()


def _tile(left: pa.Table, right: pa.Table) -> pa.Table:
    """Pair sums of one tile. left: a row for each source of the row blocks; right: cells."""
    if left.num_rows == 0:
        return pa.table({"lang": pa.array([], pa.string()), "i": pa.array([], pa.int64()),
                         "j": pa.array([], pa.int64()), "value": pa.array([], pa.int64())})
    left = left.sort_by("idx")
    idx, zero = left.column("idx").to_numpy(), left.column("p0").to_numpy()
    block, (b1, b2) = left.column("b").to_numpy(), (left.column(c)[0].as_py() for c in ("b1", "b2"))
    row = np.searchsorted(idx, right.column("idx").to_numpy())
    col = np.unique(right.column("id").to_numpy(), return_inverse=True)[1].reshape(-1)
    sums = row_distances(row, col, right.column("p").to_numpy(), zero, left.column("width")[0].as_py())
    i, j = np.triu_indices(idx.size, 1)
    own = np.ones(i.size, bool) if b1 == b2 else (block[i] == b1) & (block[j] == b2)
    i, j = i[own], j[own]
    return pa.table({"lang": pa.array([left.column("lang")[0].as_py()] * i.size, pa.string()),
                     "i": pa.array(idx[i]), "j": pa.array(idx[j]), "value": pa.array(sums[i, j])})


def _share(count: str, total: str, terms: str) -> F.Column:
    return F.expr(f"1 + (cast({SCALE} * cast({count} + {SMOOTH} as decimal(20,0)) as decimal(38,0)) "
                  f"div cast(greatest({total} + {SMOOTH} * {terms}, 1) as decimal(38,0)))")


class Audit:
    """The counts of a table of documents and what follows from them, each a DataFrame.

    ``terms`` (lang, term, id, q): kept terms, in at least ``min_docs`` documents of the language.
    ``groups`` (lang, source, idx, total, p0): all sources, with the share of a term that they lack.
    ``cells`` (lang, source, term, id, n, p): kept terms that a source holds."""

    def __init__(self, docs: DataFrame, min_docs: int = MIN_DOCS, text: str = "text", lang: str = "lang",
                 source: str = "source"):
        session(docs)
        read = docs.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source"),
                           F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
        counts = stored(read.mapInArrow(_counts, "lang string, source string, term binary, n long, docs long")
                        .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")),
                        "audit-counts")
        held = counts.where("term is not null")
        terms = held.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")) \
            .where(F.col("docs") >= min_docs).withColumn("id", F.monotonically_increasing_id())
        terms = stored(terms, "audit-terms")
        self.langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_total"))
        kept = held.drop("docs").join(terms.select("lang", "term", "id"), ["lang", "term"])
        totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = counts.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left") \
            .join(self.langs, "lang", "left").fillna(0, ["total", "v"]) \
            .withColumn("p0", _share("0", "total", "v")) \
            .withColumn("idx", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1)
        self.groups = stored(groups.select("lang", "source", "idx", "total", "v", "p0"), "audit-groups")
        self.cells = stored(kept.join(self.groups.select("lang", "source", "idx", "total", "v"), ["lang", "source"])
                            .withColumn("p", _share("n", "total", "v"))
                            .select("lang", "source", "idx", "term", "id", "n", "p"), "audit-cells")
        self.terms = terms.join(self.langs, "lang").withColumn("q", _share("n", "lang_total", "v")) \
            .select("lang", "term", "id", "q")

    def pairs(self, tile_terms: int = TILE_TERMS, row_block: int = ROW_BLOCK) -> DataFrame:
        """(lang, source, item, value) for every ordered pair of a language's sources."""
        tiles = self.langs.select("lang", F.expr(f"cast(ceil(v / {tile_terms}) as long)").alias("tiles"))
        tile = F.expr("pmod(hash(id), tiles)").cast("long").alias("tile")
        width = self.terms.select("lang", "id").join(tiles, "lang").groupBy("lang", tile).agg(F.count("*").alias("width"))
        blocks = self.groups.groupBy("lang").agg(F.expr(f"max(idx) div {row_block}").alias("last"))
        placed = [F.least("b", "other").alias("b1"), F.greatest("b", "other").alias("b2")]

        def in_blocks(df: DataFrame) -> DataFrame:
            return df.withColumn("b", F.expr(f"idx div {row_block}")).join(blocks, "lang") \
                .withColumn("other", F.explode(F.expr("sequence(0L, last)"))).drop("last").select("*", *placed).drop("other")
        rows = in_blocks(self.groups.select("lang", "idx", "p0").join(width, "lang", "left")
                         .fillna(0, ["tile", "width"]))
        cells = in_blocks(self.cells.select("lang", "idx", "id", "p").join(tiles, "lang").select("lang", "idx", "id", "p", tile))
        key = ["lang", "tile", "b1", "b2"]
        sums = rows.groupBy(*key).cogroup(cells.groupBy(*key)).applyInArrow(_tile, "lang string, i long, j long, value long") \
            .groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
        names = self.groups.select("lang", "idx", "source")
        named = sums.join(names.withColumnsRenamed({"idx": "i", "source": "first"}), ["lang", "i"]) \
            .join(names.withColumnsRenamed({"idx": "j", "source": "second"}), ["lang", "j"])
        both = F.explode(F.array(F.struct(F.col("first").alias("source"), F.col("second").alias("item")),
                                 F.struct(F.col("second").alias("source"), F.col("first").alias("item"))))
        return named.select("lang", both.alias("o"), "value").select("lang", "o.source", "o.item", "value")

    def overused(self, top: int = TOP_TERMS) -> DataFrame:
        """(lang, source, item, value, rank) of the terms whose share in a source
        exceeds the language's most, ``top`` at most for each source."""
        over = self.cells.join(self.terms.select("id", "q"), "id").where("p > q") \
            .select("lang", "source", F.col("term").cast("string").alias("item"), (F.col("p") - F.col("q")).alias("value"))
        return _by_value(over).where(F.col("rank") <= top)


def _by_value(df: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    return df.withColumn("rank", F.row_number().over(order))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, tile_terms: int = TILE_TERMS,
          row_block: int = ROW_BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): pair distances (all) and overused terms (``top``)."""
    a = Audit(docs, min_docs)
    cols = ["lang", "source", "part", "item", "value", "rank"]
    return _by_value(a.pairs(tile_terms, row_block)).withColumn("part", F.lit("pair")).select(*cols) \
        .unionByName(a.overused(top).withColumn("part", F.lit("term")).select(*cols))


ORACLE = """
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS d,
       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT lang, source, d, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS c FROM w GROUP BY lang, term HAVING count(DISTINCT d) >= 30),
l AS (SELECT lang, count(*) AS v, sum(c) AS n FROM k GROUP BY lang),
g AS (SELECT d.lang, d.source, coalesce(any_value(v), 0) AS v FROM d LEFT JOIN l ON d.lang = l.lang GROUP BY ALL),
c AS (SELECT w.lang, w.source, w.term, count(*) AS c FROM w JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
s AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL),
m AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
      1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 5)) // (coalesce(s.n, 0) + 5 * g.v) AS p,
      1 + (1000000000::HUGEINT * (k.c + 5)) // (l.n + 5 * l.v) AS q
      FROM g JOIN k ON k.lang = g.lang JOIN l ON l.lang = g.lang
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
      LEFT JOIN s ON s.lang = g.lang AND s.source = g.source),
f AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, sum(abs(x.p - y.p))::BIGINT AS value
      FROM m x JOIN m y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
      UNION ALL SELECT x.lang, x.source, 'pair', y.source, 0 FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
      WHERE x.v = 0
      UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM m WHERE c > 0 AND p > q)
SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM f)
WHERE part = 'pair' OR rank <= 50
"""
