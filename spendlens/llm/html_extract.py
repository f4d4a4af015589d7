"""Main text of pages by a site style tree.

Pages of one host are merged into a tree of styles: a node is a path of
elements (tag and class), and carries how its pages differ. Presentation
importance of a node is the entropy of its child sequences over the host's
pages; content importance of a leaf is one minus the mean entropy of its
features (the blocks of text and link targets it showed), so that what is the
same on every page weighs nothing. A node's importance joins its own with its
leaves', and branches below ``LEAST`` are removed from each page of the host.

Entropy cannot see what a single page or an ever-changing advert is, so the
names of elements speak first: scripts, forms, navigation and the like go
whatever their entropy, unless a branch so named holds the page's main element
or most of its text; where a page has a main element, or articles that hold
most of its text, what stands outside goes. The tree is then what removes repeated blocks inside
(share bars, boilerplate lines) and, where a host uses no such names, the
menus themselves.

The tree is built from the distinct pages of a host: copies of a page (the same
blocks of text, whatever the url) are one, since they say nothing of what a
site repeats. It follows from per-block counts (host, path, feature), so a host that
holds a third of all pages is counted in every task; what the second pass needs
of it is one row a host, its removed paths, joined by size.

Defined results: null and empty html give the empty string; so does a page
without text; pages without a host share one; a host of fewer than
``FEW_PAGES`` distinct pages loses nothing by entropy; repeated rows are one page
of the tree, and each keeps its row; an
empty table gives an empty table; extra columns are carried along unless their
names clash with the result's (text, n_chars), which win.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator
from hashlib import blake2b
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import in_pieces, session, stored

#: Importance below which a branch is removed, weight of a node's own presentation against its
#: leaves, pages of a host that make entropy speak, and depth to which paths are spelt out (below it a
#: path ends in a digest, and repeated blocks go one by one instead of by the branch).
LEAST, GAMMA, FEW_PAGES, DEPTH = 0.2, 0.9, 8, 24
#: Beside articles, a branch with a name of noise (an advert longer than a short article) holds the page's text only
#: if it is so many times theirs.
OUTWEIGHS = 8

# --- fixed values: element names and the words in class, id and role that tell what a branch is ---
DROPPED = frozenset("script style noscript template head title svg math iframe object embed canvas video audio map "
                    "nav footer aside form button input select textarea option menu dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s "
                   "samp small span strike strong sub sup time tt u var wbr".split())
MAIN = frozenset(("article", "main"))
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies "
    "consent notice notices alert gdpr nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside "
    "footer masthead comment comments disqus reply replies respond share sharing social related recommended "
    "recommendations newsletter subscribe subscription signup login popup modal overlay pagination pager widget "
    "widgets tags toolbar skip hidden outbrain taboola complementary contentinfo search".split())
HEADER_WORDS = frozenset("header topbar".split())
#: Words that beside one of the above leave a name what it is (site-footer), as any other word does not (has-sidebar).
NEUTRAL_WORDS = frozenset("site page global top bottom left right primary secondary box block list item container "
                          "wrapper wrap section area bar button buttons link links slot unit row".split())
MAIN_NAMES = frozenset(("main", "articlebody"))

#: Elements that a start tag of the named kind closes when it meets them open.
CLOSED_BY = {
    "p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 "
                   "h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")),
    "tr": frozenset(("tr", "tbody", "tfoot")), "td": frozenset(("td", "th", "tr", "tbody", "tfoot")),
    "th": frozenset(("td", "th", "tr", "tbody", "tfoot")), "option": frozenset(("option",)),
}

MARKUP = re.compile(
    r"<(?:!--.*?(?:-->|\Z)|(?P<raw>script|style|noscript|template|textarea|title)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|[!?][^>]*>|(?P<end>/)?(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>)", re.S | re.I)
NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HREF = re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[a-z0-9]+")


def _named(names: Iterable[str], words: frozenset[str]) -> bool:
    """Whether one of the whole names is one of ``words``, alone or beside neutral ones."""
    for name in names:
        if name in words:
            return True
        parts = [w for w in WORD.findall(name) if not w.isdigit()]
        if not words.isdisjoint(parts) and all(w in words or w in NEUTRAL_WORDS for w in parts):
            return True
    return False


class Element:
    """``suspect`` is why its branch may go (see SUSPECT), ``main`` how far it is the page's main element: 2 by the
    tag main, 1 by article or a name. ``size``, ``story`` and ``holds`` are the text below it, that of it in
    articles, and whether a main tag with text is among it."""
    __slots__ = ("tag", "path", "parent", "suspect", "main", "children", "size", "story", "holds", "dropped", "off")

    def __init__(self, tag: str, path: str, parent: Element | None, suspect: int, main: int):
        self.tag, self.path, self.parent, self.suspect, self.main = tag, path, parent, suspect, main
        self.children: list[str] = []
        self.size = self.story = 0
        self.holds = self.dropped = False
        self.off = bool(suspect or parent and parent.off)


#: Why a branch may go: its tag, its name or a form, a page's header. 0 is not at all.
TAG, NAME, HEADER = 1, 2, 3


class Page:
    """Blocks of text of a page, each with its path, and the child sequence of every element."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, str, bool, int]] = []  # path, text, dropped, in main
        self.nodes: list[tuple[str, str]] = []  # path, child sequence
        self.links: list[tuple[str, str]] = []
        self._text: list[str] = []
        self._stack = [Element("", "", None, 0, 0)]
        self._all = list(self._stack)
        self._found: list[tuple[Element, str]] = []
        at = 0
        for m in MARKUP.finditer(source):
            if m.start() > at:
                self._text.append(source[at:m.start()])
            at = m.end()
            if m["tag"]:
                self._meet(m["tag"].lower(), bool(m["end"]), m["rest"])
        if at < len(source):
            self._text.append(source[at:])
        while len(self._stack) > 1:
            self._close()
        self._flush()
        self._judge()

    def _judge(self) -> None:
        """Which branches go and which are main, once all text is known: a name does not drop a branch that holds
        the page's main element or most of its text."""
        elements, root = self._all, self._all[0]
        for e, text in self._found:
            e.size += len(text)
        for e in reversed(elements):
            if e.size and e.tag in MAIN:
                e.story = e.size
                e.holds = e.holds or e.tag == "main"
            if e.suspect == TAG and not e.holds:
                e.size = e.story = 0
            if e.parent:
                e.parent.size += e.size
                e.parent.story += e.story
                e.parent.holds = e.parent.holds or e.holds
        for e in elements[1:]:
            top = e.parent
            most = e.holds or 2 * e.story > root.story or \
                2 * e.size > root.size and e.size > OUTWEIGHS * (root.story - e.story)
            e.dropped = top.dropped or e.suspect == TAG and not e.holds or e.suspect == NAME and not most \
                or e.suspect == HEADER and not top.main and not most
            e.main = 0 if e.dropped else max(e.main, top.main)
        self.blocks = [(e.path, text, e.dropped, e.main) for e, text in self._found]

    def _flush(self) -> None:
        if self._text:
            raw = "".join(self._text)
            self._text = []
            text = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
            if text:
                self._found.append((self._block(), text))

    def _block(self) -> Element:
        return next((e for e in reversed(self._stack) if e.tag not in INLINE or e.off), self._stack[0])

    def _close(self) -> None:
        gone = self._stack.pop()
        if gone.tag not in INLINE:
            self.nodes.append((gone.path, " ".join(gone.children)))

    def _meet(self, tag: str, end: bool, rest: str) -> None:
        if end:
            if tag == "br":
                self._flush()
            elif any(e.tag == tag for e in self._stack):
                if tag not in INLINE:
                    self._flush()
                elif self._stack[-1].tag != tag and not any(
                        e.tag in INLINE for e in self._stack[self._depth(tag):]):
                    return  # an inline end tag does not close blocks
                elif any(e.tag not in INLINE for e in self._stack[self._depth(tag):]):
                    return
                if self._stack[-1].off:
                    self._flush()
                while self._stack[-1].tag != tag:
                    self._close()
                self._close()
            return
        top = self._stack[-1]
        if tag in VOID:
            if tag not in ("wbr", "img", "input"):
                self._flush()
            return
        if tag not in INLINE:
            self._flush()
            for open_tag, by in CLOSED_BY.items():
                if tag in by:
                    self._close_open(open_tag)
            top = self._stack[-1]
        whole: set[str] = set()
        names = ""
        if rest:
            for _, a, b, c in NAMES.findall(rest):
                whole.update((a or b or c).lower().split())
            words = {w for name in whole for w in WORD.findall(name)}
            names = ".".join(sorted(w for w in words if not w.isdigit()))
            if tag == "a":
                for a, b, c in HREF.findall(rest):
                    self.links.append((self._block().path, a or b or c))
        step = f"{tag}.{names}" if names else tag
        suspect = main = 0
        if tag in DROPPED and tag != "form":
            suspect = TAG
        elif tag == "form" or tag not in ("html", "body", "article", "main") and _named(whole, NOISE_WORDS):
            suspect = NAME
        elif tag == "header" or tag not in ("html", "body") and _named(whole, HEADER_WORDS):
            suspect = HEADER
        if tag == "main":
            main = 2
        elif tag == "article" or tag != "body" and not MAIN_NAMES.isdisjoint(whole):
            main = 1
        if suspect and not top.off:
            self._flush()
        path = top.path
        if tag not in INLINE:
            block = self._block()
            block.children.append(step)
            path = _below_path(block.path, step)
        self._stack.append(Element(tag, path, top, suspect, main))
        self._all.append(self._stack[-1])

    def _depth(self, tag: str) -> int:
        return max(i for i, e in enumerate(self._stack) if e.tag == tag)

    def _close_open(self, tag: str) -> None:
        """Close an open ``tag`` unless an element that keeps its own content stands between."""
        for i in range(len(self._stack) - 1, 0, -1):
            e = self._stack[i]
            if e.tag == tag:
                while len(self._stack) > i:
                    self._close()
                return
            if e.tag not in INLINE and e.tag not in ("td", "th", "tr", "tbody", "thead", "tfoot") or \
                    tag not in ("tr", "td", "th") and e.tag in ("td", "th"):
                return

    def text(self, removed: frozenset[str] = frozenset()) -> str:
        """What is left without the ``removed`` branches."""
        blocks = [(p, t, m) for p, t, dropped, m in self.blocks if not dropped and not _below(p, removed)]
        # articles and names tell the main element if they hold most of what is left, the tag main always
        marked = sum(len(t) for _, t, m in blocks if m)
        least = 1 if marked and 2 * marked >= sum(len(t) for _, t, _ in blocks) else 2
        if any(m >= least for _, _, m in blocks):
            blocks = [b for b in blocks if b[2] >= least]
        return " ".join(t for _, t, _ in blocks)


def _below_path(path: str, step: str) -> str:
    """The path of ``step`` under ``path``; from DEPTH levels on, what follows them is a digest of the whole path,
    so that paths stay short and apart."""
    if path.count("/") < DEPTH:
        return f"{path}/{step}"
    key = blake2b(f"{path}/{step}".encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()
    return f"{path.partition('/#')[0]}/#{key}"


def _below(path: str, removed: frozenset[str]) -> bool:
    if not removed:
        return False
    if path in removed:
        return True
    at = path.rfind("/")
    while at > 0:
        if path[:at] in removed:
            return True
        at = path.rfind("/", 0, at)
    return False


SEEN = "host string, page long, whole long, items array<struct<path: string, kind: int, feature: long>>"
#: Kinds of counts: pages that have a path; a child sequence there; a feature there.
PAGES, SHAPES, FEATURES = range(3)


def _host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1)), F.lit(""))


def _page_items(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a distinct page of a host in each piece: digests of its text blocks and of all that is counted, and
    what it counts for."""
    import xxhash

    def digest(s: str) -> int:
        return xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) - (1 << 63)

    for b in in_pieces(batches, "html", 16_000_000):
        pages: dict[tuple[str, int], tuple[int, list[tuple[str, int, int]]]] = {}
        for host, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            page = Page(source or "")
            own = digest("\n".join(f"{p}\t{t}" for p, t, dropped, _ in page.blocks if not dropped))
            # a page counts once for each path, shape and feature it has
            seen = {(p, SHAPES, digest(c)) for p, c in page.nodes} | {(p, PAGES, 0) for p, _ in page.nodes}
            seen |= {(p, FEATURES, digest(t)) for p, t, dropped, _ in page.blocks if not dropped}
            seen |= {(p, FEATURES, digest("href " + h)) for p, h in page.links}
            items = sorted(seen)
            one = (digest(repr(items)), items)
            pages[host, own] = min(pages.get((host, own), one), one)  # of copies that differ in links, always the same
        flat = [x for _, items in pages.values() for x in items]
        ends = list(accumulate((len(items) for _, items in pages.values()), initial=0))
        items = pa.StructArray.from_arrays(
            [pa.array([x[0] for x in flat], pa.string()), pa.array([x[1] for x in flat], pa.int32()),
             pa.array([x[2] for x in flat], pa.int64())], names=["path", "kind", "feature"])
        yield pa.RecordBatch.from_arrays(
            [pa.array([h for h, _ in pages], pa.string()), pa.array([d for _, d in pages], pa.int64()),
             pa.array([w for w, _ in pages.values()], pa.int64()),
             pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)], names=["host", "page", "whole", "items"])


def style_tree(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, path, pages and importance (0 to 1) of each node of each host's tree."""
    session(pages)
    distinct = pages.select(_host(F.col(url_col)).alias("host"), F.col(html_col).alias("html")) \
        .mapInArrow(_page_items, SEEN) \
        .groupBy("host", "page").agg(F.min_by("items", "whole").alias("items"))
    counted = distinct.select("host", F.explode("items").alias("x")).select("host", "x.*") \
        .groupBy("host", "path", "kind", "feature").agg(F.count(F.lit(1)).alias("n"))
    m = F.max(F.when(F.col("kind") == PAGES, F.col("n")))
    # sums from which both entropies follow once the number of pages m is known
    shape, feature = F.col("kind") == SHAPES, F.col("kind") == FEATURES
    nodes = counted.groupBy("host", "path").agg(
        m.alias("pages"),
        F.sum(F.when(shape, F.col("n"))).alias("shape_n"),
        F.sum(F.when(shape, F.col("n") * F.log2("n"))).alias("shape_nlog"),
        F.count(F.when(shape, 1)).alias("shapes"),
        F.sum(F.when(feature, F.log2("n"))).alias("feature_log"),
        F.count(F.when(feature, 1)).alias("features")).where("pages IS NOT NULL")
    log_m = F.log2(F.greatest(F.col("pages"), F.lit(2)))
    presentation = (F.log2("shape_n") - F.col("shape_nlog") / F.col("shape_n")) / log_m
    # features one minus their mean entropy: log(pages that show it) over log(pages)
    content = F.lit(1.0) - F.col("feature_log") / F.col("features") / log_m
    # a few numbers a node; stored, since both sides of the join below read them
    own = stored(nodes.select("host", "path", "pages", "shapes", "features",
                              F.greatest(F.coalesce(presentation, F.lit(0.0)), F.lit(0.0)).alias("presentation"),
                              F.greatest(content, F.lit(0.0)).alias("content")), "style-nodes")
    # every node's content goes to itself and all branches above, weighed by its features
    above = F.transform(F.sequence(F.lit(2), F.size(F.split("path", "/"))),
                        lambda k: F.array_join(F.slice(F.split("path", "/"), 1, k), "/"))
    leaves = own.where("features > 0 AND path <> ''").select(
        "host", F.explode(above).alias("path"), (F.col("content") * F.col("features")).alias("c"), "features") \
        .groupBy("host", "path").agg((F.sum("c") / F.sum("features")).alias("below"))
    part = F.pow(F.lit(GAMMA), F.col("shapes"))
    return own.join(leaves, ["host", "path"], "left").select(
        "host", "path", "pages", F.when(F.col("below").isNull(), F.col("presentation")).otherwise(
            (1 - part) * F.col("presentation") + part * F.col("below")).alias("importance"))


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` without ``html`` and with text and n_chars."""
    spark = session(pages)
    low = style_tree(pages, url_col, html_col).where(
        (F.col("importance") < LEAST) & (F.col("pages") >= FEW_PAGES) & (F.col("path") != "")) \
        .groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("removed"))
    # one row a host: small beside the pages, and Spark joins it by its stored size
    low = stored(low, "style-tree")
    keep = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    rows = pages.select(F.struct(*keep).alias("row"), F.col(html_col).alias("html"), _host(F.col(url_col)).alias("host"))
    joined = rows.join(low, "host", "left").select("row", "html", "removed")

    def prune(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_pieces(batches, "html", 16_000_000):
            texts = [Page(h).text(frozenset(r or ())) if h else ""
                     for h, r in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["row", "text"])

    schema = joined.select("row", F.lit("").alias("text")).schema
    return joined.mapInArrow(prune, schema).select("row.*", "text", F.length("text").cast("long").alias("n_chars"))
