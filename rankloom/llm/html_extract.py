"""Main text of web pages by a site style tree.

The DOMs of a host's pages are merged: an element is known by the tags and classes from the root down to it. For each
element of the merged tree, over all pages of the host, two entropies are computed: of its presentation (which
sequences of child tags it has) and of its content (on how many pages each of its texts stands). A text that is the
same on every page says nothing; a branch whose importance is low is removed from each page, in articles as well. What
an element is by its own name (a menu, a form) comes before what the entropy says, as a host may have only one page; of
articles, main elements and the rest of the page, the importance of their text chooses.

The merged tree is never held anywhere: pages add counts to (host, element, feature) rows, which are summed before and
after one shuffle, and a page is read against the few weak elements of its host.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from rankloom.llm.common import slices, staged

#: Elements of fewer pages are not judged; importance under which a branch goes; weight of presentation in it.
LEAST_PAGES, LOW, PRESENTATION = 3, 0.2, 0.1
#: Importance from which on an element counts in full; share of the text outside articles under which an article beside it is a teaser.
FULL, TEASER = 0.9, 0.25

_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style title textarea noscript template iframe svg math object canvas audio video xmp noframes".split())
_DROP = _RAW | set("nav footer aside form button select menu dialog head datalist fieldset".split())
_MAIN = {"article", "main"}
_DROP_ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
#: Words in class or id that name what is not the article.
_DROP_WORDS = set(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs sidebar footer "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments "
    "disqus replies reply respond related recommended recommendations widget widgets pagination pager toolbar disclaimer masthead topbar skip search".split()
)
#: A start tag of these closes an open element of the same set, up to the element in the third place.
_CLOSES = {t: ({"li"}, {"ul", "ol"}) for t in ("li",)} | {t: ({"dt", "dd"}, {"dl"}) for t in ("dt", "dd")} | {t: ({"td", "th"}, {"tr", "table"}) for t in ("td", "th")} | {"tr": ({"tr"}, {"table"}), "option": ({"option"}, {"select"})}
_NO_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|[^<]+|<", re.S)
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|\Z)", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@lru_cache(4096)
def _element(tag: str, attrs: str) -> tuple[str, bool]:
    """(name in the style tree, dropped for what it is) of an element outside an article."""
    if not attrs or attrs.isspace():
        return tag, tag in _DROP or tag == "header"
    names, drop = [], tag in _DROP or tag == "header"
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            words = [w for w in re.split(r"[^a-z]+", value.lower()) if w]
            if key == "class":
                names = words
            # header is no reason yet: an article may have one
            drop = drop or not _DROP_WORDS.isdisjoint(words)
        elif key == "role":
            drop = drop or value.lower().strip() in _DROP_ROLES
        elif key == "style":
            drop = drop or bool(_HIDDEN.search(value))
        else:
            drop = drop or value.lower() != "false"
    return ".".join([tag, *names]), drop


class _Open:
    """The open elements of a page, with the places of each tag, so that no tag is sought through all of them."""

    def __init__(self) -> None:
        #: tag, path, dropped, article, child tags
        self.stack: list[tuple[str, int, bool, int, list[str]]] = [("", 0, False, 0, [])]
        self.places: dict[str, list[int]] = defaultdict(list)
        self.blocks = [0]
        self.closed: list[tuple[int, int]] = []

    def push(self, tag: str, *rest: object) -> None:
        if tag not in _INLINE:
            self.blocks.append(len(self.stack))
        self.places[tag].append(len(self.stack))
        self.stack.append((tag, *rest))

    def last(self, *tags: str) -> int:
        """The place of the innermost of these tags; 0 if none is open."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def close_to(self, depth: int) -> None:
        """Closes the elements from the innermost out to the one at depth."""
        while len(self.stack) > depth:
            tag, path, _, _, children = self.stack.pop()
            self.places[tag].pop()
            if tag not in _INLINE:
                self.blocks.pop()
            self.closed.append((path, xxhash.xxh64_intdigest(" ".join(children)) >> 1))


def parse(page: str | None) -> tuple[list[tuple[str, int, bool, int]], list[tuple[int, int]]]:
    """(text blocks, elements) of a page.

    A block is (text, element, dropped, number of the outermost article or main it is in or 0); an element is (path, hash of its child tags), once for
    each time it stands on the page. Broken markup is read as browsers do in the common cases: p, li, td and their
    like close each other, an end tag closes what is open inside it, a stray end tag is nothing, a tag that never ends
    is text. Time is in proportion to the page, however deep its elements are or many of its tags broken.
    """
    blocks: list[tuple[str, int, bool, int]] = []
    open_ = _Open()
    stack = open_.stack
    articles = 0
    text: list[str] = []
    at: list[tuple] = []
    skip = ""

    def flush() -> None:
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                blocks.append((joined, at[0][1], at[0][2], at[0][3]))
            text.clear()
            at.clear()

    for m in _TOKEN.finditer(page or ""):
        tag = m[2]
        if tag is None:
            piece = m[0]
            if skip or piece.startswith(("<!", "<?")):
                continue
            if not text:
                at.append(stack[open_.blocks[-1]])
            # what an inline element drops is no part of the block
            if stack[-1][2] and not at[0][2]:
                continue
            text.append(html.unescape(piece))
            continue
        tag = tag.lower()
        if skip:
            if m[1] and tag == skip:
                skip = ""
            continue
        if m[1]:
            if tag == "br" and text:
                text.append(" ")
            depth = open_.last(tag)
            if depth:
                if tag not in _INLINE:
                    flush()
                elif open_.blocks[-1] > depth:
                    continue  # an inline end tag doesn't close blocks
                open_.close_to(depth)
            continue
        if tag not in _INLINE and tag != "br":
            flush()
        if tag in _NO_P:
            paragraph = open_.last("p")
            if paragraph > open_.last("button", "td", "th", "table"):
                open_.close_to(paragraph)
        if tag in _CLOSES:
            same, stop = _CLOSES[tag]
            depth = open_.last(*same)
            if depth > open_.last(*(stop - same)):
                open_.close_to(depth)
        parent = stack[-1]
        parent[4].append(tag)
        if tag == "br":
            if text:
                text.append(" ")
            continue
        if tag in _VOID:
            continue
        if tag in _RAW:
            skip = "" if m[3].endswith("/") and tag in ("svg", "math", "object") else tag
            continue
        name, drop = _element(tag, m[3])
        if tag == "header" and parent[3] and drop:
            drop = _element("div", m[3])[1]
        path = xxhash.xxh64_intdigest(f"{parent[1]}/{name}") >> 1
        article = parent[3]
        if not article and tag in _MAIN and not drop:
            article = articles = articles + 1
        open_.push(tag, path, parent[2] or drop, article, [])
    flush()
    open_.close_to(1)
    return blocks, open_.closed


def host_of(url: str | None) -> str:
    """The host of a URL in lower case, without user, port and a leading www; '' if there is none."""
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return re.sub(r"^www\.", "", m[1].lower()) if m else ""


def main_text(page: str | None, low: frozenset[int] = frozenset(), weak: dict[int, float] | None = None) -> str:
    """The blocks of the main text in page order, joined by an empty line; '' if there is none.

    Low elements go wherever they stand. Of the rest, each article or main element and all text outside of them are
    candidates, which weigh the sum of their characters times importance (`weak`, 1 if not given). If none of the
    articles is outweighed by the text outside, the articles are read; else the text outside, and of the articles those
    that are no teasers beside it. On a page of low elements alone, as of copies of one page, the articles are read.
    """
    blocks, _ = parse(page)
    kept = [(t, path, article) for t, path, drop, article in blocks if not drop and path not in low]
    if not kept:
        return "\n\n".join(t for t, _, drop, article in blocks if article and not drop)
    weights: dict[int, float] = defaultdict(float)
    for t, path, article in kept:
        weights[article] += len(t) * (weak.get(path, 1.0) if weak else 1.0)
    outside = weights.pop(0, 0.0)
    if outside > max(weights.values(), default=0.0):
        chosen = {0} | {article for article, weight in weights.items() if weight >= TEASER * outside}
    else:
        chosen = set(weights)
    return "\n\n".join(t for t, _, article in kept if article in chosen)


def style_tree(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, element, pages, content, presentation, importance) of the merged tree of every host.

    Sums alone: a feature that stands n times, c_j times on page j, has entropy ln(n) - sum(c_j ln c_j) / n, divided by
    the log of the element's pages. Rows are summed by page batch, by task and after the shuffle, so that neither a
    large host nor a frequent text meets one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sums: dict[tuple, list[float]] = defaultdict(lambda: [0, 0.0])
            for url, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                host = host_of(url)
                blocks, elements = parse(page)
                seen = {path for path, _ in elements}
                texts = Counter((path, xxhash.xxh64_intdigest(t) >> 1) for t, path, drop, _ in blocks if not drop)
                kept = {path for path, _ in texts}
                for path in kept & seen:
                    sums[host, path, 0, 0][0] += 1
                for (path, feature), c in texts.items():
                    row = sums[host, path, 1, feature]
                    row[0] += c
                    row[1] += c * math.log(c)
                for path, children in elements:
                    if path in kept:
                        sums[host, path, 2, children][0] += 1
            if sums:
                cols = list(zip(*sums))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64()), pa.array([v[0] for v in sums.values()], pa.int64()), pa.array([v[1] for v in sums.values()], pa.float64())],
                    ["host", "element", "kind", "feature", "n", "s"],
                )

    rows = pages.select(F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    counted = rows.mapInArrow(run, "host string, element long, kind int, feature long, n long, s double")
    counted = counted.groupBy("host", "element", "kind", "feature").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    n = F.col("n").cast("double")
    is_kind = lambda k, value: F.when(F.col("kind") == k, value)
    tree = counted.groupBy("host", "element").agg(
        F.max(is_kind(0, F.col("n"))).alias("pages"),
        F.avg(is_kind(1, F.log(n) - F.col("s") / n)).alias("texts"),
        F.sum(is_kind(2, n)).alias("stood"),
        F.sum(is_kind(2, n * F.log(n))).alias("styles"),
    )
    scale = F.log(F.greatest("pages", F.lit(2)).cast("double"))
    tree = tree.where(F.col("pages").isNotNull()).withColumns({
        "content": F.when(F.col("pages") == 1, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("texts") / scale)),
        "presentation": F.when(F.col("pages") == 1, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.log("stood") - F.col("styles") / F.col("stood")) / scale))),
    })
    tree = tree.withColumn("importance", (1 - PRESENTATION) * F.col("content") + PRESENTATION * F.col("presentation"))
    return tree.select("host", "element", "pages", "content", "presentation", "importance")


def extract(pages: DataFrame, low: float = LOW, least_pages: int = LEAST_PAGES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row; null html is empty, a page without a main text has ''.

    Pages of null or odd URLs share the host ''. Repeated rows and null ids stay. The weak elements of hosts are written
    first; Spark broadcasts them if they are small by its own threshold, and else joins by host with its skew handling.
    """
    tree = style_tree(pages, url_col, html_col)
    judged = tree.where((F.col("pages") >= least_pages) & (F.col("importance") < max(low, FULL)))
    judged = judged.groupBy("host").agg(F.collect_list(F.struct("element", "importance")).alias("weak"))
    judged = staged(judged.select("host", F.col("weak.element").alias("weak"), F.col("weak.importance").alias("importance")), "weak-elements")
    kind = pages.schema[id_col].dataType.simpleString()
    host = F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", "")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"), host.alias("host")).join(judged, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            texts = []
            for page, paths, importance in zip(*(b.column(c).to_pylist() for c in (2, 3, 4))):
                weak = dict(zip(paths or (), importance or ()))
                texts.append(main_text(page, frozenset(p for p, x in weak.items() if x < low), weak))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.select("page_id", "url", "html", "weak", "importance").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
