"""Main text of web pages by minimum-cut labelling of their blocks.

A page is parsed into blocks: runs of text between block-level tags.  A classifier
gives each block a score for content against boilerplate, from its text (length,
share of link text, sentence ends, ...) and from what encloses it (semantic tags,
roles, words of class and id).  Words are weak evidence that text, an article around
them and neighbours outweigh, unless a whole name says what an element inside an
article is (``ad``, ``notice-box``, ``comments``).  What an element says is weighed against
what it holds: tags of boilerplate around most of a page's prose (an unclosed ``nav``, a ``form``
around the body) say nothing, and a name around most of an article's text is weak again.  The blocks are the nodes of a flow network: a
positive score is the capacity from the source, a negative one that to the sink;
neighbours in page order and blocks with a common parent are joined by smoothness
edges that are the stronger the nearer they are in the tree.  A maximum flow (by
blocking flows on layered residual networks) finds the minimum cut; what stays on the
source's side is content.

The weights of the text features are fitted on a bounded sample of pages: blocks
whose enclosing tags settle what they are (inside article or main; inside nav,
footer, aside, header) serve as labels, and the default weights as prior, so that
few or no labels leave them as they are.

Pages are independent: no shuffle, one page in memory at a time.

Results
-------
One row per row.  A null or empty html, or a page without content, has the empty
text.  White space inside a block (line breaks included) becomes one space; blocks
are joined by two line feeds.  Repeated rows get equal results; other columns are
left out.  Broken markup is read as far as it goes: an unclosed title, button or
list of choices ends at the next block-level tag.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds of tags.
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NO_TEXT = frozenset("script style noscript template title textarea select button svg annotation annotation-xml iframe object canvas audio video".split())
#: What a start tag closes, if open, and the tags that it does not look beyond.
CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)),
          "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}

#: Words of class, id and role that mark boilerplate or content.
BOILERPLATE = frozenset("""ad ads advert adverts advertisement advertisements advertising adsense banner banners sponsor sponsored promo promotion
nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars widget widgets footer footnav masthead topbar toolbar cookie cookies consent gdpr
notice notices alert popup modal overlay newsletter subscribe subscription signup login register paywall share sharing social related recommended
recommendations trending popular comment comments commentlist disqus reply replies respond pagination pager tags legal copyright contentinfo complementary
search searchbox skip""".split())
#: Words that decide if they are a whole name but for fillers, and these fillers.
DECISIVE = BOILERPLATE - frozenset("""legal copyright tags social popular trending search alert related recommended recommendations register
banner banners""".split())
FILLERS = frozenset("box block wrapper wrap container section list area inline bar item unit slot inner outer top bottom left right text body".split())
#: Tags of boilerplate, and tags without text that block-level tags end.
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog".split())
BRIEF = frozenset("title button select textarea".split())
CONTENT = frozenset("article content contents story post entry main body text prose".split())
#: Roles that say as much as a tag, tags whose id is a name to link to, and words after which a class names a layout.
LANDMARKS = frozenset("navigation banner contentinfo complementary search menu menubar dialog alertdialog".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
LAYOUT = frozenset("has with no without hide show".split())
#: Capacities of tags and roles, of a page's header, of an element with words of boilerplate, and of an article.
STRONG, HEADER, WORDS, INSIDE = -8.0, -6.0, -4.0, 3.0
#: Further capacity of a whole name inside an article.
NAMED = -7.0
#: Largest absolute score that text features may give.
TEXT_LIMIT = 4.0
#: Strength of the smoothness edges.
NEAR, SIBLING = 1.6, 0.5

_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
FEATURES = ("bias", "words", "links", "ended", "stops", "heading", "item", "sign")
DEFAULT = np.array([-1.0, 0.8, -4.0, 0.8, 0.5, 0.5, -0.7, -3.0])


@dataclass
class Element:
    tag: str
    depth: int
    parent: Element | None
    prior: float = 0.0
    article: bool = False
    doubted: bool = False
    seed: int = 0
    silent: bool = False
    linked: bool = False
    strong: bool = False
    named: bool = False
    scope: Element | None = None  # the article around it
    #: Characters, characters of links, and blocks that are sentences of prose, in the whole element.
    size: int = 0
    links: int = 0
    prose: int = 0
    #: What the elements around a block add to its prior once all is read, and whether its tags still settle it.
    later: float | None = None
    settled: bool = True

    def weigh(self, page: Element) -> None:
        """Fill ``later`` and ``settled`` from the root down to this element."""
        todo = [self]
        while todo[-1].later is None and todo[-1].parent is not None:
            todo.append(todo[-1].parent)
        for e in reversed(todo):
            if e.later is not None:
                continue
            e.later, e.settled = (e.parent.later, e.parent.settled) if e.parent is not None else (0.0, True)
            if e.strong and 2 * e.size > page.size and 3 * e.links < e.size and e.prose:
                e.later, e.settled = e.later - STRONG, False
            if e.named and e.scope is not None and 2 * e.size <= e.scope.size:
                e.later += NAMED


@dataclass
class Block:
    text: str
    place: Element
    prior: float
    seed: int
    features: list[float] = field(default_factory=list)


def _names(tag: str, attrs: dict[str, str | None], article: bool) -> set[str]:
    """Words of class and role, and of the id unless it only names a heading or a section of an article."""
    keys = ("class", "role") if tag in HEADINGS or tag == "section" and article else ("class", "id", "role")
    out = set()
    for name in " ".join(attrs.get(k) or "" for k in keys).split():
        words = [w.lower() for w in _WORD.findall(name)]
        out.update(words[:next((i for i, w in enumerate(words) if w in LAYOUT), len(words))])
    return out


def _named(tag: str, attrs: dict[str, str | None]) -> bool:
    """Whether a class or, but for headings, the id is a decisive word and fillers."""
    for key in ("class",) if tag in HEADINGS else ("class", "id"):
        for name in (attrs.get(key) or "").split():
            words = {w.lower() for w in _WORD.findall(name)}
            if words & DECISIVE and words <= DECISIVE | FILLERS:
                return True
    return False


class Blocks(HTMLParser):
    """Reads a page into blocks, with a small stack of open elements."""

    RCDATA_CONTENT_ELEMENTS = ()  # an unclosed title does not take the rest of the page

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack = [Element("#root", 0, None)]
        self.found: list[Block] = []
        self.parts: list[str] = []
        self.link_chars = 0
        self.article_found = False

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            place = self.stack[-1]
            while place.tag not in BLOCK and place.parent is not None:
                place = place.parent
            words = text.split(" ")
            self.found.append(Block(text, place, place.prior, place.seed, [
                1.0, float(np.log1p(len(words))), min(1.0, self.link_chars / len(text)), float(text[-1] in ".!?…\"”»"),
                min(1.0, 5.0 * sum(w[-1] in ".,;" for w in words) / len(words)), float(place.tag in HEADINGS),
                float(place.tag in ("li", "td", "th", "dt", "dd")), float("©" in text)]))
            top = self.stack[-1]
            top.size += len(text)
            top.links += min(self.link_chars, len(text))
            top.prose += len(words) >= 8 and text[-1] in ".!?…"
        self.parts, self.link_chars = [], 0

    def close_to(self, index: int) -> None:
        if any(e.tag in BLOCK for e in self.stack[index:]):
            self.flush()
        while len(self.stack) > index:
            gone = self.stack.pop()
            above = self.stack[-1]
            above.size, above.links, above.prose = above.size + gone.size, above.links + gone.links, above.prose + gone.prose

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            if tag == "hr":
                self.flush()
            return
        if tag in BLOCK:
            self.flush()
            brief = next((i for i, e in enumerate(self.stack) if e.tag in BRIEF), 0)
            if brief:
                self.close_to(brief)
            wanted, stops = CLOSES.get(tag, ((), ()))
            for i in range(len(self.stack) - 1, 0, -1):
                open_ = self.stack[i].tag
                if open_ in wanted or open_ == "p" and not any(e.tag in BLOCK for e in self.stack[i + 1:]):
                    self.close_to(i)
                    break
                if open_ in stops or not wanted and open_ in BLOCK:
                    break
        above, attrs = self.stack[-1], dict(attrs)
        own = Element(tag, above.depth + (tag in BLOCK), above, above.prior, above.article, above.doubted, above.seed,
                      above.silent or tag in NO_TEXT, above.linked or tag == "a", scope=above.scope)
        if tag in BLOCK or attrs:
            names = _names(tag, attrs, above.article) if attrs else set()
            role = (attrs.get("role") or "").strip().lower()
            hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in (attrs.get("style") or "").replace(" ", "")
            own.named = tag not in ("body", "html") and _named(tag, attrs)
            if tag in BOILERPLATE_TAGS or hidden or tag not in ("body", "html") and role in LANDMARKS:
                own.prior, own.seed, own.strong = own.prior + STRONG, -1, not hidden
            elif tag == "header" and not own.article:
                own.prior, own.seed = own.prior + HEADER, -1
            else:
                if tag not in ("body", "html") and (own.named or names & BOILERPLATE or "header" in names and not own.article):
                    own.prior, own.doubted, own.seed = own.prior + WORDS, True, min(own.seed, 0)
                if tag in ("article", "main") or role in ("main", "article"):
                    # under doubt, an article after another one is a comment or a teaser rather than the text
                    if not own.article and (not own.doubted or not self.article_found):
                        own.prior += INSIDE
                    own.article = True
                    if not own.named:
                        own.scope = own.scope or own
                    if not own.doubted:
                        self.article_found, own.seed = True, own.seed or 1
                elif tag in BLOCK and tag not in ("body", "html") and names & CONTENT:
                    own.prior += INSIDE / 2
        self.stack.append(own)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                self.close_to(i)
                return
            if tag not in BLOCK and tag not in NO_TEXT and self.stack[i].tag in BLOCK:
                return

    def handle_data(self, data):
        top = self.stack[-1]
        if not top.silent:
            self.parts.append(data)
            if top.linked:
                self.link_chars += len(data.strip())


def blocks(html: str) -> list[Block]:
    """Blocks of a page in order."""
    parser = Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    page = parser.stack[0]
    parser.close_to(1)
    for b in parser.found:
        b.place.weigh(page)
        b.prior += b.place.later
        b.seed = b.seed if b.place.settled else 0
    return parser.found


def tree_distance(a: Element, b: Element) -> int:
    """Steps between two elements in the tree of block-level elements."""
    steps = 0
    while a is not b:
        if a.depth < b.depth or a.depth == b.depth and b.parent is not None and a.parent is None:
            a, b = b, a
        steps += a.tag in BLOCK
        a = a.parent
    return steps


def minimum_cut(scores: Sequence[float], edges: Sequence[tuple[int, int, float]]) -> list[bool]:
    """Whether each node is on the source's side of a minimum cut.

    ``scores``: capacity from the source (positive) or to the sink (negative); ``edges``: undirected capacities.
    Blocking flows on layered networks; every layer of paths is at least one edge longer than the last.
    """
    n = len(scores)
    source, sink = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def join(a: int, b: int, there: float, back: float) -> None:
        head[a].append(len(to))
        to.append(b)
        room.append(there)
        head[b].append(len(to))
        to.append(a)
        room.append(back)
    for i, s in enumerate(scores):
        if s > 0:
            join(source, i, s, 0.0)
        elif s < 0:
            join(i, sink, -s, 0.0)
    for a, b, w in edges:
        join(a, b, w, w)
    least = 1e-9
    while True:
        layer = [-1] * (n + 2)
        layer[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in head[a]:
                if room[e] > least and layer[to[e]] < 0:
                    layer[to[e]] = layer[a] + 1
                    queue.append(to[e])
        if layer[sink] < 0:
            return [layer[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                cut = 0
                for k, e in enumerate(path):
                    room[e] -= flow
                    room[e ^ 1] += flow
                for k, e in enumerate(path):
                    if room[e] <= least:
                        cut = k
                        break
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while at[a] < len(head[a]):
                e = head[a][at[a]]
                if room[e] > least and layer[to[e]] == layer[a] + 1:
                    break
                at[a] += 1
            if at[a] < len(head[a]):
                path.append(head[a][at[a]])
                a = to[path[-1]]
            elif path:
                a = to[path.pop() ^ 1]
                at[a] += 1
            else:
                break


def label(found: Sequence[Block], weights: np.ndarray = DEFAULT) -> list[bool]:
    """Whether each block is content."""
    if not found:
        return []
    text = np.clip(np.array([b.features for b in found]) @ weights, -TEXT_LIMIT, TEXT_LIMIT)
    scores = [float(t) + b.prior for t, b in zip(text, found)]
    edges = []
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            before = found[i - 1].place
            heads = before.tag in HEADINGS and before.parent is b.place.parent  # a heading goes with what follows it
            edges.append((i - 1, i, NEAR if heads else NEAR / (1 + tree_distance(before, b.place))))
        parent = id(b.place.parent)
        if last.get(parent, i - 1) != i - 1:
            edges.append((last[parent], i, SIBLING))
        last[parent] = i
    return minimum_cut(scores, edges)


def main_text(html: str | None, weights: np.ndarray = DEFAULT) -> str:
    """Content blocks of a page, joined by two line feeds."""
    found = blocks(html or "")
    return "\n\n".join(b.text for b, keep in zip(found, label(found, weights)) if keep)


def fit_weights(rows: np.ndarray, labels: np.ndarray, rounds: int = 200, rate: float = 0.5, prior: float = 0.02) -> np.ndarray:
    """Logistic regression by gradient steps, drawn to the default weights."""
    weights = DEFAULT.copy()
    if min((labels > 0).sum(), (labels < 0).sum()) < 20:
        return weights
    y = (labels > 0).astype(float)
    balance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(rows @ weights, -30, 30)))
        weights = weights - rate * (((p - y) * balance) @ rows / len(rows) + prior * (weights - DEFAULT))
    return weights


def fit(pages: DataFrame, sample: int = 300, per_page: int = 40) -> np.ndarray:
    """Weights of the text features from about ``sample`` different pages (by a hash of the html) and at most ``per_page`` blocks of each."""
    n = pages.count()
    picked = (pages.where(F.pmod(F.xxhash64(F.col("html").cast("string"), F.lit(3)), F.lit(max(n, sample)).cast("long")) < sample)
              .select(F.col("html").cast("string").alias("html")).where("html is not null").distinct())

    def run(batches):
        for batch in batches:
            out = []
            for html in batch.column("html").to_pylist():
                settled = [b for b in blocks(html) if b.seed]
                out += [[*b.features, float(b.seed)] for b in settled[::max(1, -(-len(settled) // per_page))]]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.float64()))], names=["row"])
    rows = sorted(r[0] for r in picked.mapInArrow(run, "row array<double>").collect())
    table = np.array(rows, dtype=float).reshape(-1, len(FEATURES) + 1)
    return fit_weights(table[:, :-1], table[:, -1])


def extract(pages: DataFrame, weights: np.ndarray = DEFAULT, html: str = "html", keys: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """``keys``, ``text`` and ``n_blocks`` (blocks before labelling) of every page."""
    slim = pages.select(*keys, F.col(html).cast("string").alias("__html"))
    schema = T.StructType([*slim.schema.fields[:-1], T.StructField("text", T.StringType()), T.StructField("n_blocks", T.LongType())])
    names = list(keys)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts, sizes = [], []
                for page in part.column("__html"):
                    found = blocks(page.as_py() or "")
                    sizes.append(len(found))
                    texts.append("\n\n".join(b.text for b, keep in zip(found, label(found, weights)) if keep))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in names), pa.array(texts, pa.string()), pa.array(sizes, pa.int64())],
                                                 names=schema.names)
    return slim.mapInArrow(run, schema)
