"""Main text of web pages by a tree-structured graphical model over their DOM nodes.

Every element and every run of text is a node that is content or not. A node has potentials of
its own, weights of its tag, of words in its class, id and role, and of how much text and how many
links it holds; an edge has potentials for the states of parent and child, by the kind of child.
Sum-product messages go from the leaves to the root and back and give every node's marginal
exactly, since the graph is a tree. Runs of text with a marginal of at least one half are kept.

Weights are trained by gradient ascent on the likelihood of labelled pages, where the same
messages give the expectations. Labelled are pages with one ``article`` element: it marks the
main text. At most ``SAMPLE_PAGES`` of them, of at most ``SAMPLE_CHARS`` characters, are used,
those with the smallest hash of their id. They show few kinds of boilerplate, so each is used a
second time with blocks of other kinds planted in and around the article (sidebars, notices,
forms, comments and so on), and a third time with the article under another element.

Blocks are what block elements separate; white space in a block becomes one space, character
references are decoded, blocks are joined by an empty line. The text of scripts, styles and the
page's head is no text. A null or empty page has an empty text; broken markup is read as
browsers do in the main: unclosed elements end with their parents. Without any labelled page
all weights are zero and all text is kept. Rows are independent; repeated rows and clashing
column names make no difference.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.columns import text_slices

SAMPLE_PAGES = 200
SAMPLE_CHARS = 40_000
STEPS = 100
RATE = 0.1
DECAY = 1e-3

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SILENT = frozenset("script style head title template noscript svg math iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main "
    "menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("button caption html body option tbody td tfoot th thead tr legend".split())
# A start tag ends an open element of these kinds, up to the given boundary.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
TAGS = (
    "#text html body div span p a b i em strong u small font br ul ol li dl dt dd table tr td th "
    "h1 h2 h3 h4 h5 h6 article main section aside nav header footer form input button label select "
    "option textarea fieldset figure figcaption img blockquote pre code menu dialog details summary "
    "address hr time cite q sup sub center other"
).split()
TAG_AT = {tag: n for n, tag in enumerate(TAGS)}
WORDS = (
    "ad ads advert advertisement sponsor sponsored promo banner nav navigation menu breadcrumb "
    "breadcrumbs header masthead footer sidebar aside widget related recommended share social "
    "comment comments reply discussion cookie consent notice alert popup modal overlay newsletter "
    "subscribe signup login search form toolbar pagination pager tags copyright legal disclaimer "
    "skip meta byline author content article main post entry story body text"
).split()
WORD_AT = {word: n for n, word in enumerate(WORDS)}
# The words from here on speak for content, those before against it.
CONTENT_FROM = WORDS.index("content")
EXTRAS = ("bias", "boilerplate word", "content word", "length", "links", "share", "in link", "short")
N_FEATURES = len(TAGS) + len(WORDS) + len(EXTRAS)
KINDS = 3  # of an edge, by the child: text, inline element, block element

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")


@dataclass
class Page:
    """The nodes of one page, parents before children."""

    tag: list[int] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    kind: list[int] = field(default_factory=list)
    words: list[tuple[int, ...]] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    block: list[int] = field(default_factory=list)
    linked: list[bool] = field(default_factory=list)
    mark: list[str | None] = field(default_factory=list)  # for labels only

    def add(self, tag, parent, kind, words=(), text=None, block=0, linked=False, mark=None) -> int:
        self.tag.append(TAG_AT.get(tag, TAG_AT["other"]))
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.kind.append(kind)
        self.words.append(words)
        self.text.append(text)
        self.block.append(block)
        self.linked.append(linked)
        self.mark.append(mark)
        return len(self.tag) - 1


def _attributes(source: str) -> tuple[tuple[int, ...], str | None]:
    """The known words of class, id and role, and a label mark."""
    words, mark = set(), None
    if "=" in source:
        for match in _ATTRIBUTE.finditer(source):
            name = match[1].lower()
            value = match[2] if match[2] is not None else match[3] if match[3] is not None else match[4]
            if name in ("class", "id", "role"):
                for part in _PART.findall(value):
                    part = part.lower()
                    if part in WORD_AT:
                        words.add(WORD_AT[part])
            elif name == MARK:
                mark = value
    return tuple(sorted(words)), mark


MARK = "data-label"


def parsed(source: str) -> Page:
    page = Page()
    root = page.add("html", -1, 2)
    stack: list[tuple[str, int]] = [("html", root)]
    silent = links = block = 0

    def close(count: int) -> None:
        nonlocal silent, links, block
        for _ in range(count):
            name, _ = stack.pop()
            silent -= name in SILENT
            links -= name == "a"
            block += name in BLOCK

    def close_within(names: tuple[str, ...], until: tuple[str, ...]) -> None:
        for up, (name, _) in enumerate(reversed(stack)):
            if name in until:
                return
            if name in names:
                close(up + 1)
                return

    def add_text(raw: str) -> None:
        if raw and not silent:
            text = html.unescape(raw) if "&" in raw else raw
            if text:
                page.add("#text", stack[-1][1], 0, text=text, block=block, linked=links > 0)

    at, end = 0, len(source)
    while at < end:
        match = _TOKEN.search(source, at)
        if match is None:
            add_text(source[at:])
            break
        add_text(source[at : match.start()])
        at = match.end()
        name = match[2]
        if name is None:
            if match[0].startswith("<![CDATA["):
                add_text(html.escape(match[0][9:-3]))
            continue
        name = name.lower()
        if match[1]:
            if name == "br":
                add_text(" ")
            elif name in ("html", "body"):
                pass
            elif any(n == name for n, _ in stack[1:]):
                up = next(i for i, (n, _) in enumerate(reversed(stack)) if n == name)
                close(up + 1)
            elif name == "p":
                block += 1
            continue
        if name == "html":
            continue
        if name in CLOSES_P:
            close_within(("p",), ("button", "td", "th", "table", "caption", "div", "li", "article", "section"))
        if name in ENDS:
            close_within(*ENDS[name])
        if name == "body" and any(n == "head" for n, _ in stack):
            close(next(i for i, (n, _) in enumerate(reversed(stack)) if n == "head") + 1)
        if name == "br":
            add_text(" ")
            continue
        block += name in BLOCK
        words, mark = _attributes(match[3])
        node = page.add(name, stack[-1][1], 2 if name in BLOCK else 1, words, mark=mark)
        if name in VOID or (match[3].endswith("/") and name in ("svg", "path", "use")):
            continue
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
            if name not in SILENT:
                stack.append((name, node))
                add_text(source[at : stop.start() if stop else end])
                stack.pop()
            at = stop.end() if stop else end
            continue
        stack.append((name, node))
        silent += name in SILENT
        links += name == "a"
    return page


def blocks_text(page: Page, keep: np.ndarray) -> str:
    """The kept runs of text as blocks."""
    out, last, parts = [], None, []
    for text, block, wanted in zip(page.text, page.block, keep, strict=True):
        if text is None or not wanted:
            continue
        if block != last and parts:
            out.append("".join(parts))
            parts = []
        last = block
        parts.append(text)
    if parts:
        out.append("".join(parts))
    clean = (_SPACE.sub(" ", block).strip() for block in out)
    return "\n\n".join(block for block in clean if block)


@dataclass
class Forest:
    """The nodes of several pages as arrays, with their features."""

    features: np.ndarray
    parent: np.ndarray
    depth: np.ndarray
    kind: np.ndarray
    first: np.ndarray  # of each page, and the end


def forest(pages: list[Page]) -> Forest:
    first = np.cumsum([0, *(len(p.tag) for p in pages)])
    n = int(first[-1])
    joined = lambda name: [x for p in pages for x in getattr(p, name)]
    shift = np.repeat(first[:-1], np.diff(first))
    parent = np.array(joined("parent"), np.int64)
    parent = np.where(parent < 0, -1, parent + shift)
    depth = np.array(joined("depth"), np.int64)
    features = np.zeros((n, N_FEATURES), np.float32)
    features[np.arange(n), joined("tag")] = 1
    extras = features[:, len(TAGS) + len(WORDS) :]
    extras[:, 0] = 1
    for node, words in enumerate(joined("words")):
        for word in words:
            features[node, len(TAGS) + word] = 1
            extras[node, 2 if word >= CONTENT_FROM else 1] = 1
    own = np.array([len(t.strip()) if t else 0 for t in joined("text")], np.float64)
    linked = np.array(joined("linked"), bool)
    length, in_links = own.copy(), np.where(linked, own, 0.0)
    for level in range(int(depth.max(initial=0)), 0, -1):
        at = np.flatnonzero(depth == level)
        np.add.at(length, parent[at], length[at])
        np.add.at(in_links, parent[at], in_links[at])
    page_of = np.repeat(np.arange(len(pages)), np.diff(first))
    whole = length[first[:-1]][page_of] if n else length
    extras[:, 3] = np.log1p(length) / 8
    extras[:, 4] = in_links / np.maximum(length, 1)
    extras[:, 5] = length / np.maximum(whole, 1)
    extras[:, 6] = linked
    extras[:, 7] = length < 25
    return Forest(features, parent, depth, np.array(joined("kind"), np.int64), first)


@dataclass
class Model:
    """Weights of a node being content, and of the states of parent and child by kind of child."""

    own: np.ndarray
    edge: np.ndarray  # (kinds, parent state, child state)

    @classmethod
    def zero(cls) -> Model:
        return cls(np.zeros(N_FEATURES), np.zeros((KINDS, 2, 2)))

    def messages(self, trees: Forest) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of nodes (n, 2) and of edges (n, 2, 2), by two sweeps of messages."""
        n = len(trees.parent)
        potential = np.zeros((n, 2))
        potential[:, 1] = trees.features @ self.own
        edge = self.edge[trees.kind]
        levels = [np.flatnonzero(trees.depth == d) for d in range(int(trees.depth.max(initial=0)) + 1)]
        up = np.zeros((n, 2))
        inside = potential.copy()
        for at in reversed(levels[1:]):
            message = np.logaddexp(edge[at, :, 0] + inside[at, None, 0], edge[at, :, 1] + inside[at, None, 1])
            up[at] = message
            np.add.at(inside, trees.parent[at], message)
        down = np.zeros((n, 2))
        for at in levels[1:]:
            above = trees.parent[at]
            rest = inside[above] + down[above] - up[at]
            down[at] = np.logaddexp(edge[at, 0] + rest[:, 0, None], edge[at, 1] + rest[:, 1, None])
        node = inside + down
        node = np.exp(node - np.logaddexp(node[:, 0], node[:, 1])[:, None])
        pair = np.zeros((n, 2, 2))
        at = np.flatnonzero(trees.parent >= 0)
        above = trees.parent[at]
        rest = inside[above] + down[above] - up[at]
        both = edge[at] + rest[:, :, None] + inside[at][:, None, :]
        both -= both.max(axis=(1, 2), keepdims=True)
        both = np.exp(both)
        pair[at] = both / both.sum(axis=(1, 2), keepdims=True)
        return node, pair


def labels(page: Page) -> np.ndarray:
    """Whether a node is content: below a marked or article element and not below a mark of no."""
    out = np.zeros(len(page.tag), bool)
    article = TAG_AT["article"]
    for node, (tag, parent, mark) in enumerate(zip(page.tag, page.parent, page.mark, strict=True)):
        inside = out[node] = parent >= 0 and out[parent]
        if mark is not None:
            out[node] = mark == "1"
        elif not inside:
            out[node] = tag == article
    return out


# Kinds of boilerplate that are planted into training pages; {} is a text.
PLANTED = (
    '<aside{0} class="sidebar"><h3>{1}</h3><p>{2}</p></aside>',
    '<aside{0}><ul><li><a href="#">{1}</a></li><li><a href="#">{1}</a></li></ul></aside>',
    '<div{0} id="sidebar"><p>{2}</p></div>',
    '<header{0} class="site-header"><h2>{1}</h2><p>{1}</p></header>',
    '<header{0}><a href="/">{1}</a></header>',
    '<div{0} class="header">{1}</div>',
    '<div{0} class="cookie-notice"><p>{2}</p><button>{1}</button></div>',
    '<div{0} class="notice">{2}</div>',
    '<div{0} class="alert banner" role="alert">{2}</div>',
    '<div{0} class="advertisement">{2}</div>',
    '<div{0} class="ad">{2}</div>',
    '<div{0} class="ads sponsored"><p>{2}</p></div>',
    '<div{0} class="promo banner"><a href="#">{1}</a></div>',
    '<form{0} action="/q"><label>{1}</label><input name="q"><button>{1}</button></form>',
    '<form{0} class="newsletter"><p>{2}</p><input type="email"><button>{1}</button></form>',
    '<form{0}><select><option>{1}</option><option>{1}</option></select><textarea>{1}</textarea></form>',
    '<section{0} class="comments"><h2>{1}</h2><div class="comment"><p>{2}</p></div>'
    '<div class="comment"><p>{2}</p></div></section>',
    '<div{0} id="comments"><ol><li><p>{2}</p></li><li><p>{2}</p></li></ol></div>',
    '<ul{0} class="comments"><li>{2}</li><li>{2}</li></ul>',
    '<div{0} class="related"><h4>{1}</h4><ul><li><a href="#">{1}</a></li></ul></div>',
    '<div{0} class="share social"><a href="#">{1}</a> <a href="#">{1}</a></div>',
    '<nav{0} class="breadcrumbs"><a href="#">{1}</a> / <a href="#">{1}</a></nav>',
    '<div{0} class="menu"><ul><li><a href="#">{1}</a></li></ul></div>',
    '<footer{0}><p>{2}</p></footer>',
    '<div{0} class="footer">{2}</div>',
)
HOLDERS = ("<main{0}>|</main>", '<div{0} class="content">|</div>', '<div{0} id="article-body">|</div>',
           '<section{0} class="post entry">|</section>', '<div{0} class="story text">|</div>')


def examples(pages: list[str], seed: int = 5) -> list[str]:
    """The labelled pages, and versions of them with planted blocks and other holders."""
    draw = random.Random(seed)
    short, long = [], []
    for source in pages:
        page = parsed(source)
        for text in page.text:
            text = html.escape((text or "").strip())
            if len(text) >= 60:
                long.append(text[: draw.randrange(60, 400)])
            if text:
                short.append(text[:20])
    short, long = short or ["text"], long or ["some longer text"]

    def block() -> str:
        return draw.choice(PLANTED).format(f' {MARK}="0"', draw.choice(short), draw.choice(long))

    out = []
    for source in pages:
        out.append(source)
        for holder in (None, draw.choice(HOLDERS)):
            match = re.search(r"<article[^>]*>(.*)</article\s*>", source, re.S | re.I)
            if match is None:
                continue
            inner = match[1]
            gaps = [m.end() for m in re.finditer(r"</p\s*>|</h1\s*>", inner, re.I)]
            for gap in sorted(draw.sample(gaps, min(len(gaps), draw.randrange(3))), reverse=True):
                inner = inner[:gap] + block() + inner[gap:]
            around = "<article>|</article>" if holder is None else holder.format(f' {MARK}="1"')
            opening, _, closing = around.partition("|")
            before = "".join(block() for _ in range(draw.randrange(4)))
            after = "".join(block() for _ in range(draw.randrange(4)))
            out.append(
                source[: match.start()] + before + opening + inner
                + "".join(block() for _ in range(draw.randrange(2))) + closing + after
                + source[match.end() :]
            )
    return out


def trained(pages: list[str], steps: int = STEPS) -> Model:
    """Weights for labelled pages: gradient ascent on their likelihood."""
    model = Model.zero()
    read = [parsed(source) for source in examples(pages)]
    if not read:
        return model
    trees = forest(read)
    truth = np.concatenate([labels(page) for page in read]).astype(np.int64)
    inner = np.flatnonzero(trees.parent >= 0)
    seen_own = trees.features.T @ truth.astype(np.float64)
    seen_edge = np.zeros_like(model.edge)
    np.add.at(seen_edge, (trees.kind[inner], truth[trees.parent[inner]], truth[inner]), 1.0)
    params, seen = (model.own, model.edge), (seen_own, seen_edge)
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        node, pair = model.messages(trees)
        expected_edge = np.zeros_like(model.edge)
        np.add.at(expected_edge, trees.kind[inner], pair[inner])
        expected = (trees.features.T @ node[:, 1], expected_edge)
        for p, s, e, m, v in zip(params, seen, expected, first, second, strict=True):
            grad = (s - e) / len(read) - DECAY * p
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            p += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def learned(pages: DataFrame, *, key: str = "page_id", source: str = "html") -> Model:
    """A model trained on a bounded number of the table's pages that have one article."""
    fit = pages.filter(
        F.col(source).rlike(r"(?is)<article[\s>].*</article")
        & (F.length(source) <= SAMPLE_CHARS)
    )
    drawn = fit.select(F.xxhash64(F.col(key)).alias("draw"), F.col(source).alias("source"))
    rows = drawn.orderBy("draw", "source").limit(SAMPLE_PAGES).collect()
    return trained([r.source for r in rows if r.source.lower().count("<article") == 1])


def extract(
    pages: DataFrame,
    model: Model,
    *,
    key: str = "page_id",
    url: str = "url",
    source: str = "html",
) -> DataFrame:
    """``key, url, text, n_chars`` of every page."""
    slim = pages.select(F.col(key), F.col(url), F.col(source).alias("source"))
    schema = slim.select(key, url).schema.add("text", "string").add("n_chars", "long")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_slices(batches, "source"):
            read = [parsed(s or "") for s in rows.column("source").to_pylist()]
            trees = forest(read)
            node, _ = model.messages(trees)
            keep = node[:, 1] >= 0.5 - 1e-9
            texts = [
                blocks_text(page, keep[a:b])
                for page, a, b in zip(read, trees.first[:-1], trees.first[1:], strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    rows.column(1),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                names=schema.names,
            )

    return slim.mapInArrow(work, schema)
