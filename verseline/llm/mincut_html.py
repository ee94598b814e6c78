"""Main-text extraction by a minimum cut over a page's text blocks.

A page is cut into text blocks.  A linear classifier, fitted on the blocks' own
features, and what the elements around a block say of it give its log-odds of
being content; their positive part is the block's capacity from the source,
their negative part that to the sink.  Neighbouring blocks, and blocks that
follow each other under one parent, are tied by smoothness edges whose capacity
falls with their distance in the element tree.  The minimum cut labels the
blocks: those on the source's side are content.  So a short line between
paragraphs goes with them, and a sentence among links with those.

Parsing takes one pass and time in proportion to the page, however deep its
elements nest and whatever is left unclosed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verseline.llm.tables import bound_batches, lean

TOKEN = re.compile(r"""<!--(?:.*?)(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>"']|"[^"]*"|'[^']*')*+)>|<(?=/?[a-zA-Z])[^>]*(?:>|\Z)""", re.DOTALL)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
PART = re.compile(r"[a-z]+")

#: elements whose content is no text of the page; without an end tag the first kind lasts to the page's end, the others
#: to the next block
RAW_TO_END = {"script", "style", "textarea", "title", "iframe"}
RAW = RAW_TO_END | {"noscript", "template", "svg", "math", "object", "select", "head", "canvas", "video", "audio", "button"}
#: elements that begin and end a block
BLOCK = {*"address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()}
VOID = {*"area base br col embed hr img input link meta source track wbr".split()}
HEADINGS = {f"h{i}" for i in range(1, 7)}
PROSE = {"p", "pre", "blockquote"}
ITEMS = {"li", "td", "th", "dt", "dd", "legend", "caption", "figcaption", "summary"}
#: an open element that a new one ends, up to a container
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
CONTAINERS = {"ul", "ol", "menu", "dl", "table", "tbody", "thead", "tfoot"}

#: what an element, or a word in its class, id or role, says of the text in it: from -1, boilerplate, to 1, content
ELEMENT = {"article": 1.0, "main": 0.7, "nav": -1.0, "footer": -1.0, "aside": -1.0, "form": -1.0, "menu": -0.8, "dialog": -1.0, "search": -1.0, "fieldset": -0.5, "address": -0.3}
#: a page header, but not one inside the article, which holds its headline
HEADER = -1.0
GOOD_WORDS = {*"article content entry post story main text body".split()}
COMMENTS = {*"comment comments reply replies disqus".split()}
BAD_WORDS = COMMENTS | {*"ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notification alert menu nav navigation navbar breadcrumb breadcrumbs sidebar footer share sharing social related recommended popup modal overlay subscribe subscription newsletter signup login widget toolbar pagination pager copyright legal disclaimer skip hidden masthead topbar complementary contentinfo form search".split()}
#: class names that tell of a page's layout or state, and elements whose class does
STATE = re.compile(r"^(?:has|no|with|without|not|js)-|-(?:open|opened|closed|enabled|disabled|xs|sm|md|lg|xl|free|less)$")
OUTER = {"html", "body", "main", "article"}
#: elements that are what their name says; a form can hold the whole page, and class names are anything
SURE = {"nav", "footer", "aside", "header", "menu", "dialog", "search"}
#: any other bad container counts less if it holds most of the prose outside of sure ones, at least so many blocks of it,
#: and no good container outside of it has any: a page's text does not stand in its advert, so the name misleads then.
#: Comments can well be longer than the article
MANY, MOST, MOST_COMMENTS = 3, 0.6, 0.9

#: log-odds for features of a block: where fitting starts from, and what ``fit`` made of the 2,500 pages at sf0.1
FEATURES = ("constant", "length", "links", "stop", "heading", "prose", "item", "copyright")
PRIOR = (-0.5, 1.5, -4.0, 0.7, 0.3, 0.7, -0.5, -3.0)
WEIGHTS = (-0.32, 1.79, -4.14, 0.66, 0.49, 1.18, -0.55, -3.31)
#: log-odds that what surrounds a block adds at most, and that its own features do
GOOD, BAD, OWN = 2.5, 6.0, 4.0
#: capacity of a tie at distance 0, in log-odds; it falls with 1 / (1 + distance)
TIE, NEAR = 3.0, 1.5
#: capacities are whole numbers
SCALE = 1000


class Block:
    """A text block: its features, where it stands, and the container that speaks of it."""

    __slots__ = ("text", "features", "element", "parent", "steps", "mark")

    def __init__(self, text: str, features: tuple[float, ...], element: int, parent: int, steps: int, mark: int):
        self.text, self.features = text, features
        #: numbers of its element and of that element's parent
        self.element, self.parent = element, parent
        #: tree steps from the block before
        self.steps = steps
        #: place in the page's marks
        self.mark = mark


class Mark:
    """A container with a say: how much (-1 to 1), whether that is sure, the mark around it, and the blocks that it holds."""

    __slots__ = ("says", "sure", "comments", "outer", "first", "end")

    def __init__(self, says: float, sure: bool, comments: bool, outer: int, first: int):
        self.says, self.sure, self.comments, self.outer, self.first, self.end = says, sure, comments, outer, first, None


def _says(name: str, attributes: str, in_article: bool) -> tuple[float, bool]:
    """(what an element says of its text, whether it holds comments)."""
    says, comments = ELEMENT.get(name, 0.0), False
    if name == "header" and not in_article:
        says = HEADER
    if not attributes:
        return says, False
    good = bad = False
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if key in ("class", "id", "role"):
            if name in OUTER:
                continue
            for token in HUMP.sub("-", value).lower().split():
                if not STATE.search(token):
                    parts = PART.findall(token)
                    comments = comments or not COMMENTS.isdisjoint(parts)
                    bad = bad or not BAD_WORDS.isdisjoint(parts)
                    good = good or not GOOD_WORDS.isdisjoint(parts)
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", "").lower():
            bad = True
    if bad:
        return min(says, -1.0), comments
    return (max(says, 0.4) if good and says >= 0 else says), comments


class _Page:
    """The parser's state: open block elements, text and marks."""

    def __init__(self):
        self.blocks: list[Block] = []
        self.marks: list[Mark] = [Mark(0.0, False, False, 0, 0)]
        #: open block elements: (name, number, mark, inside an article)
        self.stack: list[tuple[str, int, int, bool]] = [("", 0, 0, False)]
        #: where in the stack elements of a name stand, and containers
        self.open: dict[str, list[int]] = {}
        self.containers: list[int] = []
        self.parts: list[str] = []
        self.linked = self.number = self.last = 0
        #: the least depth since the last block
        self.low = 1
        self.link = False
        #: inside an unclosed element whose content is no text
        self.mute = False

    def say(self, piece: str) -> None:
        if self.mute:
            return
        self.parts.append(piece)
        if self.link:
            self.linked += len(piece.strip())

    def close_block(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts.clear()
            if text:
                name, number, mark, _ = self.stack[-1]
                depth = len(self.stack)
                self.low = min(self.low, depth)
                parent = self.stack[-2][1] if depth > 1 else -1
                self.blocks.append(Block(text, block_features(text, self.linked, name), number, parent, self.last - self.low + depth - self.low, mark))
                self.last = self.low = depth
        self.linked = 0
        self.mute = False

    def push(self, name: str, attributes: str) -> None:
        _, _, mark, inside = self.stack[-1]
        self.number += 1
        says, comments = _says(name, attributes, inside)
        if says:
            self.marks.append(Mark(says, says < 0 and name in SURE, comments, mark, len(self.blocks)))
            mark = len(self.marks) - 1
        self.open.setdefault(name, []).append(len(self.stack))
        if name in CONTAINERS:
            self.containers.append(len(self.stack))
        self.stack.append((name, self.number, mark, inside or name == "article"))

    def pop_to(self, size: int) -> None:
        """Closes elements until ``size`` are open."""
        while len(self.stack) > size:
            name, _, mark, _ = self.stack.pop()
            self.open[name].pop()
            if name in CONTAINERS:
                self.containers.pop()
            if mark != self.stack[-1][2]:
                self.marks[mark].end = len(self.blocks)
        self.low = min(self.low, size)

    def end_tag(self, name: str) -> None:
        if name == "a":
            self.link = False
        elif name in BLOCK:
            self.close_block()
            if at := self.open.get(name):
                self.pop_to(at[-1])
                self.link = False

    def start_tag(self, name: str, attributes: str) -> None:
        if name == "a":
            self.link = True
        elif name == "br":
            self.parts.append(" ")
        elif name in BLOCK:
            self.close_block()
            self.link = False
            if self.stack[-1][0] == "p":
                self.pop_to(len(self.stack) - 1)
            ended = max((self.open[n][-1] for n in CLOSES.get(name, ()) if self.open.get(n)), default=0)
            if ended > (self.containers[-1] if self.containers else 0):
                self.pop_to(ended)
            if name not in VOID:
                self.push(name, attributes)


def parse(html: str) -> _Page:
    """The page's text blocks in order, and its marks."""
    page = _Page()
    unended: set[str] = set()
    at, end = 0, len(html)
    while at < end:
        m = TOKEN.search(html, at)
        stop = m.start() if m else end
        if stop > at:
            page.say(unescape(html[at:stop]))
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            page.end_tag(name)
        elif name in RAW:
            if m[3] and m[3].rstrip().endswith("/") and name in ("svg", "math"):
                continue
            done = None
            if name not in unended:
                # the head's own content holds no blocks; it ends at its end tag or at the body
                ends = r"</head\s*>|(?=<body[\s>])" if name == "head" else f"</{name}(?=[\\s/>])[^>]*>"
                done = re.compile(ends, re.IGNORECASE).search(html, at)
            if done:
                at = done.end()
            elif name in RAW_TO_END:
                break
            else:
                unended.add(name)
                page.mute = True
        else:
            page.start_tag(name, m[3])
    page.close_block()
    page.pop_to(1)
    return page


def block_features(text: str, linked: int, element: str) -> tuple[float, ...]:
    return (
        1.0,
        min(1.0, len(text) / 120),
        min(1.0, linked / len(text)),
        float(text[-1] in ".!?…\"»”"),
        float(element in HEADINGS),
        float(element in PROSE),
        float(element in ITEMS),
        float("©" in text[:40] or "(c)" in text[:40].lower()),
    )


def own_odds(block: Block, weights: tuple[float, ...] = WEIGHTS) -> float:
    """What a block's features say of it, in log-odds."""
    return max(-OWN, min(OWN, sum(w * f for w, f in zip(weights, block.features))))


def odds(page: _Page, weights: tuple[float, ...] = WEIGHTS) -> list[float]:
    """The log-odds of content of each block: its own, and what the marks around it say.

    Of nested marks a bad one wins over good ones; no number of them counts more than one.
    """
    own = [own_odds(b, weights) for b in page.blocks]
    sure = [False]
    for mark in page.marks[1:]:
        sure.append(sure[mark.outer] or mark.sure)
    prose = [len(b.text) if o > 0 and not sure[b.mark] else 0 for b, o in zip(page.blocks, own)]
    length, many, good = [0], [0], [0]
    for b, n in zip(page.blocks, prose):
        length.append(length[-1] + n)
        many.append(many[-1] + (n > 0))
        good.append(good[-1] + (n > 0 and page.marks[b.mark].says > 0))
    heard = [0.0]
    for mark in page.marks[1:]:
        says = mark.says
        alone = good[mark.end] - good[mark.first] == good[-1]
        if says < 0 and not mark.sure and alone and many[mark.end] - many[mark.first] >= MANY:
            share = (length[mark.end] - length[mark.first]) / length[-1]
            most = MOST_COMMENTS if mark.comments else MOST
            says *= min(1.0, (1 - share) / (1 - most))
        outer = heard[mark.outer]
        heard.append(min(outer, says) if says < 0 or outer < 0 else max(outer, says))
    return [o + (GOOD if heard[b.mark] > 0 else BAD) * heard[b.mark] for b, o in zip(page.blocks, own)]


def ties(blocks: list[Block]) -> Iterator[tuple[int, int, float]]:
    """(block, later block, capacity) of neighbours, and of blocks that follow each other under one parent."""
    last_under: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            yield i - 1, i, TIE / (1 + b.steps)
        j = last_under.get(b.parent, i)
        if j < i - 1:
            yield j, i, NEAR / (1 if blocks[j].element == b.element else 3)
        last_under[b.parent] = i


class Flow:
    """Maximum flow by blocking flows (Dinic) on a graph whose terminals are excesses of its nodes."""

    def __init__(self, excess: list[int]):
        #: above 0: what is left of the capacity from the source; below 0: of that to the sink
        self.excess = excess
        self.out: list[list[int]] = [[] for _ in excess]
        self.to: list[int] = []
        self.room: list[int] = []

    def tie(self, a: int, b: int, capacity: int) -> None:
        for x, y in ((a, b), (b, a)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(capacity)

    def reached(self) -> list[int]:
        """Steps from the source in the rest of the graph, -1 where it does not lead."""
        level = [0 if e > 0 else -1 for e in self.excess]
        queue = [v for v, e in enumerate(self.excess) if e > 0]
        for v in queue:
            for e in self.out[v]:
                w = self.to[e]
                if self.room[e] and level[w] < 0:
                    level[w] = level[v] + 1
                    queue.append(w)
        return level

    def run(self) -> list[bool]:
        """True for the nodes on the source's side of the minimum cut that takes least to the sink's side."""
        excess, out, to, room = self.excess, self.out, self.to, self.room
        while True:
            level = self.reached()
            if not any(lv >= 0 and e < 0 for lv, e in zip(level, excess)):
                return [lv >= 0 for lv in level]
            nth = [0] * len(excess)
            for source in [v for v, e in enumerate(excess) if e > 0]:
                path: list[int] = []
                v = source
                while excess[source] > 0:
                    if excess[v] < 0:
                        push = min(excess[source], -excess[v], *(room[e] for e in path))
                        excess[source] -= push
                        excess[v] += push
                        for e in path:
                            room[e] -= push
                            room[e ^ 1] += push
                        path.clear()
                        v = source
                        continue
                    edges = out[v]
                    while nth[v] < len(edges):
                        e = edges[nth[v]]
                        if room[e] and level[to[e]] == level[v] + 1:
                            break
                        nth[v] += 1
                    if nth[v] < len(edges):
                        path.append(edges[nth[v]])
                        v = to[path[-1]]
                    elif path:
                        v = to[path.pop() ^ 1]
                        nth[v] += 1
                    else:
                        break


def label(page: _Page, weights: tuple[float, ...] = WEIGHTS) -> list[bool]:
    """Content or not, for each block, by the minimum cut."""
    flow = Flow([round(SCALE * o) for o in odds(page, weights)])
    for a, b, capacity in ties(page.blocks):
        flow.tie(a, b, round(SCALE * capacity))
    return flow.run()


def main_text(html: str | None, weights: tuple[float, ...] = WEIGHTS) -> str:
    """The content blocks, one a line; null and empty pages give an empty text."""
    if not html:
        return ""
    page = parse(html)
    return "\n".join(b.text for b, good in zip(page.blocks, label(page, weights)) if good)


def fit(pages: list[str], ridge: float = 30.0, rounds: int = 30) -> tuple[float, ...]:
    """Weights from pages whose elements tell content from boilerplate: blocks inside a mark are labelled by what it
    says, the others are left out.  Each counts twice, once without its element, so that pages of bare divisions are
    learned too.  Only own features are learned, so the weights serve pages without such marks.

    Logistic regression by Newton steps, both classes weighted alike, drawn to PRIOR by ``ridge`` (of 1000 for all
    blocks) as pages of few designs say little of others; an empty list gives PRIOR.
    """
    rows, labels = [], []
    for html in pages:
        page = parse(html)
        for b in page.blocks:
            says = page.marks[b.mark].says
            if says:
                bare = [0.0 if n in ("heading", "prose", "item") else f for n, f in zip(FEATURES, b.features)]
                rows += [b.features, bare]
                labels += [says > 0] * 2
    x, y = np.array(rows).reshape(-1, len(FEATURES)), np.array(labels, float)
    prior = np.array(PRIOR)
    w = prior.copy()
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * 1000
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ w)))
        grad = x.T @ (share * (y - p)) - ridge * (w - prior)
        w = w + np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
    return tuple(round(float(v), 2) for v in w)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Per row of pages: the kept columns, text and n_chars (code points).

    Null and empty html give an empty text; repeated rows stay; an empty table gives an empty table.
    Pages of any length and depth are read whole.
    """
    bound_batches(pages.sparkSession)
    kept = [f for f in pages.schema.fields if f.name in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = [main_text(h) for h in part.column(part.num_columns - 1).to_pylist()]
                columns = [part.column(i) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*(f.name for f in kept), "text", "n_chars"])

    return pages.select(*(F.col(f"`{f.name}`") for f in kept), F.col(f"`{html_col}`").alias("_html")).mapInArrow(lean(run), schema)
