"""Main text of web pages: boosted trees over DOM nodes, decoded as a tree.

A page becomes a tree of blocks and text runs. Gradient-boosted trees give every
node the probability that main text lies in it, from densities, attribute
tokens, depth and siblings. Decoding chooses the most likely labelling in which
nothing below a dropped node is kept and every kept text has kept ancestors.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements without content, elements whose content is
#: never shown as text, elements that start a block, and what an opening tag
#: closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head title script style noscript template textarea select option datalist button svg math iframe object canvas audio video".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup"
    " li main menu nav ol p pre search section summary table caption thead tbody tfoot tr td th ul".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Where an implied end stops.
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
#: Elements that leave a head open; any other, and text, ends it.
IN_HEAD = HIDDEN & frozenset("title script style noscript template".split()) | frozenset("html head base link meta".split())
#: Elements of graphics and formulas that hold HTML.
EMBEDDING = frozenset("foreignobject desc annotation-xml".split())
#: Words in class and id attributes, by what they hint at.
SIDE_TOKENS = frozenset(
    "ad ads adv advert advertisement advertising banner sponsor sponsored promo promotion sidebar side aside menu nav navbar navigation breadcrumb breadcrumbs"
    " header masthead topbar footer foot bottom copyright legal notice notices cookie cookies consent gdpr alert warning popup modal overlay comment comments"
    " commentlist discussion respond reply replies disqus reader related recommended more share sharing social follow subscribe subscription newsletter signup"
    " login search form widget toolbar pagination pager tags meta byline outbrain taboola skip".split()
)
MAIN_TOKENS = frozenset("article content main story post entry body text blog page paragraph prose maincontent articlebody".split())
GROUPS = (
    {"#text"}, {"p"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"li", "dd", "dt"}, {"ul", "ol", "dl", "menu"}, {"table", "tbody", "tr", "td", "th"},
    {"div", "section", "center"}, {"article", "main"}, {"nav"}, {"header"}, {"footer"}, {"aside", "dialog"}, {"form", "fieldset", "search"},
    {"blockquote", "pre", "figure", "figcaption"}, {"html", "body"},
)

#: By tag, a bit for each group that has it.
GROUP_BITS = {tag: sum(1 << g for g, names in enumerate(GROUPS) if tag in names) for tag in frozenset().union(*GROUPS)}

_MARKS, _UPPER = re.compile("[.,;!?]"), re.compile("[A-Z]")
_WORDS = re.compile("[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

#: Bound of the training sample in pages, and variants made of each.
TRAIN_PAGES, VARIANTS, SEED = 160, 3, 5
TREES, DEPTH, RATE, BINS = 40, 4, 0.3, 24

#: Pages are scored together until they have this many nodes or characters: the
#: trees take a few array operations per call, which are dear for one small page.
NODES_TOGETHER, CHARS_TOGETHER = 10_000, 1 << 20


@dataclass
class Node:
    """A block element, or a run of text between block boundaries (``#text``)."""

    tag: str
    parent: int
    depth: int
    tokens: frozenset[str] = frozenset()
    text: list[str] = field(default_factory=list)
    linked: int = 0
    main: bool | None = None

    @cached_property
    def said(self) -> str:
        """The text of a finished run, white space turned into single spaces."""
        return " ".join("".join(self.text).split())


class Opened:
    """Names of open elements, outermost first, and where each name stands."""

    def __init__(self):
        self.names: list[str] = []
        self.places: dict[str, list[int]] = {}

    def push(self, name: str) -> None:
        self.places.setdefault(name, []).append(len(self.names))
        self.names.append(name)

    def pop(self) -> str:
        name = self.names.pop()
        self.places[name].pop()
        return name

    def clear(self) -> None:
        self.names.clear()
        self.places.clear()

    def __len__(self) -> int:
        return len(self.names)

    def __contains__(self, name: str) -> bool:
        return bool(self.places.get(name))

    def last(self, names: set[str]) -> int:
        """Place of the innermost element of these names, or -1."""
        return max((self.places[name][-1] for name in names if name in self), default=-1)

    def first_behind(self, names: set[str], place: int) -> int | None:
        """The outermost place behind ``place`` of an element of these names."""
        found = ((places, bisect_right(places, place)) for places in map(self.places.get, names) if places)
        return min((places[at] for places, at in found if at < len(places)), default=None)


class Page(HTMLParser):
    """Blocks and text runs of a page, in page order; node 0 is the root."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("#root", -1, 0)]
        self.open = [0]
        self.tags = Opened()  # the names of ``open``
        self.tags.push("#root")
        self.run = self.links = 0
        self.hidden = Opened()  # a hidden element, and what is open inside
        self.marks: list[bool | None] = [None]
        self.feed(html)
        if self.rawdata.startswith("<!"):  # a comment without end
            self.rawdata = ""
        self.close()
        del self.open, self.tags, self.marks, self.hidden

    def _flush(self) -> None:
        self.run = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._imply_hidden_ends(tag)
        if self.hidden or tag in HIDDEN:
            if tag in HIDDEN or tag in BLOCK or tag in EMBEDDING:
                self.hidden.push(tag)
            return
        if tag == "br":
            self.handle_data(" ")
        elif tag == "a":
            self.links += 1
        elif tag == "hr":
            self._flush()
        if tag not in BLOCK:
            return
        self._flush()
        self._imply_ends(tag)
        given = dict(attrs)
        words = _WORDS.findall(f"{given.get('class') or ''} {given.get('id') or ''} {given.get('role') or ''}") if given else ()
        self.open.append(len(self.nodes))
        self.tags.push(tag)
        mark = given.get("data-main")
        self.marks.append(self.marks[-1] if mark is None else mark == "1")
        self.nodes.append(Node(tag, self.open[-2], len(self.open) - 1, frozenset(w.lower() for w in words)))

    def _imply_hidden_ends(self, tag: str) -> None:
        """Ends hidden elements whose end tag may be left out before ``tag``."""
        if not self.hidden:
            return
        last = self.hidden.names[-1]
        if tag == "body" and "template" not in self.hidden and "iframe" not in self.hidden:
            self.hidden.clear()
        elif last == "head" and tag not in IN_HEAD or last == "option" and tag in ("option", "optgroup", "hr"):
            self.hidden.pop()
        elif last in ("svg", "math") and tag in BLOCK:
            self.hidden.pop()
        elif tag in ("select", "input", "textarea") and "select" in self.hidden:
            self._end_hidden("select")
        elif tag == "button" and "button" in self.hidden:
            self._end_hidden("button")

    def _end_hidden(self, tag: str) -> None:
        while self.hidden.pop() != tag:
            pass

    def _imply_ends(self, tag: str) -> None:
        if "p" in self.tags:
            self._end("p")
        if tag in CLOSES:
            ended = self.tags.first_behind(CLOSES[tag], max(0, self.tags.last(SCOPES[tag])))
            while ended is not None and len(self.open) > ended:
                self._pop()

    def _end(self, tag: str) -> None:
        while self._pop() != tag:
            pass

    def _pop(self) -> str:
        self.open.pop()
        self.marks.pop()
        return self.tags.pop()

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.hidden:
            self._end_hidden(tag)
        elif tag == "a":
            self.links = max(0, self.links - 1)
        elif tag in BLOCK:
            inside = tag in self.tags
            if self.hidden and not inside:
                return
            self.hidden.clear()  # left open inside an element that ends
            self._flush()
            if inside:
                self._end(tag)
                self.links = 0

    def handle_data(self, data: str) -> None:
        if self.hidden.names == ["head"] and data.strip():
            self.hidden.clear()
        if self.hidden or not (self.run or data.strip()):
            return
        if not self.run:
            self.run = len(self.nodes)
            self.nodes.append(Node("#text", self.open[-1], len(self.open), main=self.marks[-1]))
        self.nodes[self.run].text.append(data)
        self.nodes[self.run].linked += len(data.strip()) if self.links else 0


def features(*pages: list[Node]) -> np.ndarray:
    """A row per node, page after page: densities of its subtree, tokens, depth, siblings."""
    nodes = [node for page in pages for node in page]
    roots = np.cumsum([0, *map(len, pages)])[:-1]
    first = np.repeat(roots, [len(page) for page in pages])
    up = (first + [max(0, node.parent) for node in nodes]).tolist()
    n = len(nodes)
    chars, linked, marks, runs, tags, upper, children = ([0] * n for _ in range(7))
    for i, node in enumerate(nodes):
        if node.tag == "#text":
            text = node.said
            chars[i], linked[i], runs[i] = len(text), min(node.linked, len(text)), 1
            marks[i] = len(_MARKS.findall(text))
            upper[i] = len(_UPPER.findall(text))
        else:
            tags[i] = 1
    for i in range(n - 1, -1, -1):  # children come after their parents
        if (p := up[i]) != i:
            children[p] += 1
            for totals in (chars, linked, marks, runs, tags, upper):
                totals[p] += totals[i]
    side = [len(node.tokens & SIDE_TOKENS) if node.tokens else 0 for node in nodes]
    main = [len(node.tokens & MAIN_TOKENS) if node.tokens else 0 for node in nodes]
    group = [GROUP_BITS.get(node.tag, 0) for node in nodes]
    side_above, main_above, group_above = side.copy(), main.copy(), group.copy()
    place, before, earlier, last, seen, read = [0] * n, [0] * n, [0] * n, [-1] * n, [0] * n, 0
    for i, node in enumerate(nodes):
        if (p := up[i]) == i:
            read = 0
            continue
        side_above[i] += side_above[p]
        main_above[i] += main_above[p]
        group_above[i] |= group_above[p]
        place[i], seen[p] = seen[p], seen[p] + 1
        before[i] = chars[last[p]] if last[p] >= 0 else 0
        last[p] = i
        earlier[i] = read
        if node.tag == "#text":
            read += chars[i]
    bits = 1 << np.arange(len(GROUPS))
    chars, linked, marks, runs, tags, upper, children, place, before, earlier, side, main = (
        np.array(column, float) for column in (chars, linked, marks, runs, tags, upper, children, place, before, earlier, side, main)
    )
    columns = [
        np.log1p(chars), chars / (tags + 1), linked / (chars + 1), marks / (chars + 1), upper / (chars + 1), np.log1p(runs), chars / (runs + 1),
        [node.depth for node in nodes], place / (children[up] + 1), children, children[up], np.log1p(before), chars / (chars[up] + 1),
        chars / (chars[first] + 1), earlier / (chars[first] + 1), side, main, side[up], main[up], side_above, main_above, linked[up] / (chars[up] + 1),
    ]
    in_groups = [(np.array(masks, np.int64)[:, None] & bits) > 0 for masks in (group, group_above)]
    return np.column_stack([np.column_stack(columns), *in_groups]).astype(np.float32)


@dataclass
class Tree:
    """A full binary tree: feature and limit per inner node, value per leaf."""

    feature: np.ndarray
    limit: np.ndarray
    value: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        for _ in range(DEPTH):
            at = 2 * at + 1 + (x[rows, self.feature[at]] > self.limit[at])
        return self.value[at - (2**DEPTH - 1)]


def _grow(x: np.ndarray, edges: list[np.ndarray], binned: np.ndarray, gradient: np.ndarray, weight: np.ndarray) -> Tree:
    """A tree on the gradient, split by split from histograms."""
    inner = 2**DEPTH - 1
    feature, limit, at = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32), np.zeros(len(x), np.int64)
    is_edge = np.arange(BINS) < np.array([len(e) for e in edges])[:, None]
    places = binned + np.arange(x.shape[1]) * BINS  # a histogram per feature, one behind the other

    def histograms(rows: np.ndarray, values: np.ndarray) -> np.ndarray:
        sums = np.bincount(places[rows].ravel(), np.repeat(values[rows], x.shape[1]), is_edge.size)
        return sums.reshape(is_edge.shape).cumsum(axis=1)

    for node in range(inner):
        rows = np.flatnonzero(at == node)
        if not len(rows):
            continue
        total_g, total_w = gradient[rows].sum(), weight[rows].sum()
        g, w = histograms(rows, gradient), histograms(rows, weight)
        gain = np.where(is_edge, g**2 / (w + 1) + (total_g - g) ** 2 / (total_w - w + 1) - total_g**2 / (total_w + 1), -np.inf)
        f, edge = np.unravel_index(gain.argmax(), gain.shape)
        if gain[f, edge] > 1e-6:
            feature[node], limit[node] = f, edges[f][edge]
        at[rows] = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
    leaf = at - inner
    value = np.bincount(leaf, gradient, inner + 1) / (np.bincount(leaf, weight, inner + 1) + 1)
    return Tree(feature, limit, RATE * value)


def boost(x: np.ndarray, truth: np.ndarray) -> list[Tree]:
    """Gradient-boosted trees for the logistic loss."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    edges = [e[e < x[:, f].max()] for f, e in enumerate(edges)]
    binned = np.column_stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)])
    score, trees = np.zeros(len(x)), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        trees.append(_grow(x, edges, binned, truth - p, p * (1 - p)))
        score += trees[-1](x)
    return trees


def decode(nodes: list[Node], score: np.ndarray) -> np.ndarray:
    """Kept nodes: the most likely labelling without contradictions."""
    kept, dropped = (-np.logaddexp(0, -score)).tolist(), (-np.logaddexp(0, score)).tolist()  # best totals of the subtree
    for i in range(len(nodes) - 1, 0, -1):
        parent = nodes[i].parent
        dropped[parent] += dropped[i]
        kept[parent] += max(kept[i], dropped[i])
    choice = np.zeros(len(nodes), bool)
    choice[0] = True
    for i in range(1, len(nodes)):
        choice[i] = choice[nodes[i].parent] and kept[i] > dropped[i]
    return choice


def page_score(nodes: list[Node], trees: list[Tree]) -> np.ndarray:
    return _scores(features(nodes), trees)


def _scores(x: np.ndarray, trees: list[Tree]) -> np.ndarray:
    return np.sum([tree(x) for tree in trees], axis=0) if trees else x[:, 0] - 3


def main_text(html: str | None, trees: list[Tree]) -> str:
    """Kept blocks in page order, two line ends between them."""
    return next(main_texts([html], trees))


def main_texts(pages: Iterable[str | None], trees: list[Tree]) -> Iterator[str]:
    """``main_text`` of every page, in their order."""

    def texts() -> Iterator[str]:
        scores = _scores(features(*together), trees)
        for nodes, score in zip(together, np.split(scores, np.cumsum([len(nodes) for nodes in together])[:-1])):
            kept = decode(nodes, score)
            yield "\n\n".join(text for node, k in zip(nodes, kept) if k and node.tag == "#text" and (text := node.said))

    together, held, chars = [], 0, 0
    for html in pages:
        together.append(Page(html or "").nodes)
        held, chars = held + len(together[-1]), chars + len(html or "")
        if held >= NODES_TOGETHER or chars >= CHARS_TOGETHER:
            yield from texts()
            together, held, chars = [], 0, 0
    if together:
        yield from texts()


def _tagged(nodes: list[Node]) -> list[bool]:
    """Whether a run lies in an article or main element and in none for other uses."""
    article, other = np.zeros(len(nodes), bool), np.zeros(len(nodes), bool)
    for i, node in enumerate(nodes):
        if node.parent > 0:  # parents come first
            above = nodes[node.parent].tag
            article[i] = article[node.parent] or above in ("article", "main")
            other[i] = other[node.parent] or above in ("nav", "aside", "footer", "form", "header")
    return (article & ~other).tolist()


def variant(rng: np.random.Generator, article: list[tuple[str, str]], other: list[str]) -> str:
    """A page around the blocks of an article in other markup; elements carry
    ``data-main``, whether their text is main text."""

    def pick(*options: str) -> str:
        return options[rng.integers(len(options))]

    def words(low: int, high: int) -> str:
        text = pick(*other).split()
        start = int(rng.integers(max(1, len(text) - 3)))
        return escape(" ".join((text[start:] + text)[: int(rng.integers(low, high))]))

    def links() -> str:
        return "<ul>" + "".join(f'<li><a href="#">{words(1, 4)}</a></li>' for _ in range(rng.integers(2, 8))) + "</ul>"

    def paragraphs() -> str:
        return "".join(f"<p>{words(4, 40)}</p>" for _ in range(rng.integers(1, 4)))

    def side(kind: str) -> str:
        head, tail = {
            "menu": (pick("<nav data-main=0>", '<div class="menu" data-main=0>', '<div id="main-nav" data-main=0>', '<ul class="breadcrumbs" data-main=0>'), links()),
            "header": (pick("<header data-main=0>", '<div class="site-header" data-main=0>', '<div id="masthead" data-main=0>'), f"<h2>{words(1, 6)}</h2>" + links()),
            "footer": (pick("<footer data-main=0>", '<div class="footer" data-main=0>', '<div id="page-footer" data-main=0>'), f"&copy; {words(2, 14)}"),
            "sidebar": (pick("<aside data-main=0>", '<div class="sidebar" data-main=0>', '<section class="related-posts" data-main=0>'), f"<h3>{words(1, 4)}</h3>" + pick(links(), paragraphs())),
            "notice": (pick('<div class="cookie-notice" data-main=0>', '<div id="consent" data-main=0>', '<p class="notice" data-main=0>', '<div class="alert" data-main=0>'), words(4, 30)),
            "advert": (pick('<div class="ad" data-main=0>', '<div class="advert" data-main=0>', '<aside class="promo" data-main=0>', '<div class="sponsored banner" data-main=0>'), words(3, 30)),
            "form": (pick("<form data-main=0>", '<form class="newsletter" data-main=0>', '<div class="subscribe" data-main=0>'), f"<label>{words(1, 8)}</label><input> {words(2, 9)}"),
            "comments": (pick('<section class="comments" data-main=0>', '<div id="comments" data-main=0>', '<ol class="commentlist" data-main=0>', '<div class="reader-comment" data-main=0>'), paragraphs() + pick("", paragraphs())),
        }[kind]
        return f"{head}{tail}</{re.match('<([a-z]+)', head)[1]}>"

    body = [f"<{tag}>{escape(text)}</{tag}>" for tag, text in article]
    for kind in ("advert", "notice", "sidebar", "form"):
        if rng.random() < 0.3:
            body.insert(int(rng.integers(len(body) + 1)), side(kind))
    if rng.random() < 0.3:
        body.append(side("comments"))
    names = ('class="content"', 'id="main"', 'class="post-body"', 'class="entry-content"', 'class="story"', "")
    frame = pick("article", "article", "main", "div", "section", "td")
    holder = f"<{frame} {pick(*names)} data-main=1>" + "".join(body) + f"</{frame}>"
    holder = f"<table><tr>{holder}</tr></table>" if frame == "td" else pick("{}", "{}", '<div class="wrapper">{}</div>', '<div id="page">{}</div>').replace("{}", holder)
    above = [side(kind) for kind in ("header", "menu", "notice", "advert") if rng.random() < 0.6]
    below = [side(kind) for kind in ("sidebar", "comments", "form", "advert", "footer") if rng.random() < 0.6]
    return "<html><body>" + "".join(above) + holder + "".join(below) + "</body></html>"


def _labelled(nodes: list[Node], main: list[bool]) -> np.ndarray:
    """Whether main text lies in a node, from the text runs that are main text."""
    truth = np.zeros(len(nodes))
    for i in range(len(nodes) - 1, 0, -1):
        truth[i] = max(truth[i], float(bool(nodes[i].tag == "#text" and main[i])))
        truth[nodes[i].parent] = max(truth[nodes[i].parent], truth[i])
    return truth


def train(pages: list[str]) -> list[Tree]:
    """Fit trees on pages that mark their article, and on variants of them with
    other markup, asides inside the article, notices, forms and comments."""
    rng = np.random.default_rng(SEED)
    rows, truths = [], []

    def learn(nodes: list[Node], main: list[bool]) -> None:
        rows.append(features(nodes))
        truths.append(_labelled(nodes, main))

    for html in pages:
        nodes = Page(html).nodes
        main = _tagged(nodes)
        found = [(node, node.said) for node, m in zip(nodes, main) if node.tag == "#text" and m]
        if not found:
            continue
        learn(nodes, main)
        article = [(tag if (tag := nodes[node.parent].tag) in ("p", "h1", "h2", "h3", "li", "blockquote") else "p", text) for node, text in found if text]
        other = [text for node, m in zip(nodes, main) if node.tag == "#text" and not m and (text := node.said)] or ["Home"]
        article = [("p" if tag == "li" else tag, text) for tag, text in article]
        for _ in range(VARIANTS):
            made = Page(variant(rng, article, other + [text for _, text in article])).nodes
            learn(made, [bool(node.main) for node in made])
    return boost(np.concatenate(rows), np.concatenate(truths)) if rows else []


def fit(pages: DataFrame, html: str = "html", limit: int = TRAIN_PAGES) -> list[Tree]:
    """Trees from at most ``limit`` different pages with an article or main
    element, chosen by a hash of their content; copies count once. Without such a
    page there are no trees, and ``page_score`` keeps long runs of text."""
    marked = pages.where(F.col(html).rlike(r"(?i)<(?:article|main)[\s>]")).select(F.xxhash64(html).alias("draw"), F.col(html).alias("html"))
    drawn = marked.select("draw").distinct().orderBy("draw").limit(limit)
    chosen = marked.join(drawn, "draw", "left_semi").dropDuplicates(["draw"]).orderBy("draw")
    return train([row["html"] for row in chosen.collect()])


def extract(pages: DataFrame, trees: list[Tree], html: str = "html", carry: list[str] = ["page_id", "url"]) -> DataFrame:
    """The ``carry`` columns and ``text`` of every page.

    A null or empty page, and one without main text, has the empty text.
    Repeated rows are pages each; broken markup is read as far as it goes. Any
    other column is not looked at.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = list(main_texts((page.as_py() for page in batch.column(len(carry))), trees))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*carry, "text"])

    slim = pages.select(*carry, F.col(html).alias("html"))
    types = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    return slim.mapInArrow(scan, ", ".join(f"`{c}` {types[c]}" for c in carry) + ", text string")
