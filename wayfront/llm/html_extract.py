"""Main text of web pages by a tree-structured graphical model.

A page's elements are the variables (main text or not).  Each has a potential from its
tag, names and text measures, and each parent-child pair one from both labels.  As the
graph is the element tree, one pass of sums and products upward and one downward give
exact marginals, for training (gradients of the log-likelihood of labelled pages) and
for extraction: a text block is kept if its element's marginal is above one half.

Blocks: text is cut where a block element begins or ends; character references are
decoded; white space inside a block becomes one space (so does ``<br>``); blocks are
joined by two newlines in page order.  Scripts, styles, templates and comments have no
text.

Defined results: null html counts as empty, whose text is empty; markup that is broken
is read as far as it goes, with missing end tags implied; repeated rows give a row
each; other columns are ignored.  Pages of any length and depth are read whole, without
recursion.
"""

from __future__ import annotations

import bisect
import functools
import json
import math
import random
import re
from collections.abc import Iterable
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_batch, small_batches
from .html_pages import labelled_pages

BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("head script style template noscript title iframe svg canvas audio video".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that a start tag of the given one ends, and those that keep it from looking further out.
ENDS = {"li": ({"li", "p"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}), "tr": ({"tr", "td", "th", "p"}, {"table"}), "td": ({"td", "th", "p"}, {"tr", "table"}), "th": ({"td", "th", "p"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set())}
ENDS |= {t: ({"p"}, {"td", "th", "table", "button", "object"}) for t in "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()}

TAGS = tuple("article aside blockquote body button dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header label legend li main nav ol option p pre section select span table td textarea th tr ul a".split())
#: Parts of names that speak for or against main text.
CUES = ("advert", "ad", "ads", "alert", "article", "banner", "body", "breadcrumb", "comment", "comments", "consent", "content", "cookie", "copyright", "disqus", "entry", "footer", "header", "legal", "main", "masthead", "menu", "nav", "navbar", "newsletter", "notice", "popup", "post", "promo", "related", "share", "side", "sidebar", "signup", "social", "sponsor", "sponsored", "story", "subscribe", "text", "topbar", "widget")
NAME_PARTS = re.compile(r"[a-z]+")
SPACES = re.compile(r"\s+")
FEATURES = {f: i for i, f in enumerate([*(f"tag:{t}" for t in (*TAGS, "other")), *(f"name:{c}" for c in CUES), "root", "words:0", "words:few", "words:some", "words:many", "links:all", "links:most", "links:some", "links:none", "stops", "hidden", "depth"])}


class Tree(HTMLParser):
    """Elements in page order, and the blocks of text with the element that bears each."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tags: list[str] = ["#root"]
        self.parents: list[int] = [-1]
        self.names: list[set[str]] = [set()]
        self.marked: list[bool] = [False]
        self.hidden: list[bool] = [False]
        self.words: list[int] = [0]
        self.linked: list[int] = [0]
        self.stops: list[int] = [0]
        self.open: list[int] = [0]
        self.silent = self.links = 0
        self.blocks: list[tuple[int, str]] = []
        self.buffer: list[str] = []
        self.blank = True
        self.bearer = 0
        #: Depths in ``open`` of each tag's elements, and of all that bear blocks.
        self.depths: dict[str, list[int]] = {}
        self.bearers: list[int] = [0]

    def flush(self) -> None:
        text = SPACES.sub(" ", "".join(self.buffer)).strip()
        if text:
            self.blocks.append((self.bearer, text))
        self.buffer.clear()
        self.blank = True

    def pop_to(self, depth: int) -> None:
        while len(self.open) > depth:
            tag = self.tags[self.open.pop()]
            self.depths[tag].pop()
            self.silent -= tag in SILENT
            self.links -= tag == "a"
            if tag in BLOCKS:
                self.bearers.pop()
                self.flush()

    def innermost(self, tags: Iterable[str]) -> int:
        """The depth of the innermost open element with one of the tags; 0 without any."""
        return max((own[-1] for t in tags if (own := self.depths.get(t))), default=0)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """``<![`` begins a comment up to the next ``>``, whatever follows."""
        end = self.rawdata.find(">", i + 3)
        return end + 1 if end >= 0 else -1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self.buffer.append(" ")
        ended, walls = ENDS.get(tag, (set(), set()))
        wall = self.innermost(walls)
        found = min((own[k] for t in ended if (own := self.depths.get(t)) and (k := bisect.bisect_right(own, wall)) < len(own)), default=None)
        if found is not None:
            self.pop_to(found)
        if tag in BLOCKS:
            self.flush()
        if tag in VOID:
            return
        at = dict(attrs)
        self.tags.append(tag)
        self.parents.append(self.open[-1])
        self.names.append(set(NAME_PARTS.findall(f"{at.get('class') or ''} {at.get('id') or ''} {at.get('role') or ''}".lower())))
        self.marked.append("data-main" in at)
        self.hidden.append("hidden" in at or at.get("aria-hidden") == "true" or "display:none" in (at.get("style") or "").replace(" ", ""))
        self.words.append(0)
        self.linked.append(0)
        self.stops.append(0)
        self.depths.setdefault(tag, []).append(len(self.open))
        if tag in BLOCKS:
            self.bearers.append(len(self.open))
        self.open.append(len(self.tags) - 1)
        self.silent += tag in SILENT
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.tags[self.open[-1]] == tag and tag not in BLOCKS:
            self.pop_to(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        k = self.innermost(HEADINGS if tag in HEADINGS else {tag})
        wall = self.bearers[-1] if tag not in BLOCKS and tag not in SILENT else self.innermost(("body", "html", "table"))
        if k > wall or k and k == wall:
            self.pop_to(k)

    def handle_data(self, data: str) -> None:
        if self.silent:
            return
        owner = self.open[self.bearers[-1]]
        if self.blank:
            self.bearer, self.blank = owner, not data.strip()
        self.buffer.append(data)
        n = len(data.split())
        self.words[owner] += n
        self.linked[owner] += n if self.links else 0
        self.stops[owner] += data.count(".") + data.count("?") + data.count("!") + data.count(",")


def parse(html: str) -> Tree:
    tree = Tree()
    tree.feed(html)
    tree.close()
    tree.pop_to(1)
    tree.flush()
    return tree


def active(tree: Tree) -> list[list[int]]:
    """The features of every element; text measures cover the element's whole subtree."""
    n = len(tree.tags)
    words, linked, stops = tree.words[:], tree.linked[:], tree.stops[:]
    for i in range(n - 1, 0, -1):
        p = tree.parents[i]
        words[p] += words[i]
        linked[p] += linked[i]
        stops[p] += stops[i]
    out, f = [], FEATURES
    for i in range(n):
        w, share = words[i], linked[i] / words[i] if words[i] else 0
        own = [f.get(f"tag:{tree.tags[i]}", f["tag:other"]), *(f[f"name:{c}"] for c in sorted(tree.names[i]) if f"name:{c}" in f)]
        own.append(f["words:0" if not w else "words:few" if w < 6 else "words:some" if w < 25 else "words:many"])
        if w:
            own.append(f["links:all" if share > 0.8 else "links:most" if share > 0.4 else "links:some" if share else "links:none"])
        if stops[i] * 20 > w > 5:
            own.append(f["stops"])
        if tree.hidden[i]:
            own.append(f["hidden"])
        if not i:
            own.append(f["root"])
        out.append(own)
    return out


def soft(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def marginals(parents: list[int], node: list[float], pair: list[float]) -> tuple[list[float], list[tuple[float, float, float, float]]]:
    """P(main) of each element, and P(parent's label, own label) for 00, 01, 10, 11.

    ``node`` are log-odds of main text; ``pair`` log-potentials for 00, 01, 10, 11.
    """
    n = len(parents)
    up0, up1 = [0.0] * n, node[:]
    message: list[tuple[float, float]] = [(0.0, 0.0)] * n
    for i in range(n - 1, 0, -1):
        m0 = soft(up0[i] + pair[0], up1[i] + pair[1])
        m1 = soft(up0[i] + pair[2], up1[i] + pair[3])
        message[i] = (m0, m1)
        p = parents[i]
        up0[p] += m0
        up1[p] += m1
    down0, down1 = [0.0] * n, [0.0] * n
    prob = [0.0] * n
    both: list[tuple[float, float, float, float]] = [(0.0, 0.0, 0.0, 0.0)] * n
    for i in range(n):
        if i:
            p = parents[i]
            rest0, rest1 = up0[p] + down0[p] - message[i][0], up1[p] + down1[p] - message[i][1]
            down0[i], down1[i] = soft(rest0 + pair[0], rest1 + pair[2]), soft(rest0 + pair[1], rest1 + pair[3])
            joint = (rest0 + pair[0] + up0[i], rest0 + pair[1] + up1[i], rest1 + pair[2] + up0[i], rest1 + pair[3] + up1[i])
            top = max(joint)
            weights = [math.exp(j - top) for j in joint]
            total = sum(weights)
            both[i] = (weights[0] / total, weights[1] / total, weights[2] / total, weights[3] / total)
        gap = up0[i] + down0[i] - up1[i] - down1[i]
        prob[i] = 1 / (1 + math.exp(min(max(gap, -700), 700)))
    return prob, both


def labels(tree: Tree) -> list[int]:
    """Marked elements are main; an element between is main if all the text below it is."""
    n = len(tree.tags)
    main, all_words = [0] * n, [0] * n
    inside = tree.marked[:]
    for i in range(1, n):
        inside[i] = inside[i] or inside[tree.parents[i]]
    for i in range(n - 1, -1, -1):
        all_words[i] += tree.words[i]
        main[i] += tree.words[i] if inside[i] else 0
        if i:
            all_words[tree.parents[i]] += all_words[i]
            main[tree.parents[i]] += main[i]
    return [int(inside[i] or (0 < all_words[i] <= 2 * main[i] and tree.tags[i] not in ("#root", "html", "body"))) for i in range(n)]


def train(pages: list[str], epochs: int = 25, rate: float = 0.15, decay: float = 1e-4, seed: int = 20_071) -> tuple[list[float], list[float]]:
    """Feature and pair weights by stochastic gradients with adaptive steps."""
    weights, pair = np.zeros(len(FEATURES)), np.zeros(4)
    squares, pair_squares = np.full(len(FEATURES), 1e-2), np.full(4, 1e-2)
    known = [(t, active(t), labels(t)) for t in map(parse, pages)]
    rng = random.Random(seed)
    for _ in range(epochs):
        rng.shuffle(known)
        for tree, found, truth in known:
            prob, both = marginals(tree.parents, [float(weights[f].sum()) for f in found], pair.tolist())
            g, g_pair = -decay * weights, np.zeros(4)
            for i, f in enumerate(found):
                g[f] += truth[i] - prob[i]
                if i:
                    g_pair -= both[i]
                    g_pair[2 * truth[tree.parents[i]] + truth[i]] += 1
            squares += g**2
            pair_squares += g_pair**2
            weights += rate * g / np.sqrt(squares)
            pair += rate * g_pair / np.sqrt(pair_squares)
    return weights.tolist(), pair.tolist()


PAGES, PAGES_SEED = 300, 20_072


@functools.lru_cache(1)
def model() -> str:
    """The trained model as JSON, trained once for each process."""
    weights, pair = train(labelled_pages(PAGES, PAGES_SEED))
    return json.dumps({"weights": weights, "pair": pair})


@functools.lru_cache(2)
def loaded(data: str) -> tuple[list[float], list[float]]:
    found = json.loads(data)
    return found["weights"], found["pair"]


def main_text(html: str, weights: list[float], pair: list[float]) -> tuple[str, int, int]:
    """The text, and numbers of blocks kept and seen."""
    tree = parse(html)
    if not tree.blocks:
        return "", 0, 0
    prob, _ = marginals(tree.parents, [sum(weights[k] for k in f) for f in active(tree)], pair)
    kept = [text for bearer, text in tree.blocks if prob[bearer] > 0.5]
    return "\n\n".join(kept), len(kept), len(tree.blocks)


EXTRACTED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_blocks", pa.int64()), ("n_dropped", pa.int64())])


def extract(pages: DataFrame) -> DataFrame:
    """Per row of ``pages``: page_id, url, text, n_chars, n_blocks and n_dropped."""
    small_batches(pages.sparkSession)
    shared = model()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        weights, pair = loaded(shared)
        found = [main_text(h or "", weights, pair) for h in batch["html"].to_pylist()]
        columns = [[f[0] for f in found], [len(f[0]) for f in found], [f[1] for f in found], [f[2] - f[1] for f in found]]
        return pa.record_batch([batch["page_id"].cast(pa.int64()), batch["url"].cast(pa.string()), *(pa.array(c, f.type) for c, f in zip(columns, list(EXTRACTED)[2:], strict=True))], EXTRACTED)

    return pages.select("page_id", "url", "html").mapInArrow(by_batch(EXTRACTED, work), "page_id long, url string, text string, n_chars long, n_blocks long, n_dropped long")
