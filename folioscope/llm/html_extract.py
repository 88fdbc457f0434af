"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text. A classifier's costs of calling a block content or boilerplate become
capacities to the two terminals; blocks that follow each other, and blocks near each other in the element tree, are
tied by smoothness edges that get weaker with their distance. The maximum flow's cut is the cheapest labelling; blocks
on the content side are joined.

The classifier is a logistic curve over a block's tag, length, links, punctuation, depth, place and the names of the
elements around it. It and the strength of the edges are fitted on labelled pages put together from the pieces in
html_samples.py, once in the driver; only the weights go to the tasks.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.html_samples import BOILERPLATE, CONTENT, FRAMES
from folioscope.llm.quality_classifier import fit_logistic

#: Elements that begin a block, that have no end, whose text is outside an article, whose text is no text.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE = frozenset("nav footer aside form menu button select label fieldset dialog object".split())
SILENT = frozenset("script style title textarea template noscript iframe svg canvas".split())
#: Words of class, id and role that speak against an article, less strongly against it, and for it.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr comment comments disqus reply replies "
    "share sharing social related recommended newsletter subscribe subscription signup login popup modal pagination pager widget toolbar contentinfo complementary".split()
)
HINTS = frozenset("banner menu header notice notices alert copyright legal search form dialog overlay meta tags tools".split())
FAVOURS = frozenset("article articlebody body content entry main post story text".split())

_NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_WORD = re.compile(r"[a-z0-9]+")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_SILENT_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|$)", re.I) for tag in SILENT}
#: Ancestors whose last block a block is tied to.
UP = 3


@dataclass
class Element:
    tag: str
    number: int
    block: bool
    parent: int  # number of the element around it that begins a block
    article: bool = False
    outside: bool = False
    hidden: bool = False
    marks: float = 0.0  # the largest that named() gives for it or an element around it
    hints: float = 0.0
    favours: float = 0.0


@dataclass
class Block:
    text: str
    tag: str
    around: tuple[int, ...]  # the block elements that hold it, innermost first, UP at most
    depth: int
    linked: int  # characters inside links
    inside: Element

    @property
    def parent(self) -> int:
        return self.around[0] if self.around else 0


def token_end(html: str, at: int, ahead: dict[str, int]) -> int:
    """Where the tag that begins before `at` ends, behind its sign; -1 if it does not. ahead: next places of signs, so that none is sought twice."""

    def seek(sign: str, k: int) -> int:
        if -1 < ahead.get(sign, -2) < k or sign not in ahead:
            ahead[sign] = html.find(sign, k)
        return ahead[sign]

    while True:
        end = seek(">", at)
        if end < 0:
            return -1
        quotes = [q for q in (seek('"', at), seek("'", at)) if 0 <= q < end]
        if not quotes:
            return end + 1
        q = min(quotes)
        close = seek(html[q], q + 1)
        if close < 0 or html[at:q].rstrip()[-1:] != "=":  # no value, or one that never ends: a sign as any other
            if close < 0 and seek(">", q) >= 0 and not html[at:q].rstrip().endswith("="):
                at = q + 1
                continue
            if close < 0:
                return end + 1
            at = q + 1
            continue
        at = close + 1


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): text, open or close, in one pass over the page."""
    at, n, ahead = 0, len(html), {}
    while at < n:
        begin = html.find("<", at)
        if begin < 0:
            yield "text", "", html[at:]
            return
        if begin > at:
            yield "text", "", html[at:begin]
        following = html[begin + 1 : begin + 2]
        if html.startswith("<!--", begin):
            end = html.find("-->", begin + 2)
            at = n if end < 0 else end + 3
        elif following in ("!", "?") and following:
            end = html.find(">", begin)
            at = n if end < 0 else end + 1
        elif (m := _NAME.match(html, begin + 1 + (following == "/"))) is not None:
            end = token_end(html, m.end(), ahead)
            if end < 0:  # a tag that never ends
                return
            name = m[0].lower()
            at = end
            if following == "/":
                yield "close", name, ""
            elif name in SILENT:
                close = _SILENT_END[name].search(html, end)
                if close is None:
                    return
                at = close.end()
                end = html.find(">", at)
                at = n if end < 0 else end + 1
            else:
                yield "open", name, html[m.end() : end - 1]
        elif following == "/":
            end = html.find(">", begin)
            at = n if end < 0 else end + 1
        else:
            yield "text", "", "<"
            at = begin + 1


def named(tag: str, attrs: str) -> tuple[float, float, float]:
    """Twice the shares of marks, hints and favouring words among the words of class, id and role, 1 at most."""
    if not attrs or tag in ("body", "html"):
        return 0.0, 0.0, 0.0
    words = [w for x in _NAMED.findall(attrs) for w in _WORD.findall("".join(x).lower())]
    n = len(words)
    return tuple(min(1.0, 2 * sum(w in kind for w in words) / n) for kind in (MARKS, HINTS, FAVOURS)) if n else (0.0, 0.0, 0.0)


def blocks_of(html: str) -> list[Block]:
    """Blocks in page order; unclosed elements end with what holds them, a new block element ends an open paragraph."""
    out: list[Block] = []
    stack = [Element("", 0, True, 0)]
    parents = [0]  # by number
    open_tags: Counter = Counter()
    parts: list[str] = []
    link, linked = 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                k = len(stack) - 1
                while not stack[k].block:
                    k -= 1
                around, x = [], stack[k].parent
                while len(around) < UP:
                    around.append(x)
                    if not x:
                        break
                    x = parents[x]
                out.append(Block(text, stack[k].tag, tuple(around), k, linked, stack[-1]))
            parts.clear()
        linked = 0

    def close(k: int) -> None:
        nonlocal link
        if any(e.block for e in stack[k:]):
            flush()
        for e in stack[k:]:
            open_tags[e.tag] -= 1
            link -= e.tag == "a"
        del stack[k:]

    for kind, tag, rest in tokens(html):
        if kind == "text":
            parts.append(rest)
            if link:
                linked += len(rest)
            continue
        block = tag in BLOCKS
        if kind == "close":
            if not open_tags[tag]:
                continue
            wide = block and tag != "p" or tag == "a"
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
                if stack[k].block and tag != "p" and not wide:  # an inline element ends inside its block only
                    break
            continue
        if tag in ("br", "hr"):
            parts.append(" ")
        if block:
            flush()
            same = tag in ("li", "dt", "dd", "td", "th", "tr", "option")
            if open_tags["p"] or same and open_tags[tag]:
                for k in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph, an item the item before
                    if stack[k].tag == "p" or same and tag == stack[k].tag:
                        close(k)
                        break
                    if stack[k].tag in ("div", "ul", "ol", "table", "article", "section", "main", "blockquote"):
                        break
        if tag in VOID or rest.endswith("/") and not block:
            continue
        top = stack[-1]
        article = top.article or tag in ("article", "main")
        marks, hints, favours = named(tag, rest)
        outside = tag in OUTSIDE or tag == "header" and not article
        new = Element(tag, len(parents), block, top.number if top.block else top.parent, article, top.outside or outside, top.hidden or bool(rest and _HIDDEN.search(rest)), max(top.marks, marks), max(top.hints, hints), max(top.favours, favours))
        parents.append(new.parent)
        stack.append(new)
        open_tags[tag] += 1
        link += tag == "a"
    flush()
    return out


#: What features() gives, in order.
FEATURES = ("bias", "log_words", "words_10", "words_below_4", "sentence", "linked", "p", "heading", "item", "cell", "quote", "depth", "article", "outside", "hidden", "marks", "hints", "favours", "hints_in_article", "first", "last")


def features(blocks: list[Block]) -> np.ndarray:
    n = len(blocks)
    out = np.zeros((n, len(FEATURES)))
    for i, b in enumerate(blocks):
        w, e, at = b.text.count(" ") + 1, b.inside, (i + 0.5) / n
        out[i] = (
            1, min(3.0, math.log(w)), w >= 10, w < 4, b.text.endswith((".", "!", "?", "…", '."', "。", ":")), min(1.0, b.linked / len(b.text)), b.tag == "p", b.tag[:1] == "h" and b.tag[1:].isdigit(), b.tag in ("li", "dd", "dt"), b.tag in ("td", "th", "caption"),
            b.tag in ("blockquote", "pre", "figcaption"), min(1.0, b.depth / 16), e.article, e.outside, e.hidden, e.marks, e.hints, e.favours, e.hints * e.article, max(0.0, 0.1 - at), max(0.0, at - 0.9),
        )
    return out


def edges_of(blocks: list[Block], strength: float, fade: float) -> list[tuple[int, int, float]]:
    """Smoothness edges: the block before in the page, and the last block before below each of the UP elements around.

    An edge's weight is strength, times fade for each step from the two blocks up to the element that holds both.
    """
    last: dict[int, int] = {}
    out: dict[tuple[int, int], float] = {}
    for i, b in enumerate(blocks):
        for k, x in enumerate(b.around):
            j = last.get(x)
            if j is not None:
                other = blocks[j].around.index(x)
                out.setdefault((j, i), strength * fade ** (k + other))
        if i and (i - 1, i) not in out:
            out[i - 1, i] = strength * fade ** (2 * UP)
        for x in b.around:
            last[x] = i
    return [(i, j, w) for (i, j), w in out.items()]


def min_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the content side of the minimum cut; nodes that could be on either side are not.

    A node with a positive cost hangs on the source by that capacity, one with a negative cost on the sink.
    Flow is pushed along shortest paths (breadth-first levels, then depth-first blocking flows).
    """
    n = len(costs)
    source, sink = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    at: list[list[int]] = [[] for _ in range(n + 2)]

    def add(a: int, b: int, forth: float, back: float) -> None:
        at[a].append(len(to))
        to.append(b)
        cap.append(forth)
        at[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i, c in enumerate(costs):
        if c > 0:
            add(source, i, c, 0.0)
        elif c < 0:
            add(i, sink, -c, 0.0)
    for a, b, w in edges:
        add(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in at[a]:
                if cap[e] > 1e-12 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        tried = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(cap[e] for e in path)
                cut = 0
                for k in range(len(path) - 1, -1, -1):
                    cap[path[k]] -= flow
                    cap[path[k] ^ 1] += flow
                    if cap[path[k]] <= 1e-12:
                        cut = k
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            row, k = at[a], tried[a]
            while k < len(row) and not (cap[row[k]] > 1e-12 and level[to[row[k]]] == level[a] + 1):
                k += 1
            tried[a] = k
            if k < len(row):
                path.append(row[k])
                a = to[row[k]]
            elif a == source:
                break
            else:
                a = to[path.pop() ^ 1]
                tried[a] += 1


@dataclass(frozen=True)
class Model:
    weights: tuple[float, ...]  # one for each of FEATURES
    strength: float
    fade: float

    def costs(self, blocks: list[Block]) -> list[float]:
        """Positive: so much dearer to call it boilerplate; negative: content. The logarithm of the odds."""
        return (features(blocks) @ np.array(self.weights)).tolist() if blocks else []

    def keep(self, blocks: list[Block]) -> list[bool]:
        return min_cut(self.costs(blocks), edges_of(blocks, self.strength, self.fade))

    def text(self, html: str | None) -> str:
        blocks = blocks_of(html or "")
        return "\n\n".join([b.text for b, k in zip(blocks, self.keep(blocks)) if k])


def sample_page(rnd: random.Random) -> tuple[list[Block], list[bool]]:
    """A page put together from labelled pieces, and its blocks' labels. Content words are marked while it is cut into blocks."""
    sign = "\ue000"
    good = [rnd.choice(CONTENT) for _ in range(rnd.randrange(3, 12))]
    frame = rnd.choice(FRAMES)
    page = frame.replace("{content}", "".join(x.replace("{text}", sign) for x in good))
    while "{other}" in page:
        page = page.replace("{other}", "".join(rnd.choice(BOILERPLATE) for _ in range(rnd.randrange(4))), 1)
    blocks = blocks_of(page)
    labels = [sign in b.text for b in blocks]
    for b in blocks:
        b.text = b.text.replace(sign, "").strip() or "."
    return blocks, labels


@lru_cache(maxsize=1)
def fitted(pages: int = 600, seed: int = 8) -> Model:
    """Costs fitted on half of the sample pages, edges on the other half: those with the fewest wrong labels."""
    rnd = random.Random(seed)
    made = [sample_page(rnd) for _ in range(pages)]
    first, rest = made[: pages // 2], made[pages // 2 :]
    x = np.concatenate([features(b) for b, _ in first])
    y = np.concatenate([np.array(k, float) for _, k in first])
    weights = tuple(fit_logistic(x, y, np.ones(len(y))).tolist())
    best = None
    for strength in (0.0, 0.25, 0.5, 1.0, 1.5, 2.0, 3.0):
        for fade in (0.2, 0.4, 0.6, 0.8):
            model = Model(weights, strength, fade)
            wrong = sum(k != t for b, labels in rest for k, t in zip(model.keep(b), labels))
            if best is None or wrong < best[0]:
                best = wrong, model
    return best[1]


def main_text(html: str | None) -> str:
    return fitted().text(html)


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    A null html counts as empty and gives an empty text; so does a page without content blocks. Pages of any
    length are read whole, in one pass, broken markup as far as it goes: a value whose quote never ends, and a sign that
    begins no tag, are read as any other text; a tag that never ends is left out. Repeated rows give equal rows; null ids
    and urls stay null; other columns are not read. Each page is labelled by itself in one pass without a shuffle.
    """
    model = model or fitted()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [model.text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return slim.mapInArrow(run, "page_id long, url string, text string, n_chars long")
