"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks, the stretches of text between block-level tags. A
classifier and the block's place in the page give the cost of calling it content
or boilerplate; these are the capacities to the two terminals. Neighbouring
blocks, and blocks that are close in the element tree, are joined by edges that
cost their weight when the two are labelled differently. A maximum flow finds the
cheapest labelling, and the blocks on the content side are the text.

The classifier is a logistic regression on shape features of a block (length,
share of linked text, punctuation, kind of element, place in the page). It is
fitted on the pages themselves: blocks inside elements that name their role
(article, nav, footer ...) are its examples, taken from a bounded sample of pages.

A null html is an empty page and gives the empty text. Repeated pages give
repeated rows, a null id or url is carried along, extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import blocks as byte_blocks
from sieveline.llm.common import pick

SAMPLE_PAGES = 2000
"""Pages the classifier is fitted on: those whose id hashes lowest."""

# HTML's element kinds
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template title textarea iframe svg object select math canvas".split())
TO_END = frozenset("script style noscript template title textarea iframe".split())
"""Of these, those that take the rest of a page if they are left open; the others are passed over."""
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
}
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])

# Words in class, id and role that name a part's purpose
FOREIGN_WORDS = frozenset(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments commentlist consent "
    "cookie cookies copyright discussion disqus footer gdpr login masthead menu menubar modal nav navbar navigation "
    "newsletter notice notification pager pagination popup promo promoted promotion related recommended replies reply "
    "respond search share sharing sidebar signin signup skip social sponsor sponsored subscribe subscription toolbar "
    "topbar widget".split()
)
OWN_WORDS = frozenset("article articlebody content entry main maincontent post story".split())
FOREIGN_TAGS = frozenset("nav footer aside form button menu dialog fieldset legend".split())
OWN_TAGS = frozenset(["article", "main"])

# Evidence of the surrounding elements, in log-odds
OWN, FOREIGN, PAGE_HEADER = 4.0, -9.0, -7.0
TEXT_MOST = 2.5
"""The classifier's say lies within this many log-odds of 0."""
ADJACENT, NEAR = 0.5, 0.8
"""Weights of the smoothness edges; that of DOM proximity halves with each step between the blocks' parents."""

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_NAMES = re.compile(r"(?:\s|^)(class|id|role|itemprop|style|aria-hidden|hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_WORD = re.compile(r"[A-Za-z][a-z]*|[0-9]+")


class Block:
    __slots__ = ("text", "linked", "tag", "path", "place", "named")

    def __init__(self, text: str, linked: int, tag: str, path: tuple, place: float, named: tuple = ()):
        self.text, self.linked, self.tag, self.path, self.place = text, linked, tag, path, place
        self.named = named  # elements around it that a class word calls foreign


def _evidence(tag: str, attributes: str, place: float) -> tuple[float, bool]:
    """An element's say on everything inside, added to that of the elements around it; whether a word in its names is foreign."""
    add, foreign = 0.0, False
    if tag in FOREIGN_TAGS:
        add += FOREIGN
    elif tag in OWN_TAGS:
        add += OWN
    elif tag == "header":
        add += 0.0 if place > 0 else PAGE_HEADER
    if attributes and tag not in ("body", "html"):
        words: set[str] = set()
        for name, value in _NAMES.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("class", "id", "role", "itemprop"):
                words.update(_WORD.findall(value))
                words.add(value)
            elif name == "hidden" or (name == "aria-hidden" and value == "true"):
                add += FOREIGN
            elif "display:none" in value.replace(" ", ""):
                add += FOREIGN
        if words & FOREIGN_WORDS:
            add += FOREIGN
            foreign = True
        elif words & OWN_WORDS and tag not in OWN_TAGS and place <= 0:
            add += OWN
    return add, foreign


def page_blocks(source: str) -> list[Block]:
    """Blocks with text, in page order. Unclosed and stray tags are taken as browsers would, roughly."""
    out: list[Block] = []
    stack: list[tuple[str, int, float]] = [("", 0, 0.0)]  # element, its number, evidence inside it
    words: list[str] = []
    named: set[int] = set()
    holders: set[int] = set()  # elements around an article
    linked = links = elements = 0
    at, n = 0, len(source)

    def close() -> None:
        nonlocal words, linked
        if words:
            text = " ".join("".join(words).split())
            if text:
                inner = next((e for e in reversed(stack) if e[0] in BLOCK), stack[0])
                out.append(Block(text, linked, inner[0], tuple(e[1] for e in stack if e[0] in BLOCK), stack[-1][2], tuple(e[1] for e in stack if e[1] in named)))
        words, linked = [], 0

    def add(raw: str) -> None:
        nonlocal linked
        text = html.unescape(raw) if "&" in raw else raw
        words.append(text)
        if links:
            linked += len(text.strip())

    while at < n:
        hit = _TOKEN.search(source, at)
        if hit is None:
            add(source[at:])
            break
        if hit.start() > at:
            add(source[at : hit.start()])
        at = hit.end()
        if hit.group(2) is None:
            continue
        ends, tag, attributes = hit.group(1), hit.group(2).lower(), hit.group(3)
        if tag in BLOCK or tag == "head":
            close()
        elif tag == "br":
            words.append(" ")
        if ends:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == tag:
                    links -= sum(e[0] == "a" for e in stack[depth:])
                    del stack[depth:]
                    break
                if tag not in BLOCK and stack[depth][0] in BLOCK:
                    break  # a stray inline end tag closes nothing around the block
            continue
        if tag in RAW:
            if not attributes.endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                at = stop.end() if stop else n if tag in TO_END else at
            continue
        if tag == "option":  # its end tag may be left out, and it holds text alone
            following = source.find("<", at)
            at = following if following >= 0 else n
            continue
        if tag in VOID:
            continue
        if tag in BLOCK:  # an open paragraph ends, with the inline elements left open in it
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == "p" or stack[depth][0] in CLOSES.get(tag, ()):
                    links -= sum(e[0] == "a" for e in stack[depth:])
                    del stack[depth:]
                    if stack[-1][0] not in CLOSES.get(tag, ()):
                        break
                elif stack[depth][0] in BLOCK:
                    break
        if attributes.endswith("/") and tag not in BLOCK:
            continue
        elements += 1
        links += tag == "a"
        place = stack[-1][2]
        add_to, foreign = _evidence(tag, attributes, place)
        if foreign:
            named.add(elements)
        elif tag in OWN_TAGS:
            holders.update(e[1] for e in stack)
        stack.append((tag, elements, place + add_to))
    close()
    # a class word says nothing on an element around an article, or, on a page without one, around most of the text
    freed = named & holders
    if named and not holders:
        held: dict[int, int] = {}
        for block in out:
            for element in block.named:
                held[element] = held.get(element, 0) + len(block.text)
        freed = {e for e, size in held.items() if 2 * size > sum(len(b.text) for b in out)}
    for block in out if freed else ():
        block.place -= FOREIGN * sum(e in freed for e in block.named)
    return out


KINDS = ("heading", "paragraph", "item", "other")
SHAPE = [("length", 12), ("links", 4), ("stop", 2), ("kind", len(KINDS)), ("third", 3)]
_OFFSETS = np.cumsum([0, *[n for _, n in SHAPE]])
WIDTH = int(_OFFSETS[-1])


def shape(block: Block, index: int, count: int) -> tuple[int, ...]:
    """Which value of each shape feature a block has."""
    text = block.text
    kind = 0 if block.tag in HEADINGS else 1 if block.tag in ("p", "blockquote", "pre") else 2 if block.tag in ("li", "td", "th", "dd", "dt") else 3
    return (
        min(len(text).bit_length(), 11),
        min(3, 4 * block.linked // (len(text) + 1)),
        int(text[-1] in ".!?…:;\"'”»。"),
        kind,
        min(2, 3 * index // count),
    )


def prior() -> np.ndarray:
    """Where the weights start, and stay without examples: long unlinked sentences are content."""
    weights = np.zeros(WIDTH)
    weights[: SHAPE[0][1]] = np.linspace(-2.5, 2.5, SHAPE[0][1])
    weights[_OFFSETS[1] : _OFFSETS[2]] = [0.3, -0.5, -1.5, -2.5]
    weights[_OFFSETS[2] : _OFFSETS[3]] = [-0.3, 0.3]
    return weights


def fit(counts: list[tuple[tuple[int, ...], int, int]], pull: float = 5.0, rounds: int = 15) -> np.ndarray:
    """Ridge logistic regression around the prior by Newton steps; `counts` has (shape, is content, how often)."""
    weights = start = prior()
    if counts:
        x = np.zeros((len(counts), WIDTH))
        for i, (values, _, _) in enumerate(counts):
            x[i, _OFFSETS[:-1] + np.array(values)] = 1
        y = np.array([c[1] for c in counts], float)
        total = np.array([c[2] for c in counts], float)
        # both classes weigh the same, or the commoner one would decide what few features can tell apart
        for label in (0, 1):
            total[y == label] *= 500 / max(1.0, total[y == label].sum())
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-x @ weights))
            slope = x.T @ (total * (y - p)) - pull * (weights - start)
            bend = (x * (total * p * (1 - p))[:, None]).T @ x + pull * np.eye(WIDTH)
            weights = weights + np.linalg.solve(bend, slope)
    return weights


class Flow:
    """Maximum flow between two terminals by shortest augmenting phases; the cut is what the source still reaches."""

    def __init__(self, n: int):
        self.ends: list[list[int]] = [[] for _ in range(n + 2)]
        self.to: list[int] = []
        self.room: list[float] = []
        self.source, self.sink = n, n + 1

    def edge(self, a: int, b: int, there: float, back: float) -> None:
        for at, other, room in ((a, b, there), (b, a, back)):
            self.ends[at].append(len(self.to))
            self.to.append(other)
            self.room.append(room)

    def levels(self) -> list[int]:
        level = [-1] * len(self.ends)
        level[self.source] = 0
        queue = deque([self.source])
        while queue:
            at = queue.popleft()
            for e in self.ends[at]:
                if self.room[e] > 1e-9 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[at] + 1
                    queue.append(self.to[e])
        return level

    def content_side(self) -> list[int]:
        """Levels after the flow is at its most; nodes that are reached belong to the source."""
        while True:
            level = self.levels()
            if level[self.sink] < 0:
                return level
            turn = [0] * len(self.ends)
            path: list[int] = []
            at = self.source
            while True:
                if at == self.sink:
                    least = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= least
                        self.room[e ^ 1] += least
                    back = next(i for i, e in enumerate(path) if self.room[e] <= 1e-9)
                    at = self.to[path[back] ^ 1]
                    del path[back:]
                    continue
                for i in range(turn[at], len(self.ends[at])):
                    e = self.ends[at][i]
                    if self.room[e] > 1e-9 and level[self.to[e]] == level[at] + 1:
                        turn[at] = i
                        path.append(e)
                        at = self.to[e]
                        break
                else:
                    if at == self.source:
                        break
                    level[at] = -1
                    at = self.to[path.pop() ^ 1]


def label(found: list[Block], weights: np.ndarray) -> list[bool]:
    """Which blocks are content, by the minimum cut of the page's graph."""
    n = len(found)
    odds = []
    for i, block in enumerate(found):
        said = float(weights[_OFFSETS[:-1] + np.array(shape(block, i, n))].sum())
        odds.append(block.place + max(-TEXT_MOST, min(TEXT_MOST, said)))
    if all(z > 0 for z in odds) or all(z <= 0 for z in odds):
        return [z > 0 for z in odds]
    flow = Flow(n)
    for i, z in enumerate(odds):
        if z > 0:
            flow.edge(flow.source, i, z, 0.0)
        else:
            flow.edge(i, flow.sink, -z, 0.0)
    newest: dict[int, int] = {}  # by element: the latest block inside it
    for i, block in enumerate(found):
        if i:
            flow.edge(i - 1, i, ADJACENT, ADJACENT)
        for steps, element in enumerate(reversed(block.path[:-1])):
            if element in newest:
                other = newest[element]
                apart = steps + len(found[other].path) - block.path.index(element) - 2
                near = NEAR / 2**apart
                flow.edge(other, i, near, near)
                break
        for element in block.path:
            newest[element] = i
    level = flow.content_side()
    return [level[i] >= 0 for i in range(n)]


def main_text(source: str | None, weights: np.ndarray) -> str:
    found = page_blocks(source or "")
    if not found:
        return ""
    return "\n".join([b.text for b, own in zip(found, label(found, weights)) if own])


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE_PAGES) -> np.ndarray:
    """Weights of the block classifier, from at most `sample` pages.

    What reaches the driver are counts per combination of shape values, at most
    12 x 4 x 2 x 4 x 3 x 2 rows.
    """
    rows = pick(pages, id_col, html_col).toDF("id", "html").withColumn("h", F.xxhash64("html"))
    # ids alone are ordered and meet in one task; their pages stay where they are
    chosen = rows.select("id", "h").orderBy(F.xxhash64("id"), "id", "h").limit(sample).toDF("_id", "_h")
    rows = rows.join(chosen, rows["id"].eqNullSafe(chosen["_id"]) & (rows["h"] == chosen["_h"]), "left_semi")
    rows = rows.dropDuplicates(["id", "h"]).select("id", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_blocks(batches, "html"):
            shapes, labels = [], []
            for source in batch.column("html").to_pylist():
                found = page_blocks(source or "")
                for i, block in enumerate(found):
                    if block.place:
                        shapes.append(shape(block, i, len(found)))
                        labels.append(int(block.place > 0))
            yield pa.record_batch([pa.array(shapes, pa.list_(pa.int32())), pa.array(labels, pa.int32())], names=["shape", "own"])

    counted = rows.mapInArrow(run, "shape array<int>, own int").groupBy("shape", "own").count()
    return fit(sorted((tuple(r["shape"]), r["own"], r["count"]) for r in counted.collect()))


def extract(
    pages: DataFrame, weights: np.ndarray, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """`id_col`, `url_col` and the main `text` of every page."""
    rows = pick(pages, id_col, url_col, html_col).toDF("id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_blocks(batches, "html"):
            texts = [main_text(source, weights) for source in batch.column("html").to_pylist()]
            yield pa.record_batch([batch.column("id"), batch.column("url"), pa.array(texts, pa.string())], names=["id", "url", "text"])

    kinds = [rows.schema[n].dataType.simpleString() for n in ("id", "url")]
    out = rows.mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
