"""Main-text extraction by minimum-cut labelling of HTML blocks.

A page is cut into text blocks: runs of text between block-level tags.  Every block gets two costs, in
log-odds: the capacity from the source (what calling it boilerplate costs) and to the sink (what calling
it content costs).  They come from a logistic classifier over the whole block (its length, link
density, sentence marks and tag), whose answer is bounded by TEXT, and from what the elements around
it say (AREA, NAMES, WITHIN).  Smoothness edges join blocks that follow each other, weaker the further
apart they are in the DOM, and blocks that share a parent.  The minimum cut, found as a maximum flow, is
the labelling of least total cost; blocks still reachable from the source are content.  So a short line
between paragraphs is content and a long notice among links is none.

The classifier is fitted on the blocks of a bounded sample of SAMPLE pages whose elements say what
they are (article and main, or nav, header, footer, aside and names of notices); where there are none of
either kind, fixed weights stand in.  All pages are labelled alike, whatever their number.

Text of scripts, styles, comments and other elements without text is never in a block.  Character
references are decoded, white space inside a block becomes one space, blocks are joined in page order
by one line feed.  Null html counts as empty; a page without content has an empty text.  Unclosed and
stray tags are tolerated: head and body may be left out, an element that is never closed and that holds
no text of its own (video, select, template ...) hides nothing, a quote that is never closed ends with
its tag.  Whole pages are read.  Repeated rows give repeated results, an empty table none; other columns
are left out, whatever their names.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import lean

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\s[^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*|/)?)\s*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style|itemprop)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)

_LOOSE = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)")
RAW = frozenset("script style textarea title".split())  # their text ends at their own closing tag
HIDDEN = frozenset("noscript template svg math iframe object select canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
NOT_MAIN = frozenset("nav header footer aside form button menu dialog".split())
MAIN = frozenset("article main".split())
TAGS = ("p", "h1", "h2", "h3", "h4", "li", "td", "div", "span", "blockquote", "pre", "dd", "dt", "th", "label", "button", "option")
_BAD = re.compile(r"(?:^|[^a-z])(?:ad|ads|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|header|masthead|footer|sidebar\w*|side|widget\w*|comment\w*|reply|replies|respond|disqus|cookie\w*|consent|notice\w*|alert|popup|modal|overlay|subscribe|newsletter|signup|login|share|sharing|social|related|recommend\w*|breadcrumb\w*|pagination|pager|toolbar|skip|copyright|legal|disclaimer|search|tags?|meta|byline|form|gdpr|hidden)(?:$|[^a-z])")
_GOOD = re.compile(r"(?:^|[^a-z])(?:article\w*|content|main|body|post|story|entry|text|prose)(?:$|[^a-z])")
_WHITE = re.compile(r"[\s\x1c-\x1f]+")
_SENTENCE = re.compile(r"[.!?:;,…。！？]")

SCALE = 100  # capacities are integers
SMOOTH, SIBLING = 4.0, 1.0  # of neighbours one step apart in the DOM, of blocks of one parent
AREA, NAMES, WITHIN, AGAINST = 6.0, 6.0, 1.5, 9.0  # what elements around a block say, and the most against it
TEXT = 3.0  # bound of what the text alone says
SAMPLE = 400  # pages that the classifier is fitted on
LEAST_ROWS = 20_000  # of their blocks that come to the driver, at most


class Block:
    """A block of text: linked letters, its element and its parent, and the marks around it."""

    __slots__ = ("text", "linked", "element", "parent", "tag", "bad", "good")

    def __init__(self, text: str, linked: int, element: int, parent: int, tag: str, bad: float, good: float):
        self.text, self.linked, self.element, self.parent, self.tag, self.bad, self.good = text, linked, element, parent, tag, bad, good


def _area(tag: str, attributes: str, root: bool) -> tuple[float, float]:
    """(against, for): what an element says about the text in it."""
    bad, good = (AREA if tag in NOT_MAIN else 0.0), (WITHIN if tag in MAIN else 0.0)
    if attributes and ("=" in attributes or "hidden" in attributes):
        names = []
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            value = (a or b or c).lower()
            name = name.lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                bad += AREA
            elif name == "role" and value in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu"):
                bad += AREA
            elif name == "role" and value in ("main", "article"):
                good += WITHIN
            elif name in ("class", "id"):
                names.append(value)
        said = " ".join(names).replace("_", "-")
        if said and not root:
            if _BAD.search(said):
                bad += NAMES
            elif _GOOD.search(said):
                good += WITHIN / 2
    return bad, good


def _end(html: str, tag: str, pos: int) -> int:
    """Where the element ``tag``, opened before ``pos``, is closed: after its closing tag, or -1."""
    depth = 1
    for m in re.compile(rf"<(/?){tag}(?=[\s/>])[^>]*>", re.I).finditer(html, pos):
        depth += -1 if m[1] else 0 if m[0].endswith("/>") else 1
        if not depth:
            return m.end()
    return -1


def parse(html: str) -> tuple[list[Block], list[tuple[int, int]]]:
    """The text blocks of a page, in page order, and of each element its parent and depth."""
    out: list[Block] = []
    tree: list[tuple[int, int]] = [(0, 0)]
    pieces: list[str] = []
    linked = 0
    # open block-level elements: tag, number, marks against and for
    stack: list[tuple[str, int, float, float]] = [("", 0, 0.0, 0.0)]
    links = 0

    def flush() -> None:
        nonlocal pieces, linked
        if pieces:
            text = _WHITE.sub(" ", unescape("".join(pieces))).strip()
            if text:
                tag, element, bad, good = stack[-1]
                out.append(Block(text, min(linked, len(text)), element, tree[element][0], tag, bad, good))
            pieces, linked = [], 0

    pos, end = 0, len(html)
    while pos < end:
        at = html.find("<", pos)
        if at < 0:
            at = end
        if at > pos:
            piece = html[pos:at]
            pieces.append(piece)
            if links:
                linked += len(piece.strip())
        if at == end:
            break
        m = _TOKEN.match(html, at) or _LOOSE.match(html, at)
        if m is None:
            pieces.append("<")
            pos = at + 1
            continue
        pos = m.end()
        close, tag = m.group(1), m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if tag in RAW or tag in HIDDEN:
            if tag not in INLINE:
                flush()
            if not close and not (tag in HIDDEN and m.group(0).endswith("/>")):
                stop = _end(html, tag, pos)
                # a script without an end takes the rest, as in browsers; other elements hide nothing then
                pos = stop if stop >= 0 else end if tag in ("script", "style") else pos
            continue
        if tag == "a":
            links = 0 if close else 1
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in INLINE:
            continue
        flush()
        if close:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    links = 0
                    break
            continue
        links = 0
        if tag in CLOSES_P and stack[-1][0] == "p" or tag == "li" and stack[-1][0] == "li" or tag in ("dd", "dt") and stack[-1][0] in ("dd", "dt") or tag in ("td", "th", "tr") and stack[-1][0] in ("td", "th") or stack[-1][0] == "head" and tag not in ("meta", "link", "base"):
            stack.pop()
        if tag in VOID:
            continue
        bad, good = _area(tag, m.group(3), tag in ("html", "body"))
        tree.append((stack[-1][1], tree[stack[-1][1]][1] + 1))
        stack.append((tag, len(tree) - 1, min(AGAINST, stack[-1][2] + bad), max(stack[-1][3], good)))
    flush()
    return out, tree


def blocks(html: str) -> list[Block]:
    return parse(html)[0]


def features(b: Block) -> list[float]:
    """What the classifier sees of a block: its whole text and its tag, nothing of the area around it."""
    n = len(b.text)
    marks = len(_SENTENCE.findall(b.text))
    return [1.0, float(np.log2(1 + n)), b.linked / n, min(4.0, 100.0 * marks / n), float(marks > 0), *(float(b.tag == t) for t in TAGS)]


# Stands in where no page says what its elements are.
DEFAULT = np.array([-3.0, 0.5, -4.0, 0.3, 0.7, *({"p": 1.0, "h1": 1.5, "h2": 1.0, "h3": 0.8, "blockquote": 1.0, "pre": 1.0, "li": -0.5, "td": -0.3, "button": -3.0, "option": -3.0, "label": -2.0}.get(t, 0.0) for t in TAGS)])


def said(b: Block) -> int | None:
    """Content or not, as the elements around a block say: nothing but marks for, or marks against."""
    return 0 if b.bad > 0 else 1 if b.good >= WITHIN else None


def fit_weights(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, both labels of equal weight, shrunk towards DEFAULT."""
    if not (y == 0).any() or not (y == 1).any():
        return DEFAULT
    w, share = DEFAULT.copy(), np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ ((p - y) * share) + 0.01 * (w - DEFAULT)
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(w)), gradient)
        w = w - step * min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
    return w


def costs(b: Block, weights: np.ndarray = DEFAULT) -> tuple[int, int]:
    """(cost as boilerplate, cost as content) in units of 1 / SCALE log-odds."""
    score = float(np.clip(np.dot(features(b), weights), -TEXT, TEXT)) + b.good - b.bad
    return (round(SCALE * score), 0) if score > 0 else (0, round(-SCALE * score))


def _steps(tree: list[tuple[int, int]], i: int, j: int) -> int:
    """Steps between two elements in the tree, one at least."""
    n = 0
    while i != j:
        if tree[i][1] >= tree[j][1]:
            i = tree[i][0]
        else:
            j = tree[j][0]
        n += 1
    return max(1, n)


def minimum_cut(source: list[int], sink: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes stay with the source in the smallest minimum cut (Dinic's algorithm).

    ``source`` and ``sink`` hold the terminal capacities, ``edges`` (i, j, capacity) both ways.
    """
    n = len(source)
    s, t = n, n + 1
    to: list[int] = []
    cap: list[int] = []
    of: list[list[int]] = [[] for _ in range(n + 2)]

    def link(i: int, j: int, c: int, back: int) -> None:
        of[i].append(len(to))
        to.append(j)
        cap.append(c)
        of[j].append(len(to))
        to.append(i)
        cap.append(back)

    for i in range(n):
        # what can go straight through needs no search
        through = min(source[i], sink[i])
        if source[i] > through:
            link(s, i, source[i] - through, 0)
        if sink[i] > through:
            link(i, t, sink[i] - through, 0)
    for i, j, c in edges:
        link(i, j, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        todo = deque([s])
        while todo:
            i = todo.popleft()
            for e in of[i]:
                if cap[e] and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    todo.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        nxt = [0] * (n + 2)
        path: list[int] = []
        i = s
        while True:
            if i == t:
                flow = min(cap[e] for e in path)
                for k, e in enumerate(path):
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                k = next(k for k, e in enumerate(path) if not cap[e])
                i = to[path[k] ^ 1]
                del path[k:]
                continue
            while nxt[i] < len(of[i]):
                e = of[i][nxt[i]]
                if cap[e] and level[to[e]] == level[i] + 1:
                    break
                nxt[i] += 1
            else:
                if i == s:
                    break
                level[i] = -1
                i = to[path.pop() ^ 1]
                continue
            path.append(e)
            i = to[e]


def labelled(html: str | None, weights: np.ndarray = DEFAULT) -> list[tuple[Block, bool, bool]]:
    """The blocks of a page, whether they are content, and whether their own costs alone would say so."""
    found, tree = parse(html or "")
    terminal = [costs(b, weights) for b in found]
    edges = []
    for i, (a, b) in enumerate(zip(found, found[1:])):
        near = SMOOTH / _steps(tree, a.element, b.element) / (4 if a.bad != b.bad else 1)
        edges.append((i, i + 1, round(SCALE * near)))
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if b.parent in last and last[b.parent] < i - 1:
            edges.append((last[b.parent], i, round(SCALE * SIBLING)))
        last[b.parent] = i
    content = minimum_cut([a for a, _ in terminal], [b for _, b in terminal], edges)
    return [(b, keep, pro > con) for b, keep, (pro, con) in zip(found, content, terminal)]


def main_text(html: str | None, weights: np.ndarray = DEFAULT) -> str:
    """The main text of a page."""
    return "\n".join(b.text for b, keep, _ in labelled(html, weights) if keep)


def fit(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE) -> np.ndarray:
    """The classifier's weights, from the ``sample`` pages whose hashes come first."""
    html = F.col(html_col)
    chosen = pages.select(html.alias("html")).filter("html is not null").orderBy(F.xxhash64("html"), F.length("html")).limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h in batch.column(0):
                rows = [(features(b), label) for b in blocks(h.as_py()) if (label := said(b)) is not None]
                # blocks that look alike to the classifier are counted
                alike, count = np.unique(np.round(np.array([[*x, y] for x, y in rows]).reshape(len(rows), -1), 3), axis=0, return_counts=True) if rows else (np.zeros((0, 1)), np.zeros(0))
                yield pa.RecordBatch.from_arrays([pa.array(alike.tolist(), pa.list_(pa.float64())), pa.array(count.astype(np.int64))], names=["x", "n"])

    # a page gives at most as many rows as it has blocks; LEAST_ROWS bounds them all
    rows = chosen.mapInArrow(lean(run), "x array<double>, n long").limit(LEAST_ROWS).toPandas()
    if not len(rows):
        return DEFAULT
    m = np.repeat(np.stack(rows["x"].to_numpy()), np.minimum(rows["n"].to_numpy(), 64), axis=0)
    return fit_weights(m[:, :-1], m[:, -1])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) per row."""
    rows = pages.select(F.col(id_col).alias(id_col), F.col(url_col).alias(url_col), F.col(html_col).alias("_html"))
    weights = fit(pages, html_col)
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                texts = [main_text(h, weights) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    return rows.mapInArrow(lean(run), f"{id_col} {kinds[id_col]}, {url_col} {kinds[url_col]}, text string, n_chars long")
