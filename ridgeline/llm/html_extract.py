"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks of text at block-level tags. The graph has a node for
each block and for each container around blocks. A linear classifier gives each
block a score from its words, links, tag and ending, from whether it stands in
the page's article or, where there is one, outside of it, and from marks of
boilerplate around it (tags, and names in attributes). A positive score is the
capacity from the source (content), a negative one the capacity to the sink
(boilerplate), MOST at most. Smoothness edges join each block to its container,
each container to the one around it, and consecutive blocks, the weaker the
farther apart they stand in the document tree. Containers have no capacity of
their own. The minimum cut is the labelling of least cost: a short line between
paragraphs stays with them, a sentence among menu entries goes with them. Within a
run of blocks the edges of a block together outweigh any score. The cut is found
by maximum flow over all blocks and containers; only on pages of more than
FLOW_NODES of them are nodes whose score outweighs their edges fixed first,
which is exact too.

The weights are fitted (``fit``) on the pages' own structure: pages with an
article element label their blocks, in it and without a mark or not. Each page
counts twice, as it is and without what its structure says, so that text alone
must also tell. The fit starts from PRIOR, which stands for EVIDENCE blocks less
than the sample; LEARN pages and LEARN_BLOCKS of each, spread evenly, are its bound.

Pages are independent, so extraction is one scan: no shuffle, and memory for one
batch of pages. Reading a page takes time in proportion to its length, whatever
stands in it.

Defined results: null or empty html, and pages whose blocks are all
boilerplate, give an empty text; hidden parts are no blocks; unclosed tags end
where a container ends; an unclosed comment, script or style swallows the rest as
browsers do; a < after the last > is text; from an attribute whose quote never
closes on, quotes are not looked at; a button within a paragraph, heading or list
item is text of it; repeated rows are extracted each; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from html import unescape
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_END = re.compile(r"""[>"']""")
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
_WORDS = re.compile(r"[a-z]+")
RAW = frozenset("script style noscript template svg iframe title textarea select option annotation annotation-xml object canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINER = frozenset("html body div section article main nav header footer aside form ul ol dl table thead tbody tfoot tr td th figure blockquote details dialog fieldset menu address center".split())
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre figcaption caption legend label summary hr".split())
AGAINST_TAG = frozenset("nav header footer aside form menu dialog fieldset".split())
FOR_TAG = frozenset("article main".split())
#: Names of boilerplate, and names that parts of an article may have too.
AGAINST_NAME = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar footer header topbar toolbar ad ads adv advert adverts advertisement advertorial banner sponsor sponsored"
    " cookie cookies consent gdpr newsletter subscribe subscription signup login sharing comment comments commentlist disqus pagination pager complementary contentinfo outbrain taboola".split()
)
WEAK_NAME = frozenset(
    "side rail masthead promo promoted promotion notice notices notification alert popup modal overlay register share social related recommended recommendations"
    " discussion respond reply replies reactions form search widget widgets copyright legal disclaimer teaser".split()
)
FOR_NAME = frozenset("article content main post entry story body text articlebody".split())

#: What the classifier sees of a block; STRUCTURE is what the page's structure says.
FEATURES = ("bias", "log_words", "link_share", "paragraph", "heading", "item", "ending", "in_article", "outside", "marked", "weakly", "own_mark", "own_weak", "alone")
STRUCTURE = FEATURES.index("in_article")
PRIOR = np.array([-1.2, 0.9, -4.0, 0.8, 0.8, -0.6, 0.2, 2.0, -3.0, -12.0, -0.8, -10.0, -0.8, 2.5])
MOST_LOG = 6.0
#: Pages and blocks of each that are learned from, the blocks that they count as, and the prior's variance.
LEARN, LEARN_BLOCKS, EVIDENCE, VARIANCE = 2000, 64, 300.0, 1.0
#: Largest capacity of a block. Smoothness: a block and its container, containers, consecutive blocks of one container.
MOST, INSIDE, AROUND, NEXT = 3.0, 0.6, 0.4, 1.4
#: Nodes that go to maximum flow as they are.
FLOW_NODES = 1024


class _Block:
    __slots__ = ("parts", "links", "tag", "place", "hidden", "own", "weak", "rank", "outer", "inner", "reset", "form", "apart", "inside", "outside", "marked")

    def __init__(self, tag: str, own: tuple[int, int, int], inside: _Inside, apart: int):
        self.parts, self.links, self.tag, self.place, self.apart = [], 0, tag, inside.number, apart
        #: Whether it is shown, its own names (of boilerplate, weak ones), and weak names around it.
        self.hidden, self.own, self.weak = inside.hidden | own[0], own[1:], inside.weak
        self.inside = self.outside = self.marked = False
        #: What holds the block (2: article or main, 1: a name for content), and the marks as boilerplate outside and inside of that.
        self.rank, self.outer, self.inner, self.reset, self.form = inside.rank, inside.outer, inside.inner, inside.reset, inside.form


class _Form:
    """A form, the form around it, and what is found out about it."""

    def __init__(self, number: int, around: _Form | None):
        self.number, self.around, self.words, self.wide, self.n_wide = number, around, 0, False, 0


class _Inside:
    """An open container: hidden, what holds it, its marks, and weak names within what holds it."""

    __slots__ = ("tag", "number", "hidden", "rank", "outer", "inner", "reset", "form", "weak")

    def __init__(self, tag: str, number: int, hidden: int, rank: int, outer: float, inner: int, reset: int, form: _Form | None, weak: int):
        self.tag, self.number, self.hidden, self.rank, self.outer, self.inner, self.reset, self.form, self.weak = tag, number, hidden, rank, outer, inner, reset, form, weak


def _hidden(attributes: str) -> bool:
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" and value.lower() != "false" or name == "style" and _NO_DISPLAY.search(value):
            return True
    return False


def _names(attributes: str) -> tuple[int, int, int]:
    """(names for content, names of boilerplate, weak ones) in the attributes."""
    good = bad = weak = 0
    for m in _NAMES.finditer(attributes):
        for w in _WORDS.findall((m[1] or m[2] or m[3] or "").lower()):
            good |= w in FOR_NAME
            bad |= w in AGAINST_NAME
            weak |= w in WEAK_NAME
    return good, bad, weak


def _judge(blocks: list[_Block], forms: list[_Form]) -> int:
    """Sets inside of the article's blocks, outside of the others where there is one, and marked; returns the article's rank.

    A form that holds most of the page's words is no mark. A mark around the
    article (or, where there is none, around the part named as content) is no
    mark on it: that is the part with the fewest marks around it, if it holds
    as many words as stand on the page without a mark. What is marked inside
    of the article stays so, and so do articles within further marks, such
    as teasers and comments.
    """
    words = [len("".join(b.parts).split()) for b in blocks]
    half = sum(words) / 2
    for b, w in zip(blocks, words, strict=True):
        if b.form:
            b.form.words += w
    for f in reversed(forms):
        if f.around:
            f.around.words += f.words
    wide = []  # each lies in the one before
    for f in forms:
        f.wide = f.words > half
        f.n_wide = (f.around.n_wide if f.around else 0) + f.wide
        if f.wide:
            wide.append(f.number)
    for b in blocks:
        if b.form and b.form.n_wide:
            outside = bisect_left(wide, b.reset, 0, b.form.n_wide)
            b.outer, b.inner = b.outer - outside, b.inner - (b.form.n_wide - outside)
    open_ = sum(w for b, w in zip(blocks, words, strict=True) if not (b.hidden or b.outer or b.inner))
    rank = depth = 0
    for k in (2, 1):
        part = [(b.outer, w) for b, w in zip(blocks, words, strict=True) if w and b.rank == k and not b.hidden and not b.inner]
        least = min((n for n, _ in part), default=0)
        if part and (not least or sum(w for n, w in part if n == least) >= open_):
            rank, depth = k, least
            break
    for b in blocks:
        b.marked = b.inner > 0 or b.outer > (depth if b.rank == rank else 0)
        b.inside = bool(rank) and b.rank == rank and b.outer <= depth
        b.outside = rank == 2 and not b.inside
    return rank


def blocks_of(html: str) -> tuple[list[_Block], list[int], int]:
    """The blocks with text in page order, judged by what stands around them; the container around each container; the article's rank."""
    out: list[_Block] = []
    around = [0]
    stack = [_Inside("", 0, 0, 0, 0.0, 0, 0, None, 0)]
    n_open: dict[str, int] = {}
    forms: list[_Form] = []
    block = _Block("", (0, 0, 0), stack[0], 0)
    at, in_link, size, end, quoted = 0, 0, len(html), html.rfind(">"), True
    low = last = level = 1  # open containers: the fewest since the last block, its own, the next one's

    def text(a: int, b: int) -> None:
        if b > a:
            s = html[a:b]
            block.parts.append(s)
            if in_link:
                block.links += len(s)

    def flush(tag: str, own: tuple[int, int, int] = (0, 0, 0)) -> None:
        nonlocal block, low, last, level
        if block.parts:
            out.append(block)
            last = low = level
        low, level = min(low, len(stack)), len(stack)
        block = _Block(tag, own, stack[-1], last - low + level - low)  # steps up and down the tree since the block before

    while at < size:
        start = html.find("<", at)
        if start < 0 or start > end:
            text(at, size)
            break
        if html.startswith("<!--", start):
            text(at, start)
            close = html.find("-->", start + 4)
            at = size if close < 0 else close + 3
            continue
        m = _TAG.match(html, start + 1)
        if m is None:
            if html[start + 1] in "!?":
                text(at, start)
                at = html.find(">", start) + 1
            else:
                text(at, start + 1)
                at = start + 1
            continue
        text(at, start)
        stop = m.end()
        while quoted and html[stop] != ">":
            q = _END.search(html, stop)
            if q is None or q[0] == ">":
                stop = q.start() if q else -1
                break
            close = html.find(q[0], q.end())
            quoted = 0 <= close < end
            stop = close + 1
        if not quoted or stop < 0:
            stop = html.find(">", m.end())
        tag, rest, at = m[2].lower(), html[m.end() : stop], stop + 1
        if m[1]:
            if tag == "a":
                in_link = 0
            elif tag in CONTAINER:
                if n_open.get(tag):
                    in_link = 0
                    closed = ""
                    while closed != tag:
                        closed = stack.pop().tag
                        n_open[closed] -= 1
                flush("")
            elif tag in LEAF:
                flush("")
            continue
        if tag in RAW and not rest.endswith("/"):
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at, end + 1)
            at = size if close is None else close.end()
        elif tag == "button" and block.tag not in LEAF:
            close = re.compile(r"</button\b[^>]*>", re.I).search(html, at, end + 1)
            at = size if close is None else close.end()
        elif tag == "br":
            block.parts.append(" ")
        elif tag == "a":
            in_link = 1
        elif tag in CONTAINER:
            inside, number = stack[-1], len(around)
            around.append(inside.number)
            page = tag in ("html", "body")  # names there speak of the whole page
            good, bad, weak = _names(rest) if rest and not page else (0, 0, 0)
            hidden = inside.hidden | bool(rest and not page and _hidden(rest))
            against = tag in AGAINST_TAG and not (tag == "header" and inside.rank == 2)
            rank, outer, inner, reset, form = inside.rank, inside.outer, inside.inner, inside.reset, inside.form
            if tag == "form" and not bad:
                form = _Form(number, form)
                forms.append(form)
            mark, around_weak = float(bad or against), inside.weak
            opens = 2 if tag in FOR_TAG else int(good and not mark)
            if opens == 2 or opens > rank:
                rank, outer, inner, reset, around_weak = opens, outer + inner, 0, number, 0
                if good:  # an article named for both, as by its categories, is judged like what is around it
                    outer, mark = outer + mark / 2, 0.0
            stack.append(_Inside(tag, number, hidden, rank, outer, inner + int(mark), reset, form, around_weak | weak))
            n_open[tag] = n_open.get(tag, 0) + 1
            flush("")
        elif tag in LEAF:
            _, bad, weak = _names(rest) if rest else (0, 0, 0)
            flush(tag, (int(bool(rest and _hidden(rest))), bad, weak))
    flush("")
    return out, around, _judge(out, forms)


def features(block: _Block, text: str, alone: bool) -> list[float]:
    """The block's FEATURES; alone: the page has no other."""
    share = min(1.0, block.links / max(1, sum(map(len, block.parts))))
    heading = block.tag[:1] == "h" and block.tag != "hr"
    ending = text[-1:] in ".!?:;\"'”’»…。"
    words = min(log1p(text.count(" ") + 1), MOST_LOG)
    return [1.0, words, share, block.tag == "p", heading, block.tag in ("li", "label", "dt"), ending, block.inside, block.outside, block.marked, block.weak, *block.own, alone]


def min_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the source's side of a minimum cut (ties: as few nodes as possible)."""
    n = len(scores)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    own, fixed = list(scores), [None] * n
    # A node whose own capacity outweighs its edges is decided; its edges become capacities of its neighbours.
    weight = [sum(x.values()) for x in near]
    queue = deque(range(n) if n > FLOW_NODES else ())
    while queue:
        i = queue.popleft()
        if fixed[i] is None and abs(own[i]) > weight[i] + 1e-9:
            fixed[i] = own[i] > 0
            for j, w in near[i].items():
                own[j] += w if fixed[i] else -w
                weight[j] -= w
                del near[j][i]
                queue.append(j)
            near[i] = {}
    rest = [i for i in range(n) if fixed[i] is None]
    if not rest:
        return [bool(x) for x in fixed]
    source, sink = n, n + 1
    residual: dict[int, dict[int, float]] = {i: dict(near[i]) for i in rest} | {source: {}, sink: {}}
    for i in rest:
        if own[i] > 0:
            residual[source][i], residual[i][source] = own[i], 0.0
        else:
            residual[i][sink], residual[sink][i] = -own[i], 0.0
    while True:  # blocking flows in layers of equal distance from the source
        layer, queue = {source: 0}, deque([source])
        while queue:
            a = queue.popleft()
            for b, w in residual[a].items():
                if w > 1e-12 and b not in layer:
                    layer[b] = layer[a] + 1
                    queue.append(b)
        if sink not in layer:
            return [bool(fixed[i]) if fixed[i] is not None else i in layer for i in range(n)]
        _blocking(residual, layer, source, sink)


def _blocking(residual: dict[int, dict[int, float]], layer: dict[int, int], source: int, sink: int) -> None:
    """Pushes flow along the layers until no path is left in them."""
    steps = {a: iter([b for b in residual[a] if layer.get(b, -1) == layer[a] + 1]) for a in layer}
    path, now = [source], {a: next(steps[a], None) for a in layer}
    while path:
        a = path[-1]
        if a == sink:
            hops = list(zip(path, path[1:], strict=False))
            flow = min(residual[x][y] for x, y in hops)
            keep = len(path)
            for k, (x, y) in enumerate(hops):
                residual[x][y] -= flow
                residual[y][x] = residual[y].get(x, 0.0) + flow
                if residual[x][y] <= 1e-12 and keep == len(path):
                    keep = k + 1
            del path[keep:]
            continue
        while now[a] is not None and residual[a][now[a]] <= 1e-12:
            now[a] = next(steps[a], None)
        if now[a] is None:
            path.pop()
            if path:
                now[path[-1]] = next(steps[path[-1]], None)
        else:
            path.append(now[a])


def _shown(html: str) -> tuple[list[_Block], list[str], list[int], int]:
    """Blocks that are shown and have text, their texts, the container around each container, and the article's rank."""
    found, around, rank = blocks_of(html)
    texts = [" ".join(unescape("".join(b.parts)).split()) if not b.hidden else "" for b in found]
    kept = [(b, t) for b, t in zip(found, texts, strict=True) if t]
    return [b for b, _ in kept], [t for _, t in kept], around, rank


def labelled(html: str, weights: np.ndarray = PRIOR) -> list[tuple[str, float, bool]]:
    """(text, the block's score, label of the minimum cut) of the page's blocks."""
    blocks, texts, around, _ = _shown(html)
    if not blocks:
        return []
    scores = np.clip(np.array([features(b, t, len(blocks) == 1) for b, t in zip(blocks, texts, strict=True)], float) @ weights, -MOST, MOST).tolist()
    nodes: dict[int, int] = {}  # containers around blocks
    edges = []
    for i, b in enumerate(blocks):
        c = b.place
        while c not in nodes:
            nodes[c] = len(blocks) + len(nodes)
            c = around[c]
        edges.append((nodes[b.place], i, INSIDE))
        if i:
            edges.append((i - 1, i, NEXT / (1 + b.apart)))
    edges += [(nodes[around[c]], k, AROUND) for c, k in nodes.items() if c]
    keep = min_cut(scores + [0.0] * len(nodes), edges)
    return list(zip(texts, scores, keep[: len(blocks)], strict=True))


def main_text(html: str | None, weights: np.ndarray = PRIOR) -> str:
    return "\n".join(s for s, _, keep in labelled(html, weights) if keep) if html else ""


def examples(html: str) -> list[tuple[list[float], bool]]:
    """(features, whether it is content) of blocks of a page with an article element; none of another page."""
    blocks, texts, _, rank = _shown(html)
    if rank != 2:
        return []
    chosen = sorted({k * len(blocks) // LEARN_BLOCKS for k in range(LEARN_BLOCKS)}) if len(blocks) > LEARN_BLOCKS else range(len(blocks))
    return [(features(blocks[k], texts[k], len(blocks) == 1), blocks[k].inside and not blocks[k].marked and not any(blocks[k].own)) for k in chosen]


def fitted(rows: np.ndarray, content: np.ndarray) -> np.ndarray:
    """Weights of the logistic classifier around PRIOR; every row counts as it is and without its structure."""
    bare = rows.copy()
    bare[:, STRUCTURE:] = 0
    x, y, w = np.concatenate([rows, bare]), np.concatenate([content, content]).astype(float), PRIOR.copy()
    if not len(x):
        return w
    share = min(1.0, EVIDENCE / len(x))
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = share * (x.T @ (p - y)) + (w - PRIOR) / VARIANCE
        bend = share * (x.T * (p * (1 - p))) @ x + np.eye(len(w)) / VARIANCE
        w = w - np.linalg.solve(bend, slope)
    return w


def fit(pages: DataFrame, learn: int = LEARN) -> np.ndarray:
    """The classifier's weights, from at most that many pages with an article element (those of the lowest hashes)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for html in batch.column("html").to_pylist() for x in examples(html)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.list_(pa.float64())), pa.array([y for _, y in found], pa.bool_())], ["x", "y"])

    html = F.col("html").cast("string")
    rows = pages.select(html.alias("html"), F.xxhash64(F.col("page_id").cast("long"), html).alias("turn")).filter(F.col("html").rlike(r"(?i)<(article|main)\b"))
    found = rows.orderBy("turn").limit(learn).select("html").mapInArrow(emit, "x array<double>, y boolean").toArrow()  # learn * LEARN_BLOCKS rows
    x = found.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    return fitted(x, found.column("y").to_numpy())


def _extracted(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), weights) for x in batch.column("html")]
            chars = pa.array([len(x) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), chars], ["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages; weights are those of ``fit`` on the pages themselves unless given."""
    weights = fit(pages) if weights is None else weights
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extracted(weights), "page_id long, url string, text string, n_chars long")
