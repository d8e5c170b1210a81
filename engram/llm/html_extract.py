"""Main text of web pages by minimum-cut labelling.

A page becomes blocks: runs of text between block-level tags, each in its boxes (elements). Blocks and boxes are the nodes
of a graph. A classifier gives a block its log-odds of being content by its text alone; a box has evidence by its tag and
names. Both become capacities to the source (content) or the sink (boilerplate). Smoothness edges tie a block to its box, a
box to the one around it (as strongly as it has text), and neighbours in the page by their closeness in the DOM. The
minimum cut is the labelling of least cost, so that a box's evidence reaches its blocks, and enough prose outweighs a
box's name. Nodes whose own capacity outweighs all their edges are settled first (exactly), the others by augmenting paths.

The classifier is fitted to the pages themselves: blocks in article and main elements against those in nav, footer and
aside elements, on a bounded sample of pages, as a linear discriminant, from sums of one pass.
"""

from __future__ import annotations

import math
import re
from collections import deque
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import add_columns, arrow_map, prepare, quoted, widened

#: Tags: text within is never shown as prose; block-level; void.
SKIPPED = frozenset("head script style noscript template svg math iframe object canvas audio video select option datalist button textarea title map".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6".split())
#: Evidence of a box: log-odds by tag, and by the words of its class, id, role and label (whole words, or beginnings).
TAGS = dict.fromkeys("nav footer aside form menu dialog search fieldset".split(), -200.0) | {"header": -30.0, "main": 200.0, "article": 12.0}
WORDS = dict.fromkeys("ad ads dfp outbrain taboola cookie cookies gdpr consent comment comments disqus reply replies".split(), -200.0)
WORDS |= dict.fromkeys("banner popup modal overlay respond discussion newsletter signup login breadcrumb breadcrumbs sidebar sidenav pagination pager navbar menu menus footer".split(), -60.0)
WORDS |= dict.fromkeys("nav navigation notice notices alert related share sharing widget widgets toolbar copyright masthead skip".split(), -30.0)
WORDS |= dict.fromkeys("social legal disclaimer header head forms form foot search side".split(), -1.0)
WORDS |= dict.fromkeys("article content post entry main story prose text body news".split(), 4.0)
BEGINNINGS = {"advert": -200.0, "sponsor": -60.0, "promo": -60.0, "subscri": -60.0, "recommend": -30.0}
NEGATORS = frozenset("no not non has have with without".split())
STRONG, LOW, HIGH, TIE, CLIP, LINKS = -60.0, -200.0, 6.0, 3.0, 2.8, -4.0
#: The characters that count as one unit of capacity, and the most units of a block; pages of the sample (expected).
UNIT, UNITS, SAMPLE_PAGES = 100, 8.0, 2000
#: Weights of FEATURES, the constant first, where no blocks tell content and boilerplate apart.
FEATURES = ("one", "length", "linked", "ended", "commas")
PLAIN = (0.0, 1.0, -5.0, 0.8, 0.4)
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
NAMES = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
STYLE = re.compile(r"\bstyle\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", re.I)
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
VALUES = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
CAMEL = re.compile(r"([a-z])([A-Z])")


def hidden(attributes: str) -> bool:
    """By the attribute hidden, by aria-hidden, or by its style; the word elsewhere says nothing."""
    if any(INVISIBLE.search(a or b) for a, b in STYLE.findall(attributes)):
        return True
    if re.search(r"\baria-hidden\s*=\s*[\"']?true", attributes, re.I):
        return True
    return "hidden" in VALUES.sub(" ", attributes).lower().split()


def named(attributes: str) -> float:
    """Evidence of the words in an element's names; a word after `no`, `with` and the like says what its layout has."""
    names = " ".join(a or b or c for a, b, c in NAMES.findall(attributes))
    words = re.split(r"[^a-z0-9]+", CAMEL.sub(r"\1-\2", names).lower())
    found = {w: WORDS[w] if w in WORDS else next((v for k, v in BEGINNINGS.items() if w.startswith(k)), 0.0) for before, w in zip(["", *words], words) if before not in NEGATORS}
    return max(LOW, min(HIGH, sum(found.values())))


class Box:
    """An open element: its tag, its own evidence, whether it stands in an article, in a tag that is never content (sure),
    or in what its tags or names call boilerplate (bad)."""

    __slots__ = ("tag", "up", "depth", "evidence", "skip", "main", "bad", "sure", "units", "linked", "place")

    def __init__(self, tag: str, up: Box | None, attributes: str = ""):
        self.tag, self.up, self.depth, self.units, self.linked, self.place = tag, up, up.depth + 1 if up else 0, 0.0, 0.0, -1
        plain = tag in ("html", "body")
        self.skip = tag in SKIPPED or bool(up and up.skip) or bool(attributes) and not plain and hidden(attributes)
        own = TAGS.get(tag, 0.0)
        self.sure = bool(up and up.sure) or own <= LOW
        if up and (tag == "header" and up.main or tag == "main" and up.sure or tag == "article" and up.bad):
            own = 0.0
        main = tag in ("article", "main") and own > 0
        if attributes and not plain:
            own = max(LOW, own + named(attributes))
        self.evidence = own
        self.main = main or bool(up and up.main)
        self.bad = self.sure or own <= STRONG or bool(up and up.bad) and not main


class Block:
    __slots__ = ("parts", "box", "linked", "text")

    def __init__(self, box: Box):
        self.parts, self.box, self.linked, self.text = [], box, 0, ""


def blocks(html: str) -> list[Block]:
    """Blocks in page order; unclosed and stray tags are tolerated."""
    root = box = Box("html", None)
    out, now, links, at, low = [], None, 0, 0, None

    def put(raw: str) -> None:
        nonlocal now
        if box.skip or not raw or (now is None and raw.isspace()):
            return
        if now is None:
            out.append(now := Block(box))
        now.parts.append(raw)
        if links:
            now.linked += len(raw.strip())

    search, n = TAG.search, len(html)
    while at < n:
        m = search(html, at)
        if m is None:
            rest = html[at:]
            put(rest)
            break
        put(html[at : m.start()])
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        if m.group(1):  # a closing tag
            if name == "a":
                links = max(0, links - 1)
            elif name in BLOCKS or name in SKIPPED:
                up = box
                while up is not root and up.tag != name:
                    up = up.up
                if up is not root:
                    box = up.up
                if name in BLOCKS:
                    now = None
            continue
        if name in RAW:  # nothing in it is a tag
            low = low or html.lower()
            end = low.find("</" + name, at)
            at = n if end < 0 else end
            if end < 0:
                break
            at = html.find(">", at) + 1 or n
            continue
        if name == "a":
            links += not m.group(3).endswith("/")
        elif name in BLOCKS or name in SKIPPED:
            if name in BLOCKS:
                now, links = None, 0
            if name in VOID:
                continue
            if name == "body":
                while box is not root:
                    box = box.up
            if name in BLOCKS and box.tag in PARAGRAPHS and (name in PARAGRAPHS or name not in ("br", "hr")):
                box = box.up
            if name in ("li", "dt", "dd", "td", "th", "tr", "option") and box.tag == name:
                box = box.up
            new = Box(name, box, m.group(3))
            if name in ("article", "main") and box.bad and named(m.group(3)) >= 0:
                low = low or html.lower()
                up = box
                while up is not root and low.find("</" + up.tag, at) < 0:  # never closed: it does not hold the article
                    up = up.up
                box = up
                new = Box(name, box, m.group(3))
            if not m.group(3).endswith("/"):
                box = new
    for b in out:
        b.text = " ".join(unescape("".join(b.parts)).split())
    return [b for b in out if b.text]


def features(b: Block) -> list[float]:
    """What the text of a block says, in the order of FEATURES."""
    n = len(b.text)
    ended = b.text[-1] in ".!?…\"'”»:;" and b.text[0] != "©"
    return [1.0, max(-1.5, min(2.5, math.log(n / 40))), min(1.0, b.linked / n), float(ended), min(1.0, 25.0 * sum(map(b.text.count, ",;")) / n)]


def sums_of(html: str) -> np.ndarray:
    """For boilerplate and content that tags tell: the number of blocks, sums of their features and of products."""
    k = len(FEATURES)
    out = np.zeros((2, k + 1, k))
    for b in blocks(html):
        if b.box.sure or b.box.main and not b.box.bad:
            x = np.array(features(b))
            side = out[int(not b.box.sure)]
            side[0] += x
            side[1:] += np.outer(x, x)
    return out


def discriminant(sums: np.ndarray) -> tuple[float, ...]:
    """Weights of a linear discriminant from such sums; PLAIN where one side has fewer than a hundred blocks."""
    n0, n1 = sums[0, 0, 0], sums[1, 0, 0]
    if min(n0, n1) < 100:
        return PLAIN
    m0, m1 = sums[0, 0, 1:] / n0, sums[1, 0, 1:] / n1
    spread = sum(s[2:, 1:] - n * np.outer(m, m) for s, n, m in ((sums[0], n0, m0), (sums[1], n1, m1))) / (n0 + n1)
    w = np.linalg.solve(spread + 0.02 * np.eye(len(m0)), m1 - m0)
    return (float(-w @ (m0 + m1) / 2), *w.tolist())  # as if both sides were equally frequent


def _apart(a: Box, b: Box) -> int:
    """Steps between two boxes in the tree."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.up
        else:
            b = b.up
        steps += 1
    return steps


def graph(found: list[Block], weights: tuple[float, ...]) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Costs of the nodes (blocks first, then their boxes) and ties."""
    boxes: list[Box] = []
    units = [min(UNITS, max(len(b.text), 2) / UNIT) for b in found]
    for b, u in zip(found, units, strict=True):
        box = b.box
        while box is not None:
            if box.place < 0:
                box.place = len(found) + len(boxes)
                boxes.append(box)
            box.units += u
            box.linked += u * min(1.0, b.linked / len(b.text))
            box = box.up
    costs = [u * max(-CLIP, min(CLIP, sum(w * x for w, x in zip(weights, features(b), strict=True)))) for b, u in zip(found, units, strict=True)]
    # outside of articles, boxes that are mostly links are lists of links; paragraphs and headings are likely content
    costs += [box.evidence + (box.units if box.tag in PARAGRAPHS or box.tag in ("blockquote", "pre") else 0.0) + (LINKS * max(1.0, box.units) if box.linked > 0.7 * box.units and not box.main else 0.0) for box in boxes]
    ties = [(i, b.box.place, (TIE + 0.5) * u) for i, (b, u) in enumerate(zip(found, units, strict=True))]
    ties += [(box.place, box.up.place, TIE * box.units) for box in boxes if box.up is not None]
    ties += [(i - 1, i, 2.0 * min(units[i - 1], units[i]) / (1 + _apart(found[i - 1].box, found[i].box))) for i in range(1, len(found))]
    return costs, ties


def minimum_cut(costs: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """True (content) or False for each block, of least cost: a block labelled against its log-odds pays them, and ends
    of a tie with different labels pay its weight. Equal costs are boilerplate."""
    n = len(costs)
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for i, j, w in ties:
        near[i].append((j, w))
        near[j].append((i, w))
    cost, label = list(costs), [None] * n
    queue = deque(range(n))
    while queue:  # settled: the own cost is more than all open ties
        i = queue.popleft()
        if label[i] is None and abs(cost[i]) > sum(w for j, w in near[i] if label[j] is None):
            label[i] = cost[i] > 0
            for j, w in near[i]:
                if label[j] is None:
                    cost[j] += w if label[i] else -w
                    queue.append(j)
    left = [i for i in range(n) if label[i] is None]
    if left:
        at = {i: k for k, i in enumerate(left)}
        source, sink = len(left), len(left) + 1
        graph: list[dict[int, float]] = [{} for _ in range(len(left) + 2)]
        for i in left:
            graph[source][at[i]], graph[at[i]][source] = max(0.0, cost[i]), 0.0
            graph[at[i]][sink], graph[sink][at[i]] = max(0.0, -cost[i]), 0.0
            for j, w in near[i]:
                if label[j] is None:
                    graph[at[i]][at[j]] = graph[at[i]].get(at[j], 0.0) + w
        side = _reachable(graph, source, sink)
        for i in left:
            label[i] = at[i] in side
    return label


def _reachable(graph: list[dict[int, float]], source: int, sink: int) -> set[int]:
    """Nodes on the source's side of a minimum cut: shortest augmenting paths by levels."""
    tiny = 1e-9
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            u = queue.popleft()
            for v, c in graph[u].items():
                if c > tiny and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if sink not in level:
            return set(level)
        ways = [iter(list(g)) for g in graph]
        path = [source]
        while path:
            u = path[-1]
            if u == sink:
                flow = min(graph[a][b] for a, b in zip(path, path[1:]))
                cut = 0
                for k, (a, b) in enumerate(zip(path, path[1:])):
                    graph[a][b] -= flow
                    graph[b][a] = graph[b].get(a, 0.0) + flow
                    if graph[a][b] <= tiny and not cut:
                        cut = k + 1
                del path[max(1, cut) :]
                continue
            for v in ways[u]:
                if graph[u][v] > tiny and level.get(v) == level[u] + 1:
                    path.append(v)
                    break
            else:
                path.pop()


def main_text(html: str, weights: tuple[float, ...] = PLAIN) -> tuple[str, int, int, int]:
    """The text, the number of blocks, of those that are content, and of those whose label is not that of their own cost."""
    found = blocks(html)
    if not found:
        return "", 0, 0, 0
    costs, ties = graph(found, weights)
    label = minimum_cut(costs, ties)[: len(found)]
    kept = [b.text for b, good in zip(found, label, strict=True) if good]
    return " ".join(kept), len(found), len(kept), sum(good != (c > 0) for good, c in zip(label, costs))


def fit_blocks(pages: DataFrame, html_col: str = "html", sample_pages: int = SAMPLE_PAGES) -> tuple[float, ...]:
    """The weights of a block's features, from about sample_pages pages (all, if fewer), chosen by a hash of their html."""
    prepare(pages.sparkSession)
    html = pages.select(F.col(quoted(html_col)).cast("string").alias("html")).where("html is not null")
    share = min(1.0, sample_pages / max(1, html.count()))
    some = html.where(F.pmod(F.xxhash64("html"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)

    def run(b: pa.RecordBatch) -> dict:
        total = sum(map(sums_of, b.column(0).to_pylist()), np.zeros((2, len(FEATURES) + 1, len(FEATURES))))
        return {"at": pa.array(np.arange(total.size)), "x": pa.array(total.ravel())}

    rows = arrow_map(some, run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()  # a row for each sum
    total = np.zeros((2, len(FEATURES) + 1, len(FEATURES)))
    for r in rows:
        total.flat[r["at"]] = r.x
    return discriminant(total)


def extract_text(pages: DataFrame, html_col: str = "html", weights: tuple[float, ...] = PLAIN) -> DataFrame:
    """pages with text (string), n_chars (long, code points), n_blocks, n_content and n_turned (int: blocks that the cut
    labels against their own cost). weights: those of fit_blocks.

    Null and empty html, and pages without content, give the empty text. Each row is for itself, so that repeated rows have
    the same text; columns with the new names are replaced, all others pass through. An empty table gives no rows."""
    prepare(pages.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [main_text(h or "", weights) for h in batch.column(batch.schema.names.index(html_col)).cast(pa.string()).to_pylist()]
        counts = {n: pa.array([g[k] for g in got], pa.int32()) for k, n in ((1, "n_blocks"), (2, "n_content"), (3, "n_turned"))}
        return add_columns(batch, text=pa.array([g[0] for g in got], pa.string()), n_chars=pa.array([len(g[0]) for g in got], pa.int64()), **counts)

    return arrow_map(pages, run, widened(pages, text="string", n_chars="bigint", n_blocks="int", n_content="int", n_turned="int"))


def op5_html(spark, sf_dir: str) -> DataFrame:
    """One row for each row of pages: page_id, url, text, n_chars and counts of blocks. Cases are those of extract_text."""
    pages = common.read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_text(pages, weights=fit_blocks(pages)).select("page_id", "url", "text", "n_chars", "n_blocks", "n_content", "n_turned")
