"""Main text of web pages by a tree-structured graphical model.

The nodes are a page's block elements and its runs of text; each is content or not. A node's own evidence is log-linear in its tag,
names, length and links; parent-child potentials connect the nodes; sum-product messages up and down the tree give every node's exact
marginal. Both are trained together from labelled pages: ``labelled_pages.PAGES`` unless a caller brings their own.
"""

from __future__ import annotations

import html as entities
import math
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements by how HTML treats them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math textarea select canvas title".split())
INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr button".split()
)
CLOSED_BY_LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
P_FENCES = frozenset("table td th button article section main aside nav header footer body html div form".split()) - {"div", "form"}

# Names in class, id and role that hint at a part of a page; their weights are learned.
CUES = (
    "ad ads advert sponsor promo banner nav menu header footer head foot sidebar aside side widget cookie consent notice alert popup modal gdpr comment "
    "comments reply discussion form login signup search subscribe newsletter share social related recommend breadcrumb pager pagination tags toolbar "
    "copyright legal article content main post entry body story text page wrap container title headline"
).split()

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)?", re.S)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?(?:false|until))|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
LABEL = re.compile(r"\bdata-content\s*=\s*[\"']?([01])", re.I)
SPACE = re.compile(r"\s+")


@dataclass
class Tree:
    """A page's nodes in document order, so that a parent comes before its children. Runs of text have the tag '#run'."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    attributes: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)

    def add(self, parent: int, tag: str, attributes: str = "", text: str = "", linked: int = 0) -> int:
        for column, value in zip((self.parent, self.tag, self.attributes, self.text, self.linked), (parent, tag, attributes, text, linked)):
            column.append(value)
        return len(self.tag) - 1


def parse(page: str) -> Tree:
    """Blocks and text runs of a page. Broken markup is read as browsers do in the common cases: missing and stray ends, unclosed quotes."""
    tree = Tree()
    stack: list[tuple[str, int]] = [("#root", tree.add(-1, "#root"))]  # open elements; inline ones carry their block's node
    run: list[str] = []
    links = [0, 0]  # open links; characters inside links in this run

    def flush() -> None:
        text = SPACE.sub(" ", "".join(run)).strip()
        if text:
            tree.add(stack[-1][1], "#run", "", text, links[1])
        run.clear()
        links[1] = 0

    def feed(piece: str) -> None:
        piece = entities.unescape(piece) if "&" in piece else piece
        run.append(piece)
        if links[0]:
            links[1] += len(piece.strip())

    def close_to(depth: int) -> None:
        if any(t not in INLINE for t, _ in stack[depth:]):
            flush()
        links[0] -= sum(t == "a" for t, _ in stack[depth:])
        del stack[depth:]

    def closes(tag: str) -> None:
        """Elements that a start tag ends without saying so."""
        like, fences = CLOSED_BY_LIKE.get(tag), FENCES.get(tag, ())
        if like:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in like:
                    close_to(depth)
                    if tag != "tr":
                        return
                elif stack[depth][0] in fences:
                    return
        elif tag not in INLINE:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == "p":
                    return close_to(depth)
                if stack[depth][0] in P_FENCES:
                    return

    at = 0
    while True:
        found = TOKEN.search(page, at)
        if found is None:
            feed(page[at:])
            break
        if found.start() > at:
            feed(page[at : found.start()])
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:  # an end tag
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == tag:
                    close_to(depth)
                    break
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else (len(page) if tag in ("script", "style", "template", "textarea") else at)
            if tag not in ("script", "style", "title", "template", "noscript"):
                run.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag != "wbr":
                run.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                links[0] += 1
            stack.append((tag, stack[-1][1]))
            continue
        closes(tag)
        flush()
        stack.append((tag, tree.add(stack[-1][1], tag, found[3])))
    flush()
    return tree


LENGTHS, SHARES, COMMAS = (1, 20, 60, 150, 400, 1200, 4000), (0.01, 0.2, 0.5, 0.8), (1, 3, 8)


def name_features(tag: str, attributes: str) -> list[str]:
    names = " ".join(next(filter(None, m), "") for m in NAMED.findall(attributes)).lower() if attributes else ""
    words = set(re.split(r"[^a-z]+", names)) - {""}
    cues = sorted({c for c in CUES for w in words if w == c or (len(c) > 3 and c in w)})
    return [f"tag={tag}", *[f"cue={c}" for c in cues], *(["hidden"] if attributes and HIDDEN.search(attributes) else [])]


def node_shapes(tree: Tree) -> list[tuple]:
    """Of each node, what its text says: (run or block, buckets of length, link share and commas, whether a run ends a sentence)."""
    n = len(tree.tag)
    length, linked, commas = [len(t) for t in tree.text], list(tree.linked), [t.count(",") for t in tree.text]
    for i in range(n - 1, 0, -1):
        p = tree.parent[i]
        length[p] += length[i]
        linked[p] += linked[i]
        commas[p] += commas[i]
    shapes = []
    for i in range(n):
        text = tree.text[i]
        share = linked[i] / length[i] if length[i] else 0
        sizes = bisect_right(LENGTHS, length[i]), bisect_right(SHARES, share), bisect_right(COMMAS, commas[i])
        shapes.append(("run", *sizes, text[-1] in ".!?:;。") if text else ("block", *sizes, None))
    return shapes


def shape_features(shape: tuple) -> list[str]:
    kind, length, links, commas, stop = shape
    found = [f"{kind}:length={length}", f"{kind}:links={links}", f"{kind}:commas={commas}"]
    return found if stop is None else [*found, f"run:stop={stop}"]


@dataclass
class Model:
    """Log odds of content by feature, and log potentials [parent's label][child's label] by the parent's tag ('' for tags not seen)."""

    weights: dict[str, float]
    bias: float
    pair: dict[str, list[list[float]]]

    def marginals(self, tree: Tree) -> list[float]:
        """Probability of content of every node: one pass of messages from the leaves up, one from the root down."""
        n = len(tree.tag)
        weight, known, own = self.weights, {}, []
        for name, shape in zip(zip(tree.tag, tree.attributes), node_shapes(tree)):
            if name not in known:
                known[name] = sum(weight.get(f, 0.0) for f in name_features(*name))
            if shape not in known:
                known[shape] = sum(weight.get(f, 0.0) for f in shape_features(shape))
            own.append(self.bias + known[name] + known[shape])
        # messages as log odds: what the subtree below says of its parent's label
        pair, other = self.pair, self.pair[""]
        belief, up = own[:], [0.0] * n
        for i in range(n - 1, 0, -1):
            (a, b), (c, d) = pair.get(tree.tag[tree.parent[i]], other)
            up[i] = _lse(c, d + belief[i]) - _lse(a, b + belief[i])
            belief[tree.parent[i]] += up[i]
        for i in range(1, n):
            (a, b), (c, d) = pair.get(tree.tag[tree.parent[i]], other)
            rest = belief[tree.parent[i]] - up[i]
            belief[i] += _lse(b, d + rest) - _lse(a, c + rest)
        return [1 / (1 + math.exp(-max(-500.0, min(500.0, z)))) for z in belief]

    def main_text(self, page: str | None) -> str:
        if not page:
            return ""
        tree = parse(page)
        chance = self.marginals(tree)
        return "\n\n".join(t for t, tag, p in zip(tree.text, tree.tag, chance) if tag == "#run" and p >= 0.5)


def _lse(x: float, y: float) -> float:
    high = x if x > y else y
    return high + math.log1p(math.exp(-abs(x - y)))


def labels_of(tree: Tree) -> list[int]:
    """Labels of a labelled page: data-content="1" or "0" holds for an element and what is in it; a block over both kinds is content."""
    given, label = [None] * len(tree.tag), [0] * len(tree.tag)
    for i in range(len(tree.tag)):
        mark = LABEL.search(tree.attributes[i])
        given[i] = int(mark[1]) if mark else (given[tree.parent[i]] if i else None)
        label[i] = given[i] or 0
    for i in range(len(tree.tag) - 1, 0, -1):
        if label[i] and given[tree.parent[i]] is None:
            label[tree.parent[i]] = 1
    return label


def train(pages: Iterable[str], rounds: int = 300, l2: float = 1e-3) -> Model:
    """The model under which the labels of ``pages`` are likeliest: gradient steps on observed less expected counts of features and of
    label pairs, where the expectations are the marginals of the same two message passes, here for all pages at once, depth by depth."""
    parent, depth, tags, rows, label = [], [], [], [], []
    for page in pages:
        tree, start = parse(page), len(parent)
        shapes = node_shapes(tree)
        for i in range(len(tree.tag)):
            parent.append(start + tree.parent[i] if i else -1)
            depth.append(depth[parent[-1]] + 1 if i else 0)
            tags.append(tree.tag[tree.parent[i]] if i else "")
            rows.append([*name_features(tree.tag[i], LABEL.sub("", tree.attributes[i])), *shape_features(shapes[i])])
        label += labels_of(tree)
    names, kinds = sorted({f for row in rows for f in row}), sorted(set(tags) | {""})
    index = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(rows), len(names) + 1))
    x[:, -1] = 1
    for r, row in enumerate(rows):
        x[r, [index[f] for f in row]] = 1
    parent, y, level = np.array(parent, np.int64), np.array(label, np.int64), np.array(depth)
    kind = np.array([kinds.index(t) for t in tags])
    levels = [np.flatnonzero(level == d) for d in range(level.max() + 1)] if len(y) else []
    w, pair = np.zeros(x.shape[1]), np.zeros((len(kinds), 4))  # pair: by parent's tag, on top of what holds for all tags ('')
    square, square_pair = np.full_like(w, 1e-4), np.full_like(pair, 1e-4)
    edges = np.flatnonzero(parent >= 0)
    seen = np.zeros_like(pair)
    np.add.at(seen, (kind[edges], 2 * y[parent[edges]] + y[edges]), 1)
    for _ in range(rounds if len(y) else 0):
        a, b, c, d = (pair[kind] + pair[0]).T
        low, up = x @ w, np.zeros(len(y))
        for nodes in reversed(levels[1:]):
            up[nodes] = np.logaddexp(c[nodes], d[nodes] + low[nodes]) - np.logaddexp(a[nodes], b[nodes] + low[nodes])
            np.add.at(low, parent[nodes], up[nodes])
        belief, rest = low.copy(), np.zeros(len(y))
        for nodes in levels[1:]:
            rest[nodes] = belief[parent[nodes]] - up[nodes]
            belief[nodes] += np.logaddexp(b[nodes], d[nodes] + rest[nodes]) - np.logaddexp(a[nodes], c[nodes] + rest[nodes])
        joint = np.stack([a, b + low, c + rest, d + rest + low], 1)[edges]
        joint = np.exp(joint - joint.max(1, keepdims=True))
        joint /= joint.sum(1, keepdims=True)
        expected = np.zeros_like(pair)
        np.add.at(expected, kind[edges], joint)
        g = x.T @ (y - 1 / (1 + np.exp(-np.clip(belief, -500, 500)))) / len(y) - l2 * w
        gap = seen - expected
        gap[0] += gap[1:].sum(0)
        g_pair = gap / len(y) - l2 * pair
        square, square_pair = square + g * g, square_pair + g_pair * g_pair
        w, pair = w + 0.2 * g / np.sqrt(square), pair + 0.2 * g_pair / np.sqrt(square_pair)
    whole = {t: (p + pair[0] if t else p).reshape(2, 2).tolist() for t, p in zip(kinds, pair)}
    return Model(dict(zip(names, w[:-1].tolist())), float(w[-1]), whole)


def _extractor(model: Model):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [model.main_text(page.as_py()) for page in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[*batch.schema.names[:-1], "text", "n_chars"],
            )

    return extract


def main_text(pages: DataFrame, html: str = "html", labelled: Iterable[str] | None = None) -> DataFrame:
    """``pages`` with text (content blocks in page order, joined by two line breaks; empty if none) and n_chars (its code points).

    A null page counts as empty. Repeated rows and other columns stay; input columns named text or n_chars give way.
    """
    if labelled is None:
        from tablemill.llm.labelled_pages import PAGES as labelled
    ready = pages.withColumn("__html", F.col(html))
    ready = ready.drop(*[c for c in pages.columns if c.lower() in ("text", "n_chars")])
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in ready.schema.fields[:-1])
    return ready.mapInArrow(_extractor(train(labelled)), f"{fields}text string, n_chars long")
