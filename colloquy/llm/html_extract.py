"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree: block elements are inner nodes, runs of text between block
boundaries are leaves. Every node is content or not. Node potentials are log-linear in
the node's own markup and text; parent-child potentials tie neighbours together. One
pass of messages up the tree and one down give exact marginals; leaves with a content
marginal of one half or more make up the text. All pages of a batch form one forest, so
messages run level by level over arrays. Weights are trained by maximum likelihood on
labelled pages (``html_pages``).
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from colloquy.llm.common import prepared, slices, table
from colloquy.llm.html_pages import MARK, labelled_pages

#: Labelled pages for training, steps of training, and the seed of the pages.
TRAIN_PAGES, STEPS, SEED = 500, 250, 2

# Fixed values of the HTML standard: elements that hold no text of the page, that have
# no end tag, and that stand for blocks.
# Of ``math`` readers see all but its annotations; ``xmp`` shows its text as it is written.
RAW = frozenset("script style noscript template title textarea iframe object svg canvas audio video noembed noframes annotation annotation-xml".split())
VERBATIM = "xmp"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup html label legend li main menu nav ol optgroup option p pre search section select "
    "summary table tbody td tfoot th thead tr ul xmp".split()
)
#: An element that opens closes an open one of these, up to the nearest of the others.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "optgroup"}),
}
# A quote opens a string only right after "="; anywhere else it is a plain character.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)?)*+)>")
_LETTER = re.compile("[a-zA-Z]")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTR = re.compile(r"(?:^|\s)(class|id|role|style|hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in (*RAW, VERBATIM)}


@dataclass
class Tree:
    """Nodes in page order: parents come before their children. Leaves have a text."""

    parent: list[int]
    depth: list[int]
    tag: list[str]
    attrs: list[str]
    text: list[str | None]
    linked: list[int]


def parse(page: str | None) -> Tree:
    """Tree of a page; broken markup is read as browsers mostly do. Linear in its length."""
    t = Tree([-1], [0], ["#page"], [""], [None], [0])
    page = page or ""
    stack, run, linked, links, at, size = [0], [], 0, 0, 0, len(page)
    # Where in the stack the open elements of each name are: a look-up never walks the stack.
    places: dict[str, list[int]] = {}

    def nearest(names: Iterable[str]) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=-1)

    def cut(depth: int) -> None:
        for node in stack[depth:]:
            places[t.tag[node]].pop()
        del stack[depth:]

    def add(tag: str, attrs: str, text: str | None = None, inside: int = 0) -> int:
        t.parent.append(stack[-1])
        t.depth.append(t.depth[stack[-1]] + 1)
        t.tag.append(tag)
        t.attrs.append(attrs)
        t.text.append(text)
        t.linked.append(inside)
        return len(t.parent) - 1

    def flush() -> None:
        nonlocal run, linked
        if run:
            body = "".join(run)
            body = " ".join((html.unescape(body) if "&" in body else body).split())
            if body:
                add("#text", "", body, linked)
        run, linked = [], 0

    while at < size:
        lt = page.find("<", at)
        end = size if lt < 0 else lt
        if end > at:
            run.append(page[at:end])
            if links:
                linked += end - at
        if lt < 0:
            break
        nxt = page[lt + 1 : lt + 2]
        if nxt in ("!", "?"):
            close = "-->" if page.startswith("<!--", lt) else ">"
            stop = page.find(close, lt + 2)
            at = size if stop < 0 else stop + len(close)
            continue
        if nxt == "/" and not _LETTER.match(page, lt + 2):  # no end tag: a comment up to the next >
            stop = page.find(">", lt + 2)
            if stop < 0:
                break
            at = stop + 1
            continue
        m = _TAG.match(page, lt) or _LOOSE.match(page, lt)
        if not m:
            if nxt == "/" or _LETTER.match(nxt):  # cut off inside a tag
                break
            run.append("<")
            at = lt + 1
            continue
        at, name, closing = m.end(), m[2].lower(), m[1]
        if name in RAW and not closing:
            if not m[3].endswith("/"):
                stop = _END[name].search(page, at)
                at = stop.end() if stop else size
            run.append(" ")
            continue
        if name == "a":
            links = 0 if closing else 1
            continue
        if name in VOID:
            if name in ("br", "hr"):
                run.append(" ")
            if name == "hr":
                flush()
            continue
        if name not in BLOCKS:
            continue
        flush()
        links = 0
        if closing:
            open_at = nearest((name,))
            if open_at > 0:
                cut(open_at)
            continue
        if t.tag[stack[-1]] == "p":
            cut(len(stack) - 1)
        if name in CLOSES:
            closed, bounds = CLOSES[name]
            open_at = nearest(closed)
            if open_at > nearest(bounds):
                cut(open_at)
        shown = "pre" if name == VERBATIM else name
        places.setdefault(shown, []).append(len(stack))
        stack.append(add(shown, m[3]))
        if name == VERBATIM:
            stop = _END[name].search(page, at)
            end = stop.start() if stop else size
            run.append(html.escape(page[at:end], quote=False))
            flush()
            cut(len(stack) - 1)
            at = stop.end() if stop else size
    flush()
    return t


def _scale(n: int) -> int:
    return min(9, n.bit_length())


@lru_cache(maxsize=4096)
def _markup(tag: str, attrs: str) -> tuple[str, ...]:
    out = [f"t:{tag}"]
    if attrs:
        for name, value in _ATTR.findall(attrs):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or name == "style" and "display:none" in value.lower().replace(" ", ""):
                out.append("hidden")
            elif name != "style":
                out += [f"c:{w.lower()}" for w in _NAME.findall(value)]
    return tuple(dict.fromkeys(out))


def node_features(t: Tree) -> Iterator[tuple[int, str]]:
    for i, text in enumerate(t.text):
        up = t.tag[t.parent[i]] if i else "#"
        if text is None:
            for f in _markup(t.tag[i], t.attrs[i]):
                yield i, f
            yield i, f"u:{up}>{t.tag[i]}"
            continue
        n = len(text)
        words = text.count(" ") + 1
        share = min(4, 4 * t.linked[i] // max(1, n))
        yield i, "leaf"
        yield i, f"w:{_scale(words)}"
        yield i, f"k:{share}"
        yield i, f"w:{_scale(words)} k:{share}"
        yield i, f"p:{up}"
        yield i, f"p:{up} w:{_scale(words)}"
        yield i, "stop" if text[-1] in ".!?" else "open"
        if "©" in text:
            yield i, "copyright"


class Forest:
    """Trees of a batch as arrays, with message passing over all of them at once."""

    def __init__(self, trees: list[Tree]):
        first = np.cumsum([0] + [len(t.parent) for t in trees])
        self.first = first
        self.parent = np.concatenate([np.where(np.array(t.parent) < 0, -1, np.array(t.parent) + f) for t, f in zip(trees, first)])
        depth = np.concatenate([t.depth for t in trees])
        order = np.argsort(depth, kind="stable")
        bounds = np.searchsorted(depth[order], np.arange(1, depth.max() + 2))
        self.levels = [order[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        # Two kinds of edges: to an element, to a text.
        self.kind = np.concatenate([[1 if x is not None else 0 for x in t.text] for t in trees])

    def beliefs(self, node: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log beliefs of nodes, messages to parents, and what nodes hold from below.

        ``node[n, state]`` and ``edge[kind, parent state, child state]`` are log potentials.
        """
        below = node.copy()
        up = np.zeros_like(node)
        for level in reversed(self.levels):
            up[level] = np.logaddexp.reduce(edge[self.kind[level]] + below[level][:, None, :], axis=2)
            np.add.at(below, self.parent[level], up[level])
        full = below.copy()
        for level in self.levels:
            above = full[self.parent[level]] - up[level]
            full[level] += np.logaddexp.reduce(edge[self.kind[level]] + above[:, :, None], axis=1)
        return full, up, below


@dataclass
class ContentModel:
    weights: dict[str, float]
    edge: np.ndarray

    def marginals(self, trees: list[Tree]) -> list[np.ndarray]:
        """Probability of content of every node of each tree."""
        forest = Forest(trees)
        node = np.zeros((forest.first[-1], 2))
        weights = self.weights
        for t, f in zip(trees, forest.first):
            for i, name in node_features(t):
                w = weights.get(name)
                if w is not None:
                    node[f + i, 1] += w
        full, _, _ = forest.beliefs(node, self.edge)
        p = 1 / (1 + np.exp(np.clip(full[:, 0] - full[:, 1], -700, 700)))
        return np.split(p, forest.first[1:-1])

    def texts(self, pages: list[str | None]) -> list[str]:
        """Main text of each page."""
        trees = [parse(p) for p in pages]
        return [
            "\n".join(x for x, p in zip(t.text, marginal) if x is not None and p >= 0.5)
            for t, marginal in zip(trees, self.marginals(trees))
        ]


def train(pages: list[str], steps: int = STEPS, ridge: float = 2e-4, rate: float = 0.15) -> ContentModel:
    """Maximum-likelihood weights from pages whose content leaves start with ``MARK``.

    An inner node is content where some leaf below it is. The gradient is what is seen
    less what the model expects, of node features and of parent-child states.
    """
    trees = [parse(p) for p in pages]
    labels = []
    for t in trees:
        label = np.zeros(len(t.parent), int)
        for i in range(len(t.parent) - 1, -1, -1):
            if t.text[i] is not None and MARK in t.text[i]:
                label[i] = 1
                t.text[i] = t.text[i].replace(MARK, "")
            if label[i] and i:
                label[t.parent[i]] = 1
        labels.append(label)
    y = np.concatenate(labels)
    forest = Forest(trees)
    names: dict[str, int] = {}
    pairs = [(f + i, names.setdefault(name, len(names))) for t, f in zip(trees, forest.first) for i, name in node_features(t)]
    rows, columns = np.array(pairs).T
    n, d = len(y), len(names)
    child = np.flatnonzero(forest.parent >= 0)
    up_y, kind = y[forest.parent[child]], forest.kind[child]
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (kind, up_y, y[child]), 1)
    w, edge = np.zeros(d), np.zeros((2, 2, 2))
    m, v = np.zeros(d + 8), np.zeros(d + 8)
    for step in range(1, steps + 1):
        node = np.zeros((n, 2))
        node[:, 1] = np.bincount(rows, w[columns], n)
        full, up, below = forest.beliefs(node, edge)
        p = 1 / (1 + np.exp(np.clip(full[:, 0] - full[:, 1], -700, 700)))
        joint = (full[forest.parent[child]] - up[child])[:, :, None] + edge[kind] + below[child][:, None, :]
        joint -= joint.max((1, 2), keepdims=True)
        joint = np.exp(joint)
        joint /= joint.sum((1, 2), keepdims=True)
        expected = np.stack([joint[kind == k].sum(0) for k in (0, 1)])
        grad = np.concatenate([np.bincount(columns, (p - y)[rows], d), (expected - seen).ravel()]) / len(pages)
        grad += ridge * np.concatenate([w, edge.ravel()])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, edge = w - move[:d], edge - move[d:].reshape(2, 2, 2)
    return ContentModel({name: float(w[i]) for name, i in names.items()}, edge)


def extract(pages: DataFrame, model: ContentModel | None = None, key: str = "page_id", source: str = "html") -> DataFrame:
    """``key, text`` of every row: the main text of the page.

    A null or empty page, and one without content, has an empty text. Rows are
    independent; repeated rows give repeated results; other columns are not read. The
    model (some hundred kB) is sent to each executor once.
    """
    spark = prepared(pages.sparkSession)
    shared = spark.sparkContext.broadcast(model or default_model())
    found = pages.select(F.struct(*[F.col(f"`{c}`") for c in ([key] if isinstance(key, str) else key)]).alias("key"), F.col(source).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            texts = shared.value.texts(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["key", "text"])

    kind = found.schema["key"].dataType.simpleString()
    return found.mapInArrow(run, f"key {kind}, text string").select("key.*", "text")


@cache
def default_model() -> ContentModel:
    """The model of the generated pages, trained once in a driver: its pages are always the same."""
    return train(labelled_pages(TRAIN_PAGES, SEED))


def op2_html_extract(spark, sf_dir: str) -> DataFrame:
    """Main text of every page and its length in characters."""
    found = extract(table(prepared(spark), sf_dir, "pages"), key=["page_id", "url"])
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
