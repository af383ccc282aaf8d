"""Main text of web pages by boosted trees over DOM nodes and a decoding that
keeps ancestors and descendants in agreement.

A page becomes a tree of block elements and runs of text (:mod:`dom`).  Each node
is *in* the article, *out* of it, or *mixed* (it holds both; runs cannot be).
Gradient-boosted trees (:mod:`boosting`) give the log probability of the three
for every node from its subtree's density of text, markup and links, its tag and
attribute words and those of its ancestors, its depth, and its siblings.

Decoding takes the best labelling of the whole tree in which everything below an
*in* node is in, and everything below an *out* node is out: a run cannot be kept
in a rejected menu, nor dropped from an element that is wholly article.  It is
exact, by a pass from the leaves to the root and one back.

The trees are fitted once per session on ``TRAIN_PAGES`` pages of known layout
(:mod:`layouts`), since the tables say nothing about the parts of pages; they
are never fitted on pages to be extracted.  Every page is read whole.

Defined cases: a null, empty or text-free page gives an empty text; text without
any markup is one run; scripts, styles, form controls and comments never count;
a page may be cut off anywhere; repeated rows and null ids are kept; other
columns are not read; an empty table has no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from . import boosting, dom, layouts

TRAIN_PAGES, SEED = 700, 7
IN, OUT, MIXED = 0, 1, 2
SMOOTH, CLEAR = 8.0, 0.8
FEATURES = (
    "depth runs chars text_density link_density nodes children siblings place page_share begins stops commas digits capitals link_count controls run_mean run_most short_share "
    "tag name_low name_high above_low above_high nearest sibling_mean sibling_share before after same_tag"
).split()
_STOPS = str.maketrans("", "", ".!?")


def _levels(depth: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)


class Forest:
    """The trees of several pages as arrays; ``parent`` is -1 at roots."""

    def __init__(self, pages: list[dom.Tree]):
        base = np.cumsum([0, *(len(t.parent) for t in pages)])
        self.base = base

        def column(name: str, kind=np.int64) -> np.ndarray:
            return np.array([v for t in pages for v in getattr(t, name)], kind)

        self.page = np.repeat(np.arange(len(pages)), np.diff(base))
        parent = column("parent")
        self.parent = np.where(parent < 0, -1, parent + base[self.page])
        self.depth = column("depth")
        self.tag = [v for t in pages for v in t.tag]
        self.names = [v for t in pages for v in t.names]
        self.text = [v for t in pages for v in t.text]
        self.run = np.array([not t for t in self.tag], bool)
        self.linked, self.links, self.controls = column("linked"), column("links"), column("controls")
        self.markup = column("last") - column("first")
        n = len(self.parent)
        self.levels = _levels(self.depth) if n else []
        # A node's descendants follow it: the end of its subtree, from the leaves up.
        self.end = np.arange(1, n + 1)
        for level in reversed(self.levels):
            p = self.parent[level]
            np.maximum.at(self.end, p[p >= 0], self.end[level[p >= 0]])
        self.holds = self.below(self.run) > 0

    def below(self, value: np.ndarray) -> np.ndarray:
        """Sum over each node and its descendants."""
        total = np.append(0, np.cumsum(value))
        return total[self.end] - total[: len(value)]

    def most_below(self, value: np.ndarray) -> np.ndarray:
        out = value.copy()
        for level in reversed(self.levels):
            p = self.parent[level]
            np.maximum.at(out, p[p >= 0], out[level[p >= 0]])
        return out

    def above(self, value: np.ndarray, of) -> np.ndarray:
        """``of`` (a numpy ufunc) over each node and its ancestors."""
        out = value.copy()
        for level in self.levels[1:]:
            p = self.parent[level]
            out[level] = np.where(p >= 0, of(out[level], out[np.maximum(p, 0)]), out[level])
        return out


def _per(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def features(f: Forest, leaning: dict[str, float]) -> np.ndarray:
    """A row of FEATURES for every node; ``leaning`` is how far a tag or an attribute word speaks for the article."""
    n = len(f.parent)
    size = np.array([len(t) for t in f.text], np.int64)
    stops = np.array([len(t) - len(t.translate(_STOPS)) for t in f.text], np.int64)
    commas = np.array([t.count(",") for t in f.text], np.int64)
    digits = np.array([sum(map(t.count, "0123456789")) for t in f.text], np.int64)
    capitals = np.array([sum(c.isupper() for c in t[:64]) for t in f.text], np.int64)
    heads = np.minimum(size, 64)
    runs, chars, linked, links = (f.below(v) for v in (f.run, size, f.linked, f.links))
    root = f.base[:-1][f.page]
    total = chars[root]
    before_text = np.append(0, np.cumsum(size))[:n] - np.append(0, np.cumsum(size))[root]
    p = np.maximum(f.parent, 0)
    has = f.parent >= 0
    counted = has & f.holds  # siblings without text say nothing
    children, child_chars = (np.bincount(p[counted], v, n) for v in (np.ones(int(counted.sum())), chars[counted]))
    # Order among siblings with text.
    at = np.flatnonzero(counted)
    at = at[np.argsort(f.parent[at], kind="stable")]
    same = np.append(False, f.parent[at][1:] == f.parent[at][:-1]) if len(at) else np.empty(0, bool)
    left, right, place, same_tag = (np.zeros(n) for _ in range(4))
    if len(at):
        left[at[1:]] = np.where(same[1:], chars[at[:-1]], 0)
        right[at[:-1]] = np.where(same[1:], chars[at[1:]], 0)
        first = np.flatnonzero(~same)
        place[at] = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        code = {t: i for i, t in enumerate(dict.fromkeys(f.tag))}
        kind = np.array([code[t] for t in f.tag], np.int64)
        key, inverse, many = np.unique(p[at] * (len(code) + 1) + kind[at], return_inverse=True, return_counts=True)
        same_tag[at] = many[inverse]
    tag = np.array([leaning.get("<" + t, 0.0) for t in f.tag])
    known = [[leaning[w] for w in ws if w in leaning] for ws in f.names]
    low, high = (np.array([g(v, default=0.0) for v in known]) for g in (min, max))
    low_here, high_here = np.minimum(low, tag), np.maximum(high, tag)
    above_low, above_high = f.above(low_here, np.minimum), f.above(high_here, np.maximum)
    spoken = np.where(-low_here > high_here, low_here, high_here)
    nearest = np.where(np.abs(spoken) >= CLEAR, spoken, 0.0)  # of the closest node at or above that speaks clearly
    for level in f.levels[1:]:
        nearest[level] = np.where(nearest[level] != 0, nearest[level], nearest[f.parent[level]])
    siblings = children[p] * has
    mean = _per(child_chars[p] * has, siblings)
    columns = (
        f.depth, np.log1p(runs), np.log1p(chars), _per(chars, np.maximum(f.markup, chars)), _per(linked, chars), np.log1p(f.end - np.arange(n)), children, siblings, _per(place, siblings), _per(chars, total), _per(before_text, total),
        _per(f.below(stops), chars), _per(f.below(commas), chars), _per(f.below(digits), chars), _per(f.below(capitals), f.below(heads)), np.log1p(links), f.below(f.controls), np.log1p(_per(chars, runs)), np.log1p(f.most_below(size)),
        _per(f.below(f.run & (size < 40)), runs), tag, low, high, above_low, above_high, nearest, np.log1p(mean), _per(chars, child_chars[p] * has), np.log1p(left), np.log1p(right), _per(same_tag, siblings),
    )
    return np.stack([np.asarray(c, float) for c in columns], axis=1) if n else np.empty((0, len(FEATURES)))


def labels(f: Forest, content: np.ndarray) -> np.ndarray:
    """IN, OUT or MIXED for every node; ``content`` says it of each run, in order."""
    good = np.zeros(len(f.parent), np.int64)
    good[np.flatnonzero(f.run)] = content
    inside, all_ = f.below(good), f.below(f.run)
    return np.where(inside == 0, OUT, np.where(inside == all_, IN, MIXED))


class Model:
    def __init__(self, leaning: dict[str, float], trees: boosting.Trees):
        self.leaning, self.trees = leaning, trees

    def kept(self, f: Forest) -> np.ndarray:
        """Which nodes are runs of the article, by the best consistent labelling."""
        n = len(f.parent)
        if not n:
            return np.zeros(0, bool)
        score = np.zeros((n, 3))
        rows = np.flatnonzero(f.holds)
        score[rows] = self.trees.scores(features(f, self.leaning)[rows])
        score[f.run, MIXED] = -np.inf
        inside, outside = f.below(score[:, IN]), f.below(score[:, OUT])
        best, mixed = np.maximum(inside, outside), score[:, MIXED].copy()
        for level in reversed(f.levels):
            best[level] = np.maximum(best[level], mixed[level])
            p = f.parent[level]
            np.add.at(mixed, p[p >= 0], best[level[p >= 0]])
        own = np.where(mixed >= np.maximum(inside, outside), MIXED, np.where(inside > outside, IN, OUT))
        for level in f.levels[1:]:
            above = own[f.parent[level]]
            own[level] = np.where(above == MIXED, own[level], above)
        return f.run & (own == IN)


def learn(pages: list[tuple[str, list[bool]]]) -> Model:
    """A model from pages whose runs of text are known to belong to the article or not."""
    f = Forest([dom.parse(page) for page, _ in pages])
    content = np.array([c for _, cs in pages for c in cs], np.int64)
    y = labels(f, content)
    rows = np.flatnonzero(f.holds)
    counts: dict[str, np.ndarray] = {}
    for i in rows.tolist():
        if y[i] == MIXED:
            continue
        for word in {"<" + f.tag[i], *f.names[i]}:
            counts.setdefault(word, np.zeros(2))[y[i]] += 1
    leaning = {w: float(np.log((c[IN] + SMOOTH / 2) / (c[OUT] + SMOOTH / 2))) for w, c in counts.items() if c.sum() >= 5}
    return Model(leaning, boosting.fit(features(f, leaning)[rows], y[rows], 3, depth=5, rate=0.3, sample=0.35))


@lru_cache(maxsize=2)
def trained(n: int = TRAIN_PAGES, seed: int = SEED) -> Model:
    return learn(layouts.pages(n, seed))


def main_texts(pages: list[str], model: Model) -> list[str]:
    f = Forest([dom.parse(p) for p in pages])
    kept = np.flatnonzero(model.kept(f))
    out: list[list[str]] = [[] for _ in pages]
    for i in kept.tolist():
        out[f.page[i]].append(f.text[i])
    return ["\n\n".join(x) for x in out]


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    model = model or trained()
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def rows(batches):
        for b in A.pieces(batches, "html"):
            texts = main_texts(b["html"].fill_null("").to_pylist(), model)
            yield A.batch(schema, b["page_id"], b["url"], texts, [len(t) for t in texts])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(rows, "page_id long, url string, text string, n_chars long")
