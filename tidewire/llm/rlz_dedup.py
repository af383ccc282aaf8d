"""Substring dedup by relative Lempel-Ziv parsing.

Tokens are words.  A word is removed if it lies in a window of ``LENGTH``
consecutive words whose sequence also starts in a document with a smaller id.

Reference blocks hold the stretches around shared anchors (see
:mod:`repeats`), so every block in which a stretch can have a match is the one it
meets.  A block is indexed by a suffix array over its words.  Each stretch is
parsed greedily against the parts of the block that come from smaller
documents: from a factor's start an interval of the array is narrowed word by
word for as long as it holds a smaller document; that is the next factor, a word
without match is a literal.  Factors of ``LENGTH`` words or more are duplicate
spans.  A window over a factor boundary lies in no factor; those are looked up
in the same index.  An anchor dealt over several blocks has its open windows
merged across them.

Defined cases: a null text has no words, a text with fewer than ``LENGTH`` words
loses none; rows with a null doc_id lose nothing; whole repeats of a row get the
same result each; rows that share a doc_id and differ in text are documents of
equal id, so none is before the other; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from . import repeats as R
from .suffixes import sequence_sums, suffix_array

LENGTH, GRAM = 13, 5


class Block:
    """A suffix array over a block's words, searched by interval refinement; ``lookups`` counts the places that a search began at."""

    def __init__(self, tokens: np.ndarray, off: np.ndarray, doc: np.ndarray):
        n = len(tokens)
        self.tokens, self.end, self.doc = tokens, np.repeat(off[1:], np.diff(off)), doc
        self.sa = suffix_array(tokens, 1, self.end - np.arange(n))
        # Smallest document of 2^k entries from each place of the array.
        self.least = [doc[self.sa]]
        while 2 << len(self.least) - 1 <= n:
            half = 1 << len(self.least) - 1
            self.least.append(np.minimum(self.least[-1][:-half], self.least[-1][half:]))
        self.lookups = 0

    def smallest(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Smallest document among the entries lo to hi - 1 of the suffix array (lo < hi)."""
        level = np.frexp((hi - lo).astype(float))[1] - 1
        out = np.empty(len(lo), np.int64)
        for k in np.unique(level).tolist():
            m = level == k
            out[m] = np.minimum(self.least[k][lo[m]], self.least[k][hi[m] - (1 << k)])
        return out

    def _bound(self, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray, token: np.ndarray, right: bool) -> np.ndarray:
        """Binary search among entries lo to hi for ``token`` at ``depth``; an ended text stands before all tokens."""
        lo, hi = lo.copy(), hi.copy()
        while True:
            live = np.flatnonzero(lo < hi)
            if not len(live):
                return lo
            mid = (lo[live] + hi[live]) >> 1
            at = self.sa[mid] + depth[live]
            inside = at < self.end[self.sa[mid]]
            value = np.where(inside, self.tokens[np.minimum(at, len(self.tokens) - 1)], -1)
            below = (value <= token[live]) if right else (value < token[live])
            lo[live[below]] = mid[below] + 1
            hi[live[~below]] = mid[~below]

    def extend(self, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The intervals narrowed by the word at ``at + depth``, and whether a smaller document than that of ``at`` is left in them."""
        token = self.tokens[at + depth]
        lo = self._bound(lo, hi, depth, token, False)
        hi = self._bound(lo, hi, depth, token, True)
        ok = lo < hi
        ok[ok] = self.smallest(lo[ok], hi[ok]) < self.doc[at[ok]]
        return lo, hi, ok


def factors(block: Block, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the greedy factors of all texts; a word without a match is a literal of length 1.

    All texts are parsed in step, a word of each at a time; a search begins at factor starts only.
    """
    starts, sizes = [], []
    n = len(block.tokens)
    at, end = off[:-1][np.diff(off) > 0], off[1:][np.diff(off) > 0]
    lo, hi, depth = np.zeros(len(at), np.int64), np.full(len(at), n), np.zeros(len(at), np.int64)
    block.lookups += len(at)
    while len(at):
        more = at + depth < end
        ok = np.zeros(len(at), bool)
        x, y, ok[more] = block.extend(lo[more], hi[more], depth[more], at[more])
        lo[more], hi[more] = x, y
        depth[ok] += 1
        done = ~ok
        if done.any():
            starts.append(at[done])
            sizes.append(np.maximum(depth[done], 1))
            at[done] += np.maximum(depth[done], 1)
            lo[done], hi[done], depth[done] = 0, n, 0
            stay = at < end
            block.lookups += int((done & stay).sum())
            at, end, lo, hi, depth = at[stay], end[stay], lo[stay], hi[stay], depth[stay]
    s, k = np.concatenate(starts) if starts else np.empty(0, np.int64), np.concatenate(sizes) if sizes else np.empty(0, np.int64)
    order = np.argsort(s)
    return s[order], k[order]


def holds(block: Block, at: np.ndarray, window: int) -> np.ndarray:
    """Whether the window at each place also starts in a smaller document."""
    found = np.zeros(len(at), bool)
    block.lookups += len(at)
    live, lo, hi = np.arange(len(at)), np.zeros(len(at), np.int64), np.full(len(at), len(block.tokens))
    for depth in range(window):
        lo, hi, ok = block.extend(lo, hi, np.full(len(live), depth), at[live])
        live, lo, hi = live[ok], lo[ok], hi[ok]
    found[live] = True
    return found


def parse(block: Block, off: np.ndarray, window: int) -> np.ndarray:
    """Places at which a duplicate window starts.

    Windows inside a factor need no look.  Those over a boundary are looked up,
    but for windows that begin where a factor does: that factor is the longest
    match there, so a shorter one than the window rules it out.
    """
    start, size = factors(block, off)
    n = len(block.tokens)
    inside = np.zeros(n + 1, np.int64)
    long = size >= window
    np.add.at(inside, start[long], 1)
    np.add.at(inside, (start + size - window + 1)[long], -1)
    found = np.cumsum(inside[:-1]) > 0
    open_ = np.arange(n) + window <= block.end
    open_ &= ~found
    open_[start] = False
    at = np.flatnonzero(open_)
    found[at[holds(block, at, window)]] = True
    return found


def decide(window: int):
    def by_factors(data, off, doc, lo, size):
        starts, ends, tok = A.word_bounds(data, off)
        h = A.Hasher(data).ranges(starts, ends)
        block = Block(A.word_codes(data, starts, ends), tok, np.repeat(doc, np.diff(tok)))
        dup = parse(block, tok, window)
        context = np.repeat(np.arange(len(size)), size)
        at = tok[context] + np.arange(int(size.sum())) - np.repeat(np.cumsum(size, dtype=np.int64) - size, size)
        return dup[at], *(A.span_hash(*sequence_sums(h, which), at, at + window) for which in (0, 1))

    return by_factors


def remove(docs: DataFrame, length: int = LENGTH, shard: int = R.SHARD) -> DataFrame:
    """One row per document: n_words, n_removed, kept_sha256 of the kept words, and removed runs of words ``start:end``."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    kind = R.Kind(words=True, window=length, gram=min(GRAM, length), other_document=True)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("removed_words", pa.string())])

    def rows(batches):
        for b in A.pieces(batches):
            data, off = A.utf8(b["text"])
            _, _, tok = A.word_bounds(data, off)
            gone = R.mask(b["gone"], tok, length)
            n_removed = A.sums(gone, tok)
            digests, spans = [], []
            for text, i, j, n in zip(A.texts(b["text"]), tok[:-1].tolist(), tok[1:].tolist(), n_removed.tolist(), strict=True):
                words = text.split()
                runs = ""
                if n:
                    flags = gone[i:j]
                    step = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
                    runs = ",".join(f"{x}:{y}" for x, y in step.reshape(-1, 2).tolist())
                    words = [w for w, g in zip(words, flags.tolist(), strict=True) if not g]
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
                spans.append(runs)
            yield A.batch(schema, b["doc_id"], np.diff(tok), n_removed, digests, spans)

    return R.removed(docs, kind, decide(length), shard).mapInArrow(rows, "doc_id long, n_words long, n_removed long, kept_sha256 string, removed_words string")
