"""Content-chosen anchors: where repeated windows must meet.

Every window of ``window`` consecutive tokens has one anchor: the place of the
smallest hash among its ``gram``-token grams, the leftmost of equal ones.  Equal
windows have their anchors at equal offsets, so they meet under the anchor's
hash; only about ``2 / (window - gram + 2)`` of all places are anchors.  The
windows of one anchor start at consecutive places ``lo`` to ``hi``; they read the
tokens from ``lo`` to ``hi + window``, the anchor's *context*.
"""

from __future__ import annotations

import numpy as np

from . import arrays as A


def _sliding_least(h: np.ndarray, size: int) -> np.ndarray:
    """Smallest of each run of ``size`` values, by doubling."""
    out, have = h, 1
    while have < size:
        step = min(have, size - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(hashes: np.ndarray, off: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, lo, hi) of all anchors; ``hashes`` has a gram hash for each token place (a gram may cross rows).

    A gram's hash is reduced to its upper bits and its place put below, so ties go left.
    """
    n, w = len(hashes), window - gram + 1
    starts = np.maximum(np.diff(off) - window + 1, 0)  # windows of each row
    total = int(starts.sum())
    if not total or n < w:
        e = np.empty(0, np.int64)
        return e, e, e, e
    bits = max(1, int(n).bit_length())
    ranked = (hashes >> np.uint64(bits) << np.uint64(bits)) | np.arange(n, dtype=np.uint64)
    best = _sliding_least(ranked, w) & np.uint64((1 << bits) - 1)
    row = np.repeat(np.arange(len(starts)), starts)
    at = np.arange(total) - np.repeat(np.cumsum(starts) - starts, starts) + off[row]
    anchor = best[at].astype(np.int64)
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], total) - 1
    return row[first], anchor[first], at[first], at[last]


def context_hash(keys: np.ndarray, anchor: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Of a context's tokens (``keys``: their hash), the anchor's offset and the number of windows."""
    return A.mix(keys ^ A.mix((anchor - lo).astype(np.uint64) << np.uint64(32) | (hi - lo).astype(np.uint64)))
