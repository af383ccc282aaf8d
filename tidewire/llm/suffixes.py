"""Suffix arrays of many short texts, in numpy.

``tokens`` holds all texts one after the other; ``rem`` says how many tokens are
left in a place's own text, so no suffix reads past its text's end.
"""

from __future__ import annotations

import numpy as np

from . import arrays as A

PACK = 7  # bytes in a first key: nine bits each, zero past the end


def remaining(off: np.ndarray) -> np.ndarray:
    return np.repeat(off[1:], np.diff(off)) - np.arange(off[-1])


def byte_keys(data: np.ndarray, rem: np.ndarray) -> np.ndarray:
    """The next PACK bytes of each place as one ordered number."""
    full = np.append(data.astype(np.uint64) + np.uint64(1), np.zeros(PACK, np.uint64))
    key = np.zeros(len(data), np.uint64)
    for i in range(PACK):
        key = key << np.uint64(9) | np.where(rem > i, full[i : i + len(data)], np.uint64(0))
    return key


def suffix_array(keys: np.ndarray, known: int, rem: np.ndarray) -> np.ndarray:
    """Larsson-Sadakane refinement: ``keys`` order the first ``known`` tokens; only groups that are still tied are sorted again, by the rank of the place that many tokens on.

    Equal suffixes (of different texts) keep the order of their places.
    """
    n = len(keys)
    sa = np.argsort(keys, kind="stable")
    new = np.append(True, keys[sa][1:] != keys[sa][:-1]) if n else np.empty(0, bool)
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    slots = np.arange(n)
    while len(slots):
        single = new & np.append(new[1:], True)
        # All members of a tied group end within their first ``known`` tokens, or none does.
        slots = slots[~single & (rem[sa[slots]] >= known)]
        at = sa[slots]
        key = rank[at] * (n + 2) + np.where(rem[at] > known, rank[np.minimum(at + known, n - 1)] + 1, 0)
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        sa[slots] = at
        new = np.append(True, key[1:] != key[:-1]) if len(at) else np.empty(0, bool)
        rank[at] = np.maximum.accumulate(np.where(new, slots, 0)) if len(at) else at
        known *= 2
    return sa


def kasai(tokens: np.ndarray, off: np.ndarray, rem: np.ndarray, sa: np.ndarray, jump: np.ndarray | None = None) -> np.ndarray:
    """Common prefix of each entry of ``sa`` with the one before it, by Kasai's rule, all texts in step.

    ``jump`` may hold keys of PACK tokens, to compare that many at once.
    """
    n = len(sa)
    inverse = np.empty(n, np.int64)
    inverse[sa] = np.arange(n)
    before = np.where(inverse > 0, sa[inverse - 1], -1)
    lcp = np.zeros(n, np.int64)
    lengths = np.diff(off)
    order = np.argsort(-lengths, kind="stable")
    size = lengths[order]
    have = np.zeros(len(order), np.int64)
    for t in range(int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(-size, -t, "left"))
        p = off[order[:live]] + t
        j = before[p]
        h = np.maximum(have[:live] - 1, 0)
        h[j < 0] = 0
        limit = np.where(j < 0, 0, np.minimum(rem[p], rem[np.maximum(j, 0)]))
        if jump is not None:
            go = np.flatnonzero(h + PACK <= limit)
            while len(go):
                go = go[jump[p[go] + h[go]] == jump[j[go] + h[go]]]
                h[go] += PACK
                go = go[h[go] + PACK <= limit[go]]
        go = np.flatnonzero(h < limit)
        while len(go):
            go = go[tokens[p[go] + h[go]] == tokens[j[go] + h[go]]]
            h[go] += 1
            go = go[h[go] < limit[go]]
        have[:live] = h
        lcp[inverse[p]] = h
    return lcp


def of_bytes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array, common prefixes and remaining lengths of byte texts."""
    rem = remaining(off)
    keys = byte_keys(data, rem)
    sa = suffix_array(keys, PACK, rem)
    return sa, kasai(data, off, rem, sa, keys), rem


def of_words(hashes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rem = remaining(off)
    keys = np.unique(hashes, return_inverse=True)[1].astype(np.int64)
    sa = suffix_array(keys, 1, rem)
    return sa, kasai(keys, off, rem, sa), rem


def sequence_sums(h: np.ndarray, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums and inverse powers, to hash any run of word hashes at once (see ``arrays.span_hash``)."""
    return A.prefix_sums(h, which), A.powers(len(h), which)[1]
