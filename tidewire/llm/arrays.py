"""Vectorised helpers over the UTF-8 bytes of Arrow string columns.

Every operator that works inside Arrow tasks walks its batches through
:func:`pieces`, which cuts them so that one piece holds at most ``PIECE_BYTES``
of text (or a single longer row).  Memory in a Python worker is then bounded by
the longest text, not by the number of rows in an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa

PIECE_BYTES = 2_000_000

#: Separators of words are exactly space and \t \n \v \f \r, all ASCII, so words
#: of the UTF-8 bytes are words of the text.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
WORD = ~SPACE

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64
#: Polynomials over the integers modulo the prime 2^61 - 1.  Unlike modulo a power of two, no two strings collide for every base: a pair of n symbols collides for at most n of the 2^61 bases.
PRIME = (1 << 61) - 1
_P, _LOW31, _LOW30 = _U(PRIME), _U((1 << 31) - 1), _U((1 << 30) - 1)
_BASES = tuple(int(x) for x in np.random.default_rng(20240229).integers(1 << 50, PRIME, 2, dtype=np.int64))
_RUN = 1 << 24  # terms of 39 bits that are summed before they are reduced


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows, and row offsets (one more than rows).  Nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if binary else "")
    column = column.cast(pa.large_binary() if binary else pa.large_string())
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes of ``column`` each (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, off = utf8(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def texts(column: pa.Array) -> list[bytes]:
    """Rows as bytes; nulls are empty."""
    data, off = utf8(column)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]


def word_bounds(data: np.ndarray, off: np.ndarray, of: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every word (a run of bytes in ``of``), and the word offsets of the rows."""
    n = len(data)
    w = np.zeros(n + 1, bool)
    w[:n] = of[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.zeros(n + 1, bool)
    before[1:] = w[:-1]
    starts = np.flatnonzero(w & (edge | ~before))
    ends = np.flatnonzero(before & (edge | ~w))
    return starts, ends, np.searchsorted(starts, off)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _fold(x: np.ndarray) -> np.ndarray:
    """64-bit values modulo PRIME."""
    x = (x & _P) + (x >> _U(61))
    return np.where(x >= _P, x - _P, x)


def _joined(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """``high * 2^31 + low`` modulo PRIME."""
    high = _fold(high)
    return _fold(((high & _LOW30) << _U(31)) + (high >> _U(30)) + _fold(low))


def mulmod(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo PRIME of values below it."""
    a1, a0, b1, b0 = a >> _U(31), a & _LOW31, b >> _U(31), b & _LOW31
    mid = a1 * b0 + a0 * b1
    return _fold((a1 * b1 << _U(1)) + (mid >> _U(30)) + ((mid & _LOW30) << _U(31)) + a0 * b0)


@lru_cache(maxsize=4)
def _powers(size: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASES[which], pow(_BASES[which], -1, PRIME)):
        v = np.ones(1, _U)
        while len(v) < size:
            v = np.concatenate([v, mulmod(v, np.full(len(v), pow(base, len(v), PRIME), _U))])
        out.append(v)
    return out[0], out[1]


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo PRIME, at least n."""
    return _powers(1 << max(16, int(n + 1).bit_length()), which)


def prefix_sums(values: np.ndarray, which: int = 0) -> np.ndarray:
    """Sums of ``values[i] * base^i`` modulo PRIME, one more than values; values are 64-bit."""
    term = mulmod(_fold(values), powers(len(values), which)[0][: len(values)])
    sums = np.zeros(len(values) + 1, _U)
    sums[1:] = _joined(np.cumsum(term >> _U(31)), np.cumsum(term & _LOW31))
    return sums


class Hasher:
    """64-bit hashes of any byte ranges of ``data`` after one pass over it; ``which`` of two independent bases."""

    def __init__(self, data: np.ndarray, which: int = 0):
        up, self.down = powers(len(data), which)
        self.sums = np.zeros(len(data) + 1, _U)
        for i in range(0, len(data), _RUN):
            v, u = data[i : i + _RUN].astype(_U) + _U(1), up[i : i + min(_RUN, len(data) - i)]
            self.sums[i + 1 : i + 1 + len(v)] = _fold(_joined(np.cumsum(v * (u >> _U(31))), np.cumsum(v * (u & _LOW31))) + self.sums[i])

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return span_hash(self.sums, self.down, starts, ends)


def span_hash(sums: np.ndarray, down: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of ranges from their prefix sums, independent of where they stand."""
    h = mulmod(_fold(sums[ends] + (_P - sums[starts])), down[starts])
    return mix(h + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, equal exactly for equal words: a hash proposes, bytes decide."""
    codes = pd.factorize(Hasher(data).ranges(starts, ends).view(np.int64))[0].astype(np.int64)
    if not len(codes):
        return codes
    first = np.full(int(codes.max()) + 1, -1)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    model, size = first[codes], ends - starts
    wrong = size != size[model]
    check = np.flatnonzero(~wrong & (model != np.arange(len(codes))))
    n = size[check]
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    same = data[np.repeat(starts[check], n) + step] == data[np.repeat(starts[model[check]], n) + step]
    wrong[check[np.repeat(np.arange(len(check)), n)[~same]]] = True
    if wrong.any():
        seen: dict[bytes, int] = {}
        raw, words = data.tobytes(), np.flatnonzero(np.isin(codes, codes[wrong]))
        for i in words.tolist():
            codes[i] = len(first) + seen.setdefault(raw[starts[i] : ends[i]], len(seen))
    return codes


def run_codes(codes: np.ndarray, size: int) -> np.ndarray:
    """A number for each run of ``size`` consecutive codes, equal exactly for equal runs: runs of twice the size are pairs."""

    def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return pd.factorize(a * (int(b.max()) + 1) + b)[0].astype(np.int64) if len(a) else a

    if len(codes) < size:
        return np.empty(0, np.int64)
    out, have = pd.factorize(codes)[0].astype(np.int64), 1
    while have < size:
        step = min(have, size - have)
        out = paired(out[: len(out) - step], out[step:])
        have += step
    return out


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` consecutive values of ``h``."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, _U)
    out = np.zeros(n, _U)
    k = 1
    for i in range(size):
        k = k * 0x2545F4914F6CDD1D % (1 << 64) | 1
        out += h[i : i + n] * _U(k)
    return mix(out)


def sums(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` over each row's range, as int64."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:], dtype=np.int64)
    return total[off[1:]] - total[off[:-1]]


def cover(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in any of the ranges."""
    step = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(step[:-1]) > 0


def code_points(data: bytes, at: int) -> int:
    return len(data[:at].decode("utf-8", "replace"))


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
