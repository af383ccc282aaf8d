"""Benchmark decontamination by q-gram lemma filtering.

Texts are normalised: capitals become small letters where both have as many
bytes, every run of ASCII characters that are neither letters nor digits is one
space.  A benchmark item of m bytes occurs in
a text with at most e edits only if they share ``m - q + 1 - q * e`` q-grams
whose diagonals (text place minus item place) span no more than e.  So

1. places of the text whose q-gram occurs in any item are marked (exact 8-byte
   keys behind a bitmap), and only places in stretches dense enough for some
   item stay,
2. their (item, diagonal) hits are counted in diagonal bands of width
   ``2 * (e + 1)`` that overlap by half, so one band holds every alignment,
3. bands that meet their item's bound are verified by banded alignment with
   free ends in the text.

Items longer than ``SEGMENT`` bytes are used in overlapping segments.  Items with
fewer than ``least`` bytes after normalising are too short for edits: those of
``Q`` bytes or more count where they stand exactly, as whole words; shorter ones
where they are the whole text.  Items without a letter or digit match nothing.
Items are broadcast in blocks of about ``BLOCK`` bytes of text, each block one
pass, so the benchmark may grow without a larger broadcast; what the passes find
is joined by document, and the result is the same for any number of blocks.

Defined cases: null and empty texts and null items match nothing; an empty
benchmark leaves every document clean; items that repeat are found once each; repeated rows are judged alike; columns
other than id and text are not read (``clean`` returns them unchanged).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A

Q, EDIT_RATE, LEAST, SEGMENT = 8, 0.1, 24, 512
BLOCK = 4_000_000
_FOLD = A.LOWER.copy()
_FOLD[[c for c in range(128) if not chr(c).isalnum()]] = 32
_U = np.uint64
#: First bytes of characters of 2, 3 and 4 bytes; the last up to U+1FFFF.
_LEADS = {2: (0xC2, 0xDF), 3: (0xE0, 0xEF), 4: (0xF0, 0xF0)}


@lru_cache(maxsize=3)
def _small(size: int) -> np.ndarray:
    """The small letter of every code point of ``size`` bytes, or the point itself where that has another length."""
    end = {2: 0x800, 3: 0x10000, 4: 0x20000}[size]
    out = np.arange(end)
    for c in range(end // 32 if size > 2 else 0x80, end):
        low = chr(c).lower()
        if len(low) == 1 and low != chr(c) and not 0xD800 <= c < 0xE000 and len(low.encode()) == size:
            out[c] = ord(low)
    return out


def _normal(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised bytes, row offsets, and the place of each byte in ``data``."""
    x = _FOLD[data]
    for size, (first, last) in _LEADS.items():
        lead = np.flatnonzero((data >= first) & (data <= last))
        if len(lead):
            points = np.zeros(len(lead), np.int64)
            for i in range(size):
                points = points << 6 | (data[lead + i] & (0x7F >> size if i == 0 else 0x3F))
            small = _small(size)[points]
            for i in range(size - 1, -1, -1):
                x[lead + i] = (0x80 | (small & 0x3F)) if i else (0xFF00 >> size & 0xFF | small)
                small = small >> 6
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32)
    at = np.flatnonzero(keep)
    return x[at], np.searchsorted(at, off), at


def _grams(x: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as one number."""
    n = len(x) - Q + 1
    if n <= 0:
        return np.empty(0, _U)
    two = x[:-1].astype(np.uint16) | x[1:].astype(np.uint16) << 8
    four = two[:-2].astype(np.uint32) | two[2:].astype(np.uint32) << 16
    return (four[:-4].astype(_U) | four[4:].astype(_U) << _U(32))[:n]


def _slot(keys: np.ndarray) -> np.ndarray:
    return (keys * _U(0x9E3779B97F4A7C15) >> _U(40)).astype(np.int64)


@dataclass
class Index:
    items: list  # item id of each pattern
    patterns: list[np.ndarray]
    edits: np.ndarray
    need: np.ndarray  # q-grams to share
    sizes: np.ndarray
    keys: np.ndarray  # distinct q-grams, sorted
    first: np.ndarray  # of each key in the arrays below; one more than keys
    of: np.ndarray  # pattern
    place: np.ndarray
    bitmap: np.ndarray
    whole: np.ndarray  # patterns that must stand as whole words
    tiny: dict[bytes, list]  # items that must be the whole text


def index(rows: list[tuple[int, str]], rate: float = EDIT_RATE, least: int = LEAST) -> Index:
    items, patterns, tiny = [], [], {}
    for item, text in rows:
        data = np.frombuffer((text or "").encode(), np.uint8)
        x = _normal(data, np.array([0, len(data)]))[0]
        x = x[(x[:1] == 32).sum() : len(x) - int(len(x) > 0 and x[-1] == 32)]
        if len(x) < Q:
            if len(x):
                tiny.setdefault(x.tobytes(), []).append(item)
            continue
        starts = [0] if len(x) <= SEGMENT else [*range(0, len(x) - SEGMENT, SEGMENT // 2), len(x) - SEGMENT]
        for s in starts:
            items.append(item)
            patterns.append(x[s : s + SEGMENT])
    sizes = np.array([len(p) for p in patterns], np.int64)
    whole = sizes < least
    edits = np.where(whole, 0, np.minimum((sizes * rate).astype(np.int64), (sizes - Q) // Q))
    grams = [_grams(p) for p in patterns]
    key = np.concatenate(grams) if grams else np.empty(0, _U)
    of = np.repeat(np.arange(len(patterns)), [len(g) for g in grams])
    place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.empty(0, np.int64)
    order = np.argsort(key, kind="stable")
    keys, first = np.unique(key[order], return_index=True)
    bitmap = np.zeros(1 << 24, bool)
    bitmap[_slot(keys)] = True
    return Index(items, patterns, edits, sizes - Q + 1 - Q * edits, sizes, keys, np.append(first, len(key)), of[order], place[order], np.packbits(bitmap, bitorder="little"), whole, tiny)


def align(text: np.ndarray, lows: np.ndarray, highs: np.ndarray, pattern: list[np.ndarray], diag: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each pattern against the text on diagonals ``diag`` to ``diag + width - 1``, and where that alignment ends.

    ``lows`` and ``highs`` bound the text that each may use; all candidates go row by row together.
    """
    k, longest = len(pattern), max(map(len, pattern))
    padded = np.zeros((k, longest), np.uint8)
    for i, p in enumerate(pattern):
        padded[i, : len(p)] = p
    size = np.array([len(p) for p in pattern])
    d = diag[:, None] + np.arange(width)
    slope = np.arange(width)
    big = 1 << 20
    row = np.where((d >= lows[:, None]) & (d <= highs[:, None]), 0, big)
    best, end = np.full(k, big), np.zeros(k, np.int64)
    for i in range(longest):
        at = d + i
        ok = (at >= lows[:, None]) & (at < highs[:, None])
        differs = text[np.clip(at, 0, len(text) - 1)] != padded[:, i : i + 1]
        new = np.where(ok, row + differs, big)
        # skipping a pattern byte keeps the text place, which is the next diagonal of the row before
        new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)
        new = np.minimum.accumulate(new - slope, axis=1) + slope  # skipping text bytes
        row = new
        last = size == i + 1
        if last.any():
            best[last] = row[last].min(1)
            end[last] = d[last, row[last].argmin(1)] + i + 1
    return best, end


def hits(column: pa.Array, ix: Index) -> list[tuple[int, int, int, int, int]]:
    """(row, item, start, end, edits) of verified regions, in bytes of the rows."""
    data, off = A.utf8(column)
    x, noff, at = _normal(data, off)
    out = []
    if ix.tiny:
        for row in np.flatnonzero(np.diff(noff) < Q + 2).tolist():
            text = x[noff[row] : noff[row + 1]].tobytes()
            for item in ix.tiny.get(text.strip(b" "), ()):
                out.append((row, item, 0, int(off[row + 1] - off[row]), 0))
    if len(ix.keys) and len(data) >= Q:
        out += [(row, ix.items[p], s, e, k) for row, p, s, e, k in _regions(x, noff, at, off, ix)]
    return out


def _regions(x: np.ndarray, noff: np.ndarray, at: np.ndarray, off: np.ndarray, ix: Index) -> list[tuple[int, int, int, int, int]]:
    """The same with patterns, by the q-gram lemma and alignment; x is normalised, ``at`` its places in the data."""
    g = _grams(x)
    if not len(g):
        return []
    slot = _slot(g)
    marked = (ix.bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1
    # A region of an item lies within size + edits places; some item's bound must be met there.
    span, least = int((ix.sizes + ix.edits).max()), int(ix.need.min())
    total = np.append(0, np.cumsum(marked, dtype=np.int64))
    n = len(g)
    dense = total[np.minimum(np.arange(n) + span, n)] - total[:-1] >= least
    near = A.cover(n, np.flatnonzero(dense), np.minimum(np.flatnonzero(dense) + span, n)) if dense.any() else dense
    places = np.flatnonzero(near & (marked == 1))
    if not len(places):
        return []
    found = np.searchsorted(ix.keys, g[places])
    found[found == len(ix.keys)] = 0
    same = ix.keys[found] == g[places]
    places, found = places[same], found[same]
    many = ix.first[found + 1] - ix.first[found]
    where = np.repeat(ix.first[found] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    pattern, diagonal = ix.of[where], np.repeat(places, many) - ix.place[where]
    width = ix.edits[pattern] + 1
    band = (diagonal + SEGMENT) // width
    base = int(band.max()) + 2
    key, shared = np.unique(np.concatenate([pattern * base + band, pattern * base + band - 1]), return_counts=True)
    met = shared >= ix.need[key // base]
    p, b = key[met] // base, key[met] % base
    # The rows that a band's alignments can lie in.
    low = b * (ix.edits[p] + 1) - SEGMENT
    first = np.searchsorted(noff, np.maximum(low, 0), "right") - 1
    last = np.searchsorted(noff, np.clip(low + 2 * (ix.edits[p] + 1) + ix.sizes[p], 0, len(x) - 1), "right") - 1
    many = last - first + 1
    p, b = np.repeat(p, many), np.repeat(b, many)
    r = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
    out, seen = [], set()
    for i in range(0, len(p), 256):
        q = p[i : i + 256]
        step = ix.edits[q] + 1
        best, end = align(x, noff[r[i : i + 256]], noff[r[i : i + 256] + 1], [ix.patterns[j] for j in q], b[i : i + 256] * step - SEGMENT, int(2 * step.max()))
        for row, j, e, z in zip(r[i : i + 256].tolist(), q.tolist(), best.tolist(), end.tolist(), strict=True):
            if ix.whole[j] and e == 0:
                s = z - int(ix.sizes[j])
                if (s > noff[row] and x[s - 1] != 32) or (z < noff[row + 1] and x[z] != 32):
                    continue
            if e <= ix.edits[j] and (row, j, z) not in seen:
                seen.add((row, j, z))
                s = max(int(noff[row]), z - int(ix.sizes[j]))
                out.append((row, j, int(at[s] - off[row]), int(at[z - 1] + 1 - off[row]), e))
    return out


def blocks(benchmark: DataFrame, limit: int = BLOCK) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ``limit`` bytes of text, one at a time on the driver."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // limit)
    for i in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i)
        yield [tuple(x) for x in part.orderBy("item_id").collect()]


def scan(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE, limit: int = BLOCK, least: int = LEAST) -> DataFrame:
    """One row per document: contaminated, item_ids (sorted), n_regions, and regions ``item:start:end:edits`` in bytes."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    region = pa.struct([(c, pa.int64()) for c in ("item", "start", "end", "edits")])
    kind = "array<struct<item:long,start:long,end:long,edits:long>>"

    def found(batches, shared, keyed: bool):
        for b in A.pieces(batches):
            of: list[list] = [[] for _ in range(b.num_rows)]
            for row, *what in hits(b["text"], shared.value):
                of[row].append(dict(zip(("item", "start", "end", "edits"), what, strict=True)))
            if keyed:
                some = [i for i, v in enumerate(of) if v]
                yield pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array(some, pa.int64())), b["t"].take(pa.array(some, pa.int64())), pa.array([of[i] for i in some], pa.list_(region))], ["doc_id", "t", "found"])
            else:
                yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(of, pa.list_(region))], ["doc_id", "found"])

    parts = [docs.sparkSession.sparkContext.broadcast(index(block, rate, least)) for block in blocks(benchmark, limit)]
    if not parts:
        all_ = docs.select("doc_id", F.array().cast(kind).alias("found"))
    elif len(parts) == 1:
        all_ = docs.mapInArrow(lambda batches: found(batches, parts[0], False), f"doc_id long, found {kind}")
    else:
        # Each pass returns documents with a region only, named by id and text, so repeated rows and null ids keep theirs.
        docs = docs.withColumn("t", F.xxhash64("text"))
        each = [docs.mapInArrow(lambda batches, shared=shared: found(batches, shared, True), f"doc_id long, t long, found {kind}") for shared in parts]
        rows = each[0]
        for other in each[1:]:
            rows = rows.unionByName(other)
        per = rows.distinct().groupBy(F.col("doc_id").alias("id_"), F.col("t").alias("t_")).agg(F.flatten(F.collect_list("found")).alias("found"))
        joined = docs.select("doc_id", "t").join(per, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("t") == F.col("t_")), "left")
        all_ = joined.select("doc_id", F.coalesce("found", F.array().cast(kind)).alias("found"))
    sorted_ = F.array_sort("found")
    told = F.transform(sorted_, lambda r: F.concat_ws(":", r["item"], r["start"], r["end"], r["edits"]))
    items = F.array_sort(F.array_distinct(F.transform("found", lambda r: r["item"])))
    return all_.select("doc_id", (F.size("found") > 0).alias("contaminated"), items.alias("item_ids"), F.size("found").cast("long").alias("n_regions"), F.array_join(told, ",").alias("regions"))


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE, limit: int = BLOCK, least: int = LEAST) -> DataFrame:
    """The documents in which no item occurs, with all their columns; one pass per block, no shuffle."""
    for block in blocks(benchmark, limit):
        shared = docs.sparkSession.sparkContext.broadcast(index(block, rate, least))

        def rows(batches, shared=shared):
            for b in A.pieces(batches):
                stay = np.ones(b.num_rows, bool)
                for row, *_ in hits(b["text"], shared.value):
                    stay[row] = False
                yield b.filter(pa.array(stay))

        docs = docs.mapInArrow(rows, docs.schema)
    return docs
