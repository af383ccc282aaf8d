"""Variable-capacity best-fit packing of documents into training sequences.

A document's length is its number of words plus one for the separator, so empty
texts are kept (length 1); another length column can be given.  A document
longer than the largest capacity gives full pieces of that capacity and one
remainder.

Pieces are dealt by hash of their row and place into shards of about
``shard_rows`` pieces, so long documents and rows with equal ids spread; only ids
and lengths move.  Within a shard, pieces are taken by decreasing length.  A
piece goes to the open bin with the least room that still takes it (best fit).
If none does, a bin is opened, and all permitted capacities that take the piece
are compared: each is filled, in thought, with the longest pieces still
unplaced, and the one with the least cost per token placed is opened
(``cost(c) = overhead + c``; ties go to the smaller).  At the end each bin is
downsized to the smallest capacity that takes its contents.

Defined cases: a null text counts as empty; rows with a null doc_id and
repeated rows are packed like any other; an empty table gives no bins; other
columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import stored

CAPACITIES, OVERHEAD, SHARD_ROWS = (512, 1024, 2048, 4096), 32, 20_000


def words(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+`` without building them: places where one begins."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))


class _Lengths:
    """Unplaced pieces by length, for filling bins in thought."""

    def __init__(self, lengths: list[int]):
        self.count: dict[int, int] = {}
        for n in lengths:
            self.count[n] = self.count.get(n, 0) + 1
        self.sizes = sorted(self.count)

    def take(self, n: int) -> None:
        self.count[n] -= 1
        if not self.count[n]:
            del self.count[n]
            self.sizes.pop(bisect_left(self.sizes, n))

    def fill(self, room: int) -> int:
        """Tokens that the longest unplaced pieces fill of ``room``."""
        placed, at = 0, len(self.sizes)
        while placed < room:
            at = bisect_left(self.sizes, room - placed + 1, 0, at) - 1
            if at < 0:
                break
            n = self.sizes[at]
            placed += n * min(self.count[n], (room - placed) // n)
        return placed


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece (none longer than the largest capacity), and the final capacity of each bin."""
    capacities = tuple(sorted(capacities))
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    left = _Lengths(lengths)
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    used: list[int] = []
    opened: list[int] = []
    rooms: list[tuple[int, int]] = []  # (room, bin), sorted
    for i in order:
        n = lengths[i]
        left.take(n)
        at = bisect_left(rooms, (n, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            fit = [c for c in capacities if c >= n]
            costs = [((overhead + c) / (n + left.fill(c - n)), c) for c in fit]
            room = min(costs)[1]
            b = len(opened)
            opened.append(room)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += n
        if room > n:
            insort(rooms, (room - n, b))
    return bins, offsets, [next(c for c in capacities if c >= u) for u in used]


def plan(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, length: Column | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, bin_id, capacity, bin_used, bin_offset.

    ``start`` counts from the document's first token; the separator is its last.
    """
    capacities = tuple(sorted(capacities))
    top = capacities[-1]
    length = words(F.col("text")) + 1 if length is None else length
    # Row numbers are written down, so that a task run again deals its rows alike.
    sized = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), length.cast("long").alias("n"), F.monotonically_increasing_id().alias("row")))
    last = F.floor((F.greatest("n", F.lit(1)) - 1) / top)
    shards = max(1, -(-(sized.agg(F.sum(last + 1)).first()[0] or 0) // shard_rows)) if shard_rows else 1
    pieces = sized.select("doc_id", "row", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), last), lambda i: F.struct(i.alias("piece"), (i * top).alias("start"), F.least(F.lit(top).cast("long"), F.col("n") - i * top).alias("length")))).alias("p")).select("doc_id", "row", "p.*")
    dealt = pieces.select("doc_id", "piece", "start", "length", F.pmod(F.xxhash64("row", "piece"), F.lit(shards)).alias("shard"))

    def shard(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        bins, offsets, sizes = pack(rows.length.tolist(), capacities, overhead)
        out = rows[["doc_id", "piece", "start", "length"]].copy()
        out["bin_id"] = [f"{rows.shard.iloc[0]}-{b}" for b in bins]
        out["capacity"] = [sizes[b] for b in bins]
        out["bin_used"] = rows.groupby(pd.Series(bins, index=rows.index)).length.transform("sum")
        out["bin_offset"] = offsets
        return out

    return dealt.groupBy("shard").applyInPandas(shard, "doc_id long, piece long, start long, length long, bin_id string, capacity long, bin_used long, bin_offset long")
