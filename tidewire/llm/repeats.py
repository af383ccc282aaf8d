"""Windows of tokens that occur earlier, over all documents.

Shared by the suffix-array and the relative Lempel-Ziv operators; they differ in
tokens, in what counts as earlier, and in how they decide what stays open here.

1. Every document gives its anchors (see :mod:`anchors`), each with two hashes of
   its context, by independent bases modulo a prime: together 122 bits decide that
   two contexts are equal.  Within a piece of a task, contexts seen earlier in the piece are
   decided on the spot, so that copies and periodic texts leave the task once.
2. Rows meet by anchor hash.  A context that another document (or place) has
   whole, and earlier, is decided.  A first context whose anchor has no other
   context needs no look: its windows are unique.  The rest is *contested*.
3. Contested contexts are cut from the texts and meet in shards by anchor; a
   shard decides every window among its contexts by an index over them.  An
   anchor with more than ``shard`` contested contexts is dealt over several
   shards.  Each of these keeps its undecided windows as sorted arrays, cut into
   as many ranges of digests as there are shards; the arrays of one range meet,
   and each is searched in those before it by binary search.
4. Decided windows go back to their documents by id.

No step gathers a group: rows of one anchor are sorted and windowed by Spark
with spilling, shards and ranges are streamed in bounded pieces, and what a
document gathers is bounded by its own length.

A document is a row's doc_id with a hash of its text: whole repeats of a row are
one document and get the same result each; rows that share an id and differ in
text are documents of equal id, so neither comes before the other but by place.
Rows with a null doc_id take no part.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import anchors as N
from . import arrays as A
from .session import stored
from .suffixes import sequence_sums

SHARD = 8192  # contested contexts of one anchor in one shard
PIECE = 1_500_000  # bytes of contexts that are indexed together


@dataclass(frozen=True)
class Kind:
    words: bool  # tokens are words, else bytes
    window: int
    gram: int
    #: A window counts as repeated if a smaller document has it; else also within the same document.
    other_document: bool


def _tokens(column: pa.Array, kind: Kind):
    """Token offsets of rows, gram hashes by place, and two independent hashes of any token range."""
    data, off = A.utf8(column)
    hashers = [A.Hasher(data, which) for which in (0, 1)]
    if not kind.words:
        n = max(0, len(data) - kind.gram + 1)
        grams = np.zeros(len(data), np.uint64)
        at = np.arange(n)
        grams[:n] = hashers[0].ranges(at, at + kind.gram)
        return off, grams, lambda a, b: [x.ranges(a, b) for x in hashers]
    starts, ends, word_off = A.word_bounds(data, off)
    h = [x.ranges(starts, ends) for x in hashers]
    grams = np.zeros(len(starts), np.uint64)
    w = A.windows(h[0], kind.gram)
    grams[: len(w)] = w
    sums = [sequence_sums(x, which) for which, x in enumerate(h)]
    return word_off, grams, lambda a, b: [A.span_hash(*x, a, b) for x in sums]


ROW = pa.schema([("doc_id", pa.int64()), ("t", pa.int32()), ("h", pa.int64()), ("ctx", pa.int64()), ("ctx2", pa.int64()), ("lo", pa.int64()), ("size", pa.int32()), ("reps", pa.int32()), ("done", pa.bool_())])


def _joined(doc: np.ndarray, t: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Adjoining or overlapping ranges of windows of one document as one."""
    order = np.lexsort((lo, t, doc))
    doc, t, lo, end = doc[order], t[order], lo[order], (lo + n)[order]
    if not len(doc):
        return doc, t, lo, end
    first_row = np.append(True, (doc[1:] != doc[:-1]) | (t[1:] != t[:-1]))
    # Running maximum of ends within a document: documents are made to lie apart.
    base = np.cumsum(first_row) * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + base)
    new = first_row | np.append(True, (lo + base)[1:] > reach[:-1])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(doc)) - 1
    return doc[at], t[at], lo[at], (reach - base)[last] - lo[at]


def _anchor_rows(b: pa.RecordBatch, kind: Kind) -> pa.RecordBatch | None:
    off, grams, ranges = _tokens(b["text"], kind)
    row, x, lo, hi = N.anchors(grams, off, kind.window, kind.gram)
    ids = b["doc_id"]
    if ids.null_count:
        known = ids.is_valid().to_numpy(zero_copy_only=False)[row]
        row, x, lo, hi = row[known], x[known], lo[known], hi[known]
        ids = ids.fill_null(0)
    if not len(row):
        return None
    h = grams[x].view(np.int64)
    ctx, ctx2 = (N.context_hash(v, x, lo, hi).view(np.int64) for v in ranges(lo, hi + kind.window))
    doc, t, size, at = np.asarray(ids)[row], np.asarray(b["t"])[row], hi - lo + 1, lo - off[row]
    # Runs of equal anchors that follow each other, as in periodic texts, are one row.
    new = np.append(True, (h[1:] != h[:-1]) | (ctx[1:] != ctx[:-1]) | (ctx2[1:] != ctx2[:-1]) | (row[1:] != row[:-1]) | (lo[1:] != hi[:-1] + 1))
    first = np.flatnonzero(new)
    reps = np.diff(np.append(first, len(row)))
    doc, t, h, ctx, ctx2, at, size = (v[first] for v in (doc, t, h, ctx, ctx2, at, size))
    done = []
    if not kind.other_document:
        many = reps > 1
        done.append((doc[many], t[many], (at + size)[many], (size * (reps - 1))[many]))
        reps = np.ones_like(reps)
    order = np.lexsort((at, doc, ctx2, ctx, h))
    doc, t, h, ctx, ctx2, at, size, reps = (v[order] for v in (doc, t, h, ctx, ctx2, at, size, reps))
    head = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (ctx[1:] != ctx[:-1]) | (ctx2[1:] != ctx2[:-1])))
    head = np.repeat(head, np.diff(np.append(head, len(doc))))
    later = doc > doc[head]
    if not kind.other_document:
        later |= (doc == doc[head]) & (at > at[head])
    done.append((doc[later], t[later], at[later], (size * reps)[later]))
    d, dt, l, n = _joined(*(np.concatenate(v) for v in zip(*done, strict=True)))
    open_ = ~later
    k = int(open_.sum())
    key = A.mix(A.mix(d.view(np.uint64)) ^ l.view(np.uint64)).view(np.int64)
    return A.batch(ROW, np.append(doc[open_], d), np.append(t[open_], dt), np.append(h[open_], key), np.append(ctx[open_], np.zeros(len(d), np.int64)), np.append(ctx2[open_], np.zeros(len(d), np.int64)), np.append(at[open_], l), np.append(size[open_], n).astype(np.int32), np.append(reps[open_], np.ones(len(d), np.int64)).astype(np.int32), np.append(np.zeros(k, bool), np.ones(len(d), bool)))


def _meet(docs: DataFrame, kind: Kind) -> DataFrame:
    """Decided (removed) and contested rows of all anchors: doc_id, t, h, lo, size, reps, removed, n."""

    def rows(batches):
        for b in A.pieces(batches):
            if (out := _anchor_rows(b, kind)) is not None:
                yield out

    found = docs.mapInArrow(rows, "doc_id long, t int, h long, ctx long, ctx2 long, lo long, size int, reps int, done boolean").repartition("h")
    same = Window.partitionBy("h", "ctx", "ctx2").orderBy("doc_id", "lo")
    anchor = Window.partitionBy("h")
    later = F.col("doc_id") > F.col("first.doc_id")
    if not kind.other_document:
        later = later | (F.col("lo") > F.col("first.lo")) & (F.col("doc_id") == F.col("first.doc_id"))
    judged = found.withColumn("first", F.first(F.struct("doc_id", "lo")).over(same)).withColumn("removed", F.col("done") | later)
    met = judged.select("doc_id", "t", "h", "ctx", "lo", "size", "reps", "removed", ((F.min("ctx").over(anchor) != F.max("ctx").over(anchor)) | (F.min("ctx2").over(anchor) != F.max("ctx2").over(anchor))).alias("several"), F.count(F.when(~F.col("removed"), 1)).over(anchor).alias("n"))
    return met.where("removed OR several").select("doc_id", "t", "h", "lo", "size", "reps", "removed", F.when(F.col("removed"), 0).otherwise(F.col("n")).alias("n"))


CONTEXT = pa.schema([("h", pa.int64()), ("unit", pa.int32()), ("units", pa.int32()), ("doc_id", pa.int64()), ("t", pa.int32()), ("lo", pa.int64()), ("size", pa.int32()), ("reps", pa.int32()), ("context", pa.binary())])


def _contexts(texts: DataFrame, kind: Kind, shard: int) -> DataFrame:
    """The bytes of each contested context; ``texts`` has doc_id, t, text and the list ``open``."""

    def rows(batches):
        for b in A.pieces(batches):
            data, off = A.utf8(b["text"])
            raw = data.tobytes()
            if kind.words:
                starts, ends, tok = A.word_bounds(data, off)
            lists = b["open"]
            flat, many = lists.flatten(), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            if not len(flat):
                continue
            row = np.repeat(np.arange(b.num_rows), many)
            h, lo, size, reps, n = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("h", "lo", "size", "reps", "n"))
            doc, t = (b[c].take(pa.array(row)).to_numpy(zero_copy_only=False) for c in ("doc_id", "t"))
            if kind.words:
                a, z = starts[tok[row] + lo], ends[tok[row] + lo + size + kind.window - 2]
            else:
                a = off[row] + lo
                z = a + size + kind.window - 1
            units = -(-n // shard)
            unit = np.where(units > 1, (A.mix(doc.view(np.uint64) ^ (lo.view(np.uint64) << np.uint64(40))) % np.maximum(units, 1).astype(np.uint64)).astype(np.int64), 0)
            yield A.batch(CONTEXT, h, unit.astype(np.int32), units.astype(np.int32), doc, t, lo, size, reps, [raw[i:j] for i, j in zip(a.tolist(), z.tolist(), strict=True)])

    return texts.mapInArrow(rows, "h long, unit int, units int, doc_id long, t int, lo long, size int, reps int, context binary")


#: Runs of n removed windows; or, of a dealt anchor h, one shard's sorted undecided windows in one range (``part``) of digests.
RANGE = pa.schema([("doc_id", pa.int64()), ("t", pa.int32()), ("lo", pa.int64()), ("n", pa.int64()), ("h", pa.int64()), ("part", pa.int32()), ("open", pa.binary())])
_FIELDS = "doc_id long, t int, lo long, n long, h long, part int, open binary"
_OPEN = np.dtype([("digest", "<u8"), ("doc", "<i8"), ("lo", "<i8"), ("t", "<i4"), ("more", "<u8")])


def _gone(doc: np.ndarray, t: np.ndarray, lo: np.ndarray) -> pa.RecordBatch:
    """Removed windows as runs."""
    d, t, l, n = _joined(doc, t, lo, np.ones(len(doc), np.int64))
    return A.batch(RANGE, d, t, l, n, *(pa.nulls(len(d), x) for x in (pa.int64(), pa.int32(), pa.binary())))


def _of_rows(wanted: np.ndarray, context: np.ndarray, offset: np.ndarray, size: np.ndarray, reps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, place in the context's run of repeats, window) of the wanted windows, with the repeats of their rows."""
    c, o, w = context[wanted], offset[wanted], np.flatnonzero(wanted)
    times = reps[c]
    at = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    c, o, w = (np.repeat(v, times) for v in (c, o, w))
    return c, at * size[c] + o, w


def _decide(contexts: DataFrame, kind: Kind, decide: Callable) -> DataFrame:
    """What each shard decides, and what the shards of a dealt anchor leave open."""

    def work(t: pa.Table):
        t = t.combine_chunks()
        raw = t["context"].combine_chunks() if isinstance(t["context"], pa.ChunkedArray) else t["context"]
        n = len(raw)
        boff = np.frombuffer(raw.buffers()[1], np.int32, n + 1, raw.offset * 4).astype(np.int64)
        data = np.frombuffer(raw.buffers()[2], np.uint8)[boff[0] : boff[-1]]
        boff = boff - boff[0]
        doc, text, lo, size, reps, units, h, unit = (t[c].to_numpy() for c in ("doc_id", "t", "lo", "size", "reps", "units", "h", "unit"))
        size, reps = size.astype(np.int64), reps.astype(np.int64)
        removed, digest, more = decide(data, boff, doc, lo, size)  # by window, in order of contexts and offsets
        context = np.repeat(np.arange(n), size)
        offset = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        c, place, _ = _of_rows(removed, context, offset, size, reps)
        yield _gone(doc[c], text[c], lo[c] + place)
        for first in np.flatnonzero((units > 1) & np.append(True, (h[1:] != h[:-1]) | (unit[1:] != unit[:-1]))).tolist():
            mine = (h[context] == h[first]) & (unit[context] == unit[first]) & ~removed
            c, place, w = _of_rows(mine, context, offset, size, reps)
            out = np.zeros(len(c), _OPEN)
            out["digest"], out["more"], out["doc"], out["t"], out["lo"] = digest[w], more[w], doc[c], text[c], lo[c] + place
            out.sort(order=["digest", "more", "doc", "lo"])
            cuts = np.append(np.searchsorted(out["digest"], np.arange(units[first], dtype=np.uint64) * np.uint64((1 << 64) // int(units[first]))), len(out))
            for part, (a, z) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                if z > a:
                    yield A.batch(RANGE, *(pa.nulls(1, x) for x in (pa.int64(), pa.int32(), pa.int64(), pa.int64())), [h[first]], [part], [out[a:z].tobytes()])

    def rows(batches):
        held: list[pa.RecordBatch] = []
        have = 0
        for b in batches:
            for p in A.pieces([b], "context", PIECE // 4) if b.num_rows else []:
                held.append(p)
                have += p["context"].nbytes
                if have < PIECE:
                    continue
                t = pa.Table.from_batches(held)
                h, u = t["h"].to_numpy(), t["unit"].to_numpy()
                same = (h == h[-1]) & (u == u[-1])
                cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
                if cut:
                    yield from work(t.slice(0, cut))
                    held = t.slice(cut).combine_chunks().to_batches()
                    have = sum(x["context"].nbytes for x in held)
        if held:
            yield from work(pa.Table.from_batches(held))

    key = ["h", "unit"]
    return contexts.repartition(*key).sortWithinPartitions(*key).mapInArrow(rows, _FIELDS)


def merged(arrays: list[np.ndarray], kind: Kind) -> np.ndarray:
    """The windows of sorted arrays that occur earlier in another; arrays are searched in each other by binary search."""

    def later(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a["doc"] > b["doc"]) if kind.other_document else (a["doc"] > b["doc"]) | (a["doc"] == b["doc"]) & (a["lo"] > b["lo"])

    def key(a: np.ndarray) -> np.ndarray:
        """Both digests as 16 bytes that order as the numbers do."""
        both = np.stack([a["digest"], a["more"]], axis=1).astype(">u8")
        return both.view("S16").ravel()

    heads, names = np.zeros(0, _OPEN), np.zeros(0, "S16")  # the earliest window of each pair of digests in the arrays so far
    for a in arrays:
        k = key(a)
        new = np.append(True, k[1:] != k[:-1])
        own, k = a[new], k[new]
        at = np.searchsorted(names, k)
        known = np.zeros(len(own), bool)
        known[at < len(names)] = names[at[at < len(names)]] == k[at < len(names)]
        spot = at[known]
        heads[spot] = np.where(later(heads[spot], own[known]), own[known], heads[spot])
        heads, names = np.insert(heads, at[~known], own[~known]), np.insert(names, at[~known], k[~known])
    return np.concatenate([a[later(a, heads[np.searchsorted(names, key(a))])] for a in arrays])


def _merge(open_: DataFrame, kind: Kind) -> DataFrame:
    """Cross-shard merge of the sorted arrays of each range of digests."""

    def rows(batches):
        held, name = [], None
        for b in batches:
            for h, part, raw in zip(b["h"].to_pylist(), b["part"].to_pylist(), b["open"], strict=True):
                if (h, part) != name and held:
                    gone = merged(held, kind)
                    held = []
                    yield _gone(gone["doc"], gone["t"], gone["lo"])
                name = (h, part)
                held.append(np.frombuffer(raw.as_buffer(), _OPEN))
        if held:
            gone = merged(held, kind)
            yield _gone(gone["doc"], gone["t"], gone["lo"])

    return open_.repartition("h", "part").sortWithinPartitions("h", "part").mapInArrow(rows, _FIELDS)


def removed(docs: DataFrame, kind: Kind, decide: Callable, shard: int = SHARD) -> DataFrame:
    """``docs`` (doc_id, text) with the list ``gone`` of (lo, n): runs of n windows from lo that occur earlier."""
    docs = docs.select("doc_id", F.hash("text").alias("t"), "text")
    met = stored(_meet(docs, kind))
    waiting = met.where("NOT removed").groupBy("doc_id", "t").agg(F.collect_set(F.struct("h", "lo", "size", "reps", "n")).alias("open"))
    decided = _decide(_contexts(docs.join(waiting, ["doc_id", "t"]), kind, shard), kind, decide)
    if (met.agg(F.max("n")).first()[0] or 0) > shard:
        decided = stored(decided)
        decided = decided.where("open IS NULL").unionByName(_merge(decided.where("open IS NOT NULL"), kind))
    gone = met.where("removed").select("doc_id", "t", "lo", (F.col("size").cast("long") * F.col("reps")).alias("n")).unionByName(decided.select("doc_id", "t", "lo", "n"))
    lists = gone.groupBy("doc_id", "t").agg(F.collect_set(F.struct("lo", "n")).alias("gone"))
    return docs.join(lists, ["doc_id", "t"], "left").select("doc_id", "text", "gone")


def mask(lists: pa.Array, off: np.ndarray, window: int) -> np.ndarray:
    """Which tokens of a piece lie in a removed window."""
    flat, many = lists.flatten(), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    base = off[:-1].repeat(many)
    lo, n = flat.field("lo").to_numpy(zero_copy_only=False), flat.field("n").to_numpy(zero_copy_only=False)
    return A.cover(int(off[-1]), base + lo, base + lo + n - 1 + window)
