"""Personal data: fixed kinds by expression, others by bootstrapped contexts.

The base kinds (``email``, ``ip``, ``card``, ``phone``) are found by expressions
whose candidates are located by their rarest byte first.  They are also the
seeds of a bootstrap:

* an *instance* is a base span (with all its words), or another run of words
  with at least ``LEAST_DIGITS`` digits or an ``@``; words of digits and
  ``().-+`` that follow each other by one space are one instance, unless they
  have over ``MOST_DIGITS`` digits, as rows of a table;
* a *pattern* is the word before or the word after an instance, of at least one
  letter, lower-cased, at most ``GAP`` other characters away.  It says nothing
  of the instance's shape, so it carries over to identifiers of unseen shapes.

Spark aggregates the pattern-instance graph over all documents, with the number
of times that each pattern's word occurs at all.  In each round

* a pattern's confidence is ``F / (F + N + 1)``: F is the trust of its distinct
  instances, N how often its word stands beside no instance.  Instances that
  are not trusted yet count for neither.  A pattern with fewer than ``support``
  trusted instances has none;
* an instance's trust is one minus the product of ``1 - confidence`` over its
  patterns; seeds have trust 1.

Instances whose trust reaches ``confidence`` at the end are spans of kind
``other`` wherever they occur.  Patterns and instances travel as hashes,
pre-aggregated in each task; a frequent word is a count and never a group.

Defined cases: a null or empty text has no spans; repeated rows count as
occurrences each and are reported alike; other columns are not read; there is
one result row per input row, of null ids too.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .session import checkpoint

KINDS = ("email", "ip", "card", "phone", "other")
LEAST_DIGITS, MOST_DIGITS = 5, 24
_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(rb"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(rb"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9]){12,}")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_NUMBER = _DIGIT.copy()
_NUMBER[list(b"().-+")] = True
_LETTER = np.zeros(256, bool)
_LETTER[list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = True
_EDGE = np.zeros(256, bool)
_EDGE[list(b".,;:!?\"'()[]{}<>#*$%&|=")] = True
GAP = 4
#: Up to so many words are told to the tasks that count them; beyond it they are joined.
TOLD = 1_000_000


def luhn(digits: bytes) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = (c - 48) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base kinds in byte offsets, by kind and then start."""
    found, free, at = [], 0, text.find(b"@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            free = m.end()
            found.append((0, start, free))
        at = text.find(b"@", max(at + 1, free))
    found += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(int(x.lstrip(b"0")[:4] or b"0") <= 255 for x in m[0].split(b"."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(b" ", b"").replace(b"-", b"")
        if len(digits) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    if b"+" in text:
        found += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(48 <= c < 58 for c in m[0]) <= 15]
    return found


@dataclass
class Found:
    """Spans of a piece in bytes of its data: base spans and candidates, by row and place."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    kind: np.ndarray  # of KINDS; 4 for candidates
    name: np.ndarray  # hash of the instance
    #: Hashes of the word before and the word after, 0 where there is none.
    before: np.ndarray
    after: np.ndarray


def search(data: np.ndarray, off: np.ndarray) -> Found:
    raw = data.tobytes()
    digits, ats = A.sums(_DIGIT[data], off), A.sums(data == 64, off)
    base = [(r, k, int(off[r]) + a, int(off[r]) + z) for r in np.flatnonzero((digits >= 4) | (ats > 0)).tolist() for k, a, z in base_spans(raw[off[r] : off[r + 1]])]
    base = np.array(base, np.int64).reshape(-1, 4)
    starts, ends, _ = A.word_bounds(data, off)
    of = np.append(0, np.cumsum(_DIGIT[data]))
    numbers, signs = np.append(0, np.cumsum(_NUMBER[data])), np.append(0, np.cumsum(data == 64))
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    numeric = (numbers[ends] - numbers[starts] == ends - starts) & (of[ends] > of[starts])
    joins = np.zeros(len(starts), bool)
    if len(starts):
        joins[1:] = numeric[1:] & numeric[:-1] & (starts[1:] == ends[:-1] + 1) & (data[np.minimum(ends[:-1], len(data) - 1)] == 32) & ~edge[starts[1:]]
    lead = np.flatnonzero(~joins)
    group = np.cumsum(~joins) - 1
    many = np.bincount(group, of[ends] - of[starts], len(lead)) > MOST_DIGITS if len(lead) else np.zeros(0, bool)
    joins &= ~many[group] if len(lead) else joins
    first = np.flatnonzero(~joins)
    s, e = starts[first], ends[np.append(first[1:], len(starts)) - 1] if len(first) else starts
    rich = (of[e] - of[s] >= LEAST_DIGITS) | (signs[e] > signs[s])
    s, e = s[rich], e[rich]
    while (trim := (s < e) & _EDGE[data[np.minimum(s, len(data) - 1)]]).any():
        s = s + trim
    while (trim := (s < e) & _EDGE[data[np.maximum(e - 1, 0)]]).any():
        e = e - trim
    taken = np.append(0, np.cumsum(A.cover(len(data), base[:, 2], base[:, 3]))) if len(data) else np.zeros(1, np.int64)
    free = (taken[e] == taken[s]) & (e > s)
    s, e = s[free], e[free]
    row = np.append(base[:, 0], np.searchsorted(off, s, "right") - 1)
    kind = np.append(base[:, 1], np.full(len(s), 4))
    s, e = np.append(base[:, 2], s), np.append(base[:, 3], e)
    hasher = A.Hasher(A.LOWER[data])
    ls, le, _ = A.word_bounds(data, off, _LETTER)
    words = hasher.ranges(ls, le)

    def beside(at: np.ndarray, ok: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        out = np.zeros(len(s), np.uint64)
        ok = np.flatnonzero(ok)
        ok = ok[(high[ok] - low[ok] <= GAP) & (of[high[ok]] == of[low[ok]]) & (low[ok] >= off[row[ok]]) & (high[ok] <= off[row[ok] + 1])]
        out[ok] = words[at[ok]]
        return out

    left, right = np.searchsorted(le, s, "right") - 1, np.searchsorted(ls, e, "left")
    none = np.zeros(1, np.int64)
    before = beside(left, left >= 0, np.append(le, none)[left], s)
    after = beside(right, right < len(ls), e, np.append(ls, none)[np.minimum(right, len(ls))])
    # The word before must lie in the same row as the span.
    before[(left >= 0) & (np.append(ls, none)[left] < off[row])] = 0
    return Found(row, s, e, kind, hasher.ranges(s, e), before, after)


def graph(docs: DataFrame) -> DataFrame:
    """Pattern-instance edges of all documents: word, side (0 before, 1 after), instance, seed, n."""
    schema = pa.schema([("word", pa.int64()), ("side", pa.int32()), ("instance", pa.int64()), ("seed", pa.bool_())])

    def rows(batches):
        for b in A.pieces(batches):
            f = search(*A.utf8(b["text"]))
            for side, word in enumerate((f.before, f.after)):
                some = word != 0
                yield A.batch(schema, word[some].view(np.int64), np.full(int(some.sum()), side, np.int32), f.name[some].view(np.int64), f.kind[some] < 4)

    return docs.select("text").mapInArrow(rows, "word long, side int, instance long, seed boolean").groupBy("word", "side", "instance").agg(F.max("seed").alias("seed"), F.count("*").alias("n"))


def word_counts(docs: DataFrame, words: DataFrame) -> DataFrame:
    """(word, times): how often each of ``words`` occurs in all documents."""
    schema = pa.schema([("word", pa.int64()), ("times", pa.int64())])
    told = None
    if words.count() <= TOLD:
        told = docs.sparkSession.sparkContext.broadcast(np.sort(np.array([r.word for r in words.collect()], np.int64)))

    def rows(batches):
        for b in A.pieces(batches):
            data, off = A.utf8(b["text"])
            starts, ends, _ = A.word_bounds(data, off, _LETTER)
            h = A.Hasher(A.LOWER[data]).ranges(starts, ends).view(np.int64)
            if told is not None:
                known = told.value
                if not len(known):
                    continue
                at = np.searchsorted(known, h)
                h = h[known[np.minimum(at, len(known) - 1)] == h]
            yield A.batch(schema, *np.unique(h, return_counts=True))

    counts = docs.select("text").mapInArrow(rows, "word long, times long").groupBy("word").agg(F.sum("times").alias("times"))
    return counts if told is not None else counts.join(words, "word", "left_semi")


def bootstrap(docs: DataFrame, rounds: int = 3, confidence: float = 0.8, support: int = 5) -> DataFrame:
    """(instance, trust) of the instances outside the base kinds that reach ``confidence`` after ``rounds`` of mutual scoring."""
    edges = checkpoint(graph(docs))
    # Patterns without enough instances, trusted or not, can never have support.
    beside = edges.groupBy("word", "side").agg(F.count("*").alias("kinds"), F.sum("n").alias("n")).where(F.col("kinds") >= support)
    alone = checkpoint(beside.join(word_counts(docs, beside.select("word").distinct()), "word").select("word", "side", (F.col("times") - F.col("n")).alias("alone")))
    edges = checkpoint(edges.join(alone, ["word", "side"]).withColumn("trust", F.col("seed").cast("double")))
    for _ in range(rounds):
        scored = edges.groupBy("word", "side", "alone").agg(F.sum("trust").alias("f"), F.count(F.when(F.col("trust") >= confidence, 1)).alias("kinds"))
        patterns = scored.where(F.col("kinds") >= support).select("word", "side", (F.col("f") / (F.col("f") + F.col("alone") + 1)).alias("score"))
        doubt = edges.join(patterns, ["word", "side"]).groupBy("instance").agg(F.exp(F.sum(F.log1p(-F.col("score")))).alias("doubt"))
        trust = F.when(F.col("seed"), 1.0).otherwise(1 - F.coalesce("doubt", F.lit(1.0)))
        edges = checkpoint(edges.join(doubt, "instance", "left").select("word", "side", "alone", "instance", "seed", "n", trust.alias("trust")))
    return edges.where(~F.col("seed") & (F.col("trust") >= confidence)).select("instance", "trust").distinct()


def find(docs: DataFrame, rounds: int = 3, confidence: float = 0.8, support: int = 5) -> DataFrame:
    """One row per document: counts of the base kinds and of others, their digest, and all spans in code points.

    Discovered instances are joined with the documents that hold them by key,
    never broadcast: their number has no bound.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    rest = pa.list_(pa.struct([("instance", pa.int64()), ("span", pa.string())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_email", pa.int64()), ("n_ip", pa.int64()), ("n_card", pa.int64()), ("n_phone", pa.int64()), ("base_sha256", pa.string()), ("base", pa.string()), ("rest", rest)])

    def rows(batches):
        for b in A.pieces(batches):
            data, off = A.utf8(b["text"])
            f = search(data, off)
            # Code points before each byte.
            points = np.append(0, np.cumsum((data & 0xC0) != 0x80))
            from_, to = points[f.start] - points[off[f.row]], points[f.end] - points[off[f.row]]
            spans: list[list[str]] = [[] for _ in range(b.num_rows)]
            other: list[list[dict]] = [[] for _ in range(b.num_rows)]
            for row, kind, name, x, y in zip(f.row.tolist(), f.kind.tolist(), f.name.view(np.int64).tolist(), from_.tolist(), to.tolist(), strict=True):
                if kind < 4:
                    spans[row].append(f"{KINDS[kind]}:{x}:{y}")
                else:
                    other[row].append({"instance": name, "span": f"other:{x}:{y}"})
            joined = [",".join(x) for x in spans]
            counts = np.zeros((4, b.num_rows), np.int64)
            np.add.at(counts, (f.kind[f.kind < 4], f.row[f.kind < 4]), 1)
            yield A.batch(schema, b["doc_id"], *counts, [hashlib.sha256(x.encode()).hexdigest() for x in joined], joined, other)

    fields = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, rest array<struct<instance:long,span:string>>"
    base = checkpoint(docs.mapInArrow(rows, fields).withColumn("row", F.monotonically_increasing_id()))
    found = bootstrap(docs, rounds, confidence, support).select("instance")
    open_ = base.select("row", F.posexplode("rest").alias("at", "c")).select("row", "at", "c.*")
    more = open_.join(found, "instance", "left_semi").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "span"))).alias("more"))
    joined = F.array_join(F.transform("more", lambda x: x["span"]), ",")
    n_other = F.size(F.coalesce("more", F.array())).cast("long")
    n_base = F.col("n_email") + F.col("n_ip") + F.col("n_card") + F.col("n_phone")
    return base.join(more, "row", "left").select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", n_other.alias("n_other"), (n_base + n_other).alias("n_spans"), F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), joined).alias("spans"))
