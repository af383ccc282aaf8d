"""Exact removal of repeated byte strings with suffix arrays.

Texts are UTF-8 bytes.  A byte is removed if a string of ``LENGTH`` bytes that
covers it also starts earlier: in a document with a smaller id, or earlier in
the same one.  Strings are judged on the input and never cross documents.

Shards hold the stretches around shared anchors (see :mod:`repeats`); each builds
a suffix array by Larsson-Sadakane refinement and common prefixes by Kasai's
rule, in numpy; entries with ``LENGTH`` bytes in common are one string, and its
earliest occurrence stays.  Where an anchor is dealt over several shards, each
leaves its open strings as sorted arrays, which are merged by binary search.

Defined cases: a null text is empty, a text shorter than ``LENGTH`` loses
nothing; rows with a null doc_id lose nothing; whole repeats of a row get the
same result each; rows that share a doc_id and differ in text are parts of one
document by place; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from . import repeats as R
from .suffixes import of_bytes

LENGTH, GRAM = 100, 32


def decide(window: int):
    def by_suffixes(data, off, doc, lo, size):
        sa, lcp, rem = of_bytes(data, off)
        of = np.empty(len(sa), np.int64)
        of[sa] = np.cumsum(lcp < window)
        context = np.repeat(np.arange(len(size)), size)
        offset = np.arange(int(size.sum())) - np.repeat(np.cumsum(size, dtype=np.int64) - size, size)
        at = off[context] + offset
        d, place, string = doc[context], lo[context] + offset, of[at]
        order = np.lexsort((place, d, string))
        new = np.append(True, string[order][1:] != string[order][:-1])
        head = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        removed = np.zeros(len(at), bool)
        removed[order] = (d[order] > d[head]) | (d[order] == d[head]) & (place[order] > place[head])
        return removed, *(A.Hasher(data, which).ranges(at, at + window) for which in (0, 1))

    return by_suffixes


def remove(docs: DataFrame, length: int = LENGTH, shard: int = R.SHARD) -> DataFrame:
    """One row per document: n_bytes, n_removed, n_spans, kept_sha256, and the kept bytes' spans ``start:end``."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    kind = R.Kind(words=False, window=length, gram=min(GRAM, length), other_document=False)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("removed_spans", pa.string())])

    def rows(batches):
        for b in A.pieces(batches):
            data, off = A.utf8(b["text"])
            gone = R.mask(b["gone"], off, length)
            edge = np.zeros(len(data) + 1, bool)
            edge[off] = True
            before, after = np.zeros_like(gone), np.zeros_like(gone)
            before[1:], after[:-1] = gone[:-1], gone[1:]
            starts = np.flatnonzero(gone & (edge[:-1] | ~before))
            ends = np.flatnonzero(gone & (edge[1:] | ~after)) + 1
            n_removed, s0 = A.sums(gone, off), np.searchsorted(starts, off)
            kept = data[~gone].tobytes()
            koff = np.append(0, np.cumsum(np.diff(off) - n_removed)).tolist()
            digests = [hashlib.sha256(kept[i:j]).hexdigest() for i, j in zip(koff[:-1], koff[1:], strict=True)]
            base = off[:-1].tolist()
            spans = [",".join(f"{x - o}:{y - o}" for x, y in zip(starts[i:j].tolist(), ends[i:j].tolist(), strict=True)) for o, i, j in zip(base, s0[:-1].tolist(), s0[1:].tolist(), strict=True)]
            yield A.batch(schema, b["doc_id"], np.diff(off), n_removed, np.diff(s0), digests, spans)

    return R.removed(docs, kind, decide(length), shard).mapInArrow(rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed_spans string")
