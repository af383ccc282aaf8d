"""In how many documents each phrase stands.

Most phrases of three words are rare, so what is shuffled is nearly all of them.  A piece of
a task sends a word once (for each of ``SHARES`` shares of the words after it), with the words
that follow it, the words that follow both, and the counts of these, instead of each phrase
by itself: a word of a phrase is written out only where it differs from the phrase before.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of documents that are counted at once, beyond which the next document opens a piece.
AT_ONCE = 2_000_000
#: Shares of the words after one word, so that a frequent first word is not one task.
SHARES = 16


def _counted(sentences: pa.Array) -> pa.RecordBatch | None:
    """(first, share, words, counts) of an array of documents, each a list of lists of words: a second word and its thirds a run, ``|`` between runs."""
    lists = sentences.flatten()
    of, words = pc.list_parent_indices(lists).to_numpy(), lists.flatten().dictionary_encode()
    doc, code, many = pc.list_parent_indices(sentences).to_numpy()[of], words.indices.to_numpy().astype(np.int64), max(1, len(words.dictionary))
    at = np.flatnonzero(of[1:] == of[:-1])
    if not len(at):
        return None
    pairs, pair = np.unique(code[at] * many + code[at + 1], return_inverse=True)
    held = np.bincount(np.unique(doc[at] * len(pairs) + pair) % len(pairs), minlength=len(pairs))
    long = np.flatnonzero(at + 2 < len(of))
    long = long[of[at[long] + 2] == of[at[long]]]
    triples, triple = np.unique(pair[long] * many + code[at[long] + 2], return_inverse=True)
    counts = np.bincount(np.unique(doc[at[long]] * max(1, len(triples)) + triple) % max(1, len(triples)), minlength=len(triples))
    # Each second word stands before its thirds, and the documents of the pair before their counts.
    offsets = np.searchsorted(triples // many, np.arange(len(pairs) + 1))
    joined = lambda of, at, by: pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), of), by)
    first, second, at = pairs // many, pairs % many, offsets + np.arange(len(pairs) + 1)
    run = joined(words.dictionary.take(pa.array(np.insert(triples % many, offsets[:-1], second))), at, " ")
    told = joined(pa.array(np.insert(counts, offsets[:-1], held)).cast(pa.string()), at, " ")
    share = np.array([zlib.crc32(w.encode()) % SHARES for w in words.dictionary.to_pylist()], np.int32)[second]
    order = np.lexsort((share, first))
    first, share, order = first[order], share[order], pa.array(order)
    new = np.flatnonzero(np.append(True, (np.diff(first) != 0) | (np.diff(share) != 0)))
    at = np.append(new, len(first))
    columns = [words.dictionary.take(pa.array(first[new])), pa.array(share[new], pa.int32()), joined(run.take(order), at, "|"), joined(told.take(order), at, "|")]
    return pa.RecordBatch.from_arrays(columns, ["first", "share", "words", "counts"])


def documents(texts: DataFrame, tokens: Column) -> DataFrame:
    """(phrase, documents) over all rows of ``texts``; ``tokens`` is an array of lists of words without spaces and ``|``, one list a sentence."""

    def rows(batches):
        for b in batches:
            size = np.cumsum(pc.fill_null(b.column(1), 0).to_numpy(zero_copy_only=False))
            cuts = np.unique([0, *np.searchsorted(size, np.arange(AT_ONCE, int(size[-1]) if len(size) else 0, AT_ONCE), "right"), b.num_rows]).tolist()
            for i, z in zip(cuts[:-1], cuts[1:], strict=True):
                told = _counted(b.column(0).slice(i, z - i))
                if told is not None:
                    yield told

    cut = texts.select(tokens.alias("tokens")).select("tokens", F.aggregate("tokens", F.lit(0), lambda n, t: n + F.size(t)).cast("long").alias("n"))
    told = cut.mapInArrow(rows, "first string, share int, words string, counts string").repartition("first", "share")
    # All of a first word and share is in one task now; that key is part of what follows.
    runs = told.select("first", "share", F.explode(F.arrays_zip(F.split("words", r"\|").alias("w"), F.split("counts", r"\|").alias("n"))).alias("x"))
    runs = runs.select("first", "share", F.split("x.w", " ").alias("w"), F.split("x.n", " ").alias("n"))
    each = F.zip_with(F.transform("w", lambda w, i: F.when(i == 0, w).otherwise(F.concat(F.col("w")[0], F.lit(" "), w))), "n", lambda w, n: F.struct(w.alias("after"), n.cast("long").alias("n")))
    held = runs.select("first", "share", F.explode(each).alias("x")).groupBy("first", "share", F.col("x.after").alias("after")).agg(F.sum("x.n").alias("documents"))
    return held.select(F.concat_ws(" ", "first", "after").alias("phrase"), "documents")
