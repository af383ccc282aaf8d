"""Quality rules: base statistics of each text, and a line labeller.

A linear-chain conditional random field labels every line of a text with words
as content (1) or boilerplate (0) by Viterbi decoding; the share of a text's
words that lie in content lines decides retention.

The model is fitted on at most ``sample_docs`` labelled documents (those with
the smallest hashes of their ids) and at most ``sample_lines`` of their lines.
Only documents are labelled, so the labels of lines are latent: they begin as
their document's, and in each round of :func:`learn` the model may move a line
to the other label, be its document good or bad.  Mixed documents thus get
mixed labels, and the transitions between them are learnt.  Statistics
and verdicts cover every whole text.

Defined cases: a null or empty text has no words and fails the base rules; a
table without usable labels takes ``DEFAULT``; repeated rows are judged alike;
other columns of the input are not read and cannot clash; the result has one
row per input row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from . import crf

WINDOW = 8
LEAST_SHARE = 0.4  # of a text's words, in content lines
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_BANG = np.zeros(256, bool)
_BANG[list(b"!?")] = True
_END = np.zeros(256, bool)
_END[list(b".!?:;\"')")] = True
FEATURES = ("log_words", "symbols", "upper", "digits", "bangs", "ended", "word_length", "distinct", "repeated", "duplicate")
#: Used where no labels are given: mild weights on the same features.
DEFAULT = crf.Model(np.array([0.3, -6.0, -4.0, -3.0, -3.0, 0.5, 0.0, 3.0, -5.0, -2.0]), 1.0, np.zeros(2), np.array([[0.7, -0.7], [-0.7, 0.7]]))

STATS = pa.schema([("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64())])


def _measure(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Base statistics of the rows; features, words and row offsets of the lines with a word."""
    data, off = A.utf8(column)
    starts, ends, word_off = A.word_bounds(data, off)
    n_words = np.diff(word_off)
    row = np.repeat(np.arange(len(n_words)), n_words)
    chars = (data & 0xC0) != 0x80
    word_chars = A.sums(chars & A.WORD[data], off)
    n_symbols = A.sums(SYMBOLS[data], off)
    code = A.word_codes(data, starts, ends)

    again = np.zeros(len(starts), bool)
    w = A.run_codes(code, WINDOW)
    if len(w):
        whole = np.flatnonzero(row[WINDOW - 1 :] == row[: len(w)])
        key = row[whole] * (int(w.max()) + 1) + w[whole]
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(whole), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at = whole[twice]
        again = A.cover(len(starts), at, at + WINDOW)
    n_repeat = A.sums(again, word_off)

    # Lines: a new one begins with each row and after each line feed.
    cut = np.flatnonzero(data == 10) + 1
    line_from = np.unique(np.concatenate([off[:-1], cut[cut < len(data)]])) if len(data) else np.empty(0, np.int64)
    line_from = line_from[line_from < len(data)]
    line_to = np.append(line_from[1:], len(data))
    has = np.searchsorted(starts, line_from), np.searchsorted(starts, line_to)
    some = has[1] > has[0]
    line_from, line_to, w0, w1 = line_from[some], line_to[some], has[0][some], has[1][some]
    line_row = np.searchsorted(off, line_from, "right") - 1
    line_off = np.searchsorted(line_row, np.arange(len(n_words) + 1))

    n_dup, duplicate = np.zeros(len(n_words), np.int64), np.zeros(len(line_from), bool)
    raw = data.tobytes()
    spans = list(zip(line_from.tolist(), line_to.tolist(), strict=True))
    for r, (a, b) in enumerate(zip(line_off[:-1].tolist(), line_off[1:].tolist(), strict=True)):
        if b - a < 2:
            continue
        seen: dict[bytes, int] = {}
        for i in range(a, b):
            s, e = spans[i]
            line = raw[s : e - 1] if raw[e - 1] == 10 else raw[s:e]
            if line in seen:
                n_dup[r] += 1
                duplicate[i] = duplicate[seen[line]] = True
            else:
                seen[line] = i

    def share(flags: np.ndarray, of: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return (total[line_to] - total[line_from]) / np.maximum(1, of)

    words = w1 - w0
    n_chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum(chars, out=n_chars[1:])
    length = n_chars[line_to] - n_chars[line_from]
    line_of_word = np.repeat(np.arange(len(words)), words)
    order = np.lexsort((code, line_of_word))
    fresh = np.ones(len(code), bool)
    if len(code) > 1:
        fresh[1:] = (code[order][1:] != code[order][:-1]) | (line_of_word[order][1:] != line_of_word[order][:-1])
    distinct = np.bincount(line_of_word[order], fresh, len(words)) / np.maximum(1, words)
    covered = np.bincount(line_of_word, again, len(words)) / np.maximum(1, words)
    last = ends[w1 - 1] - 1 if len(words) else np.empty(0, np.int64)
    features = np.column_stack([np.log1p(words), share(SYMBOLS[data], words), share(_UPPER[data], length), share(_DIGIT[data], length), share(_BANG[data], words), _END[data[last]] if len(last) else np.empty(0), np.log1p(length / np.maximum(1, words)), distinct, covered, duplicate]).astype(float)
    return [n_words, word_chars, n_symbols, n_dup, n_repeat], features, words, line_off


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = 3000, sample_lines: int = 60_000) -> crf.Model:
    """The line model from a bounded sample of labelled documents; only that sample reaches the driver."""
    chosen = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").select("doc_id", F.col("quality").cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")
    schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("line", pa.int64()), ("x", pa.list_(pa.float64()))])

    def lines(batches):
        for b in A.pieces(batches):
            _, x, _, off = _measure(b["text"])
            n = np.diff(off)
            row = np.repeat(np.arange(len(n)), n)
            yield A.batch(schema, b["doc_id"].take(pa.array(row)), b["y"].take(pa.array(row)), np.arange(len(row)) - off[row], list(x))

    rows = picked.mapInArrow(lines, "doc_id long, y int, line long, x array<double>").orderBy(F.xxhash64("doc_id"), "doc_id", "line").limit(sample_lines).toPandas()
    if rows.y.nunique() < 2:
        return DEFAULT
    change = np.flatnonzero((rows.doc_id.values[1:] != rows.doc_id.values[:-1]) | (rows.line.values[1:] <= rows.line.values[:-1])) + 1
    return learn(np.stack(rows.x.values), rows.y.values.astype(np.int8), np.concatenate([[0], change, [len(rows)]]))


def learn(x: np.ndarray, y: np.ndarray, off: np.ndarray, rounds: int = 2, sure: float = 0.8) -> crf.Model:
    """A chain model of latent line labels; ``y`` has each line's document label.

    The first labels come from lines on their own, as a chain fitted to whole
    documents of one label would never change it.  Content stands in documents of
    both labels, boilerplate mostly in bad ones: a line of a bad document is
    content if, with both kinds of documents weighed alike, it looks like a good
    one's, and a line of a good document is boilerplate only if the model is
    ``sure``.  A good document keeps a line of content, a bad one of boilerplate.
    """
    alone = crf.fit(x, y, np.arange(len(x) + 1))
    p = 1 / (1 + np.exp(-(alone.emissions(x) + alone.start[1] - alone.start[0] + np.log((y == 0).sum() / (y == 1).sum()))))
    model = alone
    for _ in range(rounds):
        labels = np.where(y == 1, p > 1 - sure, p > 0.5).astype(np.int8)
        # The line nearest to its document's label stays with it.
        order = np.lexsort((np.where(y == 1, -p, p), np.repeat(np.arange(len(off) - 1), np.diff(off))))
        nearest = order[off[:-1][np.diff(off) > 0]]
        labels[nearest] = y[nearest]
        model = crf.fit(x, labels, off)
        p = crf.marginals(model.emissions(x), off, model)[0]
    return model


def lines(docs: DataFrame, model: crf.Model = DEFAULT) -> DataFrame:
    """(doc_id, line, n_words, content) of every line with a word, counted from 0 in each document."""
    schema = pa.schema([("doc_id", pa.int64()), ("line", pa.int64()), ("n_words", pa.int64()), ("content", pa.bool_())])

    def rows(batches):
        for b in A.pieces(batches):
            _, x, words, off = _measure(b["text"])
            n = np.diff(off)
            row = np.repeat(np.arange(len(n)), n)
            y = crf.viterbi(model.emissions(x), off, model) if len(words) else np.empty(0, np.int8)
            yield A.batch(schema, b["doc_id"].take(pa.array(row)), np.arange(len(row)) - off[row], words, y == 1)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, line long, n_words long, content boolean")


def _verdicts(column: pa.Array, model: crf.Model, least_share: float) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    stats, x, words, off = _measure(column)
    y = crf.viterbi(model.emissions(x), off, model) if len(words) else np.empty(0, np.int8)
    content = A.sums(words * (y == 1), off)
    share = content / np.maximum(1, stats[0])
    failed = (stats[0] < 20) | (100 * stats[4] > 30 * stats[0])
    return stats, share, failed, ~failed & (share >= least_share)


def judge(docs: DataFrame, labels: DataFrame | None = None, model: crf.Model | None = None, least_share: float = LEAST_SHARE) -> DataFrame:
    """One row per document: base statistics, content share, base_failed and kept."""
    model = model or (fit(docs, labels) if labels is not None else DEFAULT)
    schema = pa.schema([("doc_id", pa.int64()), *STATS, ("content_share", pa.float64()), ("base_failed", pa.bool_()), ("kept", pa.bool_())])

    def rows(batches):
        for b in A.pieces(batches):
            stats, share, failed, kept = _verdicts(b["text"], model, least_share)
            yield A.batch(schema, b["doc_id"], *stats, share, failed, kept)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content_share double, base_failed boolean, kept boolean")


def keep(docs: DataFrame, labels: DataFrame | None = None, model: crf.Model | None = None, least_share: float = LEAST_SHARE) -> DataFrame:
    """The documents that :func:`judge` keeps, with all their columns, in one pass and without a shuffle."""
    model = model or (fit(docs, labels) if labels is not None else DEFAULT)

    def rows(batches):
        for b in A.pieces(batches):
            yield b.filter(pa.array(_verdicts(b["text"], model, least_share)[3]))

    return docs.mapInArrow(rows, docs.schema)
