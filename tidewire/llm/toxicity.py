"""Toxicity: a linear-chain conditional random field over tokens.

Tokens are runs of ASCII letters, digits and bytes above 127, with A-Z and the
Latin-1 letters lower-cased.  Each
has hashed features: the token and its prefixes.  Spark counts, over all labelled
training documents, in how many toxic and clean ones each feature occurs; a
feature is *marked* if it leans towards toxic documents beyond chance
(log-likelihood ratio).  Marked tokens of toxic documents are the labelled
toxic tokens on which the field is fitted, from a bounded sample of training
documents; forward-backward marginals then give each token's probability of
being toxic.  Their maximum, sum and density go through a logistic link, fitted
on the same sample, to the document's score; tokens above one half are the
offending offsets.

Tokens without a marked feature all have the same emission, so runs of them are
powers of one 2 x 2 matrix: the chain is walked over marked tokens only, exactly.

``sample_docs`` bounds the rows used for fitting; counts and scores cover all
documents.  Counting is into ``2 ** BITS`` buckets, so what reaches the driver
has a fixed bound.

Defined cases: null and empty texts have no tokens and get the score of a text
without evidence; without both classes among the training labels nothing is
marked and all scores are the base rate; repeated rows are scored alike;
columns other than id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from . import crf
from .session import checkpoint

BITS = 20
PREFIXES = (5, 7, 9)  # bytes, besides the whole token
LEAST_G2 = 18.0
TOKEN = np.zeros(256, bool)
TOKEN[48:58] = TOKEN[65:91] = TOKEN[97:123] = TOKEN[128:] = True


@dataclass(frozen=True)
class Scorer:
    log_odds: np.ndarray  # of each bucket; 0 where it is not marked
    field: crf.Model
    link: np.ndarray  # of the document features
    bias: float


def _tokens(column: pa.Array):
    """Starts and ends of tokens, token offsets of rows, and a bucket for each feature of each token."""
    data, off = A.utf8(column)
    starts, ends, tok = A.word_bounds(data, off, TOKEN)
    lower = A.LOWER[data]
    # U+00C0 to U+00DE, but for the multiplication sign, are C3 80 to C3 9E.
    upper = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)) + 1
    lower[upper] += 32
    hasher = A.Hasher(lower)
    buckets = [hasher.ranges(starts, ends) >> np.uint64(64 - BITS)]
    for k in PREFIXES:
        h = hasher.ranges(starts, np.minimum(ends, starts + k)) + np.uint64(k)
        buckets.append(np.where(ends - starts > k, A.mix(h) >> np.uint64(64 - BITS), buckets[0]))
    return data, starts, ends, tok, [b.astype(np.int64) for b in buckets]


def training_rows(labels: DataFrame) -> DataFrame:
    """Labelled rows outside the held-out fold: doc_id, y; once each, toxic if any row says so."""
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    return known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y"))


def counts(rows: DataFrame) -> DataFrame:
    """Documents of each class that hold each bucket; pre-aggregated by piece.  Bucket -1 counts documents."""
    schema = pa.schema([("bucket", pa.int32()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def count(batches):
        for b in A.pieces(batches):
            _, _, _, tok, buckets = _tokens(b["text"])
            y = np.asarray(b["y"])
            row = np.repeat(np.arange(len(y)), np.diff(tok))
            keys = np.unique(np.concatenate([(row << BITS) | x for x in buckets]))
            held, of = np.unique(keys & ((1 << BITS) - 1), return_inverse=True)
            toxic = np.bincount(of, y[keys >> BITS], len(held)).astype(np.int64)
            total = np.bincount(of, minlength=len(held))
            yield A.batch(schema, np.append(held, -1).astype(np.int32), np.append(toxic, y.sum()), np.append(total - toxic, (y == 0).sum()))

    return rows.select("text", "y").mapInArrow(count, "bucket int, toxic long, clean long").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def marked_buckets(table: DataFrame) -> DataFrame:
    """(bucket, odds) of the buckets that lean towards toxic documents beyond chance."""
    sums = {r.y: r.n for r in table.where("bucket = -1").select(F.explode(F.array(F.struct(F.lit(1).alias("y"), F.col("toxic").alias("n")), F.struct(F.lit(0).alias("y"), F.col("clean").alias("n")))).alias("r")).select("r.*").collect()}
    t, c = float(sums.get(1) or 0), float(sums.get(0) or 0)
    if not t or not c:
        return table.where("false").select("bucket", F.lit(0.0).alias("odds"))
    a, b, n = F.col("toxic"), F.col("clean"), t + c
    part = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
    held = a + b
    g2 = 2 * (part(a, held * (t / n)) + part(b, held * (c / n)) + part(t - a, (n - held) * (t / n)) + part(c - b, (n - held) * (c / n)))
    odds = F.log((a + 0.5) / (t + 1)) - F.log((b + 0.5) / (c + 1))
    return table.where("bucket >= 0").where((g2 >= LEAST_G2) & (odds > 1.5)).select("bucket", odds.alias("odds"))


def _marked(column: pa.Array, log_odds: np.ndarray):
    """Marked tokens: row offsets, places among the row's tokens, byte starts and ends, features; and token offsets."""
    data, starts, ends, tok, buckets = _tokens(column)
    odds = np.stack([log_odds[b] for b in buckets], 1) if len(starts) else np.empty((0, len(buckets)), np.float32)
    at = np.flatnonzero((odds > 0).any(1))
    o = odds[at]
    features = np.column_stack([o.max(1) if len(at) else np.empty(0), o[:, 0], o[:, 0] > 0]).astype(float)
    return data, np.searchsorted(at, tok), at, starts[at], ends[at], features, tok


def _chain(x: np.ndarray, place: np.ndarray, off: np.ndarray, tok: np.ndarray, model: crf.Model) -> np.ndarray:
    """Forward-backward marginals of the marked tokens; all others have emission ``model.bias``."""
    p = np.zeros(len(x))
    if not len(x):
        return p
    t = np.exp(model.trans - model.trans.max())
    step = np.diag([1.0, np.exp(model.bias)]) @ t
    values, vectors = np.linalg.eig(step)
    big = int(np.argmax(values))
    inverse = np.linalg.inv(vectors)
    main = np.outer(vectors[:, big], inverse[big]).real
    rest = np.outer(vectors[:, 1 - big], inverse[1 - big]).real
    ratio = float((values[1 - big] / values[big]).real)

    def power(g: np.ndarray) -> np.ndarray:
        return main + (ratio ** g.astype(float))[:, None, None] * rest

    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    first = np.zeros(len(x), bool)
    first[off[:-1][np.diff(off) > 0]] = True
    before = place - np.where(first, tok[row], np.append(0, place[:-1]) + 1)
    q = power(before)
    via = np.where(first[:, None, None], q, t @ q)
    e = np.exp(np.clip(x, -50, 50))
    start = np.exp(model.start - model.start.max())
    last = np.zeros(len(x), bool)
    last[off[1:][np.diff(off) > 0] - 1] = True
    after = t @ (power(np.maximum(tok[row + 1] - place - 2, 0)) @ np.array([1.0, np.exp(model.bias)])[:, None])[..., :]
    end = np.where((tok[row + 1] - place > 1)[:, None], after[..., 0], 1.0)
    for _, cells, ok, _ in crf._groups(off):
        f = np.empty((*cells.shape, 2))
        g = np.empty((*cells.shape, 2))
        for i in range(len(cells)):
            v = via[cells[i]]
            u = np.einsum("j,kjl->kl", start, v) if i == 0 else np.einsum("kj,kjl->kl", f[i - 1], v)
            u[:, 1] *= e[cells[i]]
            f[i] = u / u.sum(1, keepdims=True)
        for i in range(len(cells) - 1, -1, -1):
            own = end[cells[i]]
            if i + 1 < len(cells):
                nxt = g[i + 1] * np.column_stack([np.ones(len(cells[i])), e[cells[i + 1]]])
                own = np.where(last[cells[i]][:, None], own, np.einsum("kjl,kl->kj", via[cells[i + 1]], nxt))
            g[i] = own / own.sum(1, keepdims=True)
        both = f * g
        p[cells[ok]] = (both[..., 1] / both.sum(-1))[ok]
    return p


def _document_features(p: np.ndarray, off: np.ndarray, tok: np.ndarray) -> np.ndarray:
    n = np.diff(off)
    row = np.repeat(np.arange(len(n)), n)
    total = np.bincount(row, p, len(n))
    most = np.zeros(len(n))
    np.maximum.at(most, row, p)
    return np.column_stack([most, np.log1p(total), np.sqrt(total / np.maximum(1, np.diff(tok)))])


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, penalty: float = 1e-2) -> tuple[np.ndarray, float]:
    """Regularised logistic regression by Newton steps."""
    z = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(z.shape[1]), penalty * np.append(np.ones(x.shape[1]), 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge) + 1e-9 * np.eye(len(w)), z.T @ (y - p) - ridge * w)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = 4000) -> Scorer:
    """Counts over all training documents, then the field and the link on at most ``sample_docs`` of them."""
    rows = training_rows(labels)
    # Labels grow with the documents, so they are never broadcast: a hashed join, which need not sort the texts.
    labelled = docs.select("doc_id", "text").join(rows.hint("shuffle_hash"), "doc_id")
    marked = marked_buckets(checkpoint(counts(labelled))).toPandas()  # fewer than 2 ** BITS rows
    odds = np.zeros(1 << BITS, np.float32)
    odds[marked.bucket] = marked.odds
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    shared = docs.sparkSession.sparkContext.broadcast(odds)
    schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("n", pa.int64()), ("places", pa.list_(pa.int64())), ("x", pa.list_(pa.float64()))])

    def look(batches):
        for b in A.pieces(batches):
            _, off, at, _, _, x, tok = _marked(b["text"], shared.value)
            pairs = list(zip(off[:-1], off[1:], strict=True))
            yield A.batch(schema, b["doc_id"], b["y"], np.diff(tok), [at[i:j] - tok[r] for r, (i, j) in enumerate(pairs)], [x[i:j].ravel() for i, j in pairs])

    seen = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInArrow(look, "doc_id long, y int, n long, places array<long>, x array<double>").toPandas()
    none = Scorer(odds, crf.Model(np.zeros(3), -5.0, np.zeros(2), np.zeros((2, 2))), np.zeros(3), -3.0)
    if not len(seen) or seen.y.nunique() < 2 or not odds.any():
        return none
    seen = seen.sort_values(["doc_id", "n"], kind="stable")
    # The field is fitted on the marked tokens and up to three neighbours to either side, which stand for the unmarked ones.
    features, labels_, off = [], [], [0]
    for y, n, places, x in seen[["y", "n", "places", "x"]].values:
        at = np.asarray(places, np.int64)
        x = np.asarray(x, float).reshape(-1, 3)
        near = np.unique(np.clip((at[:, None] + np.arange(-3, 4)).ravel(), 0, max(0, n - 1))) if len(at) else np.arange(min(n, 7))
        full = np.zeros((len(near), 3))
        full[np.searchsorted(near, at)] = x
        features.append(full)
        labels_.append((full[:, 0] > 0) & (y == 1))
        off.append(off[-1] + len(near))
    field = crf.fit(np.concatenate(features), np.concatenate(labels_).astype(np.int8), np.array(off))
    tok = np.append(0, np.cumsum(seen.n.to_numpy()))
    sizes = np.array([len(p) for p in seen.places])
    moff = np.append(0, np.cumsum(sizes))
    place = np.concatenate([np.asarray(p, np.int64) for p in seen.places]) + np.repeat(tok[:-1], sizes)
    x = np.concatenate([np.asarray(v, float) for v in seen.x]).reshape(-1, 3)
    p = _chain(field.emissions(x), place, moff, tok, field)
    return Scorer(odds, field, *_logistic(_document_features(p, moff, tok), seen.y.to_numpy(float)))


def score(docs: DataFrame, labels: DataFrame, sample_docs: int = 4000) -> DataFrame:
    """One row per document: held_out, score, predicted, and the offending spans ``start:end`` in code points."""
    scorer = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample_docs))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_spans", pa.int64()), ("spans", pa.string())])

    def rows(batches):
        s = scorer.value
        for b in A.pieces(batches):
            data, off, at, starts, ends, x, tok = _marked(b["text"], s.log_odds)
            p = _chain(s.field.emissions(x), at, off, tok, s.field)
            z = _document_features(p, off, tok) @ s.link + s.bias
            hot = p > 0.5
            row = np.repeat(np.arange(len(off) - 1), np.diff(off))
            points = np.zeros(len(data) + 1, np.int64)
            np.cumsum((data & 0xC0) != 0x80, out=points[1:])
            _, base = A.utf8(b["text"])
            spans: list[list[str]] = [[] for _ in range(b.num_rows)]
            for r, i, j in zip(row[hot].tolist(), starts[hot].tolist(), ends[hot].tolist(), strict=True):
                spans[r].append(f"{points[i] - points[base[r]]}:{points[j] - points[base[r]]}")
            yield A.batch(schema, b["doc_id"], 1 / (1 + np.exp(-np.clip(z, -30, 30))), [len(v) for v in spans], [",".join(v) for v in spans])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, score double, n_spans long, spans string")
    return out.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_spans", "spans")
