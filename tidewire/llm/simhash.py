"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints: words of the text (A-Z lower-cased), shingles of ``size`` words,
XXH64 with seed 42 of each, and per bit a majority vote.  Equal fingerprints
form one class first, so copies are counted and not compared.

Links at ``radius`` or fewer differing bits are found without losing one: cut
the 64 bits into ``radius + k`` parts, and any such pair agrees on ``k`` of
them, so it meets in the bucket of one of the k-subsets.  k grows with the
number of fingerprints so that buckets stay small; every k gives the same links.
A bucket over ``TILE`` rows is cut into tiles, and each pair of tiles is its own
task unit, so no task holds a large bucket.

Inside a unit, bit planes are stored vertically: 64 fingerprints lie in the 64
lanes of one machine word per bit.  Comparing one fingerprint with a block of 64
adds its 64 difference planes into bitwise counters by carry-save addition; lanes
past the radius are marked, and a block is abandoned once all its lanes are.
Units emit spanning links only (a lane with its group's smallest lane), never
all pairs, and connected components over these links give the groups.

:func:`one_of_each` also links documents whose sets of five-word shingles have a
Jaccard similarity of ``SIMILAR`` or more.  Equal sets form one class first.
Bands of minimum hashes only propose pairs (a pair at 0.8 shares one with
probability 1 - 5e-8); the sets of a proposed pair are then compared exactly.
The classes that share a band then meet by prefix filtering: shingles are put in
a common order, rare ones first, and two sets reach ``similar`` only if they
share one among their first fifth, so early that enough are left after it.  Texts
that share a long passage and differ in much else fall out there, by what each
has alone.  So that a large group of near copies comes together in few
comparisons, ``STARS`` times each class without a link is first compared with the
one that has least alone in its largest band; the pairs that are still apart
after that are compared exactly, but for those that the prefixes rule out.

Defined cases: null and empty texts have fingerprint zero, linked like any
other; rows with a null doc_id get a fingerprint and a null component; repeated
rows each get a row; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import components
from . import arrays as A
from .session import checkpoint, stored
from .suffixes import sequence_sums

SIZE, SEED, RADIUS, TILE = 4, 42, 4, 2048
SHINGLE, SIMILAR, BANDS, BAND_ROWS, SKETCH, STARS = 5, 0.8, 32, 4, 128, 2
_U = np.uint64


def fingerprint(words: list[bytes], size: int = SIZE) -> int:
    """Reference form of one text; :func:`fingerprints` computes the same for columns."""
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s, SEED) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _column(column: pa.Array, size: int) -> np.ndarray:
    out = np.zeros(len(column), _U)
    digest = xxhash.xxh64_intdigest
    for i, text in enumerate(A.texts(column)):
        words = text.lower().split()
        if not words:
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        n = max(1, len(words) - size + 1)
        starts = np.append(0, ends[: n - 1] + 1).tolist()
        stops = ends[min(size, len(words)) - 1 :].tolist()
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], _U)
        votes = np.zeros(64, np.int64)
        for at in range(0, n, 1 << 15):
            votes += np.unpackbits(h[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[i] = np.packbits(2 * votes > n, bitorder="little").view(_U)[0]
    return out


def fingerprints(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, fp) with the 64 bits in a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def rows(batches):
        for b in A.pieces(batches):
            yield A.batch(schema, b["doc_id"], _column(b["text"], size).view(np.int64))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, fp long")


def _planes(fps: np.ndarray) -> np.ndarray:
    """64 x blocks: bit b of 64 fingerprints in the lanes of one word."""
    full = np.zeros(-(-len(fps) // 64) * 64, _U)
    full[: len(fps)] = fps
    bits = np.unpackbits(full.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(_U)


def _exceeds(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose bitwise counter is over ``radius``."""
    over, same = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for i in range(len(counters) - 1, -1, -1):
        if radius >> i & 1:
            same &= counters[i]
        else:
            over |= same & counters[i]
            same &= ~counters[i]
    return over


def near(fps: np.ndarray, upto: np.ndarray, radius: int = RADIUS, most: int = 1 << 16):
    """Pairs (i, j), i < j < upto[i], within ``radius`` bits, in chunks of (i array, j array)."""
    n, planes = len(fps), _planes(fps)
    width = (radius + 2).bit_length() + 1
    lanes = np.arange(n)
    first, last = (lanes + 1) >> 6, (upto - 1) >> 6
    blocks = np.where(upto > lanes + 1, last - first + 1, 0)
    ends = np.cumsum(blocks)
    ones = ~_U(0)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        k = blocks[at:to]
        q = np.repeat(lanes[at:to], k)
        w = np.arange(len(q)) - np.repeat(np.cumsum(k) - k, k) + first[q]
        lo, hi = np.maximum(q + 1 - w * 64, 0), np.minimum(upto[q] - w * 64, 64)
        shift = lambda x: np.where(x >= 64, _U(0), ones << (x.astype(_U) & _U(63)))
        over = ~(shift(lo) & ~shift(hi))
        count = [np.zeros(len(q), _U) for _ in range(width)]
        for b in range(0, 64, 2):
            if not len(q):
                break
            x, y = (planes[c, w] ^ (-(fps[q] >> _U(c) & _U(1)).astype(np.int64)).astype(_U) for c in (b, b + 1))
            carry = count[0] & x | count[0] & y | x & y
            count[0] = count[0] ^ x ^ y
            for i in range(1, width):
                count[i], carry = count[i] ^ carry, count[i] & carry
            over |= carry | _exceeds(count, radius)
            if b % 8 == 6:
                alive = over != ones
                if alive.mean() < 0.8 if len(alive) else False:
                    q, w, over, count = q[alive], w[alive], over[alive], [c[alive] for c in count]
        if len(q):
            hit = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            r, lane = np.nonzero(hit)
            if len(r):
                yield q[r], w[r] * 64 + lane
        at = to


def _local_links(fps: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Lanes with their group's smallest reachable lane; ``group`` marks runs that are compared among themselves."""
    n = len(fps)
    cut = np.flatnonzero(np.append(group[1:] != group[:-1], True)) + 1
    upto = cut[np.searchsorted(cut, np.arange(n), "right")]
    label = np.arange(n)
    for a, b in near(fps, upto, radius):
        while True:
            la, lb = label[a], label[b]
            apart = la != lb
            if not apart.any():
                break
            a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while (label[label] != label).any():
                label = label[label]
    at = np.flatnonzero(label != np.arange(n))
    return at, label[at]


def parts_for(n: int, radius: int = RADIUS) -> int:
    """k, so that a bucket of uniform fingerprints has at most some 64 rows."""
    k = 1
    while k < 8 and n > 64 << (64 * k // (radius + k)):
        k += 1
    return k


def links(classes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b) over ``rep`` of ``classes`` (fp, rep), fp unique: enough links within ``radius`` to connect all groups."""
    k = parts_for(classes.count(), radius)
    cuts = [64 * i // (radius + k) for i in range(radius + k + 1)]
    masks = [sum((1 << cuts[i + 1]) - (1 << cuts[i]) for i in chosen) for chosen in combinations(range(radius + k), k)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)])
    keyed = classes.select("fp", "rep", F.explode(keys).alias("k")).select("fp", "rep", "k.part", "k.key")
    return _compared(keyed, radius, tile)


def _units(keyed: DataFrame, tile: int) -> DataFrame:
    """Rows (part, key, n, rep) of buckets of n rows with the tile pairs u, v in which a row is compared."""
    tiles = F.ceil(F.col("n") / tile).cast("int")
    tiled = keyed.withColumn("tiles", tiles).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    units = F.when(F.col("tiles") == 1, F.array(F.struct(F.lit(0).alias("u"), F.lit(0).alias("v")))).otherwise(
        F.transform(F.filter(F.sequence(F.lit(0), F.col("tiles") - 1), lambda i: i != F.col("own")), lambda i: F.struct(F.least(i, F.col("own")).alias("u"), F.greatest(i, F.col("own")).alias("v")))
    )
    return tiled.withColumn("t", F.explode(units)).select(*keyed.columns, "t.u", "t.v")


def _runs(batches, width: int, unit: slice):
    """Columns of whole units, from batches in which the rows of a unit follow each other."""
    held: list[np.ndarray] = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns[:width]]
        if held:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        last = np.logical_and.reduce([c == c[-1] for c in cols[unit]])
        cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if cut:
            yield [c[:cut].copy() for c in cols]
        held = [c[cut:].copy() for c in cols]
    if held and len(held[0]):
        yield held


def _changes(cols: list[np.ndarray]) -> np.ndarray:
    """Which rows begin a unit."""
    first = np.ones(len(cols[0]), bool)
    first[1:] = ~np.logical_and.reduce([c[1:] == c[:-1] for c in cols])
    return first


def _compared(keyed: DataFrame, radius: int, tile: int) -> DataFrame:
    """Links among rows (fp, rep, part, key) of each (part, key)."""
    sizes = keyed.groupBy("part", "key").agg(F.count("*").alias("n")).where("n > 1")
    unit = ["part", "key", "u", "v"]
    rows = _units(keyed.join(sizes, ["part", "key"]), tile).select("fp", "rep", *unit)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(batches):
        for cols in _runs(batches, 6, slice(2, 6)):
            at, to = _local_links(cols[0].view(_U), np.cumsum(_changes(cols[2:6])), radius)
            yield A.batch(schema, cols[1][at], cols[1][to])

    return rows.repartition(*unit).sortWithinPartitions(*unit, "rep").mapInArrow(compare, "a long, b long").distinct()


_FACTORS = np.random.default_rng(128).integers(1, 1 << 62, SKETCH, dtype=np.int64).astype(_U) * _U(2) + _U(1)


def _sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the SHINGLE-word shingles of each row, ascending, and row offsets.

    A text with fewer words is one shingle; one without words has none.
    """
    data, off = A.utf8(column)
    starts, ends, tok = A.word_bounds(data, off)
    h = A.Hasher(A.LOWER[data]).ranges(starts, ends)
    n = np.diff(tok)
    size = np.minimum(n, SHINGLE)
    many = np.where(n > 0, n - size + 1, 0)
    first = np.cumsum(many) - many
    row = np.repeat(np.arange(len(n)), many)
    at = tok[row] + np.arange(int(many.sum())) - first[row]
    shingles = A.span_hash(*sequence_sums(h), at, at + size[row])
    order = np.lexsort((shingles, row))
    shingles, row = shingles[order], row[order]
    new = _changes([row, shingles]) if len(row) else np.zeros(0, bool)
    return shingles[new], np.append(0, np.cumsum(np.bincount(row[new], minlength=len(n))))


def _names(shingles: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A hash of each row's set; rows without shingles have none."""
    some = np.diff(off) > 0
    out = np.zeros(len(some), _U)
    if len(shingles):
        out[some] = A.mix(np.add.reduceat(A.mix(shingles ^ _FACTORS[0]), off[:-1][some]) + np.diff(off)[some].astype(_U))
    return out.view(np.int64)


def _sketches(shingles: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Minimum hashes (rows x SKETCH) of sets that are not empty."""
    out = np.zeros((len(off) - 1, SKETCH), _U)
    for k, f in enumerate(_FACTORS):
        if len(shingles):
            out[:, k] = np.minimum.reduceat(shingles * f, off[:-1])
    return out


def _alike(pairs: DataFrame, texts: DataFrame, similar: float, most: int = 2048) -> DataFrame:
    """The pairs (a, b) of set names whose sets have at least ``similar`` of their union in common.

    The texts (rep, text) of pairs meet at b, those of a frequent b in units of about ``most``.
    """
    many = pairs.groupBy("b").agg(F.ceil(F.count("*") / most).alias("salts"))
    dealt = pairs.join(many, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("salts")).alias("salt"))
    needs = dealt.select(F.col("a").alias("rep"), F.col("b").alias("unit"), "salt").unionByName(dealt.select(F.col("b").alias("rep"), F.col("b").alias("unit"), "salt").distinct())
    rows = needs.join(texts, "rep").repartition("unit", "salt").sortWithinPartitions("unit", "salt", F.col("rep") != F.col("unit")).select("rep", "unit", "text")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def check(batches):
        name, centre = None, np.empty(0, _U)
        for batch in A.pieces(batches):
            values, off = _sets(batch["text"])
            found = []
            for i, (rep, unit) in enumerate(zip(batch["rep"].to_pylist(), batch["unit"].to_pylist(), strict=True)):
                own = values[off[i] : off[i + 1]]
                if rep == unit:
                    name, centre = unit, own.copy()
                    continue
                if name != unit:
                    raise RuntimeError(f"set {unit} has no text")
                at = np.minimum(np.searchsorted(centre, own), len(centre) - 1)
                common = int((centre[at] == own).sum())
                if common >= similar * (len(own) + len(centre) - common) - 1e-9:
                    found.append((rep, unit))
            yield A.batch(schema, [x for x, _ in found], [x for _, x in found])

    return rows.mapInArrow(check, "a long, b long").distinct()


def _prefixes(sets: DataFrame, similar: float) -> DataFrame:
    """(key, rep, size, at): the rarest shingles of each set of ``sets`` (rep, shingles), in a common order.

    Two like sets share a shingle among the first ``size - ceil(similar * size) + 1`` of both, whatever
    the order.  With rare ones first, what a set has alone stands before all that it shares.
    """
    each = sets.select("rep", F.size("shingles").cast("long").alias("size"), F.explode("shingles").alias("key"))
    common = each.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    shared = each.join(common, "key")
    alone = F.col("size") - F.count("*").over(Window.partitionBy("rep"))
    at = alone + F.row_number().over(Window.partitionBy("rep").orderBy("df", "key")) - 1
    return shared.select("key", "rep", "size", at.alias("at")).where(F.col("at") <= F.col("size") - F.ceil(F.lit(similar) * F.col("size") - 1e-9))


def _proposed(prefixes: DataFrame, similar: float, tile: int) -> DataFrame:
    """Pairs (a, b) of sets with different roots whose prefixes meet early enough for ``similar``."""
    apart = prefixes.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key", "n")
    unit = ["part", "key", "u", "v"]
    rows = _units(prefixes.join(apart, "key").withColumn("part", F.lit(0)), tile).select("rep", *unit, "root", "size", "at")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def propose(batches):
        for cols in _runs(batches, 8, slice(1, 5)):
            cuts = np.append(np.flatnonzero(_changes(cols[1:5])), len(cols[0]))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                rep, root, size, at = (c[lo:hi] for c in (cols[0], cols[5], cols[6], cols[7]))
                left = size - at  # a common shingle here leaves at most so many to share
                for i in range(len(rep) - 1):
                    need = similar / (1 + similar) * (size[i] + size[i + 1 :]) - 1e-9
                    j = i + 1 + np.flatnonzero((root[i + 1 :] != root[i]) & (np.minimum(left[i], left[i + 1 :]) >= need))
                    if len(j):
                        yield A.batch(schema, np.minimum(rep[j], rep[i]), np.maximum(rep[j], rep[i]))

    return rows.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(propose, "a long, b long").distinct()


def similar_links(docs: DataFrame, similar: float = SIMILAR, tile: int = TILE) -> DataFrame:
    """(a, b) over doc_id: enough links between documents whose shingle sets are alike to connect all groups."""
    schema = pa.schema([("doc_id", pa.int64()), ("rep", pa.int64()), ("size", pa.int64()), ("bands", pa.list_(pa.int64()))])
    named = pa.schema([("rep", pa.int64()), ("text", pa.string())])
    sets = pa.schema([("rep", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def rows(batches):
        for b in A.pieces(batches):
            shingles, off = _sets(b["text"])
            some = np.diff(off) > 0
            name, off = _names(shingles, off)[some], np.append(0, off[1:][some])
            low = _sketches(shingles, off)
            keys = np.tile(np.arange(BANDS, dtype=_U), (len(low), 1))
            for i in range(BAND_ROWS):
                keys = A.mix(keys ^ low[:, i * BANDS : (i + 1) * BANDS])
            yield A.batch(schema, b["doc_id"].filter(pa.array(some)), name, np.diff(off), list(keys.view(np.int64)))

    def name_of(batches):
        for b in A.pieces(batches):
            yield A.batch(named, pa.array(_names(*_sets(b["text"])), pa.int64()), b["text"].cast(pa.string()))

    def shingles_of(batches):
        for b in A.pieces(batches):
            values, off = _sets(b["text"])
            yield A.batch(sets, b["rep"], pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values.view(np.int64))))

    docs = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    made = stored(docs.mapInArrow(rows, "doc_id long, rep long, size long, bands array<long>"))
    # Documents with the same set are one class; their links to its smallest id need no comparison.
    classes = stored(made.groupBy("rep").agg(F.min("doc_id").alias("least"), F.first("size").alias("size"), F.first("bands").alias("bands")))
    keyed = classes.select("rep", "size", F.explode("bands").alias("key"))
    shared = stored(keyed.join(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"))
    ids = shared.select("rep").distinct().join(classes.select("rep", F.col("least").alias("doc_id")), "rep").select("doc_id").distinct()
    texts = stored(docs.join(ids, "doc_id", "left_semi").mapInArrow(name_of, "rep long, text string").dropDuplicates(["rep"]))

    prefixes = stored(_prefixes(texts.mapInArrow(shingles_of, "rep long, shingles array<long>"), similar))
    # A set with too many shingles of its own has no prefix row, and no like set.
    shared = stored(shared.join(prefixes.groupBy("rep").agg(F.min("at").alias("alone")), "rep"))

    found, free = None, shared
    for turn in range(STARS):
        # Each class without a link is compared with the one of fewest own shingles in the largest bucket that it is in.
        central = F.struct(F.col("alone") / F.col("size"), F.xxhash64("rep"))
        centres = free.groupBy("key").agg(F.min_by(F.struct("rep", "size", "alone"), central).alias("c"), F.count("*").alias("many")).where("many > 1")
        met = free.join(centres, "key").where("rep <> c.rep").groupBy("rep", "size", "alone").agg(F.max_by("c", F.struct("many", "key")).alias("c"))
        enough = F.least(F.col("size") - F.col("alone"), F.col("c.size") - F.col("c.alone")) >= F.lit(similar / (1 + similar)) * (F.col("size") + F.col("c.size")) - 1e-9
        alike = stored(_alike(stored(met.where(enough).select(F.col("rep").alias("a"), F.col("c.rep").alias("b"))), texts, similar))
        found = alike if found is None else found.unionByName(alike)
        roots = stored(components(found).withColumnRenamed("node", "rep"))
        free = shared.join(roots, "rep", "left_anti")
    # Sets that are not together yet meet by their rarest shingles; only pairs that these do not rule out are compared.
    rooted = prefixes if found is None else prefixes.join(roots, "rep", "left")
    rooted = rooted.withColumn("root", F.col("rep") if found is None else F.coalesce("root", "rep"))
    rest = stored(_alike(stored(_proposed(rooted, similar, tile)), texts, similar))
    found = rest if found is None else found.unionByName(rest)
    of = classes.select("rep", "least")
    between = found.join(of.toDF("a", "x"), "a").join(of.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    own = made.select("doc_id", "rep").join(of, "rep").where("doc_id <> least").select(F.col("doc_id").alias("a"), F.col("least").alias("b"))
    return between.unionByName(own)


def cluster(docs: DataFrame, size: int = SIZE, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fingerprint (hexadecimal), component_id (smallest doc_id reachable)."""
    prints = checkpoint(fingerprints(docs, size))
    classes = checkpoint(prints.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = components(links(classes, radius)).select(F.col("node").alias("rep"), "root")
    of = classes.join(roots, "rep", "left").select("fp", F.coalesce("root", "rep").alias("root"))
    return prints.join(of, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("root")).alias("component_id"))


def one_of_each(docs: DataFrame, size: int = SIZE, radius: int = RADIUS, similar: float | None = SIMILAR) -> DataFrame:
    """The documents whose id is the smallest of their group, with all columns; rows with a null id stay.

    Groups join documents within ``radius`` bits and, unless ``similar`` is None, those with like shingle sets.
    """
    groups = cluster(docs, size, radius).where("component_id <> doc_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    if similar is not None:
        groups = groups.unionByName(similar_links(docs, similar))
        groups = components(groups).select(F.col("node").alias("a"), F.col("root").alias("b"))
    gone = groups.where("a <> b").select(F.col("a").alias("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
