"""Joins, folds and writes that queries share.

Each takes and returns DataFrames.  Small sides are broadcast only when asked
for by the caller with :func:`small`, which checks their size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint

SMALL_ROWS = 100_000
#: Slices of a range that are counted at once, and rows few enough to be counted by value.
SLICES = 1024
FEW_ROWS = 10_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def all_of(terms: Sequence[Column | None]) -> Column:
    """Conjunction; an absent term does not narrow."""
    out = F.lit(True)
    for term in terms:
        if term is not None:
            out = out & term
    return out


def latest(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def page(df: DataFrame, offset: int, size: int, *order: Column) -> DataFrame:
    """Rows ``offset`` to ``offset + size`` with the total beside each; the total is a one-row join, not a window over everything."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(size).join(F.broadcast(total))


def insert_ignore(target: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``target``, and of ``new`` those whose key is not there yet (first of repeated keys by row content)."""
    once = latest(new, keys, *[F.col(c) for c in new.columns])
    return target.unionByName(once.join(target.select(*keys), list(keys), "left_anti").select(*target.columns))


def upsert(target: DataFrame, new: DataFrame, keys: Sequence[str], kept: Sequence[str] = ()) -> DataFrame:
    """``new`` over ``target`` by key; columns in ``kept`` stay from the old row if there is one."""
    old = target.select(*keys, *[F.col(c).alias(f"_{c}") for c in kept], F.lit(True).alias("_held"))
    put = new.join(old, list(keys), "left")
    put = put.select(*[F.when(F.col("_held"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in kept else F.col(c) for c in target.columns])
    return target.join(new.select(*keys).distinct(), list(keys), "left_anti").select(*target.columns).unionByName(put)


def _key(df: DataFrame, by: str) -> tuple[Column, Callable[[object], Column]]:
    """A number that orders a column, and the way back from it."""
    kind = df.schema[by].dataType.typeName()
    if kind == "timestamp":
        return F.unix_micros(by), lambda v: F.timestamp_micros(F.lit(v))
    if kind == "timestamp_ntz":
        return F.unix_micros(F.col(by).cast("timestamp")), lambda v: F.timestamp_micros(F.lit(v)).cast("timestamp_ntz")
    if kind == "date":
        return F.unix_date(by), lambda v: F.date_from_unix_date(F.lit(v))
    if kind in ("string", "binary", "struct", "array", "map", "boolean"):
        raise TypeError(f"{by} is neither a number nor a time")
    return F.col(by), F.lit


def nth_largest(df: DataFrame, by: str, n: int) -> object | None:
    """The ``n``-th largest of a column's numbers (times as microseconds, dates as days), ties counted singly; None if there are fewer. Null and NaN are no numbers.

    Counts in ``SLICES`` equal slices of the range of values come to the driver; the slice with the ``n``-th is sliced again,
    between its own least and greatest value, until few rows are left, whose values are counted one by one.  No
    step sorts all rows or gathers them.
    """
    key, _ = _key(df, by)
    keys = df.select(key.alias("k")).where(F.col("k").isNotNull() & ~F.isnan(F.col("k").cast("double")))
    low, high, rows = keys.agg(F.min("k"), F.max("k"), F.count("*")).first()
    if n < 1 or rows < n:
        return None
    if math.inf in (high, -low):
        # Infinite values have no place in a range.
        most, least = keys.agg(F.count_if(F.col("k") == math.inf), F.count_if(F.col("k") == -math.inf)).first()
        if n <= most or n > rows - least:
            return math.inf if n <= most else -math.inf
        n, rows, keys = n - most, rows - most - least, keys.where((F.col("k") < math.inf) & (F.col("k") > -math.inf))
        low, high = keys.agg(F.min("k"), F.max("k")).first()
    while rows > FEW_ROWS and low < high and float(low) < float(high):
        inside = keys.where((F.col("k") >= F.lit(low)) & (F.col("k") <= F.lit(high)))
        # Halves keep the span of doubles finite.
        span = float(high) / 2 - float(low) / 2
        at = F.least(F.floor((F.col("k").cast("double") / 2 - F.lit(float(low) / 2)) / F.lit(span) * SLICES), F.lit(SLICES - 1))
        slices = inside.groupBy(at.alias("at")).agg(F.min("k").alias("a"), F.max("k").alias("b"), F.count("*").alias("n")).collect() if span > 0 else []
        if len(slices) < 2:
            break
        for s in sorted(slices, key=lambda s: -s["at"]):
            if s["n"] >= n:
                low, high, rows = s["a"], s["b"], s["n"]
                break
            n -= s["n"]
    values = keys.where((F.col("k") >= F.lit(low)) & (F.col("k") <= F.lit(high))).groupBy("k").agg(F.count("*").alias("n"))
    for r in values.orderBy(F.desc("k")).limit(min(n, FEW_ROWS)).collect():
        n -= r["n"]
        if n <= 0:
            return r["k"]
    raise ValueError(f"more than {FEW_ROWS} values of {by} are one as double")


def prune(df: DataFrame, newest: int, by: str) -> DataFrame:
    """The ``newest`` rows by a time or number; ties with the last of them stay.  Rows without one are the oldest, NaN is the newest.

    Two or a few counts come first, see :func:`nth_largest`; then the rows are filtered by a literal, which reaches the scan.
    """
    if newest < 1:
        return df.limit(0)
    nan = df.where(F.isnan(by)).count() if df.schema[by].dataType.typeName() in ("double", "float") else 0
    if nan >= newest:
        return df.where(F.isnan(by))
    bound = nth_largest(df, by, newest - nan)
    return df if bound is None else df.where(F.col(by) >= _key(df, by)[1](bound))


def pareto(cells: DataFrame, x: str, y: str, slices: int = 64) -> DataFrame:
    """Rows that no other row dominates in the numbers ``x`` and ``y``; of equal rows all stay, rows with a null or NaN go.

    By falling x, y must beat all before: within slices of x by a running maximum, over slices by their maxima,
    of which ``slices`` come to the driver.  No pairs are compared and no task sees all rows.
    """
    number = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    best = checkpoint(cells.where(number(x) & number(y)).groupBy(x).agg(F.max(y).alias("_y")))
    cuts = sorted(set(best.select(F.col(x).cast("double").alias("x")).approxQuantile("x", [i / slices for i in range(1, slices)], 0.25 / slices))) if slices > 1 else []
    at = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(x).cast("double"))) if cuts else F.lit(0)
    best = best.withColumn("_at", at)
    above: list[tuple] = []
    top = None
    for r in sorted(best.groupBy("_at").agg(F.max("_y").alias("top")).collect(), key=lambda r: -r["_at"]):
        above.append((r["_at"], top))
        top = r["top"] if top is None else max(top, r["top"])
    tops = cells.sparkSession.createDataFrame(above, f"_at int, _over {best.schema['_y'].dataType.simpleString()}")
    before = F.max("_y").over(Window.partitionBy("_at").orderBy(F.desc(x)).rowsBetween(Window.unboundedPreceding, -1))
    front = best.join(F.broadcast(tops), "_at").withColumn("_above", F.greatest(before, "_over")).where("_above IS NULL OR _y > _above").select(x, "_y")
    return cells.join(front, x).where(F.col(y) == F.col("_y")).select(*cells.columns)


#: Rows of one side of a key that meet those of the other in one unit of a join.
TILE = 4096


def _tiled(df: DataFrame, keys: Sequence[str], by: str, tile: int) -> DataFrame:
    """``df`` with the tile of its key that each row is dealt to by hash (``own``) and how many the key has (``tiles``)."""
    tiles = df.groupBy(*keys).agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    return df.join(tiles, list(keys)).withColumn("own", F.pmod(F.xxhash64(by), "tiles").cast("int"))


def _dealt(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Units in as many tasks as a shuffle has: their rows are few, so that by size Spark would gather them in one, but what they give is not."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "u", "v")


def meeting(left: DataFrame, right: DataFrame, keys: Sequence[str], left_by: str, right_by: str, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """Both sides with tiles ``u`` and ``v``, by which and ``keys`` they join as by ``keys``, in units of at most some ``tile`` rows a side.

    A hot key's join is then dealt over tasks; a row is sent once for every ``tile`` rows of its key on the other side.
    """
    a, b = _tiled(left, keys, left_by, tile), _tiled(right, keys, right_by, tile)
    count = lambda df, name: df.select(*keys, F.col("tiles").alias(name)).distinct()
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sent = a.join(count(b, "others"), list(keys)).select(*left.columns, F.col("own").alias("u"), every("others").alias("v"))
    met = b.join(count(a, "others"), list(keys)).select(*right.columns, every("others").alias("u"), F.col("own").alias("v"))
    return _dealt(sent, keys), _dealt(met, keys)


def pairs_within(df: DataFrame, keys: Sequence[str], by: str, tile: int = TILE) -> DataFrame:
    """(left, right) of the unordered pairs of different ``by`` of a key, left the smaller; ``by`` is unique within a key.

    Each pair of tiles of a key is one unit of the join, so no task walks a whole hot key.
    """
    dealt = _tiled(df.where(F.col(by).isNotNull()), keys, by, tile)
    above = F.explode(F.sequence(F.col("own"), F.col("tiles") - 1))
    a = dealt.select(*keys, F.col(by).alias("a"), F.col("own").alias("u"), above.alias("v"))
    b = dealt.select(*keys, F.col(by).alias("b"), F.explode(F.sequence(F.lit(0), F.col("own"))).alias("u"), F.col("own").alias("v"))
    met = _dealt(a, keys).join(_dealt(b, keys), [*keys, "u", "v"]).where((F.col("u") < F.col("v")) | (F.col("a") < F.col("b")))
    return met.select(F.least("a", "b").alias("left"), F.greatest("a", "b").alias("right"))


def contained(lists: DataFrame, column: str, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``lists`` with the rows of ``ids`` whose key their list column holds, as an equi-join."""
    return lists.withColumn(key, F.explode(F.array_distinct(column))).join(ids, key)
