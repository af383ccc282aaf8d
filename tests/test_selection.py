"""The newest rows and the undominated rows against plain versions, over many slices."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tidewire.operators import relational as R


def ranked(values, n):
    """What stays of values by competition rank, greatest first, null last."""
    place = lambda v: (v is None, -(float("inf") if v != v else v) if v is not None else 0)
    order = sorted(values, key=place)
    return [v for v in values if sum(place(o) < place(v) for o in order) < n]


@pytest.mark.parametrize("kind", ["long", "double", "decimal(20,2)", "float"])
def test_prune_keeps_ties_in_slices(spark, monkeypatch, kind):
    monkeypatch.setattr(R, "SLICES", 4)
    monkeypatch.setattr(R, "FEW_ROWS", 5)
    rng = random.Random(3)
    values = [rng.choice([None, rng.randint(-50, 50), rng.randint(0, 3), 10**9]) for _ in range(120)]
    df = spark.createDataFrame([(v,) for v in values], "v long").select(F.col("v").cast(kind).alias("v"))
    count = lambda vs: sorted((v is None, int(v or 0)) for v in vs)
    for n in (0, 1, 2, 7, 30, 60, 89, 95, 119, 120, 500):
        got = [r.v for r in R.prune(df, n, "v").collect()]
        assert count(got) == count(ranked(values, n)), n


def test_prune_of_times_days_and_odd_numbers(spark, monkeypatch):
    at = [datetime.datetime(2024, 1, 1) + datetime.timedelta(microseconds=i) for i in (0, 1, 1, 5)]
    df = spark.createDataFrame([(i, a, a.date()) for i, a in enumerate(at)], "id int, at timestamp, day date")
    assert sorted(r.id for r in R.prune(df, 2, "at").collect()) == [1, 2, 3]
    assert sorted(r.id for r in R.prune(df, 1, "day").collect()) == [0, 1, 2, 3]
    ntz = df.select("id", F.col("at").cast("timestamp_ntz").alias("at"))
    assert sorted(r.id for r in R.prune(ntz, 1, "at").collect()) == [3]
    big = spark.createDataFrame([(2**62 + i,) for i in range(40)], "v long")
    assert sorted(r.v - 2**62 for r in R.prune(big, 3, "v").collect()) == [37, 38, 39]
    odd = spark.createDataFrame([(float("nan"),), (1.7e308,), (-1.7e308,), (float("inf"),), (None,)], "v double")
    assert [len(R.prune(odd, n, "v").collect()) for n in range(7)] == [0, 1, 2, 3, 4, 5, 5]
    monkeypatch.setattr(R, "SLICES", 4)
    monkeypatch.setattr(R, "FEW_ROWS", 3)
    ends = spark.createDataFrame([(v,) for v in [float("inf")] * 2 + [float("-inf")] * 2 + [float(i) for i in range(9)]], "v double")
    assert [len(R.prune(ends, n, "v").collect()) for n in (1, 2, 3, 7, 11, 12, 13)] == [2, 2, 3, 7, 11, 13, 13]
    assert R.prune(odd.limit(0), 3, "v").collect() == []
    with pytest.raises(TypeError):
        R.prune(df.select(F.lit("x").alias("s")), 1, "s")


@pytest.mark.parametrize("slices", [1, 2, 5, 64])
def test_pareto_equals_comparing_all(spark, slices):
    rng = random.Random(slices)
    cells = [(i, rng.choice([None, round(rng.random(), 2)]) if i % 9 == 0 else round(rng.random(), 2), round(rng.random(), 2)) for i in range(200)] + [(900, 0.5, None), (901, float("nan"), 0.9)]
    cells += [(1000 + i, *c[1:]) for i, c in enumerate(cells[:60])]
    valid = [c for c in cells if None not in c and c[1] == c[1]]
    want = sorted(i for i, x, y in valid if not any(a >= x and b >= y and (a > x or b > y) for _, a, b in valid))
    got = R.pareto(spark.createDataFrame(cells, "id int, x double, y double"), "x", "y", slices)
    assert sorted(r.id for r in got.collect()) == want
    assert R.pareto(spark.createDataFrame([], "id int, x double, y double"), "x", "y", slices).collect() == []


def test_no_window_takes_all_rows(spark):
    cells = spark.range(100).selectExpr("id", "id / 100D AS x", "1 - id / 100D AS y")
    for df in (R.pareto(cells, "x", "y"), R.prune(cells, 5, "x")):
        assert "SinglePartition" not in df._jdf.queryExecution().executedPlan().toString()


def _plain_weights(signal, members, articles):
    out = {}
    for user, cluster, weight in signal:
        for c, story in members:
            for article, s in articles:
                if c == cluster and s == story and s is not None:
                    out[user, article] = out.get((user, article), 0) + weight
    return out


@pytest.mark.parametrize("tile", [2, 8192])
def test_article_weights_are_summed_before_users_meet_articles(spark, monkeypatch, tile):
    """Articles in several stories, twice in one and in none; no more rows are shuffled than come in."""
    from tidewire.operators import feedback as B

    monkeypatch.setattr(R, "_tiled", lambda df, keys, by, _, f=R._tiled: f(df, keys, by, tile))
    rng = random.Random(5)
    signal = [(u, c, rng.randint(-2, 3)) for u in range(9) for c in range(4) if rng.random() < 0.7]
    members = [(c, s) for c in range(4) for s in range(5) if rng.random() < 0.5]
    articles = [(a, rng.choice([0, 1, 2, 3, 4, None])) for a in range(30) for _ in range(rng.choice([1, 1, 1, 2, 3]))]
    frames = [spark.createDataFrame(rows, schema) for rows, schema in ((signal, "user_id long, cluster_id long, weight long"), (members, "cluster_id long, story_id long"), (articles, "article_id long, story_id long"))]
    df = B.article_weights(*frames)
    assert {(r.user_id, r.article_id): r.weight for r in df.collect()} == _plain_weights(signal, members, articles)
    # Users and articles meet last: nothing is grouped or dealt out above their join.
    top = df._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "Aggregate" not in top


@pytest.mark.parametrize("tile", [3, 8192])
def test_pairs_within_a_hot_key_are_dealt_out(spark, tile):
    rows = [(k, u) for k, n in (("hot", 40), ("one", 1), ("two", 2)) for u in range(n)] + [("hot", None), (None, 7)]
    df = spark.createDataFrame(rows, "k string, u long")
    got = R.pairs_within(df, ["k"], "u", tile)
    want = sorted((x, y) for k in ("hot", "one", "two") for a, x in rows if a == k and x is not None for b, y in rows if b == k and y is not None and x < y)
    assert sorted((r.left, r.right) for r in got.collect()) == want
