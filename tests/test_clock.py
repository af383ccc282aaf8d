"""Streams of articles over centuries: times that pandas cannot hold."""

import datetime as dt

from pyspark.sql import functions as F

from tidewire.streaming import assignment as A


def test_articles_of_centuries_are_assigned(spark, tmp_path):
    """Three million articles of 37 minutes end in 2235; the row that moves the clock past them is later by a slice, after the last time that pandas can hold."""
    first = dt.datetime(2024, 1, 1)
    rows = [("t", i, first + dt.timedelta(days=1950 * (i // 2), hours=i % 2), [1, i // 2], [i // 2]) for i in range(80)]
    df = spark.createDataFrame(rows, "topic string, article long, at timestamp, words array<long>, phrases array<long>")
    got = {r.article: r.story for r in A.replayed(df, str(tmp_path / "run")).collect()}
    assert got == {i: i // 2 * 2 for i in range(80)}
