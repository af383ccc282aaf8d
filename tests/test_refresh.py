"""Topics that fail keep their rows; the others change whole, in all tables, also after a crash."""

import tempfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidewire.operators import refresh as H


def rows(spark, of):
    return spark.createDataFrame([(t, v) for t, vs in of.items() for v in vs], "topic string, v long").selectExpr("*", "1 AS run")


def measure(bad=()):
    def f(df):
        v = F.when(F.col("topic").isin(*bad), F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("v")) if bad else F.col("v")
        return {"sums": df.groupBy("topic").agg(F.sum(v).alias("s")), "values": df.select("topic", "v").where("v > 0")}

    return f


def read(spark, folder, table):
    return sorted(tuple(r) for r in H.current(spark, folder, table, "topic").drop("run").collect())


def test_failing_topics_keep_both_tables(spark):
    folder = tempfile.mkdtemp()
    names = [f"t{i}" for i in range(12)]
    assert H.refresh(rows(spark, {n: [1, 2] for n in names}), "topic", measure(), folder).collect() == []
    errors = H.refresh(rows(spark, {n: [5] for n in names}), "topic", measure(("t3", "t7")), folder).collect()
    assert sorted(r.topic for r in errors) == ["t3", "t7"] and all("broken" in r.error for r in errors)
    kept = {"t3", "t7"}
    assert read(spark, folder, "sums") == sorted((n, 3 if n in kept else 5) for n in names)
    assert read(spark, folder, "values") == sorted((n, v) for n in names for v in ([1, 2] if n in kept else [5]))
    # The same again changes nothing, and runs that a topic still reads are not deleted.
    H.refresh(rows(spark, {n: [5] for n in names}), "topic", measure(("t3", "t7")), folder)
    assert H.prune_runs(spark, folder, "topic") == [1]
    assert read(spark, folder, "sums") == sorted((n, 3 if n in kept else 5) for n in names)


def test_a_topic_measured_without_rows_has_none(spark):
    folder = tempfile.mkdtemp()
    H.refresh(rows(spark, {"a": [1], "b": [2], None: [9]}), "topic", measure(), folder)
    H.refresh(rows(spark, {"a": [-1]}), "topic", measure(), folder)
    assert read(spark, folder, "values") == [("b", 2)]
    assert read(spark, folder, "sums") == [("a", -1), ("b", 2)]


def test_crash_between_tables_shows_neither(spark):
    folder = tempfile.mkdtemp()
    H.refresh(rows(spark, {"a": [1], "b": [2]}), "topic", measure(), folder)

    def dies(df):
        df.groupBy("topic").agg(F.sum("v").alias("s")).write.parquet(f"{folder}/run=1/share=0-0/sums")
        raise SystemExit("killed")

    with pytest.raises(SystemExit):
        H.refresh(rows(spark, {"a": [7], "b": [8]}), "topic", dies, folder)
    assert read(spark, folder, "sums") == [("a", 1), ("b", 2)]
    H.refresh(rows(spark, {"a": [7]}), "topic", measure(), folder)
    assert read(spark, folder, "sums") == [("a", 7), ("b", 2)]


def test_when_all_fail_it_is_not_the_topics(spark):
    folder = tempfile.mkdtemp()
    with pytest.raises(PySparkException):
        H.refresh(rows(spark, {n: [1] for n in "abcd"}), "topic", measure(tuple("abcd")), folder, most_failures=2)
    with pytest.raises(ValueError, match="no whole run"):
        H.current(spark, folder, "sums", "topic")


def test_read_through_measures_what_is_missing_once(spark):
    folder = tempfile.mkdtemp()
    asked = spark.createDataFrame([("a",), ("b",), ("a",), ("none",)], "topic string")
    H.refresh(rows(spark, {"a": [1]}), "topic", measure(), folder)
    for _ in range(2):
        got = H.read_through(rows(spark, {"a": [9], "b": [9], "c": [9]}), asked, "topic", measure(), folder, "sums")
        assert sorted((r.topic, r.s) for r in got.collect()) == [("a", 1), ("b", 9)]
    assert H._runs(spark, folder) == [0, 1]
