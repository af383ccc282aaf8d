"""A backfill that is killed goes on where it was, and sends nothing twice that is stored."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tidewire.operators import backfill as B


def make(spark, n=60):
    return spark.range(n).select("id", F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))


def provider(log, dies_at=None, refuses=()):
    """Writes what it is sent below ``log``; ends the task at one text, as a lost service would, and refuses others."""

    def call(texts):
        for t in texts:
            if t in refuses:
                raise ValueError("refused")
        for t in texts:
            if t == dies_at:
                raise SystemExit("killed")
            with open(f"{log}/{t.replace(' ', '_')}", "a") as f:
                f.write("x")
        return [[float(len(t)), 1.0] for t in texts]

    return call


def sent(log):
    return {f.replace("_", " "): os.path.getsize(f"{log}/{f}") for f in os.listdir(log)}


def test_a_killed_run_goes_on(spark):
    folder, log = tempfile.mkdtemp(), tempfile.mkdtemp()
    items = make(spark)
    with pytest.raises(Exception):  # noqa: B017, PT011 - whatever the lost task gives
        B.resume(items, provider(log, dies_at="text 40"), 2, folder, pages=6)
    kept = {f"text {r.id}" for r in B.stored(spark, folder).collect()}
    assert 20 <= len(kept) < 60 and "text 40" not in kept
    before = sent(log)
    rows = {r.id: r.vector for r in B.resume(items, provider(log), 2, folder, pages=3).collect()}
    assert rows == {i: [float(len(f"text {i}")), 1.0] for i in range(60)}
    after = sent(log)
    assert all(after[t] == before[t] for t in kept)
    # A third call has nothing to send.
    B.resume(items, provider(log), 2, folder, pages=3)
    assert sent(log) == after


def test_refused_and_changed_rows_are_sent_again(spark):
    folder, log = tempfile.mkdtemp(), tempfile.mkdtemp()
    items = make(spark, 20)
    first = {r.id: r.vector for r in B.resume(items, provider(log, refuses=("text 3",)), 2, folder, pages=2).collect()}
    assert first[3] is None and all(first[i] is not None for i in range(20) if i != 3)
    before = sent(log)
    changed = items.withColumn("text", F.when(F.col("id") == 5, F.lit("another text")).otherwise(F.col("text"))).unionByName(spark.createDataFrame([(99, "late")], "id long, text string"))
    second = {r.id: r.vector for r in B.resume(changed, provider(log), 2, folder).collect()}
    assert second[3] is not None and second[5] == [12.0, 1.0] and second[99] == [4.0, 1.0]
    new = {t for t, n in sent(log).items() if n > before.get(t, 0)}
    assert new == {"text 3", "another text", "late"}


def test_without_rows(spark):
    folder = tempfile.mkdtemp()
    assert B.resume(make(spark, 0), provider("/nowhere"), 2, folder).count() == 0
    assert B.stored(spark, folder).count() == 0
