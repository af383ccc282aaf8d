"""Every query runs; those with an oracle give the same rows as DuckDB."""

import decimal
import math
import os

import duckdb
import pytest

from tidewire import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def text(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    if isinstance(v, decimal.Decimal) or isinstance(v, float):
        return repr(float(v))
    return str(v)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(name, spark, data, duck):
    assert os.path.isdir(data)
    df = plans.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = sorted(tuple(text(r[c]) for c in cols) for r in df.collect())
    if name not in plans.ORACLE:
        assert len(set(cols)) == len(cols)
        return
    result = duck.execute(plans.ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert got == sorted(tuple(text(r[i]) for i in order) for r in result.fetchall())


def test_pairs_of_users_over_999_are_resolved(spark):
    """At sf0.1 users go to 1499; the oracle has no range."""
    folder = "/root/testdata/sf0.1"
    got = {r.ord: r.state for r in plans.QUERIES["evl_01_resolve_pairs"](spark, folder).collect()}
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    assert got == dict(con.execute(f"SELECT ord, state FROM ({plans.ORACLE['evl_01_resolve_pairs']})").fetchall())


def test_backfill_sends_whole_texts(spark, data, monkeypatch):
    from pyspark.sql import functions as F

    from tidewire.plans import stories

    monkeypatch.setattr(stories.I, "backfill", lambda items, provider, width: items.withColumn("vector", F.array_repeat(F.lit(1.0), F.length("text"))))
    got = {r.id: r.width for r in plans.QUERIES["stm_10_backfill"](spark, data).collect() if r.id % 11}
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", F.length("text").alias("n")).collect()
    assert got == {r.doc_id: r.n for r in docs if r.doc_id % 11}
