"""The maintained index against a search of all texts, after inserts, updates, deletes, replays and compaction."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidewire.operators.search_index import Index

ITEMS = "kind string, item_id string, topic_id long, title string, body string, source_ids array<long>, entity_ids array<long>"
CHANGES = f"{ITEMS}, deleted boolean, seq long"
WORDS = "tesla Tes the of and naïve Élan 東京 x_1 42 don't".split()


def batches(seed, n=4, size=40):
    r = random.Random(seed)
    out, seq = [], 0
    for _ in range(n):
        rows = []
        for _ in range(size):
            seq += 1
            text = lambda k: " ".join(r.choices(WORDS, k=r.randrange(k))) if r.random() < 0.9 else None
            key = (r.choice(["text", "snapshot"]), str(r.randrange(30)), r.randrange(3))
            rows.append((*key, text(3), text(12), r.sample(range(5), r.randrange(3)), r.choice([None, [7], [7, 8]]), r.random() < 0.2, seq))
        out.append(rows)
    return out


def live(done):
    held = {}
    for rows in done:
        for row in sorted(rows, key=lambda r: r[-1]):
            held.pop(row[:3], None)
            if not row[-2]:
                held[row[:3]] = row
    return held


def plain(done, terms):
    found = {}
    for key, row in live(done).items():
        own = set(re.findall(r"\w+", f"{row[3] or ''} {row[4] or ''}".lower()))
        if {t.lower() for t in terms} <= own:
            found[key] = row
    return found


def plain_facets(found):
    out = {}
    for row in found.values():
        for facet, values in (("topic", [row[2]]), ("source", row[5]), ("entity", row[6] or [])):
            for v in values:
                out[facet, str(v)] = out.get((facet, str(v)), 0) + 1
    return out


SEARCHES = [["the"], ["Tes"], ["the", "AND", "the"], ["tesla", "of", "東京"], ["ÉLAN"], ["missing"], ["don", "t"], []]


def check(index, done, searches=SEARCHES):
    for terms in searches:
        want = plain(done, terms)
        rows = index.search(terms).collect()
        got = {(r.kind, r.item_id, r.topic_id): (r.title, r.body) for r in rows}
        assert len(rows) == len(got) and got == {k: (v[3], v[4]) for k, v in want.items()}
        assert {(r.facet, r.value): r.n for r in index.facets(index.hits(terms)).collect()} == plain_facets(want)


@pytest.fixture
def index(spark, tmp_path):
    return Index(spark, str(tmp_path / "index"), spark.createDataFrame([], ITEMS).schema)


def test_index_follows_changes_replays_and_compaction(spark, index):
    done = batches(1)
    frame = lambda rows: spark.createDataFrame(rows, CHANGES)
    assert index.search(["the"]).count() == 0
    for i in (0, 1):
        index.apply(frame(done[i]), i)
    index.apply(frame(done[1]), 1)  # run again after a failure
    check(index, done[:2], SEARCHES[2:4])
    index.compact(1)
    check(index, done[:2], SEARCHES[:1])
    index.apply(frame(done[1]), 1)  # merged by now
    index.apply(frame(done[2]), 2)
    check(index, done[:3], SEARCHES[2:3])
    index.compact(2)
    index.apply(frame(done[3]), 3)
    check(index, done)


def test_index_over_a_stream(spark, index, tmp_path):
    done = batches(2, n=3, size=15)
    for i, rows in enumerate(done):
        spark.createDataFrame(rows, CHANGES).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(CHANGES).option("recursiveFileLookup", "true").option("pathGlobFilter", "part*").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stream.writeStream.foreachBatch(index.apply).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    want, got = plain(done, ["the"]), index.search(["the"]).collect()
    assert {(r.kind, r.item_id, r.topic_id) for r in got} == set(want) and len(got) == len(want)


def test_a_search_reads_the_folders_of_its_terms(spark, index):
    index.apply(spark.createDataFrame(batches(3)[0], CHANGES), 0)
    scan = next(line for line in index.hits(["tesla"])._jdf.queryExecution().executedPlan().toString().splitlines() if "offsets" in line and "FileScan" in line)
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ = \d+", scan) and "PushedFilters: [IsNotNull(term), EqualTo(term,tesla)]" in scan


def test_numbers_of_many_chunks_do_not_meet(spark, index):
    rows = spark.range(0, 100_000, 1, 2).select(F.lit("text").alias("kind"), F.col("id").cast("string").alias("item_id"), (F.col("id") % 3).alias("topic_id"), F.when(F.col("id") % 1000 == 0, "rare common").otherwise("common").alias("title"), F.lit("").alias("body"), F.array("id").alias("source_ids"), F.array().cast("array<long>").alias("entity_ids"), F.lit(False).alias("deleted"), F.col("id").alias("seq"))
    index.apply(rows, 0)
    assert index.search(["common"]).count() == 100_000
    assert sorted(int(r.item_id) for r in index.search(["rare", "common"]).collect()) == list(range(0, 100_000, 1000))


def test_postings_are_gathered_before_they_are_shuffled(spark, monkeypatch):
    """2000 items of one batch that share three words are three rows, and what is written is shuffled once, without a pass to sample it."""
    from tidewire.operators import search_index

    items = spark.range(2000).coalesce(1).select(F.lit(5).cast("long").alias("chunk"), F.col("id").cast("int").alias("offset"), F.lit("The end, the END of").alias("title"), F.lit("").alias("body"))
    rows = search_index._postings(items).collect()
    assert sorted((r.term, r.chunk, len(r.offsets), r.offsets == sorted(r.offsets)) for r in rows) == [(w, 5, 2000, True) for w in ("end", "of", "the")]


def test_an_index_without_batches_reads_nothing(index):
    assert index._table("postings").schema.simpleString() == "struct<term:string,chunk:bigint,offsets:array<int>,bucket:int>"
    assert index._table("postings")._jdf.queryExecution().optimizedPlan().toString().startswith("LocalRelation <empty>")
