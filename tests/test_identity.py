"""Identity by arrival against a walk through the mentions, in one part and in several; stored names made one."""

import random

import pytest

from tidewire.functions.entities import Lexicon
from tidewire.operators import identity as I

GIVEN = ("ada", "bo", "cy", "di")
LEX = Lexicon(given_names=GIVEN, furniture=("feed",), head_nouns=("bridge",), noise_words=("about",))
ROW = "id string, name string, kind string, key string"


def short(key):
    return len(key) >= 3 and " " not in key and key not in ("feed", "bridge", "about")


def walk(mentions, held):
    """One mention after the other, over a list of rows."""
    rows, log = [dict(r) for r in held], []
    by = lambda key: next((r for r in rows if r["key"] == key), None)
    for seq, id_, name, kind, key in mentions:
        first, _, last = (key or "").partition(" ")
        full = first in GIVEN and last and " " not in last
        if not key:
            log.append((seq, key, None, None))
            continue
        row, how = by(key), "exact"
        if row is None and full and short(last) and by(last):
            row, how = by(last), "takeover"
            row["key"] = key
        if row is None and short(key):
            of = [r for r in rows if r["key"] in {f"{g} {key}" for g in GIVEN}]
            if len(of) == 1:
                row, how = of[0], "fuller"
        if row is None:
            row, how = dict(id=id_, name=name, kind=kind, key=key), "new"
            rows.append(row)
        log.append((seq, key, how, row["id"]))
    return log, rows


def some(seed, n, words):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w = rng.choice(words)
        first = rng.choice((*GIVEN, "northern", "ada bo"))
        key = rng.choice([w, w, f"{first} {w}", f"{first} {w}" if rng.random() < 0.3 else w])
        key = rng.choice(["", None]) if rng.random() < 0.03 else key
        out.append((i, f"e{i:04d}", f"Name {i}", rng.choice(["person", "org"]), key))
    return out


def run(spark, mentions, held):
    m = spark.createDataFrame(mentions, "seq long, id string, name string, kind string, key string").selectExpr("*", "1 AS stretch", "2 AS _s")
    given = spark.createDataFrame([(g,) for g in (*GIVEN, GIVEN[0])], "given string")
    log, rows = I.arrivals(m, spark.createDataFrame([tuple(r.values()) for r in held], ROW), given, LEX)
    assert log.columns == ["seq", "key", "resolution", "entity"]
    return [tuple(r) for r in log.orderBy("seq").collect()], sorted((r.asDict() for r in rows.collect()), key=lambda r: r["key"])


@pytest.mark.parametrize("seed,words", [(1, ["pike"]), (2, ["pike", "olsen", "feed", "bridge", "ox", "about"]), (3, [f"name{i}" for i in range(40)])])
def test_arrivals_equal_the_walk_in_any_parts(spark, seed, words):
    mentions = some(seed, 240, words)
    log, rows = walk(mentions, [])
    rows.sort(key=lambda r: r["key"])
    assert run(spark, mentions, []) == (log, rows)
    assert {r[2] for r in log} >= {"exact", "new"}
    got, held = [], []
    for a, b in ((0, 7), (7, 60), (60, 240)):
        part, held = run(spark, mentions[a:b], held)
        got += part
    assert (got, held) == (log, rows)


def test_all_kinds_occur_and_hot_keys_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(I, "HOT", 2)
    mentions = some(5, 150, ["pike", "pike", "pike", "olsen"])
    log, rows = walk(mentions, [])
    assert {r[2] for r in log} == {"exact", "new", "takeover", "fuller", None}
    assert run(spark, mentions, [])[0] == log


def test_stored_short_name_beside_one_full_name_is_exact(spark):
    held = [dict(id="a", name="Pike", kind="person", key="pike"), dict(id="b", name="Ada Pike", kind="person", key="ada pike")]
    mentions = [(0, "x", "Pike", "person", "pike"), (1, "y", "Bo Pike", "person", "bo pike"), (2, "z", "Pike", "person", "pike")]
    log, rows = walk(mentions, held)
    assert [r[2:] for r in log] == [("exact", "a"), ("takeover", "a"), ("new", "z")]
    assert run(spark, mentions, held) == (log, sorted(rows, key=lambda r: r["key"]))


def test_no_mentions_and_nothing_stored(spark):
    assert run(spark, [], []) == ([], [])
    held = [dict(id="a", name="Pike", kind="person", key="pike")]
    assert run(spark, [], held) == ([], held)


def test_stored_names_become_one(spark):
    entities = [
        ("1", "Acme Corp", "org", "acme corp"), ("2", "ACME", "org", "acme"), ("3", "Acme Inc", "org", "acme"), ("4", "Ada Pike", "person", "ada pike"), ("5", "Pike", "person", "pike"),
        ("6", "Olsen", "person", "olsen"), ("7", "Bo Olsen", "person", "old"), ("8", "Ada Olsen", "person", "ada olsen"), ("9", "Bridge", "place", ""), ("10", None, None, None), ("11", "Feed", "org", "f"),
    ]
    links = [(1, "1"), (1, "2"), (1, "3"), (2, "5"), (2, "4"), (3, "6"), (4, "9"), (5, "99"), (6, None), (6, None)]
    given = spark.createDataFrame([(g,) for g in GIVEN], "given string")
    rows, to = I.reconcile_stored(spark.createDataFrame(entities, ROW).selectExpr("*", "1 AS to"), spark.createDataFrame(links, "article long, entity string"), given, LEX)
    # Of equal keys the one stored under it stays, and of those the longest name.
    assert sorted((r.id, r.key) for r in rows.collect()) == sorted([("3", "acme"), ("4", "ada pike"), ("7", "bo olsen"), ("8", "ada olsen"), ("9", "9"), ("10", "10"), ("11", "f")])
    # The short name joins the full name that is stored under its key, before one that is not.
    assert sorted((r.article, r.entity or "") for r in to.collect()) == [(1, "3"), (2, "4"), (3, "8"), (4, "9"), (5, "99"), (6, "")]


def test_reconciling_empty_tables(spark):
    rows, to = I.reconcile_stored(spark.createDataFrame([], ROW), spark.createDataFrame([], "article long, entity string"), spark.createDataFrame([], "given string"), LEX)
    assert rows.collect() == to.collect() == []
