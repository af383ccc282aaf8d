"""Boundary cases of the scalar functions and operators."""

import datetime as dt
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewire.functions import dates as D
from tidewire.functions import entities as E
from tidewire.functions import numbers as N
from tidewire.functions import similarity as S
from tidewire.functions import text as T
from tidewire.operators import archive as A
from tidewire.operators import evaluation as V
from tidewire.operators import feedback as B
from tidewire.operators import grouping as G
from tidewire.operators.components import components
from tidewire.operators import relational as R
from tidewire.sources import feeds
from tidewire.streaming import ingest as I


def one(spark, expr, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]) if cols else spark.range(1)
    return df.select(expr.alias("x")).first().x


def at(spark, text, zone="UTC"):
    return F.lit(text).cast("timestamp")


@pytest.mark.parametrize(
    "given,wanted",
    [
        ("Body text. https://a.example/x rest", "Body text. rest"),
        ("By Jane Doe, Staff Writer\nThe city voted.", "The city voted."),
        ("The city voted. Continue reading...", "The city voted."),
        ("Points: 6 Comments: 0 A launch", "A launch"),
        ("Rain fell. The post Rain fell first appeared on Some Site.", "Rain fell."),
        ("Caption: A dog. It barked", "It barked"),
        ("one two　three", "one two three"),
        ("", ""),
    ],
)
def test_strip_feed_metadata(spark, given, wanted):
    assert one(spark, T.strip_feed_metadata(F.lit(given))) == wanted


def test_article_text(spark):
    assert one(spark, T.article_text(F.lit(" Head "), F.lit(""))) == "Head"
    assert one(spark, T.article_text(F.lit(""), F.lit("body"))) == "body"
    assert one(spark, T.article_text(F.lit("Head"), F.lit("body"))) == "Head\nbody"


def test_lengths_count_utf16_units(spark):
    assert one(spark, T.units(F.lit("😀a"))) == 3


def test_excerpt_cuts_at_words(spark):
    long = "word " * 60
    got = one(spark, T.excerpt(F.lit(long)))
    assert got == ("word " * 43 + "word").strip() + "…" and len(got) <= 221
    assert one(spark, T.excerpt(F.lit("x" * 300))) == "x" * 220 + "…"


def test_signature(spark):
    s = one(spark, T.signature(F.lit("The Cat sat on mats. The cat ran!\nSat")))
    assert s.words == ["cat", "mats", "ran", "sat"]
    assert s.phrases == ["cat ran", "cat sat", "cat sat mats", "sat mats"]
    empty = one(spark, T.signature(F.lit("")))
    assert empty.words == [] and empty.phrases == []


def test_search_words(spark):
    assert one(spark, T.search_words(F.lit("a b-c, d e f g h i j"))) == list("abcdefgh")
    assert one(spark, T.dropped_words(F.lit("a b-c, d e f g h i j"))) is True
    assert one(spark, T.fts_match(F.lit("?!"))) is None


def test_safe_urls(spark):
    assert one(spark, T.safe_external_url(F.lit("HTTPS://Example.COM"))) == "https://example.com/"
    assert one(spark, T.safe_external_url(F.lit("javascript:alert(1)"))) is None


@pytest.mark.parametrize(
    "zone,wall,utc",
    [("America/New_York", (2026, 3, 8, 2, 30), "2026-03-08 07:30:00"), ("America/New_York", (2026, 11, 1, 1, 30), "2026-11-01 05:30:00"), ("Asia/Kolkata", (2026, 1, 1, 0, 0), "2025-12-31 18:30:00")],
)
def test_local_readings(spark, zone, wall, utc):
    y, m, d, h, mi = wall
    got = D.to_instant(F.lit(dt.date(y, m, d)), F.lit(h), F.lit(mi), F.lit(zone))
    assert one(spark, F.date_format(got, "yyyy-MM-dd HH:mm:ss")) == utc


def slot(spark, now, hour, minute, zone, cadence="daily", weekday="saturday", recorded="2020-01-01", compat=False):
    x = D.due_cadence_slot(at(spark, now), at(spark, recorded), F.lit(hour), F.lit(minute), F.lit(zone), F.lit(cadence), F.lit(weekday), compat)
    return one(spark, F.date_format(x, "yyyy-MM-dd HH:mm"))


def test_slots(spark):
    assert slot(spark, "2026-09-01 19:30:00", 7, 0, "Pacific/Auckland") == "2026-09-01 19:00"
    assert slot(spark, "2026-09-02 09:00:00", 23, 0, "Europe/London") == "2026-09-01 22:00"
    assert slot(spark, "2026-09-04 12:00:00", 8, 0, "UTC", "weekly") == "2026-08-29 08:00"
    assert slot(spark, "2026-09-05 07:00:00", 8, 0, "UTC", "weekly") == "2026-08-29 08:00"
    assert slot(spark, "2026-09-05 07:00:00", 8, 0, "UTC", "weekly", compat=True) == "2026-09-04 08:00"
    assert slot(spark, "2026-09-05 09:00:00", 8, 0, "UTC", "never") is None
    assert slot(spark, "2026-09-05 09:00:00", 8, 0, "UTC", recorded="2026-09-05 08:30:00") is None


def test_iso_days(spark):
    assert one(spark, D.iso_day(F.lit("2024-02-30"))) is None
    assert one(spark, F.date_format(D.iso_day(F.lit("2024-02-29"), "end"), "HH:mm:ss.SSS")) == "23:59:59.999"


def test_clamp_window(spark):
    got = [one(spark, D.clamp_window(F.lit(v))) for v in (0.0, 7.4, 99.0, float("nan"), float("inf"))]
    assert got == [1, 7, 30, 7, 7]


def test_lift(spark):
    f = lambda a, b: one(spark, N.lift(F.lit(a), 7, F.lit(b), 30))
    assert f(3, 0) == 999.0 and f(0, 0) == 0.0 and f(7, 30) == 1.0


def test_backoff(spark):
    assert [one(spark, D.backoff(F.lit(n), 1000, 50_000)) for n in (0, 1, 2, 7, 9)] == [1000, 1000, 2000, 50_000, 50_000]


def test_axis(spark):
    assert one(spark, N.axis_ticks(F.lit(10.0))) == [0, 5, 10]
    assert one(spark, N.nice_step(F.lit(0.0))) == 1.0


def test_cosine_is_null_for_what_cannot_be_compared(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0], [1.0, 2.0]), ([], []), (None, [1.0]), ([1.0, float("nan")], [1.0, 1.0]), ([1.0, 1.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = [r.x for r in df.select(S.cosine(F.col("a"), F.col("b")).alias("x")).collect()]
    assert got[:5] == [None] * 5 and abs(got[5] - 1) < 1e-9


def test_gate_with_missing_semantic(spark):
    none = F.lit(None).cast("double")
    assert one(spark, S.clears_gate(F.lit(0.5), none)) is True
    assert one(spark, S.clears_gate(F.lit(0.01), none, gate="either")) is False


def test_vector_codec(spark):
    df = spark.createDataFrame([([0.5, 1.0],), (None,)], "v array<float>")
    assert [r.x for r in df.select(N.decode_vector(N.encode_vector(F.col("v"))).alias("x")).collect()] == [[0.5, 1.0], None]
    bad = spark.createDataFrame([("f32le:1:AA==",), ("x",), ("f32le:1:AADAfw==",)], "t string")
    assert [r.x for r in bad.select(N.decode_vector(F.col("t")).alias("x")).collect()] == [None] * 3


def test_feed_entries(spark):
    xml = """<rss><channel><item><title>A &amp;amp; B</title><link>http://x.example/1</link><guid>g1</guid><pubDate>Mon, 01 Jan 2024 10:00:00 +0100</pubDate>
<description>short</description><content:encoded><![CDATA[<p>a longer body&#8217;s text</p>]]></content:encoded></item></channel></rss>
<feed><entry><title>Atom</title><link rel="self" href="http://x.example/self"/><link href="http://x.example/2" rel="alternate"/><id></id><updated>nonsense</updated></entry></feed>"""
    a, b = feeds.entries(spark.createDataFrame([("s", xml)], "source_id string, xml string")).orderBy("position").collect()
    assert (a.external_id, a.title, a.body, a.url) == ("g1", "A &amp; B", "a longer body’s text", "http://x.example/1")
    assert (b.external_id, b.url, b.title) == ("http://x.example/2", "http://x.example/2", "Atom")
    assert one(spark, F.unix_millis(feeds.published_at(F.lit("<updated>nonsense</updated>")))) == 0
    assert one(spark, F.unix_millis(feeds.published_at(F.lit("<pubDate>Mon, 01 Jan 2024 10:00:00 +0100</pubDate>")))) == 1704099600000


def test_entities(spark):
    text = "The minister met Jane Doe from Acme Corp in London. Jane Doe spoke. Later, rain fell."
    got = {r.key: r for r in E.extract(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()}
    assert got["jane doe"].kind == "person" and got["jane doe"].mentions == 2
    assert got["london"].kind == "place"
    assert "later" not in got


def test_identity(spark):
    keys = spark.createDataFrame([("doe",), ("jane doe",), ("roe",), ("jane roe",), ("john roe",)], "key string")
    given = spark.createDataFrame([("jane",), ("john",)], "given string")
    got = dict(E.resolve(keys, given).collect())
    assert got["doe"] == "jane doe" and got["roe"] == "roe"
    assert one(spark, E.canonical_key(F.lit("The Acme's Corp."))) == "acme"


def test_upsert_keeps_columns(spark):
    old = spark.createDataFrame([(1, 10, "a"), (2, 20, "b")], "id long, created long, v string")
    new = spark.createDataFrame([(2, 99, "c"), (3, 30, "d")], "id long, created long, v string")
    assert sorted(map(tuple, R.upsert(old, new, ["id"], ["created"]).collect())) == [(1, 10, "a"), (2, 20, "c"), (3, 30, "d")]


def test_prune_keeps_ties(spark):
    df = spark.createDataFrame([(1, 5), (2, 4), (3, 4), (4, 3)], "id long, at long")
    assert sorted(r.id for r in R.prune(df, 2, "at").collect()) == [1, 2, 3]


def test_older_hide_is_not_blocked(spark):
    rows = [(2, 1, 7, "hide_source", "this_topic", 5, None, 20), (1, 1, 7, "hide_source", "global", 5, 1, 10)]
    df = spark.createDataFrame(rows, "seq long, user_id long, cluster_id long, feedback_type string, scope string, source_id long, topic_id long, ts long")
    assert [tuple(r) for r in B.hidden_sources(df).collect()] == [(1, 5, "global", None)]


def test_chain_is_no_cluster():
    assert len(set(G.link([1, 2, 3], [(1, 2, 0.9), (2, 3, 0.8)]).values())) == 2
    assert len(set(G.link([1, 2, 3], [(1, 2, 0.9), (2, 3, 0.8), (1, 3, 0.1)]).values())) == 1


def test_clusters_do_not_depend_on_row_order(spark):
    texts = ["alpha beta gamma delta", "alpha beta gamma epsilon", "zeta eta theta", "alpha beta gamma delta epsilon", ""]
    df = spark.createDataFrame([("t", i, i, x) for i, x in enumerate(texts)], "topic string, story long, place long, text string")
    s = df.select("topic", "story", F.timestamp_seconds("place").alias("place"), T.signature(F.col("text")).alias("s")).select("topic", "story", "place", "s.*")
    a = {r.story: r.cluster for r in G.clusters(s, G.scored(s)).collect()}
    b = {r.story: r.cluster for r in G.clusters(s.orderBy(F.desc("story")), G.scored(s)).collect()}
    assert a == b and a[4] == 4 and a[2] == 2 and a[0] == a[1]


def test_rounds_of_mutual_best_pairs_equal_the_greedy_order(spark):
    import random

    rng = random.Random(11)
    t0 = dt.datetime(2024, 1, 1)
    stories, edges, want = [], [], {}
    for topic, n, share in (("dense", 12, 0.8), ("half", 12, 0.5), ("chain", 6, 0)):
        places = [rng.choice([None, *range(n // 2)]) for _ in range(n)]
        stories += [(topic, i, None if p is None else t0 + dt.timedelta(hours=p)) for i, p in enumerate(places)]
        own = [(i, j, rng.choice([0.1, 0.2, 0.3, 0.9])) for i in range(n) for j in range(i + 1, n) if rng.random() < share]
        own = own or [(i, i + 1, 1 - i / 100) for i in range(n - 1)]
        edges += [(topic, *e) for e in own]
        order = sorted(range(n), key=lambda i: (places[i] is None, places[i] or 0, i))
        want |= {(topic, k): v for k, v in G.link(order, own).items()}
    s = spark.createDataFrame(stories, "topic string, story long, place timestamp")
    e = spark.createDataFrame(edges, "topic string, left long, right long, signature double")
    for fold in (0, 40):
        assert {(r.topic, r.story): r.cluster for r in G.clusters(s, e, fold).collect()} == want
    assert G.clusters(s.limit(0), e.limit(0)).count() == 0


def test_blocks_do_not_depend_on_the_tile(spark):
    import random

    rng = random.Random(5)
    rows = [(f"t{i % 2}", i, rng.sample("abcdefghij", rng.randrange(6)), rng.sample("klmnopqrst", rng.randrange(6))) for i in range(40)]
    s = spark.createDataFrame(rows, "topic string, story long, words array<string>, phrases array<string>")
    seen = [sorted(tuple(r) for r in G.scored(s, 0.15, tile).collect()) for tile in (3, 512)]
    assert seen[0] == seen[1] and seen[0]
    met = [sorted(tuple(r) for r in G.walked(s, 0.15, tile).collect()) for tile in (3, 512)]
    assert met[0] == met[1] and sum(n for _, n in met[0]) >= len(seen[0])


def test_components_of_a_hub(spark):
    edges = [(0, i) for i in range(1, 300)] + [(i, i + 1) for i in range(400, 430)] + [(430, 7), (500, 500), (None, 3), (7, 0)]
    for salts in (1, 7):
        got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), salts=salts).collect()}
        assert got == {i: 0 for i in [*range(300), *range(400, 431)]} | {500: 500}


def test_candidates_lose_no_pair(spark):
    import random

    rng = random.Random(3)
    rows = [("t", i, sorted({f"w{int(rng.paretovariate(1)) % 40}" for _ in range(8)}), []) for i in range(60)]
    s = spark.createDataFrame(rows, "topic string, story long, words array<string>, phrases array<string>")
    got = {(r.left, r.right) for r in G.scored(s, 0.2).collect()}
    j = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    want = {(a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and 0.6 * j(a[2], b[2]) >= 0.2}
    assert got == want


def test_search_total_is_gone_past_the_last_page(spark):
    cols = "kind string, item_id string, topic_id long, title string, body string, created_at timestamp, source_ids array<long>, entity_ids array<long>"
    t0 = dt.datetime(2024, 1, 1)
    items = spark.createDataFrame([("text", str(i), 1, "Tesla news" if i else "tes", "", t0 + dt.timedelta(days=i), [i], []) for i in range(3)], cols)
    topics = spark.createDataFrame([(1,)], "topic_id long")
    assert [r.total for r in A.search(items, topics, terms=["tesla"]).collect()] == [2, 2]
    assert A.search(items, topics, terms=["tes"]).count() == 1
    assert A.search(items, topics, offset=50).count() == 0


def test_sweep_and_pairs(spark):
    scores = spark.createDataFrame([(True, 0.5, None), (True, 0.1, 0.9), (False, 0.6, 0.2)], "same_event boolean, signature double, semantic double")
    got = {(r.signature_floor, r.semantic_floor): (r.recall, r.precision_) for r in V.sweep(scores, (0.05, 0.9), (0.5,)).collect()}
    assert got == {(0.05, 0.5): (1.0, 1.0), (0.9, 0.5): (0.0, None)}


def test_stream_state_equals_batch(spark, tmp_path):
    rows = [("a", dt.datetime(2024, 1, 1, 0, i), i, i % 3 == 0) for i in range(6)] + [("b", dt.datetime(2024, 1, 1), 9, True)]
    df = spark.createDataFrame(rows, "source string, at timestamp, seq long, ok boolean")
    want = {r.source: (r.failures, r.next_ms) for r in I.backoff_batch(df).collect()}
    df.coalesce(1).write.parquet(str(tmp_path / "polls"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "polls"))
    out = {}

    def sink(batch, _):
        out.update({r.source: (r.failures, r.next_ms) for r in batch.collect()})

    I.run(I.backoff_state(stream), sink, str(tmp_path), "update")
    assert out == want and want["b"] == (0, None) and want["a"][0] == 2


def test_assignment_widens_ranges(spark):
    day = lambda d: dt.datetime(2024, 1, d)
    arts = spark.createDataFrame([("k", 1, day(1)), ("k", 2, day(3)), ("k", 3, day(5)), ("k", 4, day(20))], "topic string, article long, at timestamp")
    pairs = spark.createDataFrame([("k", 1, 2, 0.5), ("k", 1, 3, 0.5), ("k", 2, 3, 0.5), ("k", 1, 4, 0.9)], "topic string, left long, right long, score double")
    got = {r.article: r.story for r in I.assign(arts, pairs, "topic").collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_assignment_by_pieces_equals_one_pass(spark):
    import random

    rng = random.Random(2)
    hours = [rng.randrange(400) for _ in range(80)]
    pairs = [(i, j, rng.choice([0.2, 0.4])) for i in range(80) for j in range(i + 1, 80) if rng.random() < 0.08]
    score = {frozenset(p[:2]): p[2] for p in pairs}
    want, last = {}, {}
    for i in sorted(range(80), key=lambda i: (hours[i], i)):
        near = [(score[frozenset((i, f))], last[f], -f) for f in last if frozenset((i, f)) in score and hours[f] >= hours[i] - 72]
        want[i] = -max(near)[2] if near else i
        last[want[i]] = hours[i]
    t0 = dt.datetime(2024, 1, 1)
    rows = [("k", i, t0 + dt.timedelta(hours=h)) for i, h in enumerate(hours)] + [("k", 99, None), ("z", 1, t0)]
    arts = spark.createDataFrame(rows, "topic string, article long, at timestamp")
    links = spark.createDataFrame([("k", *p) for p in pairs] + [("k", 0, 99, 0.9)], "topic string, left long, right long, score double")
    got = {(r.topic, r.article): r.story for r in I.assign(arts, links, "topic").collect()}
    assert got == {("k", i): v for i, v in want.items()} | {("k", 99): 99, ("z", 1): 1}


def names_of(text, lex=E.DEFAULT):
    return {key: (name, kind) for key, name, kind, _ in E.Reader(lex).read(text)}


def test_names_at_the_head_of_a_sentence():
    assert names_of("Jane Doe spoke.") == {"jane doe": ("Jane Doe", "person")}
    assert names_of("New York City grew. They left New York City.")["new york city"] == ("New York City", "place")
    assert names_of("Later, rain fell. Weather turned.") == {}
    assert "weather" in names_of("Weather turned. They blamed Weather again.")


def test_runs_end_at_commas_sentences_and_legal_suffixes():
    assert list(names_of("They saw Jane Doe, Acme Corp Foo. Bar left Bar.")) == ["jane doe", "acme", "foo", "bar"]
    assert names_of("She runs the Bank of England now.")["bank england"] == ("Bank of England", "org")
    assert names_of("He met Jean-Luc Marais’s aide.") == {"jean luc marais": ("Jean-Luc Marais", "concept")}
    assert list(names_of("a One Two Three Four Five b")) == ["one two three four", "five"]
    assert names_of("the NATO Summit") == {"nato": ("NATO", "concept"), "summit": ("Summit", "concept")}


def test_kinds_follow_the_first_cue():
    kinds = lambda t: {k: v[1] for k, v in names_of(t).items()}
    assert kinds("they met senator Wibble in Frankfurt") == {"wibble": "person", "frankfurt": "place"}
    assert kinds("the acquisition of Tinyco by the central bank of Belvern") == {"tinyco": "org", "belvern": "place"}
    assert kinds("it launched Foo yesterday") == {"foo": "product"}
    assert kinds("we tried Foo, an AI assistant for all") == {"foo": "product"}
    assert kinds("many saw Foo and left") == {"foo": "concept"}
    # The majority of mentions decides, the first of equals.
    assert kinds("it launched Foo. we saw Foo. they like Foo too") == {"foo": "concept"}
    assert kinds("it launched Foo. we saw Foo too") == {"foo": "product"}


def test_names_that_name_nothing():
    lex = E.Lexicon(publishers=("daily planet",))
    assert names_of("as the Daily Planet wrote, the Council met Points Comments", lex) == {}
    assert names_of("Points: 6 # Comments: 0") == {}
    assert names_of("GET A B THE NEW BIG RED HOT CAR NOW OR NEVER") == {}


def test_lexicon_from_a_table(spark):
    rows = [("given_names", "Wibble", None), ("demonyms", "frobian", "frobia"), ("publishers", "planet", None)]
    lex = E.Lexicon.from_table(spark.createDataFrame(rows, "list string, word string, value string"))
    assert lex.given_names == ("wibble",) and lex.demonyms == {"frobian": "frobia"} and lex.furniture == E.DEFAULT.furniture
    assert names_of("they met Wibble Doe of the Frobian Army and read Planet", lex) == {"wibble doe": ("Wibble Doe", "person"), "frobia army": ("Frobian Army", "concept")}


def test_keys_agree_with_their_column(spark):
    names = ["The Acme's Corp.", "Bank of England", "fired OpenThing", "U.S. Senate", "German Army", "Inc", "", "Former"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", E.canonical_key(F.col("n")).alias("k")).collect()
    assert {r.n: r.k for r in got} == {n: E.Reader().key(n) for n in names}


def test_plain_text_agrees_with_its_column(spark):
    from tidewire.functions import text as T

    texts = [
        "  By Jane Doe, Staff Writer\nThe   news. https://a.b/c d", "Photo by Al Bo. Text Here", "x Points: 6 # Comments: 0 y", "The post A first appeared on B.", "Story Continue reading...",
        "Caption: a dog. Text", "doi:10.1/x text", "Credit SMITH. said", "standby by Byron", "é — plain",
    ]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.strip_feed_metadata(F.col("t")).alias("s")).collect()
    assert {r.t: r.s for r in got} == {t: E.plain_text(t) for t in texts}


def test_extract_takes_odd_rows(spark):
    rows = [(None, "Jane Doe spoke"), (1, None), (2, ""), (2, "Jane Doe spoke"), (2, "Jane Doe spoke")]
    got = E.extract(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.key) for r in got) == [(0, "jane doe"), (2, "jane doe"), (2, "jane doe")]


def test_a_replayed_batch_keeps_its_rows(spark, tmp_path):
    """Each batch's commit mark is removed in turn, as after a crash between write and commit."""
    from tidewire.streaming import ingest

    folder, schema = tmp_path / "in", "k long, v string"
    for i, ks in enumerate([(1, 2), (2, 3), (1, 3, 4)]):
        spark.createDataFrame([(k, f"b{i}") for k in ks], schema).coalesce(1).write.parquet(str(folder / f"t{i}"))
    table = lambda: {r.k: r.v for r in ingest.first_writes(ingest.source(spark, str(folder), "part", schema), ["k"], ["v"], str(tmp_path / "out")).collect()}
    first = table()
    assert set(first) == {1, 2, 3, 4}
    commits = tmp_path / "out" / "checkpoint" / "commits"
    for f in [*commits.glob("2"), *commits.glob(".2.crc")]:
        f.unlink()
    assert table() == first


def test_cues_of_several_words_come_from_a_table(spark):
    """Phrases of any list are matched over word numbers; lists of a table replace the defaults."""
    rows = [("org_cues", "joint venture with", None), ("institutions", "weather bureau", None), ("sale_phrases", "hits the shelves", None), ("product_nouns", "spacecraft", None), ("given_names", "Ulla", None)]
    lex = E.Lexicon.from_table(spark.createDataFrame(rows, "list string, word string, value string"))
    assert names_of("They signed a joint venture with Zorba today.", lex)["zorba"] == ("Zorba", "org")
    assert names_of("It was said by the weather bureau of Belvern.", lex)["belvern"] == ("Belvern", "place")
    assert names_of("now our Quill hits the shelves.", lex)["quill"] == ("Quill", "product")
    assert names_of("They praised Vega, a new small spacecraft.", lex)["vega"] == ("Vega", "product")
    assert names_of("They praised Vega, who loved his new small red spacecraft.", lex)["vega"] == ("Vega", "concept")
    assert names_of("They met Ulla Berg there.", lex)["ulla berg"] == ("Ulla Berg", "person")
    assert names_of("They met Jane Berg there.", lex)["jane berg"] == ("Jane Berg", "concept")


def test_names_are_read_alike_alone_and_with_others():
    texts = ["The minister met Jane Doe from Acme Corp in London.", None, "", "Launched Foo, its first app. Foo's maker", "A", "Jean-Luc O’Neil’s Bank of England", "in", "London", "x " * 50 + "Bank", "an AI"]
    reader = E.Reader()
    got = {}
    for row, *name in reader.read_all(texts).itertuples(index=False, name=None):
        got.setdefault(row, []).append(tuple(name))
    assert [got.get(i, []) for i in range(len(texts))] == [reader.read(t) for t in texts]


def test_kinds_of_a_table_of_any_size(spark):
    names = spark.createDataFrame([(1, "acme", "Acme", "concept", 2), (2, "x", "X", "org", 1)], "doc_id long, key string, name string, kind string, mentions long")
    known = spark.createDataFrame([("acme", "org"), ("acme", "product"), ("other", "place")], "key string, kind string")
    assert sorted(map(tuple, E.named_kinds(names, known).collect())) == [(1, "acme", "Acme", "org", 2), (2, "x", "X", "org", 1)]


def test_each_part_of_an_entry_is_read_once():
    """Expressions do not grow with the number of steps: what a step names twice is computed once."""
    from tidewire.sources import feeds

    assert str(feeds.published_at(F.col("entry"))).count("pubDate") <= 2
    assert str(feeds.longest(*[feeds.tag(F.col("entry"), x) for x in ("a", "b", "content", "d")])).count("content") <= 2
    assert str(T.article_text(F.col("title"), F.col("body"))).count("body") <= 2


def test_guards_let_every_rule_through(spark):
    """Each rule of FEED_METADATA still applies, one after the other, also where a removal brings a word together."""
    texts = {
        "x doi:10.1/abc  The text.": "The text.", "Text. CONTINUE READING...": "Text.", "Text. The Post x First Appeared On y": "Text.", "A. MISSED this morning's one? We forgive you. Read it here. B": "A. B",
        "By Ann Lee, Staff Writer\nText": "Text", "Text. Photo: Ann Lee. More": "Text. More", "Text. Credit BBC More": "Text. More", "CAPTION: one. Text": "Text", "Text. Points: 12 # more": "Text. more", "Text https://a.b/c more": "Text more",
        "by Ann: plain　　 text ": "by Ann: plain text", "": "", " \n ": "",
    }
    df = spark.createDataFrame(list(texts.items()), "text string, want string")
    wrong = df.withColumn("got", T.strip_feed_metadata(F.col("text"))).where(~F.col("got").eqNullSafe(F.col("want"))).collect()
    assert not wrong


def test_summaries_take_sentences_of_ranked_texts_only(spark, data):
    from tidewire import plans

    plan = plans.QUERIES["grp_09_10_summaries"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "documents" not in plan and "split(" not in plan


def test_several_lexicons_read_the_words_of_a_text_once(spark, monkeypatch):
    """Names by each lexicon equal those read by it alone; the words are found once for all."""
    texts = ["Officials met Acme Holdings in Berlin. The Widget Works said so.", None, "", "Mayor Ada Byron spoke; Byron left The Harbor Club.", "THE END"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    lexicons = [E.DEFAULT, E.Lexicon(furniture=(*E.DEFAULT.furniture, "byron", "acme holdings"))]
    got = E.extract_each(df, lexicons)
    for i, lex in enumerate(lexicons):
        assert sorted(tuple(r)[:5] for r in got.where(F.col("lexicon") == i).collect()) == sorted(tuple(r) for r in E.extract(df, lex=lex).collect())
    assert got.where("lexicon = 0").count() > got.where("lexicon = 1").count() > 0


def test_a_changed_lexicon_is_one_pass_over_the_texts(spark, data):
    from tidewire import plans

    plan = plans.QUERIES["txt_16_reread_changes"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_phrases_are_counted_by_document_and_words_are_sent_once(spark, monkeypatch):
    """Against a count by hand, in pieces of any size; what is shuffled goes by first word, once."""
    from tidewire.operators import phrases as P

    r = random.Random(3)
    rows = [None, [], [[]], [["a"]], [["a", "b"], [], ["a", "b", "a", "b"]], *([[r.choice("abcdefg") for _ in range(r.randrange(6))] for _ in range(r.randrange(4))] for _ in range(60))]
    want = {}
    for doc in rows:
        for phrase in {" ".join(s[i : i + k]) for s in doc or [] for k in (2, 3) for i in range(len(s) - k + 1)}:
            want[phrase] = want.get(phrase, 0) + 1
    df = spark.createDataFrame([(x,) for x in rows], "t array<array<string>>").repartition(3)
    for size in (7, 2_000_000):
        monkeypatch.setattr(P, "AT_ONCE", size)
        got = P.documents(df, F.col("t")).collect()
        assert len(got) == len(want) and {x.phrase: x.documents for x in got} == want
    plan = P.documents(df, F.col("t"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(first") == plan.count("Exchange hashpartitioning(first#") == 1 and "hashpartitioning(after" not in plan
    monkeypatch.setattr(P, "SHARES", 1)
    lists = pa.array([[["of", "the", "sea"], ["of", "the", "air"]], [["of", "the", "sea"]]], pa.list_(pa.list_(pa.string())))
    assert P._counted(lists).drop_columns(["share"]).to_pylist() == [{"first": "of", "words": "the sea air", "counts": "2 2 1"}, {"first": "the", "words": "sea|air", "counts": "2|1"}]
