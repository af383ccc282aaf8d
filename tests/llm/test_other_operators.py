"""URL filters, packing, the pipeline and the registered queries."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tidewire.llm import packing, queries, urls


def plain_rule(host, path):
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, None)


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[: min([path.index(c) for c in "?#" if c in path] or [len(path)])]


PAGES = [
    (1, "http://a.example.com/en/712", ""),
    (2, "http://A.Example.COM/en/5?x=/en/7", ""),
    (3, "https://com/en/", None),
    (4, "https://xcom/en/", ""),
    (5, None, "<p>"),
    (6, "no scheme /en/7", ""),
    (7, "http://shop.example.net/de/81#top", ""),
    (8, "http://shop.example.net/de/71", ""),
    (9, "http://É.example.org/es/#", ""),
    (10, "http://q.example.info", '<link href="http://b.example.com/en/1" rel="canonical">'),
    (11, "http://r.example.info/", '<meta http-equiv="refresh" content="0; url=http://q.example.info">'),
    (12, "http://s.example.info/", '<link rel="canonical" href="http://example.com/en/7">'),
    (13, "http://t.example.info/", '<link rel="canonical" href="http://s.example.info/">'),
    (14, "http://t.example.info/?utm_source=feed&a=1&ref=x#top", ""),
    (15, "http://t.example.info/?a=1", '<link rel=canonical href=/other>'),
    (16, "http://t.example.info/other", '<meta property="og:url" content="http://c.example.com/en/9">'),
    (1, "http://a.example.com/en/712", ""),
    (None, "http://u.example.info/", ""),
    (17, "http://a?b/en/7://c.com/en/", ""),
]


def test_urls(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("rule", F.lit(1)).withColumn("root", F.lit(2))
    got = urls.judge(pages).collect()
    assert len(got) == len(PAGES)
    by = {r.page_id: r for r in got}
    for i, url, _ in PAGES:
        host, path = plain_parts(url)
        rule, verdict = plain_rule(host, path)
        assert (by[i].host, by[i].path, by[i].rule) == (host, path, rule)
        assert rule is None or by[i].verdict == verdict
    assert [by[i].verdict for i in (10, 11, 12, 13, 14, 15, 16, None)] == ["block", "block", "allow", "allow", "block", "block", "block", "allow"]
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_relative_and_quoted_targets(spark):
    base = "http://h.example.info/a/b/page.html?q=1#top"
    want = {
        "other.html": "http://h.example.info/a/b/other.html",
        "?p=2": "http://h.example.info/a/b/page.html?p=2",
        "../x": "http://h.example.info/a/x",
        "../../../x/./y?u=http://z/../w": "http://h.example.info/x/y?u=http://z/../w",
        "..": "http://h.example.info/a/",
        "/r/../s": "http://h.example.info/s",
        "//o.example/x": "http://o.example/x",
        "https://o.example/x": "https://o.example/x",
        "mailto:a": None,
    }
    rows = [(i, base, f'<link rel="canonical" href="{t}">') for i, t in enumerate(want)]
    for (i, url, html), goal in zip(rows, want.values(), strict=True):
        got = {r.b for r in urls.alias_edges(spark.createDataFrame([(i, url, html)], "page_id long, url string, html string")).collect()}
        assert got == {goal, "http://h.example.info/a/b/page.html?q=1"} - {None}
    bare = [(1, "http://h.example.info", "<link rel=canonical href=x.html>"), (2, "http://k.example.info", """<meta http-equiv="refresh" content="0; url='http://b.example.com/en/1'">""")]
    df = spark.createDataFrame(bare, "page_id long, url string, html string")
    assert {r.b for r in urls.alias_edges(df).collect()} == {"http://h.example.info/x.html", "http://b.example.com/en/1"}
    assert {r.page_id: r.verdict for r in urls.judge(df).collect()} == {1: "allow", 2: "block"}


def test_links_in_comments_scripts_and_quotes(spark):
    url = "http://h.example.info/a/b.html"
    cases = {
        "<!-- <link rel=canonical href=x> -->": None,
        "<!-- a <link rel=canonical href=x>": None,
        '<script>"<link rel=canonical href=x>"</script><STYLE><meta property=og:url content=y></style >': None,
        "<title><link rel=canonical href=x></title><link rel=canonical href=y>": "http://h.example.info/a/y",
        '<link title="a > b" rel="canonical" href="x>y">': "http://h.example.info/a/x>y",
        "<link title=don't rel=canonical href=x>": "http://h.example.info/a/x",
        '<link rel="canonical" href="x': None,
        "<!--" * 50_000: None,
        "<script>" * 50_000: None,
        "<link a='" * 50_000: None,
        "<link " * 50_000: None,
    }
    rows = [(i, f"{url}?{i}", html) for i, html in enumerate(cases)]
    got = {(int(r.a.split("?")[1]), r.b) for r in urls.alias_edges(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {(i, b) for i, b in enumerate(cases.values()) if b}


def test_rules_that_are_not_broadcast(spark, monkeypatch):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    want = sorted(map(str, urls.judge(pages).collect()))
    monkeypatch.setattr(urls, "BROADCAST_RULES", 0)
    assert sorted(map(str, urls.judge(pages).collect())) == want


def test_packing_is_whole_and_fits(docs_of):
    rng = random.Random(1)
    rows = [(0, None), (1, ""), (2, "w " * 9000), (3, "w " * 4096), (4, "w " * 4095), (None, "a b"), (5, "x y z")] + [(i, "w " * rng.randint(0, 900)) for i in range(6, 80)]
    rows += [rows[10], rows[10]]
    docs = docs_of(rows, (("n", 1), ("piece", 2), ("shard", 3), ("length", 4)))
    for shard_rows in (20_000, 10):
        got = packing.plan(docs, shard_rows=shard_rows).collect()
        length = {i: len((t or "").split()) + 1 for i, t in rows}
        for i in length:
            copies = sum(x == i for x, _ in rows)
            own = sorted(r.start for r in got if r.doc_id == i)
            assert sum(r.length for r in got if r.doc_id == i) == length[i] * copies and own[0] == 0
        bins = {}
        for r in got:
            bins.setdefault(r.bin_id, []).append(r)
        for held in bins.values():
            used = sum(r.length for r in held)
            assert used == held[0].bin_used and held[0].capacity == min(c for c in packing.CAPACITIES if c >= used)
            at = sorted((r.bin_offset, r.length) for r in held)
            assert all(a + n == b for (a, n), (b, _) in zip(at, at[1:], strict=False)) and at[0][0] == 0
    assert packing.plan(docs_of([])).count() == 0


@pytest.mark.parametrize("rows", [[(1, "w " * 4096 * 300), (2, "w")], [(None, "a b c")] * 300])
def test_packing_spreads_long_documents_and_equal_rows(docs_of, rows):
    got = packing.plan(docs_of(rows), shard_rows=10).collect()
    held = {}
    for r in got:
        shard = r.bin_id.split("-")[0]
        held[shard] = held.get(shard, 0) + 1
    assert sum(r.length for r in got) == sum(len(t.split()) + 1 for _, t in rows)
    assert len(held) > 20 and max(held.values()) < 40


def test_filling_in_thought_uses_all_lengths():
    assert packing._Lengths(list(range(1, 91))).fill(4095) == 4095


def test_best_fit_opens_the_cheapest_bin():
    bins, _, sizes = packing.pack([600, 500, 400, 300, 100], (512, 1024, 2048), 32)
    assert sizes == [1024, 1024] and bins == [0, 1, 0, 1, 1]
    assert packing.pack([500, 500], (512, 1024), 0)[2] == [1024] or packing.pack([500, 500], (512, 1024), 0)[2] == [512, 512]
    assert packing.pack([], (8,), 1) == ([], [], [])
    rng = random.Random(0)
    lengths = [rng.randint(1, 4096) for _ in range(3000)]
    b, _, sizes = packing.pack(lengths)
    assert sum(lengths) / sum(sizes) > 0.97 and len(b) == 3000


def test_pipeline_stages(spark, data):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "benchmark_decontamination", "secret_redaction", "best_fit_packing"]
    docs = spark.read.parquet(f"{data}/documents.parquet")
    names, ids = docs.schema.names, {r.doc_id for r in docs.select("doc_id").collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data).cache()
        assert docs.schema.names == names
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= ids
        ids = now
    packed = corpus_pipeline.run(spark, data)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == ids


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n.startswith("op")))
def test_registered_queries_cover_their_tables(name, spark, data):
    table = "pages" if name.startswith(("op3_", "op12_")) else "documents"
    df = entry.queries()[name](spark, data)
    if name.startswith("op13_"):
        # No row per document: every part has all orders and steps, and its last step and removals add up to its documents.
        n = {r.part: r.n for r in spark.read.parquet(f"{data}/documents.parquet").groupBy(F.coalesce("lang", F.lit("")).alias("part")).agg(F.count("*").alias("n")).collect()}
        each = df.groupBy("part", "filter_order").agg(F.count("*").alias("steps"), (F.sum("removed") + F.min("kept")).alias("n")).collect()
        assert {(r.part, r.n) for r in each} == set(n.items()) and len(each) == 120 * len(n) and {r.steps for r in each} == {5}
        return
    key = "page_id" if table == "pages" else "doc_id"
    assert {r[0] for r in df.select(key).collect()} == {r[0] for r in spark.read.parquet(f"{data}/{table}.parquet").select(key).collect()}
    assert len(set(df.columns)) == len(df.columns)


def test_verdicts_of_classes_match_brute_force(spark):
    """Union-find over the URLs of pages and their links, spelt in several ways."""
    rng = random.Random(3)
    hosts = ["a.example.com", "b.example.com", "x.example.net", "y.example.net", "z.example.org", "neutral.example.info", "other.example.info"]
    urls_ = [f"http://{h}/{lang}/{n}" for h in hosts for lang in ("en", "de", "es", "fr") for n in (7, 8, 9)]
    pages, links = [], []
    for i, u in enumerate(urls_):
        html = "<p>x</p>"
        if rng.random() < 0.3:
            v = rng.choice(urls_)
            links.append((u, v))
            host, _, tail = v.removeprefix("http://").partition("/")
            spelt = f"HTTP://{host.upper()}/{tail}#part"
            html += rng.choice([f'<link rel="nofollow CANONICAL" href="{spelt}">', f"<meta http-equiv=refresh content=\"3; URL='{v}?utm_source=q&amp;ref=z'\">", f"<meta property='og:url' content='{spelt}'>"])
        pages.append((i, u, html))
    root = {u: u for u in urls_}
    find = lambda u: u if root[u] == u else find(root[u])
    for u, v in links:
        root[find(u)] = find(v)
    rules = {u: plain_rule(*plain_parts(u)) for u in urls_}
    want = {}
    for i, u, _ in pages:
        members = [rules[v][1] for v in urls_ if find(v) == find(u)]
        want[i] = rules[u][1] or ("allow" if "allow" in members or "block" not in members else "block")
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == want
    assert sum(rules[u][0] is None and want[i] == "block" for i, u, _ in pages) >= 3


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracles_agree(name, spark, data):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    found = con.execute(queries.ORACLE[name])
    columns = [c[0] for c in found.description]
    assert sorted(found.fetchall()) == sorted(tuple(r[c] for c in columns) for r in queries.QUERIES[name](spark, data).collect())


@pytest.mark.parametrize("rows", [[], [(None, None), (None, "x"), (1, ""), (2, " \n "), (3, None)]])
def test_pipeline_takes_odd_and_empty_tables(rows, docs_of, spark, tmp_path):
    prose = [f"This is plain prose number {i} with words such as {' '.join(f'w{i}x{k}' for k in range(40))}." for i in range(4)]
    more = [(10, prose[0]), (11, prose[0]), (11, prose[0]), (None, prose[1])] if rows else []
    docs_of([*rows, *more]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == ({10, None} if rows else set())
