"""Token alignment, main-text extraction and the filter audit, against plain versions."""

import hashlib
import html
import itertools
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidewire.llm import boosting, dom, filter_audit, html_extract, layouts, token_align

ODD = [
    None, "", " ", "x", "plain words, twice: plain words", "<|endoftext|> <s> </s> <unk>", "▁ under", "naïve café — “quotes” 日本語のテキスト 🙂🙂", "tabs\tand\nlines\r\n  two  spaces  ", " nbsp em",
    "ﬁ ligature ½", "\x00nul\x07", "a" * 3000, "é" * 500, "日" * 400, "ab" * 900 + " " * 50, "  lead and trail  ", "don't we'll 12345 3.14 $%&", "é combining",
]


@pytest.fixture(scope="module")
def both():
    return token_align.pair(token_align.FOLDER)


def plain_alignment(rows, both):
    """Rows of (doc_id, text) by dictionaries of ends, one document at a time."""
    per, counts = [], Counter()
    for i, t in rows:
        t = t or ""
        a, b = both.a.encode(" " + t, add_special_tokens=False).ids, both.b.encode(t)
        want = (" " + t).encode()
        if not t or b"".join(both.a_bytes[x] for x in a) != want or b"".join(both.b_bytes[x] for x in b) != want:
            per.append((i, 0, 0, [], []))
            continue
        ends = []
        for ids, size in ((a, both.a_bytes), (b, both.b_bytes)):
            at, of = 0, {}
            for k, x in enumerate(ids):
                at += len(size[x])
                of[at] = k
            ends.append(of)
        groups, links, pa, pb = [], [], 0, 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            za, zb = ends[0][e] + 1, ends[1][e] + 1
            groups.append(",".join(map(str, a[pa:za])) + "|" + ",".join(map(str, b[pb:zb])))
            links += [(x, y) for x, y in itertools.product(range(pa, za), range(pb, zb)) if x == za - 1 and y == zb - 1]
            links[-1] = (a[links[-1][0]], b[links[-1][1]])
            pa, pb = za, zb
        counts.update(links)
        per.append((i, len(a), len(b), groups, links))
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return sorted((i, na, nb, len(g), len(ls), sum(counts[x] == best[x[1]] for x in ls), sum(counts[x] for x in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, na, nb, g, ls in per)


def test_alignment_equals_the_plain_version(spark, docs_of, both, data):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{data}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    rows += [(10_000 + i, t) for i, t in enumerate(ODD)] + [(10_000, None), (10_004, ODD[4]), (10_004, ODD[4])]
    got = token_align.align(docs_of(rows, extra=(("piece", "p"), ("code", 1))).repartition(5))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect())) == plain_alignment(rows, both)


def test_alignment_over_several_pieces_and_no_rows(spark, docs_of, both, monkeypatch):
    rows = [(i, f"the {i % 7} same words come again and again {ODD[7]} {i % 3}") for i in range(60)]
    want = plain_alignment(rows, both)
    monkeypatch.setattr(token_align.A, "pieces", lambda batches, *a: (b.slice(i, 7) for b in batches for i in range(0, b.num_rows, 7)))
    assert sorted(map(tuple, token_align.align(docs_of(rows)).collect())) == want
    assert token_align.align(docs_of([])).count() == 0


def test_groups_are_told_apart_token_by_token():
    r = random.Random(3)
    for _ in range(40):
        n = r.randrange(1, 60)
        sizes = [(r.choice((1, 1, 2, 3, 40)), r.choice((1, 1, 2, 35))) for _ in range(n)]
        a, b = ([r.randrange(3) for _ in range(sum(s[i] for s in sizes))] for i in (0, 1))
        ga, gb = np.cumsum([s[0] for s in sizes]), np.cumsum([s[1] for s in sizes])
        code, words = token_align.interned(token_align.Tokens(np.array(a), np.array([0, len(a)])), token_align.Tokens(np.array(b), np.array([0, len(b)])), ga, gb)
        want = [",".join(map(str, a[x:y])) + "|" + ",".join(map(str, b[u:v])) for x, y, u, v in zip([0, *ga[:-1]], ga, [0, *gb[:-1]], gb, strict=True)]
        assert [words[c] for c in code] == want
        assert len(set(words)) == len(words)


def test_pairs_that_are_linked_stay_below_their_bound(both):
    seen = {(x, y) for x, y in zip(both.a_bytes[:2000], both.a_bytes[:2000], strict=True)}
    assert 0 < len(seen) < token_align.most_pairs(both) < 3_000_000


def plain_audit(docs, labels):
    first, n_by = {}, Counter()
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    marks = defaultdict(lambda: [0, 0])
    for i, q, x in labels:
        marks[i][0] |= q == 1
        marks[i][1] |= x == 1
    rows = []
    for i, t, lang in docs:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {c for c, bad in zip("ABCDE", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and first[t] < i), strict=True) if bad}
        rows.append((lang or "", fails, *(marks[i] if i is not None else (0, 0))))
    out = []
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley = {c: sum(Fraction(120, len(r[1])) for r in mine if c in r[1]) for c in "ABCDE"}
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for k, c in enumerate(order, 1):
                gone = [r for r in left if c in r[1]]
                left = [r for r in left if c not in r[1]]
                out.append((part, order, k, len(left), len(gone), sum(c in r[1] for r in mine) - len(gone), sum(r[1] == {c} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone), int(shapley[c])))
    return sorted(out)


def audit_tables(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("part", F.lit("clash")).withColumn("mask", F.lit(3))
    return d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_audit_equals_counting_order_by_order(spark):
    r = random.Random(5)
    long_ = " ".join(f"w{i}" for i in range(120))
    texts = [None, "", "Short", "SHOUT LOUD", long_, long_ + " #", "a " * 130, "A " * 130, long_ + "|", "$", "é" * 9, " ".join(f"W{i} ABC" for i in range(110))]
    docs = [(i, r.choice(texts), r.choice(["en", "fr", None, ""])) for i in range(300)] + [(None, "Short", "en"), (None, "", None), (7, "Short", "en"), (7, "Short", "en"), (7, long_, "fr")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, 300, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    d, lab = audit_tables(spark, docs, labels)
    got = filter_audit.audit(d, lab)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == plain_audit(docs, labels)


def test_audit_of_empty_tables_and_one_row(spark):
    d, lab = audit_tables(spark, [], [])
    assert filter_audit.audit(d, lab).count() == 0
    d, lab = audit_tables(spark, [(1, None, None)], [])
    assert sorted(map(tuple, filter_audit.audit(d, lab).collect())) == plain_audit([(1, None, None)], [])


def test_signed_sums_invert_to_the_cells(spark):
    r = random.Random(9)
    rows = [("p", r.randrange(32), r.randrange(5), r.randrange(3), r.randrange(3)) for _ in range(200)]
    out = filter_audit.cells(spark.createDataFrame(rows, "part string, mask int, every long, good long, toxic long")).first()
    for k, name in enumerate(("every", "good", "toxic")):
        assert out[name] == [sum(x[2 + k] for x in rows if x[1] == m) for m in range(32)]


@pytest.fixture(scope="module")
def model():
    return html_extract.trained()


def test_extraction_of_pages_with_unseen_layouts(model):
    pages = layouts.pages(150, 4242)
    f = html_extract.Forest([dom.parse(p) for p, _ in pages])
    kept, want = model.kept(f)[f.run], np.array([c for _, cs in pages for c in cs])
    size = np.array([len(t) for t in f.text])[f.run]
    assert size[kept & want].sum() / size[kept].sum() > 0.97
    assert size[kept & want].sum() / size[want].sum() > 0.97


def test_extraction_of_the_tables_pages(spark, model):
    """In these tables the article is one element, so a plain reading can say what is right."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in html_extract.extract(pages, model).collect()}
    rows = pages.collect()
    assert len(got) == len(rows) > 100
    for r in rows:
        inside = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", inside))
        want = "\n\n".join(b for b in blocks if b)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


def test_extraction_leaves_out_what_is_not_article(model):
    page = """<html><body><header class="site-header"><h1>Daily Site</h1></header><div class="cookie-notice"><p>We use cookies, as all do.</p></div>
    <nav class="menu"><ul><li><a href=/a>Home</a><li><a href=/b>World</a></ul></nav><div id="content" class="article-body"><h1>A headline &amp; more</h1>
    <p>First paragraph of the story, with <a href="/x">one link</a> and   space.<p>Second&nbsp;one<br>goes on for a while, and says what happened then.</p>
    <div class="ad advert">Buy this now</div><p>Third and last paragraph of it, which is also long enough.</p></div>
    <section id="comments" class="comments"><h3>Comments</h3><div class="comment"><p>I do not agree with this at all, since it is wrong.</p></div></section>
    <aside class="sidebar"><h3>Popular</h3><p><a href=/p>Other story</a></p></aside><form class="newsletter"><p>Subscribe here</p><input name=e></form>
    <footer class="footer"><p>&copy; Daily Site</p></footer><script>var p = "<p>no</p>"</script></body></html>"""
    assert html_extract.main_texts([page], model) == [
        "A headline & more\n\nFirst paragraph of the story, with one link and space.\n\nSecond one goes on for a while, and says what happened then.\n\nThird and last paragraph of it, which is also long enough."
    ]


def test_extraction_of_odd_pages(spark, model):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "just words & more"), (None, "u", "<p>"), (5, "u", "<article><p>cut of"), (5, "u", "<article><p>cut of"), (6, "u", "<script>x"), (7, "u", "<p>a &lt;b&gt; <!-- no <p>no</p> --> c")]
    got = html_extract.extract(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int"), model)
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got.collect()) == sorted([(1, "", 0), (2, "", 0), (3, "just words & more", 17), (0, "", 0), (5, "cut of", 6), (5, "cut of", 6), (6, "", 0), (7, "a <b> c", 7)])
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string"), model).count() == 0


@pytest.mark.parametrize("unit", ['<a href="', "<!-- ", "<script>", "<div>", "</x", "<", "<li>", "<td><tr>", "<p a='", "&amp", "<svg>", "<b><p>"])
def test_reading_a_page_is_linear(unit):
    from time import perf_counter

    took = []
    for n in (40_000, 160_000):
        page = unit * (n // len(unit))
        began = perf_counter()
        dom.parse(page)
        took.append(perf_counter() - began)
    assert took[1] < 1.5 or took[1] < 8 * took[0]


def test_labelling_is_the_best_consistent_one(model):
    """Against trying all labellings of small trees."""
    r = random.Random(2)
    for page, _ in layouts.pages(400, 77):
        tree = dom.parse(page)
        f = html_extract.Forest([tree])
        if not f.holds.sum() or f.holds.sum() > 9:
            continue
        f = html_extract.Forest([tree])
        nodes = np.flatnonzero(f.holds).tolist()
        score = np.zeros((len(f.parent), 3))
        score[nodes] = [[r.uniform(-5, 0) for _ in range(3)] for _ in nodes]

        class Fixed:
            def scores(self, x):
                return score[nodes]

        best, answers = None, []
        for labels in itertools.product(range(3), repeat=len(nodes)):
            own = dict(zip(nodes, labels, strict=True))
            if any(f.run[i] and own[i] == 2 for i in nodes) or any(f.parent[i] in own and own[f.parent[i]] != 2 and own[i] != own[f.parent[i]] for i in nodes):
                continue
            total = sum(score[i, c] for i, c in own.items())
            if best is None or total > best + 1e-9:
                best, answers = total, [{i for i in nodes if f.run[i] and own[i] == 0}]
        got = html_extract.Model(model.leaning, Fixed()).kept(f)
        assert set(np.flatnonzero(got).tolist()) in answers


def test_boosting_learns_what_one_split_cannot():
    r = np.random.default_rng(1)
    x = r.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int) + (x[:, 2] > 0.9)
    trees = boosting.fit(x[:3000], y[:3000], 3)
    score = trees.scores(x[3000:])
    assert (score.argmax(1) == y[3000:]).mean() > 0.95
    assert np.allclose(np.exp(score).sum(1), 1)
