"""Queries do their whole job: every row of their table, and what a cut would hide."""

import duckdb
import pytest

from tidewire import plans
from tidewire.sources.testdata import Tables

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture
def on_texts(spark, data, tmp_path):
    """A folder of the test tables whose documents have the given texts, as a query and its SQL read it."""

    def on(texts, name):
        rows = spark.createDataFrame([(i, "src0", "en", x, len(x or "")) for i, x in enumerate(texts)], "doc_id long, source string, lang string, text string, n_chars long")
        rows.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'" if t != "documents" else f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        return plans.QUERIES[name](spark, str(tmp_path)), con.execute(plans.ORACLE[name]) if name in plans.ORACLE else None

    return on


def test_feed_metadata_is_stripped_from_every_text(on_texts):
    """Every rule, adjoining credits, words beside letters that are not ASCII, and texts without a match."""
    bodies = [
        "x doi:10.1/abc The text.", "Text. CONTINUE READING...", "Text. The Post x First Appeared On y", "The posté a first appeared on b", "A. MISSED this morning's one? We forgive you. Read it here. B",
        "By Ann Lee, Staff Writer\nText", "x\n By Bo Lu and Al Di  \nBy Cy Do\n", "Photo by Ann Lee. Photo: Bo Lu. Image: Al", "Text. Credit BBC. Credit AP. More", "CAPTION: one. Text", "éName: 5 Points: 12 # more", "Url: http://a.b https://c.d/e　f", "plain   text", "",
    ]
    got, want = on_texts([f"t\n{b}" for b in bodies] + [None], "str_01_strip_feed_metadata")
    got = {r.doc_id: r.body for r in got.collect()}
    assert got == dict(want.fetchall()) and len(got) == len(bodies) + 1
    assert (got[7], got[8], got[10], got[12]) == ("", "Text. More", "é more", "plain text")


def test_every_text_is_read_again_and_names_come_and_go(spark, data):
    """Counts are those of the names that each lexicon finds by itself; a text without names has zeros."""
    from tidewire.functions import entities as E
    from tidewire.plans.stories import REREAD

    got = {r.doc_id: (r.added, r.removed) for r in plans.QUERIES["txt_16_reread_changes"](spark, data).collect()}
    texts = Tables(spark, data).texts.select("doc_id", "text").collect()
    want = {}
    for doc, text in texts:
        old, new = ({key for key, *_ in E.Reader(lex).read(text)} for lex in (E.DEFAULT, REREAD))
        want[doc] = (len(new - old), len(old - new))
    assert got == want and len(got) == len(texts)
    assert sum(x > 0 for x, _ in got.values()) > len(got) / 20 and sum(x > 0 for _, x in got.values()) > len(got) / 20
