"""Archive: item rows, an inverted index, and search with totals and facets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from .relational import all_of, page

COLUMNS = ("kind", "item_id", "topic_id", "title", "body", "created_at", "source_ids", "entity_ids")


def union(*parts: DataFrame) -> DataFrame:
    """Item rows of all kinds, with ``COLUMNS``."""
    return reduce(DataFrame.unionByName, [p.select(*COLUMNS) for p in parts])


def postings(items: DataFrame) -> DataFrame:
    """(term, kind, item_id, topic_id): the whole words of title and body, folded."""
    text = F.lower(F.concat_ws(" ", "title", "body"))
    words = F.array_distinct(F.filter(F.split(text, r"[^\p{L}\p{N}_]+"), lambda w: w != ""))
    return items.select(F.explode(words).alias("term"), "kind", "item_id", "topic_id")


def having_terms(items: DataFrame, index: DataFrame, terms: list[str]) -> DataFrame:
    """Items that hold all terms, by the index: one equi-join on a few terms and a count."""
    terms = sorted({t.lower() for t in terms})
    found = index.where(F.col("term").isin(*terms)).groupBy("kind", "item_id", "topic_id").agg(F.count("*").alias("n")).where(F.col("n") == len(terms))
    return items.join(found, ["kind", "item_id", "topic_id"], "left_semi")


def search(items: DataFrame, topics: DataFrame, since=None, start=None, end=None, topic=None, source=None, entity=None, terms: list[str] | None = None, index: DataFrame | None = None, offset: int = 0, size: int = C.PAGE_SIZE) -> DataFrame:
    """A page of the owned items, newest first, with the total; no rows, and so no total, beyond the last page.

    ``since`` is the retention bound; snapshots are exempt from it.
    """
    owned = items.join(topics.select("topic_id"), "topic_id", "left_semi")
    kept = all_of(
        [
            None if since is None else (F.col("kind") == "snapshot") | (F.col("created_at") >= since),
            None if start is None else F.col("created_at") >= start,
            None if end is None else F.col("created_at") <= end,
            None if topic is None else F.col("topic_id") == topic,
            None if source is None else F.array_contains("source_ids", F.lit(source)),
            None if entity is None else F.array_contains("entity_ids", F.lit(entity)),
        ]
    )
    found = owned.where(kept)
    if terms:
        found = having_terms(found, index if index is not None else postings(items), terms)
    offset = min(offset // C.PAGE_SIZE * C.PAGE_SIZE, C.MOST_OFFSET)
    return page(found, offset, size, F.desc("created_at"), F.desc("kind"), F.desc("item_id"))


def facets(items: DataFrame, topics: DataFrame) -> DataFrame:
    """Topics, sources and entities that occur in the owned items."""
    owned = items.join(topics.select("topic_id"), "topic_id", "left_semi")
    of = lambda kind, c: owned.select(F.lit(kind).alias("facet"), c.alias("value")).select("facet", F.col("value").cast("string")).distinct()
    return of("topic", F.col("topic_id")).unionByName(of("source", F.explode("source_ids"))).unionByName(of("entity", F.explode("entity_ids")))


def refreshed(items: DataFrame, changed: DataFrame) -> DataFrame:
    """``items`` with all rows of the keys in ``changed`` replaced by those rows."""
    key = ["kind", "item_id", "topic_id"]
    return items.join(changed.select(*key).distinct(), key, "left_anti").unionByName(changed)
