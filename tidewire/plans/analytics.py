"""Trends, archive, feedback, discovery, activation and briefs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import dates as D
from ..functions import text as T
from ..operators import archive as A
from ..operators import feedback as B
from ..operators import relational as R
from ..operators import search_index as X
from ..operators import trends as TR
from ..streaming.ingest import scratch
from .registry import query
from .relational import day, joined
from .scalars import settings

# ---- trends ----------------------------------------------------------------

VOLUME = "vol AS (SELECT s.topic_id, strftime(a.published_at, '%Y-%m-%d') AS slot, count(*) AS articles, count(DISTINCT a.story_id) AS stories FROM articles a JOIN topic_sources s ON s.source_id = a.source_id, clock WHERE a.published_at >= now - INTERVAL 37 DAY AND a.published_at < now GROUP BY 1, 2)"
AXIS = "axis AS (SELECT topic_id, strftime(unnest(generate_series(CAST(now - INTERVAL 37 DAY AS DATE), CAST(now AS DATE), INTERVAL 1 DAY)), '%Y-%m-%d') AS slot FROM topics, clock), filled AS (SELECT x.topic_id, x.slot, coalesce(v.articles, 0) AS articles, coalesce(v.stories, 0) AS stories FROM axis x LEFT JOIN vol v ON v.topic_id = x.topic_id AND v.slot = x.slot)"
BYDAY = "byday AS (SELECT topic_id, strftime(last_seen_at, '%Y-%m-%d') AS slot, string_agg(cluster_id, ',' ORDER BY cluster_id) AS clusters FROM clusters GROUP BY 1, 2)"
MENTIONS = "w AS (SELECT topic, user_id, count(*) FILTER (WHERE ts >= now - INTERVAL 7 DAY) AS observed, count(*) FILTER (WHERE ts < now - INTERVAL 7 DAY) AS baseline FROM ev, ev_clock WHERE ts >= now - INTERVAL 37 DAY AND ts < now GROUP BY 1, 2), e AS (SELECT *, CASE WHEN baseline > 0 THEN least(999.0, (observed / 7.0) / (baseline / 30.0)) WHEN observed > 0 THEN 999.0 ELSE 0.0 END AS lift FROM w), em AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY lift DESC, observed DESC, user_id) AS place FROM e WHERE lift >= 1.5 AND observed >= 3)"


def topic_articles(t) -> DataFrame:
    return t.articles.join(R.small(t.topic_sources.select("topic_id", "source_id")), "source_id")


def volume(t) -> DataFrame:
    return TR.volume(topic_articles(t), t.clock, "topic_id", "published_at")


def filled(t) -> DataFrame:
    return TR.zero_filled(volume(t), t.topics, t.clock, "topic_id")


def by_day(t) -> DataFrame:
    return t.clusters.groupBy("topic_id", day("last_seen_at").alias("slot")).agg(joined("cluster_id").alias("clusters"))


def mentions(t) -> DataFrame:
    return TR.emerging(TR.entity_windows(t.ev, t.ev_clock, "topic", "user_id"))


def placed(t) -> DataFrame:
    w = Window.partitionBy("topic").orderBy(F.desc("lift"), F.desc("observed"), "user_id")
    return mentions(t).withColumn("place", F.row_number().over(w))


@query("SELECT * FROM vol", VOLUME)
def trd_01_measure(t) -> DataFrame:
    return volume(t)


@query("SELECT * FROM byday", BYDAY)
def trd_02_clusters_by_day(t) -> DataFrame:
    return by_day(t)


@query("SELECT topic, user_id, observed, baseline, round(lift, 6) AS lift, place FROM em", MENTIONS)
def trd_03_lift(t) -> DataFrame:
    return placed(t).select("topic", "user_id", "observed", "baseline", F.round("lift", 6).alias("lift"), "place")


@query("SELECT * FROM filled", f"{VOLUME}, {AXIS}")
def trd_04_zero_filled(t) -> DataFrame:
    return filled(t)


@query("SELECT s.topic_id, s.slot, s.articles, b.clusters FROM (SELECT *, avg(articles) OVER (PARTITION BY topic_id) AS mean FROM filled) s JOIN byday b ON b.topic_id = s.topic_id AND b.slot = s.slot WHERE s.articles >= 3 AND s.articles > 1.5 * s.mean", f"{VOLUME}, {AXIS}, {BYDAY}")
def trd_05_spikes(t) -> DataFrame:
    return TR.spikes(filled(t), by_day(t), "topic_id")


@query("SELECT f.* FROM filled f, clock WHERE f.slot >= strftime(now - INTERVAL 2 DAY, '%Y-%m-%d')", f"{VOLUME}, {AXIS}")
def trd_06_free_tier(t) -> DataFrame:
    return TR.for_tier(filled(t), t.clock, "free")


@query("SELECT slot, CAST(sum(articles) AS BIGINT) AS articles, CAST(sum(stories) AS BIGINT) AS stories FROM filled GROUP BY 1", f"{VOLUME}, {AXIS}")
def trd_07_rollup_volume(t) -> DataFrame:
    return TR.rollup_volume(filled(t))


@query("SELECT user_id, topic, round(lift, 6) AS lift, baseline FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY lift DESC, topic) AS n FROM em) WHERE n = 1", MENTIONS)
def agg_21_rollup_entities(t) -> DataFrame:
    order = t.ev.select("topic").distinct().withColumn("ord", F.row_number().over(Window.orderBy("topic")))
    return TR.rollup_entities(placed(t), order, "topic", "user_id").select("user_id", "topic", F.round("lift", 6).alias("lift"), "baseline")


@query("SELECT topic, user_id, place FROM em WHERE place <= 10", MENTIONS)
def ord_02_emerging_order(t) -> DataFrame:
    return placed(t).where("place <= 10").select("topic", "user_id", "place")


@query("SELECT topic_id, CAST(sum(articles) AS BIGINT) AS articles, count(*) AS days FROM filled GROUP BY 1", f"{VOLUME}, {AXIS}")
def trd_08_09_stored_or_measured(t) -> DataFrame:
    """Topics with a stored trend are read, the others measured."""
    measured = filled(t).groupBy("topic_id").agg(F.sum("articles").alias("articles"), F.count("*").alias("days"))
    stored = measured.where("topic_id % 2 = 0")
    missing = t.topics.join(stored, "topic_id", "left_anti").select("topic_id")
    return stored.unionByName(measured.join(missing, "topic_id", "left_semi"))


@query("SELECT topic_id, max(articles) AS peak, count(*) AS points FROM filled GROUP BY 1", f"{VOLUME}, {AXIS}")
def trd_10_chart(t) -> DataFrame:
    from ..functions.numbers import place

    series = filled(t).groupBy("topic_id").agg(F.max("articles").alias("peak"), F.transform(F.sort_array(F.collect_list(F.struct("slot", "articles"))), lambda x: x["articles"]).alias("values"))
    return series.select("topic_id", "peak", F.size(place(F.col("values"), 40, 14, 664, 200)).cast("long").alias("points"))


# ---- archive ---------------------------------------------------------------

ITEMS = """
members2 AS (SELECT DISTINCT a.priority || '-' || CAST(a.source_id AS VARCHAR) AS cluster_id, s.topic_id, a.source_id FROM articles a JOIN topic_sources s ON s.source_id = a.source_id),
items AS (
 SELECT 'cluster' AS kind, cluster_id AS item_id, topic_id, cluster_id AS title, state AS body, created_at FROM clusters
 UNION ALL SELECT 'text', CAST(doc_id AS VARCHAR), doc_id % 5, title, body, published_at FROM texts
 UNION ALL SELECT 'snapshot', CAST(doc_id AS VARCHAR), doc_id % 5, title, '', published_at FROM texts WHERE doc_id % 10 = 0
 UNION ALL SELECT 'feedback', CAST(seq AS VARCHAR), topic_id, feedback_type, '', ts FROM feedback)
"""


def items(t) -> DataFrame:
    none, sources = F.array().cast("array<bigint>"), F.array(F.element_at(F.split("cluster_id", "-"), -1).cast("long"))
    clusters = t.clusters.select(F.lit("cluster").alias("kind"), F.col("cluster_id").alias("item_id"), "topic_id", F.col("cluster_id").alias("title"), F.col("state").alias("body"), "created_at", sources.alias("source_ids"), none.alias("entity_ids"))
    of = lambda kind, body: t.texts.select(F.lit(kind).alias("kind"), F.col("doc_id").cast("string").alias("item_id"), (F.col("doc_id") % 5).alias("topic_id"), "title", body.alias("body"), F.col("published_at").alias("created_at"), F.array(F.col("doc_id") % 20).alias("source_ids"), F.array(F.col("doc_id") % 50).alias("entity_ids"))
    said = t.feedback.select(F.lit("feedback").alias("kind"), F.col("seq").cast("string").alias("item_id"), "topic_id", F.col("feedback_type").alias("title"), F.lit("").alias("body"), F.col("ts").alias("created_at"), F.array("source_id").alias("source_ids"), none.alias("entity_ids"))
    return A.union(clusters, of("text", F.col("body")), of("snapshot", F.lit("")).where("CAST(item_id AS BIGINT) % 10 = 0"), said)


@query("SELECT kind, topic_id, count(*) AS n FROM items GROUP BY 1, 2", ITEMS)
def arc_01_items(t) -> DataFrame:
    return items(t).groupBy("kind", "topic_id").agg(F.count("*").alias("n"))


@query("SELECT kind, count(*) AS n, count(*) FILTER (WHERE title = 'retitled') AS changed FROM (SELECT kind, CASE WHEN kind = 'text' AND CAST(item_id AS BIGINT) % 100 = 0 THEN 'retitled' ELSE title END AS title FROM items) GROUP BY 1", ITEMS)
def arc_02_refresh(t) -> DataFrame:
    all_ = items(t)
    changed = all_.where("kind = 'text' AND try_cast(item_id AS BIGINT) % 100 = 0").withColumn("title", F.lit("retitled"))
    return A.refreshed(all_, changed).groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("title") == "retitled").alias("changed"))


#: The archive after three batches: all items, texts of every hundredth document rewritten, those of every seventh deleted.
CHANGED = f"""{ITEMS}, changed AS (
 SELECT kind, item_id, topic_id, CASE WHEN kind = 'text' AND TRY_CAST(item_id AS BIGINT) % 100 = 0 THEN 'retitled the end' ELSE title END AS title, CASE WHEN kind = 'text' AND TRY_CAST(item_id AS BIGINT) % 100 = 0 THEN 'and' ELSE body END AS body
 FROM items WHERE NOT (kind = 'text' AND TRY_CAST(item_id AS BIGINT) % 7 = 0)),
 hit AS (SELECT * FROM changed WHERE list_contains(string_split_regex(lower(concat_ws(' ', title, body)), '[^\\p{{L}}\\p{{N}}_]+'), 'the') AND list_contains(string_split_regex(lower(concat_ws(' ', title, body)), '[^\\p{{L}}\\p{{N}}_]+'), 'and'))
"""


def maintained(t) -> X.Index:
    all_ = items(t)
    index = X.Index(t.spark, scratch(t.spark), all_.schema)
    text = (F.col("kind") == "text") & F.col("item_id").try_cast("long").isNotNull()
    number = F.col("item_id").try_cast("long")
    batches = (
        all_.withColumn("deleted", F.lit(False)),
        all_.where(text & (number % 100 == 0)).withColumns({"title": F.lit("retitled the end"), "body": F.lit("and"), "deleted": F.lit(False)}),
        all_.where(text & (number % 7 == 0)).withColumn("deleted", F.lit(True)),
    )
    for i, changes in enumerate(batches):
        index.apply(changes.withColumn("seq", F.lit(i)), i)
    return index


@query("SELECT kind, item_id, topic_id, title FROM hit", CHANGED)
def arc_02_03_maintained_index(t) -> DataFrame:
    return maintained(t).search(["The", "and"]).select("kind", "item_id", "topic_id", "title")


@query("SELECT 'topic' AS facet, CAST(topic_id AS VARCHAR) AS value, count(*) AS n FROM hit GROUP BY 2 UNION ALL SELECT 'source', CAST(TRY_CAST(item_id AS BIGINT) % 20 AS VARCHAR), count(*) FROM hit WHERE kind IN ('text', 'snapshot') GROUP BY 2 UNION ALL SELECT 'entity', CAST(TRY_CAST(item_id AS BIGINT) % 50 AS VARCHAR), count(*) FROM hit WHERE kind IN ('text', 'snapshot') GROUP BY 2", CHANGED)
def arc_05_filtered_facets(t) -> DataFrame:
    """Facet counts of what a search finds, by intersection of lists; neither clusters nor feedback hold both words."""
    index = maintained(t)
    return index.facets(index.hits(["The", "and"]))


@query("SELECT kind, item_id FROM items WHERE list_contains(string_split_regex(lower(title || ' ' || body), '[^\\p{L}\\p{N}_]+'), 'the') AND list_contains(string_split_regex(lower(title || ' ' || body), '[^\\p{L}\\p{N}_]+'), 'and')", ITEMS)
def arc_03_match_all_terms(t) -> DataFrame:
    return A.having_terms(items(t), A.postings(items(t)), ["The", "and"]).select("kind", "item_id")


@query("SELECT kind, item_id, count(*) OVER () AS total FROM items WHERE (kind = 'snapshot' OR created_at >= TIMESTAMP '2024-01-05') AND topic_id IN (SELECT topic_id FROM topics) ORDER BY created_at DESC, kind DESC, item_id DESC LIMIT 25 OFFSET 50", ITEMS)
def arc_04_search(t) -> DataFrame:
    return A.search(items(t), t.topics, since=F.lit("2024-01-05").cast("timestamp"), offset=60).select("kind", "item_id", "total")


@query("SELECT 'topic' AS facet, CAST(topic_id AS VARCHAR) AS value FROM items WHERE topic_id < 5 UNION SELECT 'source', CAST(doc_id % 20 AS VARCHAR) FROM texts UNION SELECT 'source', CAST(source_id AS VARCHAR) FROM feedback WHERE topic_id < 5 UNION SELECT 'source', split_part(cluster_id, '-', len(string_split(cluster_id, '-'))) FROM clusters UNION SELECT 'entity', CAST(doc_id % 50 AS VARCHAR) FROM texts", ITEMS)
def arc_05_facets(t) -> DataFrame:
    return A.facets(items(t), t.topics)


# ---- feedback --------------------------------------------------------------

DECIDED = "decided AS (SELECT user_id, cluster_id, feedback_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, cluster_id, feedback_type IN ('thumbs_up', 'thumbs_down') ORDER BY ts DESC, seq DESC) AS n FROM feedback WHERE feedback_type <> 'hide_source') WHERE n = 1), sig AS (SELECT user_id, cluster_id, CAST(sum(CASE feedback_type WHEN 'thumbs_up' THEN 1 WHEN 'thumbs_down' THEN -1 WHEN 'more_like_this' THEN 2 ELSE -2 END) AS BIGINT) AS weight FROM decided GROUP BY 1, 2)"
HIDDEN = "hid AS (SELECT user_id, source_id, scope, CASE WHEN scope = 'global' THEN NULL ELSE topic_id END AS topic_id FROM (SELECT user_id, source_id, coalesce(scope, 'this_topic') AS scope, topic_id, row_number() OVER (PARTITION BY user_id, source_id ORDER BY ts DESC, seq DESC) AS n FROM feedback WHERE feedback_type = 'hide_source' AND (scope = 'global' OR topic_id <> 3)) WHERE n = 1)"


def hidden(t) -> DataFrame:
    """Topic 3 stands for one that cannot be resolved."""
    return B.hidden_sources(t.feedback.withColumn("topic_id", F.when(F.col("topic_id") != 3, F.col("topic_id"))))


@query("SELECT seq, CASE feedback_type WHEN 'thumbs_up' THEN 1 WHEN 'thumbs_down' THEN -1 WHEN 'more_like_this' THEN 2 WHEN 'less_like_this' THEN -2 ELSE 0 END AS weight FROM feedback")
def fbk_01_weights(t) -> DataFrame:
    return t.feedback.select("seq", B.weight(F.col("feedback_type")).alias("weight"))


@query("SELECT * FROM sig", DECIDED)
def fbk_02_signals(t) -> DataFrame:
    return B.signals(t.feedback).drop("active")


@query("SELECT * FROM hid", HIDDEN)
def fbk_03_hidden_sources(t) -> DataFrame:
    return hidden(t)


@query("SELECT DISTINCT user_id, source_id FROM hid WHERE scope = 'global' OR topic_id = 2", HIDDEN)
def fbk_04_hidden_in_topic(t) -> DataFrame:
    return B.hidden_in(hidden(t), 2)


STORY = "m AS (SELECT DISTINCT k AS cluster_id, k * 10 + k % 10 AS story_id FROM ev), st AS (SELECT event_id AS article_id, k * 10 + user_id % 10 AS story_id FROM ev)"


def story_members(t) -> tuple[DataFrame, DataFrame]:
    """Clusters with their story, and articles with theirs."""
    return t.ev.select(F.col("k").alias("cluster_id"), (F.col("k") * 10 + F.col("k") % 10).alias("story_id")).distinct(), t.ev.select(F.col("event_id").alias("article_id"), (F.col("k") * 10 + F.col("user_id") % 10).alias("story_id"))


@query("SELECT s.user_id, st.article_id, CAST(sum(s.weight) AS BIGINT) AS weight FROM sig s JOIN m ON m.cluster_id = s.cluster_id JOIN st ON st.story_id = m.story_id GROUP BY 1, 2", f"{DECIDED}, {STORY}")
def fbk_05_article_weights(t) -> DataFrame:
    m, st = story_members(t)
    return B.article_weights(B.signals(t.feedback), m, st)


@query("SELECT m.cluster_id, round(avg(coalesce(w.weight, 0)), 6) AS relevance FROM m JOIN st ON st.story_id = m.story_id LEFT JOIN (SELECT st.article_id, sum(s.weight) AS weight FROM sig s JOIN m ON m.cluster_id = s.cluster_id JOIN st ON st.story_id = m.story_id WHERE s.user_id = 8 GROUP BY 1) w ON w.article_id = st.article_id GROUP BY 1", f"{DECIDED}, {STORY}")
def fbk_06_relevance(t) -> DataFrame:
    m, st = story_members(t)
    weights = B.article_weights(B.signals(t.feedback.where("user_id = 8")), m, st).drop("user_id")
    return B.relevance(m.join(st, "story_id").select("cluster_id", "article_id"), weights).select("cluster_id", F.round("relevance", 6).alias("relevance"))


@query("SELECT c.cluster_id, c.topic_id FROM clusters c JOIN topics t ON t.topic_id = c.topic_id WHERE c.state = 'active' AND CAST(split_part(c.cluster_id, '-', len(string_split(c.cluster_id, '-'))) AS BIGINT) NOT IN (SELECT source_id FROM hid WHERE user_id = 8 AND (scope = 'global' OR topic_id = c.topic_id))", HIDDEN)
def fbk_07_living_brief(t) -> DataFrame:
    """Active clusters whose source the user has not hidden, globally or in the cluster's topic."""
    keyed = t.clusters.where("state = 'active'").withColumn("source_id", F.element_at(F.split("cluster_id", "-"), -1).cast("long"))
    h = hidden(t).where("user_id = 8").select("source_id", "scope", F.col("topic_id").alias("hidden_topic"))
    on = (keyed.source_id == h.source_id) & ((h.scope == "global") | (h.hidden_topic == keyed.topic_id))
    return keyed.join(h, on, "left_anti").join(R.small(t.topics.select("topic_id")), "topic_id", "left_semi").select("cluster_id", "topic_id")


@query("SELECT seq FROM (SELECT seq, feedback_type, lag(feedback_type) OVER (PARTITION BY user_id, cluster_id, CASE WHEN feedback_type IN ('thumbs_up', 'thumbs_down') THEN 'v' WHEN feedback_type = 'hide_source' THEN 'h' || CAST(source_id AS VARCHAR) || coalesce(scope, '') ELSE 'p' END ORDER BY ts, seq) AS before FROM feedback) WHERE before IS NULL OR before <> feedback_type")
def fbk_08_idempotent(t) -> DataFrame:
    return B.in_force_changes(t.feedback).select("seq")


@query("SELECT cluster_id, cluster_id AS same FROM (SELECT cluster_id, last_seen_at, article_count FROM clusters ORDER BY article_count DESC, last_seen_at DESC, cluster_id LIMIT 30)")
def ord_07_by_relevance(t) -> DataFrame:
    return t.clusters.orderBy(F.desc("article_count"), F.desc("last_seen_at"), "cluster_id").limit(30).select("cluster_id", F.col("cluster_id").alias("same"))


# ---- discovery -------------------------------------------------------------

OWNED = "owned AS (SELECT DISTINCT s.topic_id, a.source_id, ae.entity_id FROM topic_sources s JOIN articles a ON a.source_id = s.source_id JOIN article_entities ae ON ae.article_id = a.article_id, clock WHERE a.published_at >= now - INTERVAL 37 DAY AND a.published_at < now)"


def owned(t) -> DataFrame:
    recent = t.articles.join(F.broadcast(t.clock)).where((F.col("published_at") >= D.ago(F.col("now"), 37)) & (F.col("published_at") < F.col("now"))).select("article_id", "source_id")
    return recent.join(R.small(t.topic_sources.select("topic_id", "source_id")), "source_id").join(t.article_entities, "article_id").select("topic_id", "source_id", "entity_id").distinct()


@query("SELECT topic_id, count(DISTINCT source_id) AS sources, count(DISTINCT entity_id) AS entities FROM owned GROUP BY 1", OWNED)
def dsc_01_02_topics_with_entities(t) -> DataFrame:
    return owned(t).groupBy("topic_id").agg(F.countDistinct("source_id").alias("sources"), F.countDistinct("entity_id").alias("entities"))


@query("SELECT a.source_id, count(*) AS volume FROM articles a, clock WHERE a.published_at >= now - INTERVAL 37 DAY AND a.published_at < now GROUP BY 1")
def dsc_03_source_volume(t) -> DataFrame:
    recent = t.articles.join(F.broadcast(t.clock)).where((F.col("published_at") >= D.ago(F.col("now"), 37)) & (F.col("published_at") < F.col("now")))
    return recent.groupBy("source_id").agg(F.count("*").alias("volume"))


RECOMMENDED = """SELECT topic_id AS template_id, sources, entities, sources + entities AS score, row_number() OVER (ORDER BY sources + entities DESC, title, topic_id) AS place FROM (
SELECT t.topic_id, t.title,
(SELECT count(DISTINCT s.source_name) FROM linked s WHERE s.topic_id = t.topic_id AND s.source_name IN (SELECT source_name FROM linked WHERE topic_id IN (1, 4))) AS sources,
(SELECT count(DISTINCT o.entity_id) FROM owned o WHERE o.topic_id = t.topic_id AND o.entity_id IN (SELECT entity_id FROM owned WHERE topic_id IN (1, 4))) AS entities
FROM topics t WHERE t.topic_id NOT IN (1, 4) AND lower(t.title) NOT IN (SELECT lower(title) FROM topics WHERE topic_id IN (1, 4))) WHERE sources + entities > 0"""


@query(RECOMMENDED, OWNED + ", linked AS (SELECT topic_id, left(source_name, 1) AS source_name FROM topic_sources)")
def dsc_04_recommendations(t) -> DataFrame:
    """Templates for a user who holds topics 1 and 4; outlets are told apart by the initial of their name, so topics share some."""
    held = t.topics.where("topic_id IN (1, 4)").select("topic_id", "title")
    sources = t.topic_sources.select("topic_id", F.substring("source_name", 1, 1).alias("item"))
    entities = owned(t).select("topic_id", F.col("entity_id").alias("item"))
    return recommended(t.topics, held, sources, entities).withColumnRenamed("topic_id", "template_id")


def recommended(templates: DataFrame, held: DataFrame, sources: DataFrame, entities: DataFrame) -> DataFrame:
    """(topic_id, sources, entities, score, place): a point for each source and each entity shared with what is held, by score and title.

    ``templates`` and ``held``: topic_id, title.  ``sources`` and ``entities``: topic_id, item.  A template that is held,
    or whose title reads like a held one's, is left out, as is one that shares nothing.
    """
    key = T.title_key(F.coalesce("title", F.lit("")))
    free = templates.select("topic_id", "title", key.alias("key")).join(held.select("topic_id"), "topic_id", "left_anti").join(held.select(key.alias("key")), "key", "left_anti")

    def shared(of: DataFrame, name: str) -> DataFrame:
        mine = of.join(held.select("topic_id"), "topic_id", "left_semi").select("item").distinct()
        return of.distinct().join(mine, "item", "left_semi").groupBy("topic_id").agg(F.count("item").alias(name))

    none = {"sources": 0, "entities": 0}
    both = free.join(shared(sources, "sources"), "topic_id", "left").join(shared(entities, "entities"), "topic_id", "left").fillna(none)
    scored = both.select("topic_id", "title", "sources", "entities", (F.col("sources") + F.col("entities")).alias("score")).where("score > 0")
    return scored.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "title", "topic_id"))).drop("title")


@query("SELECT s.topic_id, CAST(sum(v.n) AS BIGINT) AS mentions FROM topic_sources s JOIN (SELECT source_id, count(*) AS n FROM articles, clock WHERE published_at >= now - INTERVAL 37 DAY AND published_at < now GROUP BY 1) v ON v.source_id = s.source_id GROUP BY 1")
def dsc_05_trending(t) -> DataFrame:
    return t.topic_sources.select("topic_id", "source_id").distinct().join(R.small(dsc_03_source_volume(t)), "source_id").groupBy("topic_id").agg(F.sum("volume").alias("mentions")).where("mentions > 0")


@query("SELECT topic_id, title, 2 < 3 AS can_clone FROM topics WHERE topic_id NOT IN (0, 2)")
def dsc_06_directory(t) -> DataFrame:
    held = t.spark.createDataFrame([(0,), (2,)], "topic_id long")
    return t.topics.join(held, "topic_id", "left_anti").select("topic_id", "title", (F.lit(2) < F.lit(C.FREE_TOPICS)).alias("can_clone"))


@query("SELECT user_id, greatest(0, count(DISTINCT topic) - 3) AS over_cap FROM ev GROUP BY 1")
def dsc_07_cap_overflow(t) -> DataFrame:
    return t.ev.groupBy("user_id").agg(F.greatest(F.lit(0), F.countDistinct("topic") - C.FREE_TOPICS).alias("over_cap"))


@query("SELECT s.topic_id, CAST(sum(v.n) AS BIGINT) AS mentions, row_number() OVER (ORDER BY sum(v.n) DESC, s.topic_id) AS place FROM topic_sources s JOIN (SELECT source_id, count(*) AS n FROM articles GROUP BY 1) v ON v.source_id = s.source_id GROUP BY 1")
def ord_08_trending_order(t) -> DataFrame:
    by = topic_articles(t).groupBy("topic_id").agg(F.count("*").alias("mentions"))
    return by.withColumn("place", F.row_number().over(Window.orderBy(F.desc("mentions"), "topic_id")))


# ---- activation and briefs -------------------------------------------------


@query("SELECT count(*) AS signed_up, count(p.user_id) AS activated FROM (SELECT user_id, min(ts) AS s FROM ev GROUP BY 1) u LEFT JOIN (SELECT user_id, min(ts) AS f FROM ev WHERE topic = 'purchase' GROUP BY 1) p ON p.user_id = u.user_id AND p.f BETWEEN u.s AND u.s + INTERVAL 24 HOUR")
def act_01_funnel(t) -> DataFrame:
    users = t.ev.groupBy("user_id").agg(F.min("ts").alias("s"), F.min(F.when(F.col("topic") == "purchase", F.col("ts"))).alias("f"))
    within = F.col("f").between(F.col("s"), F.col("s") + F.expr(f"INTERVAL {C.ACTIVATION_HOURS} HOURS"))
    return users.agg(F.count("*").alias("signed_up"), F.count_if(within).alias("activated"))


@query("SELECT topic_id, string_agg(cluster_id, ',' ORDER BY n) AS plan FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY article_count DESC, created_at DESC, cluster_id) AS n FROM clusters WHERE state = 'active') WHERE n <= 5 GROUP BY 1")
def brf_01_plan(t) -> DataFrame:
    w = Window.partitionBy("topic_id").orderBy(F.desc("article_count"), F.desc("created_at"), "cluster_id")
    top = t.clusters.where("state = 'active'").withColumn("n", F.row_number().over(w)).where(F.col("n") <= C.BRIEF_CLUSTERS)
    return top.groupBy("topic_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "cluster_id"))), lambda x: x["cluster_id"]), ",").alias("plan"))


@query()
def brf_02_due(t) -> DataFrame:
    """Settings whose slot is owed, without users that opted out and slots already claimed."""
    args = [F.col(c) for c in ("now", "recorded", "hour", "minute", "zone", "cadence", "weekday")]
    due = settings(t).select("user_id", D.due_cadence_slot(*args).alias("slot")).where("slot IS NOT NULL")
    opted_out = t.ev.where("topic = 'error' AND k = 99").select("user_id").distinct()
    claimed = due.where("user_id % 10 = 0")
    return due.join(opted_out, "user_id", "left_anti").join(claimed, ["user_id", "slot"], "left_anti").select("user_id", F.unix_millis("slot").alias("slot_ms"))


@query("SELECT event_id, CASE WHEN k % 9 = 0 THEN 'unknown' WHEN k % 9 = 1 THEN 'refused' WHEN ts < now - INTERVAL 20 DAY THEN 'expired' WHEN k % 9 = 2 THEN 'used' ELSE 'ok' END AS decision FROM ev, ev_clock")
def brf_03_token_decision(t) -> DataFrame:
    k, days = F.col("k") % 9, 20
    decision = F.when(k == 0, "unknown").when(k == 1, "refused").when(F.col("ts") < D.ago(F.col("now"), days), "expired").when(k == 2, "used").otherwise("ok")
    return t.ev.join(F.broadcast(t.ev_clock)).select("event_id", decision.alias("decision"))


@query("SELECT doc_id, title || chr(10) || '- ' || T AS brief FROM (SELECT doc_id, title, source AS T FROM texts)")
def brf_04_render_text(t) -> DataFrame:
    return t.texts.select("doc_id", F.concat_ws("\n- ", "title", "source").alias("brief"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE '' END AS cited FROM pages")
def brf_05_citations(t) -> DataFrame:
    evidence = F.when(F.col("page_id") % 2 == 0, F.array("url")).otherwise(F.array().cast("array<string>"))
    given = F.array("url", F.lit("https://made.up/"))
    return t.read("pages").select("page_id", F.array_join(F.filter(given, lambda u: F.array_contains(evidence, u)), ",").alias("cited"))


@query("SELECT topic, count(*) AS runs, count(*) FILTER (WHERE value > 20) AS sent FROM ev GROUP BY 1")
def brf_06_job_counters(t) -> DataFrame:
    return t.ev.groupBy("topic").agg(F.count("*").alias("runs"), F.count_if(F.col("value") > 20).alias("sent"))


@query("SELECT title AS statement, min(doc_id) AS doc_id FROM (SELECT doc_id, trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) AS title FROM texts) WHERE title <> '' GROUP BY 1")
def grp_11_url_for_statement(t) -> DataFrame:
    keyed = t.texts.select("doc_id", "published_at", T.normalize(F.col("title")).alias("statement")).where("statement <> ''")
    return keyed.groupBy("statement").agg(F.min_by("doc_id", F.struct("published_at", "doc_id")).alias("doc_id"))


