"""Filters, joins, aggregates, windows, orders and set operations on the domain's views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..operators import relational as R
from .registry import query


def ms(c: str):
    return F.unix_millis(F.col(c))


def day(c: str):
    return F.date_format(F.col(c), "yyyy-MM-dd")


def joined(c, sep=","):
    return F.array_join(F.transform(F.sort_array(F.collect_set(c)), lambda x: x.cast("string")), sep)


# ---- scans and sinks -------------------------------------------------------


@query("SELECT article_id, source_id, CAST(epoch_ms(published_at) AS BIGINT) AS published_ms FROM articles WHERE article_id IN (1, 17, 999)")
def src_09_point_lookup(t) -> DataFrame:
    return t.articles.where(F.col("article_id").isin(1, 17, 999)).select("article_id", "source_id", ms("published_at").alias("published_ms"))


@query("SELECT article_id, source_id FROM articles ORDER BY published_at, article_id LIMIT 51 OFFSET 100")
def src_10_paged_scan(t) -> DataFrame:
    return t.articles.orderBy("published_at", "article_id").offset(100).limit(51).select("article_id", "source_id")


@query("SELECT article_id FROM articles WHERE article_id > 500 AND story_id IS NULL ORDER BY article_id LIMIT 40")
def src_11_keyset_scan(t) -> DataFrame:
    return t.articles.where("article_id > 500 AND story_id IS NULL").orderBy("article_id").limit(40).select("article_id")


@query("SELECT min(doc_id) AS doc_id, md5(text) AS digest FROM documents GROUP BY md5(text)")
def src_12_digest_dedupe(t) -> DataFrame:
    return R.latest(t.read("documents").select("doc_id", F.md5("text").alias("digest")), ["digest"], F.col("doc_id"))


@query("SELECT count(*) AS articles, count(DISTINCT source) AS sources, count(DISTINCT text) AS stories, count(DISTINCT lang) AS models, CAST(epoch_ms(max(published_at)) AS BIGINT) AS last_ms FROM texts")
def src_13_corpus_counts(t) -> DataFrame:
    return t.texts.agg(F.count("*").alias("articles"), F.countDistinct("source").alias("sources"), F.countDistinct(F.col("text")).alias("stories"), F.countDistinct("lang").alias("models"), F.unix_millis(F.max("published_at")).alias("last_ms"))


@query("SELECT DISTINCT user_id, k, first_value(event_id) OVER (PARTITION BY user_id, k ORDER BY CASE WHEN topic = 'view' THEN 0 ELSE 1 END, event_id) AS event_id FROM ev WHERE topic IN ('view', 'click')")
def snk_01_insert_ignore(t) -> DataFrame:
    cols = ["user_id", "k", "event_id"]
    held = R.latest(t.ev.where("topic = 'view'").select(*cols), ["user_id", "k"], F.col("event_id"))
    return R.insert_ignore(held, t.ev.where("topic = 'click'").select(*cols), ["user_id", "k"])


@query(
    "SELECT coalesce(n.user_id, o.user_id) AS user_id, coalesce(o.first_ms, n.first_ms) AS first_ms, coalesce(n.value, o.value) AS value FROM o FULL JOIN n ON o.user_id = n.user_id",
    "o AS (SELECT user_id, CAST(epoch_ms(min(ts)) AS BIGINT) AS first_ms, round(max(value), 2) AS value FROM ev WHERE topic = 'view' AND user_id % 3 > 0 GROUP BY 1), n AS (SELECT user_id, CAST(epoch_ms(min(ts)) AS BIGINT) AS first_ms, round(max(value), 2) AS value FROM ev WHERE topic = 'click' AND user_id % 2 = 0 GROUP BY 1)",
)
def snk_02_upsert_keeps_created(t) -> DataFrame:
    def of(df):
        return df.groupBy("user_id").agg(F.unix_millis(F.min("ts")).alias("first_ms"), F.round(F.max("value"), 2).alias("value"))

    return R.upsert(of(t.ev.where("topic = 'view' AND user_id % 3 > 0")), of(t.ev.where("topic = 'click' AND user_id % 2 = 0")), ["user_id"], kept=["first_ms"])


@query("SELECT DISTINCT user_id, k FROM ev WHERE topic = 'click' UNION SELECT DISTINCT user_id, k FROM ev WHERE topic = 'view' AND user_id NOT IN (SELECT user_id FROM ev WHERE topic = 'click')")
def snk_03_replace_membership(t) -> DataFrame:
    old, new = (t.ev.where(F.col("topic") == x).select("user_id", "k").distinct() for x in ("view", "click"))
    return old.join(new.select("user_id").distinct(), "user_id", "left_anti").unionByName(new)


@query("SELECT user_id, strftime(ts, '%Y-%m-%d') AS slot, min(event_id) AS winner FROM ev GROUP BY 1, 2")
def snk_04_atomic_claim(t) -> DataFrame:
    return t.ev.groupBy("user_id", day("ts").alias("slot")).agg(F.min("event_id").alias("winner"))


@query("SELECT CAST(v.vec_id AS BIGINT) AS vec_id, CASE WHEN v.vec_id % 3 = 0 THEN 'new' ELSE 'old' END AS model FROM embeddings v")
def snk_05_conditional_update(t) -> DataFrame:
    held = t.read("embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.col("vec_id") % 3 == 0, F.when(F.col("vec_id") % 2 == 0, " ")).otherwise("old").alias("old"))
    lacking = F.col("old").isNull() | (F.trim("old") == "")
    return held.join(held.select("vec_id", F.lit("new").alias("new")), "vec_id", "left").select("vec_id", F.when(lacking, F.col("new")).otherwise(F.col("old")).alias("model"))


@query("SELECT cluster_id, article_count FROM clusters WHERE last_seen_at >= (SELECT min(last_seen_at) FROM (SELECT last_seen_at FROM clusters ORDER BY last_seen_at DESC LIMIT 10))")
def snk_06_prune_newest(t) -> DataFrame:
    return R.prune(t.clusters, 10, "last_seen_at").select("cluster_id", "article_count")


@query("SELECT story_id, CAST(epoch_ms(least(min(published_at), TIMESTAMP '1998-01-01')) AS BIGINT) AS first_ms, CAST(epoch_ms(greatest(max(published_at), TIMESTAMP '1998-01-01')) AS BIGINT) AS last_ms FROM articles WHERE story_id IS NOT NULL GROUP BY 1")
def snk_07_widen(t) -> DataFrame:
    at = F.to_timestamp(F.lit("1998-01-01"))
    return t.articles.where("story_id IS NOT NULL").groupBy("story_id").agg(F.unix_millis(F.least(F.min("published_at"), at)).alias("first_ms"), F.unix_millis(F.greatest(F.max("published_at"), at)).alias("last_ms"))


# ---- filters ---------------------------------------------------------------


@query("SELECT article_id FROM articles WHERE source_id = 3 AND priority = '1-URGENT'")
def fil_01_optional_conjunction(t) -> DataFrame:
    return t.articles.where(R.all_of([F.col("source_id") == 3, None, F.col("priority") == "1-URGENT"])).select("article_id")


@query("SELECT article_id FROM articles WHERE source_id IN (2, 5, 7) AND priority NOT IN ('5-LOW', '2-HIGH')")
def fil_02_in_and_not_in(t) -> DataFrame:
    banned = t.spark.createDataFrame([("5-LOW",), ("2-HIGH",)], "priority string")
    return t.articles.where(F.col("source_id").isin(2, 5, 7)).join(banned, "priority", "left_anti").select("article_id")


@query("SELECT article_id FROM articles WHERE published_at >= TIMESTAMP '1998-01-01' AND published_at < TIMESTAMP '1998-02-01'")
def fil_03_half_open_range(t) -> DataFrame:
    return t.articles.where("published_at >= TIMESTAMP'1998-01-01' AND published_at < TIMESTAMP'1998-02-01'").select("article_id")


@query("SELECT article_id FROM articles WHERE published_at BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1998-01-31 23:59:59.999'")
def fil_04_closed_range(t) -> DataFrame:
    return t.articles.where(F.col("published_at").between(F.lit("1998-01-01").cast("timestamp"), F.lit("1998-01-31 23:59:59.999").cast("timestamp"))).select("article_id")


@query(
    "SELECT s.story_id, a.article_id FROM s JOIN articles a ON a.source_id = s.source_id AND s.first_at >= a.published_at - INTERVAL 72 HOUR AND s.last_at <= a.published_at + INTERVAL 72 HOUR",
    "s AS (SELECT story_id, min(source_id) AS source_id, min(published_at) AS first_at, max(published_at) AS last_at FROM articles WHERE story_id IS NOT NULL GROUP BY 1)",
)
def fil_05_crossed_bounds(t) -> DataFrame:
    stories = t.articles.where("story_id IS NOT NULL").groupBy("story_id").agg(F.min("source_id").alias("source_id"), F.min("published_at").alias("first_at"), F.max("published_at").alias("last_at"))
    return crossed(t.articles.select("article_id", "source_id", "published_at"), stories).select("story_id", "article_id")


def crossed(articles: DataFrame, stories: DataFrame, hours: int = C.STORY_WINDOW_HOURS) -> DataFrame:
    """Articles with the stories of their source whose whole range lies within ``hours`` of them.

    A range join by time buckets: both bounds lie within one window, so a story
    meets an article in the bucket of its first instant or the two beside it.
    """
    width = hours * 3600
    keyed = stories.withColumn("bucket", F.floor(F.unix_timestamp("first_at") / width))
    near = articles.withColumn("bucket", F.explode(F.array(*[F.floor(F.unix_timestamp("published_at") / width) + i for i in (-1, 0, 1)])))
    inside = (F.col("first_at") >= F.col("published_at") - F.expr(f"INTERVAL {hours} HOURS")) & (F.col("last_at") <= F.col("published_at") + F.expr(f"INTERVAL {hours} HOURS"))
    return near.join(keyed, ["source_id", "bucket"]).where(inside)


@query("SELECT count(*) AS no_story, (SELECT count(*) FROM articles WHERE story_id IS NOT NULL) AS with_story FROM articles WHERE story_id IS NULL")
def fil_06_null_checks(t) -> DataFrame:
    return t.articles.agg(F.count_if(F.col("story_id").isNull()).alias("no_story"), F.count_if(F.col("story_id").isNotNull()).alias("with_story"))


@query("SELECT cluster_id FROM clusters, clock WHERE state = 'archive' OR created_at >= now - INTERVAL 3500 DAY")
def fil_07_retention(t) -> DataFrame:
    return t.clusters.join(F.broadcast(t.clock)).where((F.col("state") == "archive") | (F.col("created_at") >= F.col("now") - F.expr("INTERVAL 3500 DAYS"))).select("cluster_id")


@query("SELECT topic_id FROM (SELECT topic_id, ',' || string_agg(CAST(source_id AS VARCHAR), ',') || ',' AS ids FROM topic_sources GROUP BY 1) WHERE strpos(ids, ',7,') > 0")
def fil_08_list_membership(t) -> DataFrame:
    lists = t.topic_sources.groupBy("topic_id").agg(F.collect_list("source_id").alias("ids"))
    return lists.where(F.array_contains("ids", F.lit(7).cast("long"))).select("topic_id")


@query("SELECT DISTINCT a.story_id FROM articles a WHERE a.story_id IS NOT NULL AND EXISTS (SELECT 1 FROM clusters c WHERE c.cluster_id = a.priority || '-' || CAST(a.source_id AS VARCHAR) AND c.state = 'active')")
def fil_09_exists(t) -> DataFrame:
    keyed = t.articles.where("story_id IS NOT NULL").withColumn("cluster_id", F.concat("priority", F.lit("-"), F.col("source_id").cast("string")))
    return keyed.join(t.clusters.where("state = 'active'"), "cluster_id", "left_semi").select("story_id").distinct()


@query("SELECT CAST(vec_id AS BIGINT) AS vec_id FROM (SELECT vec_id, CASE WHEN label = 1 THEN NULL WHEN label = 2 THEN '  ' ELSE 'm' END AS model FROM embeddings) WHERE model IS NULL OR trim(model) = ''")
def fil_10_no_embedding(t) -> DataFrame:
    held = t.read("embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.col("label") == 1, None).when(F.col("label") == 2, "  ").otherwise("m").alias("model"))
    return held.where(F.col("model").isNull() | (F.trim("model") == "")).select("vec_id")


@query("SELECT article_id, CASE WHEN published_at >= now - INTERVAL 7 DAY THEN 1 ELSE 0 END AS observed FROM articles, clock WHERE published_at >= now - INTERVAL 37 DAY")
def fil_11_indicator(t) -> DataFrame:
    return t.articles.join(F.broadcast(t.clock)).where(F.col("published_at") >= F.col("now") - F.expr("INTERVAL 37 DAYS")).select("article_id", F.when(F.col("published_at") >= F.col("now") - F.expr("INTERVAL 7 DAYS"), 1).otherwise(0).alias("observed"))


@query("SELECT article_id, priority || ' ' || CAST(source_id AS VARCHAR) AS label FROM articles")
def fil_12_concat(t) -> DataFrame:
    return t.articles.select("article_id", F.concat_ws(" ", "priority", F.col("source_id").cast("string")).alias("label"))


@query("SELECT seq, feedback_type IN ('thumbs_up', 'thumbs_down') AS verdict, scope IN ('global', 'this_topic') AS scoped FROM feedback WHERE scope IS NOT NULL")
def fil_13_enum_guards(t) -> DataFrame:
    return t.feedback.where("scope IS NOT NULL").select("seq", F.col("feedback_type").isin("thumbs_up", "thumbs_down").alias("verdict"), F.col("scope").isin("global", "this_topic").alias("scoped"))


# ---- joins -----------------------------------------------------------------


@query("SELECT ae.article_id, e.entity_id, e.kind, a.source_id FROM article_entities ae JOIN articles a ON a.article_id = ae.article_id JOIN entities e ON e.entity_id = ae.entity_id")
def join_01_mentions(t) -> DataFrame:
    return t.article_entities.join(t.articles.select("article_id", "source_id"), "article_id").join(R.small(t.entities.select("entity_id", "kind")), "entity_id").select("article_id", "entity_id", "kind", "source_id")


@query("SELECT DISTINCT ts.topic_id, ae.entity_id FROM topic_sources ts JOIN articles a ON a.source_id = ts.source_id JOIN article_entities ae ON ae.article_id = a.article_id, clock WHERE a.published_at >= now - INTERVAL 37 DAY AND a.published_at < now")
def join_02_owner_entities(t) -> DataFrame:
    recent = t.articles.join(F.broadcast(t.clock)).where(F.col("published_at").between(F.col("now") - F.expr("INTERVAL 37 DAYS"), F.col("now")) & (F.col("published_at") < F.col("now"))).select("article_id", "source_id")
    return recent.join(R.small(t.topic_sources), "source_id").join(t.article_entities, "article_id").select("topic_id", "entity_id").distinct()


@query("SELECT DISTINCT story_id FROM articles a JOIN topic_sources s ON a.source_id = s.source_id WHERE s.topic_id = 2 AND story_id IS NOT NULL")
def join_03_semi(t) -> DataFrame:
    stories = t.articles.where("story_id IS NOT NULL")
    return stories.join(R.small(t.topic_sources.where("topic_id = 2")), "source_id", "left_semi").select("story_id").distinct()


@query("SELECT c.cluster_id, t.title FROM clusters c JOIN topics t ON t.topic_id = c.topic_id WHERE t.cadence = 'daily'")
def join_04_owned(t) -> DataFrame:
    return t.clusters.join(R.small(t.topics.where("cadence = 'daily'")), "topic_id").select("cluster_id", "title")


@query("SELECT s.source_id, l.topic_id FROM (SELECT topic_id, ',' || string_agg(CAST(source_id AS VARCHAR), ',') || ',' AS ids FROM topic_sources GROUP BY 1) l JOIN (SELECT DISTINCT source_id FROM articles) s ON strpos(l.ids, ',' || CAST(s.source_id AS VARCHAR) || ',') > 0")
def join_05_list_containment(t) -> DataFrame:
    lists = t.topic_sources.groupBy("topic_id").agg(F.collect_list("source_id").alias("ids"))
    return R.contained(lists, "ids", t.articles.select("source_id").distinct(), "source_id").select("source_id", "topic_id")


@query(
    "SELECT u.user_id, p.first_ms FROM u LEFT JOIN (SELECT user_id, sent_at, CAST(epoch_ms(sent_at) AS BIGINT) AS first_ms FROM (SELECT user_id, min(ts) AS sent_at FROM ev WHERE topic = 'purchase' GROUP BY 1)) p ON p.user_id = u.user_id AND p.sent_at BETWEEN u.signed_up AND u.signed_up + INTERVAL 24 HOUR",
    "u AS (SELECT user_id, min(ts) AS signed_up FROM ev GROUP BY 1)",
)
def join_06_left_with_range(t) -> DataFrame:
    users = t.ev.groupBy("user_id").agg(F.min("ts").alias("signed_up"))
    first = t.ev.where("topic = 'purchase'").groupBy("user_id").agg(F.min("ts").alias("at"))
    on = F.col("u.user_id").eqNullSafe(F.col("p.user_id")) & F.col("p.at").between(F.col("u.signed_up"), F.col("u.signed_up") + F.expr("INTERVAL 24 HOURS"))
    return users.alias("u").join(first.alias("p"), on, "left").select("u.user_id", F.unix_millis("p.at").alias("first_ms"))


@query("SELECT story_id, article_id, source_id FROM (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY published_at, article_id) AS n FROM articles WHERE story_id IS NOT NULL) WHERE n = 1")
def join_07_oldest_article(t) -> DataFrame:
    first = F.min_by(F.struct("article_id", "source_id"), F.struct("published_at", "article_id"))
    return t.articles.where("story_id IS NOT NULL").groupBy("story_id").agg(first.alias("a")).select("story_id", "a.article_id", "a.source_id")


@query("SELECT c.c_custkey AS story_id, count(a.article_id) AS articles, count(DISTINCT a.source_id) AS sources, CAST(epoch_ms(min(a.published_at)) AS BIGINT) AS first_ms FROM customer c LEFT JOIN articles a ON a.story_id = c.c_custkey GROUP BY 1")
def join_08_left_counts(t) -> DataFrame:
    stories = t.read("customer").select(F.col("c_custkey").alias("story_id"))
    return stories.join(t.articles, "story_id", "left").groupBy("story_id").agg(F.count("article_id").alias("articles"), F.countDistinct("source_id").alias("sources"), F.unix_millis(F.min("published_at")).alias("first_ms"))


MEMBERS = "members AS (SELECT DISTINCT a.priority || '-' || CAST(a.source_id AS VARCHAR) AS cluster_id, a.story_id, a.article_id FROM articles a WHERE a.story_id IS NOT NULL)"


def members(t) -> DataFrame:
    return t.articles.where("story_id IS NOT NULL").select(F.concat("priority", F.lit("-"), F.col("source_id").cast("string")).alias("cluster_id"), "story_id", "article_id")


@query("SELECT m.cluster_id, count(DISTINCT story_id) AS stories, string_agg(DISTINCT CAST(story_id AS VARCHAR), ',' ORDER BY CAST(story_id AS VARCHAR)) AS story_ids FROM members m JOIN clusters c ON c.cluster_id = m.cluster_id WHERE c.state = 'active' GROUP BY 1", MEMBERS)
def join_09_membership(t) -> DataFrame:
    held = members(t).join(t.clusters.where("state = 'active'").select("cluster_id"), "cluster_id")
    return held.groupBy("cluster_id").agg(F.countDistinct("story_id").alias("stories"), joined(F.col("story_id").cast("string")).alias("story_ids"))


@query("SELECT m.cluster_id, count(DISTINCT ae.entity_id) AS entities, min(ae.entity_id) AS least, max(ae.entity_id) AS most FROM members m JOIN article_entities ae ON ae.article_id = m.article_id GROUP BY 1", MEMBERS)
def join_10_cluster_entities(t) -> DataFrame:
    return members(t).join(t.article_entities, "article_id").groupBy("cluster_id").agg(F.countDistinct("entity_id").alias("entities"), F.min("entity_id").alias("least"), F.max("entity_id").alias("most"))


@query("SELECT s.source_name, a.article_id, a.story_id FROM articles a JOIN topic_sources s ON s.source_id = a.source_id WHERE (s.source_name, a.article_id % 100) IN (SELECT 'NATION_3', 7 UNION ALL SELECT 'NATION_11', 42)")
def join_11_composite_lookup(t) -> DataFrame:
    wanted = t.spark.createDataFrame([("NATION_3", 7), ("NATION_11", 42)], "source_name string, tail long")
    named = t.articles.join(R.small(t.topic_sources), "source_id").withColumn("tail", F.col("article_id") % 100)
    return named.join(wanted, ["source_name", "tail"]).select("source_name", "article_id", "story_id")


@query("SELECT a.article_id, count(*) AS n, string_agg(e.canonical_name, '|' ORDER BY e.canonical_name) AS names FROM articles a JOIN article_entities ae ON ae.article_id = a.article_id JOIN entities e ON e.entity_id = ae.entity_id GROUP BY 1")
def join_12_hydrate(t) -> DataFrame:
    return t.articles.select("article_id").join(t.article_entities, "article_id").join(R.small(t.entities), "entity_id").groupBy("article_id").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("canonical_name")), "|").alias("names"))


@query("SELECT p.p_partkey AS entity_id FROM part p WHERE p.p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def join_15_anti(t) -> DataFrame:
    bought = t.read("lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("entity_id"))
    return t.entities.select("entity_id").join(bought, "entity_id", "left_anti")


@query("SELECT d.d AS slot, coalesce(string_agg(c.cluster_id, ',' ORDER BY c.cluster_id), '') AS clusters FROM (SELECT DISTINCT strftime(created_at, '%Y-%m-%d') AS d FROM clusters) d LEFT JOIN clusters c ON strftime(c.created_at, '%Y-%m-%d') = d.d AND c.state = 'active' GROUP BY 1")
def join_16_lookup_map(t) -> DataFrame:
    days = t.clusters.select(day("created_at").alias("slot")).distinct()
    active = t.clusters.where("state = 'active'").groupBy(day("created_at").alias("slot")).agg(joined("cluster_id").alias("clusters"))
    return days.join(active, "slot", "left").select("slot", F.coalesce("clusters", F.lit("")).alias("clusters"))


# ---- aggregates ------------------------------------------------------------


@query("SELECT strftime(published_at, '%Y-%m-%d') AS slot, count(*) AS articles, count(DISTINCT story_id) AS stories FROM articles GROUP BY 1")
def agg_01_02_by_day(t) -> DataFrame:
    return t.articles.groupBy(day("published_at").alias("slot")).agg(F.count("*").alias("articles"), F.countDistinct("story_id").alias("stories"))


@query("SELECT topic, user_id, count(*) FILTER (WHERE ts >= now - INTERVAL 7 DAY AND ts < now) AS observed, count(*) FILTER (WHERE ts >= now - INTERVAL 37 DAY AND ts < now - INTERVAL 7 DAY) AS baseline FROM ev, ev_clock GROUP BY 1, 2")
def agg_03_conditional_sums(t) -> DataFrame:
    ago = lambda n: F.col("now") - F.expr(f"INTERVAL {n} DAYS")
    obs, base = (F.col("ts") >= ago(7)) & (F.col("ts") < F.col("now")), (F.col("ts") >= ago(37)) & (F.col("ts") < ago(7))
    return t.ev.join(F.broadcast(t.ev_clock)).groupBy("topic", "user_id").agg(F.count_if(obs).alias("observed"), F.count_if(base).alias("baseline"))


@query("SELECT k, string_agg(d || ':' || CAST(n AS VARCHAR), ',' ORDER BY d) AS series, CAST(sum(n) AS BIGINT) AS total FROM (SELECT k, strftime(ts, '%Y-%m-%d') AS d, count(*) AS n FROM ev GROUP BY 1, 2) GROUP BY 1")
def agg_04_05_fold_series(t) -> DataFrame:
    daily = t.ev.groupBy("k", day("ts").alias("d")).agg(F.count("*").alias("n"))
    series = F.transform(F.sort_array(F.collect_list(F.struct("d", "n"))), lambda x: F.concat(x["d"], F.lit(":"), x["n"].cast("string")))
    return daily.groupBy("k").agg(F.array_join(series, ",").alias("series"), F.sum("n").alias("total"))


@query("SELECT DISTINCT user_id, k FROM ev")
def agg_06_distinct_pairs(t) -> DataFrame:
    return t.ev.select("user_id", "k").distinct()


@query("SELECT source_id, count(*) AS articles FROM articles, clock WHERE published_at >= now - INTERVAL 37 DAY GROUP BY 1")
def agg_07_source_volume(t) -> DataFrame:
    return t.articles.join(F.broadcast(t.clock)).where(F.col("published_at") >= F.col("now") - F.expr("INTERVAL 37 DAYS")).groupBy("source_id").agg(F.count("*").alias("articles"))


@query("SELECT story_id, CAST(sum(n) AS BIGINT) AS articles, string_agg(CAST(source_id AS VARCHAR), ',' ORDER BY source_id) AS sources FROM (SELECT story_id, source_id, count(*) AS n FROM articles WHERE story_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
def agg_08_story_sources(t) -> DataFrame:
    return t.articles.where("story_id IS NOT NULL").groupBy("story_id").agg(F.count("*").alias("articles"), joined("source_id").alias("sources"))


@query("SELECT user_id, CAST(epoch_ms(min(ts)) AS BIGINT) AS first_ms FROM ev WHERE topic = 'purchase' GROUP BY 1")
def agg_09_first_sent(t) -> DataFrame:
    return t.ev.where("topic = 'purchase'").groupBy("user_id").agg(F.unix_millis(F.min("ts")).alias("first_ms"))


@query("SELECT count(*) AS articles, count(story_id) AS with_story FROM articles")
def agg_10_global_counts(t) -> DataFrame:
    return t.articles.agg(F.count("*").alias("articles"), F.count("story_id").alias("with_story"))


@query("SELECT CAST(epoch_ms(max(last_seen_at)) AS BIGINT) AS now_ms FROM clusters")
def agg_11_corpus_now(t) -> DataFrame:
    return t.clusters.agg(F.unix_millis(F.max("last_seen_at")).alias("now_ms"))


@query("SELECT story_id, CAST(epoch_ms(min(published_at)) AS BIGINT) AS first_ms, CAST(epoch_ms(max(published_at)) AS BIGINT) AS last_ms FROM articles WHERE story_id IS NOT NULL GROUP BY 1")
def agg_12_story_range(t) -> DataFrame:
    return t.articles.where("story_id IS NOT NULL").groupBy("story_id").agg(F.unix_millis(F.min("published_at")).alias("first_ms"), F.unix_millis(F.max("published_at")).alias("last_ms"))


@query("SELECT topic_id, string_agg(source_name, ' | ' ORDER BY source_name) AS names FROM topic_sources GROUP BY 1")
def agg_13_group_concat(t) -> DataFrame:
    return t.topic_sources.groupBy("topic_id").agg(F.array_join(F.sort_array(F.collect_list("source_name")), " | ").alias("names"))


@query("SELECT topic_id, max(position) + 1 AS next_position FROM topic_sources GROUP BY 1")
def agg_14_next_position(t) -> DataFrame:
    return t.topic_sources.groupBy("topic_id").agg((F.max("position") + 1).alias("next_position"))


@query("SELECT ae.entity_id, count(DISTINCT a.story_id) AS df, round(ln(1 + (SELECT count(DISTINCT story_id) FROM articles) * 1.0 / count(DISTINCT a.story_id)), 6) AS idf FROM article_entities ae JOIN articles a ON a.article_id = ae.article_id WHERE a.story_id IS NOT NULL GROUP BY 1")
def agg_15_idf(t) -> DataFrame:
    stories = t.articles.where("story_id IS NOT NULL").select("article_id", "story_id")
    n = stories.agg(F.countDistinct("story_id").alias("n"))
    df = t.article_entities.join(stories, "article_id").groupBy("entity_id").agg(F.countDistinct("story_id").alias("df"))
    return df.join(F.broadcast(n)).select("entity_id", "df", F.round(F.log(1 + F.col("n") / F.col("df")), 6).alias("idf"))


@query("SELECT topic_id, round(sum(CASE WHEN state = 'active' THEN 1.0 ELSE 0.0 END) / nullif(count(*), 0), 6) AS share, round(avg(article_count), 6) AS mean FROM clusters GROUP BY 1")
def agg_16_ratios(t) -> DataFrame:
    return t.clusters.groupBy("topic_id").agg(F.round(F.try_divide(F.sum(F.when(F.col("state") == "active", 1.0).otherwise(0.0)), F.count("*")), 6).alias("share"), F.round(F.avg("article_count"), 6).alias("mean"))


VELOCITY = "velocity AS (SELECT story_id, round(count(*) * 1.0 / greatest(1.0, (epoch_ms(max(published_at)) - epoch_ms(min(published_at))) / 86400000.0 / 60), 2) AS v FROM articles WHERE story_id IS NOT NULL GROUP BY 1)"


def velocity(t) -> DataFrame:
    span = (F.unix_millis(F.max("published_at")) - F.unix_millis(F.min("published_at"))) / 86400000.0 / 60
    return t.articles.where("story_id IS NOT NULL").groupBy("story_id").agg(F.round(F.count("*") / F.greatest(F.lit(1.0), span), 2).alias("v"))


@query("SELECT CASE WHEN v < 0.5 THEN 0 WHEN v < 1 THEN 1 WHEN v < 1.5 THEN 2 WHEN v < 2 THEN 3 WHEN v < 3 THEN 4 WHEN v < 5 THEN 5 ELSE 6 END AS bin, count(*) AS n FROM velocity GROUP BY 1", VELOCITY)
def agg_17_histogram(t) -> DataFrame:
    edges = C.VELOCITY_EDGES[1:]
    bin_ = reduce(lambda e, i: e.when(F.col("v") < edges[i], i), range(1, len(edges)), F.when(F.col("v") < edges[0], 0)).otherwise(len(edges))
    return velocity(t).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT max(CASE WHEN v < 1.5 THEN v END) AS below, min(CASE WHEN v >= 1.5 THEN v END) AS above FROM velocity", VELOCITY)
def agg_18_open_interval(t) -> DataFrame:
    v, at = F.col("v"), C.ACTIVE_VELOCITY
    return velocity(t).agg(F.max(F.when(v < at, v)).alias("below"), F.min(F.when(v >= at, v)).alias("above"))


@query("SELECT CAST(x.t AS DOUBLE) AS threshold, count(*) FILTER (WHERE v >= x.t) AS active FROM velocity, (SELECT unnest([0.25, 0.5, 1, 1.5, 2, 3, 5]) AS t) x GROUP BY 1", VELOCITY)
def agg_19_threshold_curve(t) -> DataFrame:
    counts = velocity(t).agg(*[F.count_if(F.col("v") >= x).alias(str(i)) for i, x in enumerate(C.VELOCITY_CURVE)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(x).alias("threshold"), F.col(str(i)).alias("active")) for i, x in enumerate(C.VELOCITY_CURVE)])).alias("r")).select("r.*")


@query("SELECT CAST(least(len(list_filter(string_split(body, '.'), lambda x: length(trim(x, ' ')) >= 24)), 3) AS BIGINT) AS bullets, count(*) AS n FROM texts GROUP BY 1")
def agg_20_bullet_distribution(t) -> DataFrame:
    bullets = F.size(F.filter(F.split("body", r"\."), lambda x: F.length(F.trim(x)) >= 24))
    return t.texts.groupBy(F.least(bullets, F.lit(3)).cast("long").alias("bullets")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS fetched, count(DISTINCT (user_id, k)) AS inserted, count(*) FILTER (WHERE topic = 'error') AS failures FROM ev")
def agg_22_cycle_counters(t) -> DataFrame:
    return t.ev.agg(F.count("*").alias("fetched"), F.countDistinct("user_id", "k").alias("inserted"), F.count_if(F.col("topic") == "error").alias("failures"))


@query("SELECT k, topic FROM (SELECT k, topic, row_number() OVER (PARTITION BY k ORDER BY n DESC, first_id) AS r FROM (SELECT k, topic, count(*) AS n, min(event_id) AS first_id FROM ev GROUP BY 1, 2)) WHERE r = 1")
def agg_23_majority(t) -> DataFrame:
    votes = t.ev.groupBy("k", "topic").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))
    return votes.groupBy("k").agg(F.max_by("topic", F.struct("n", -F.col("first_id"))).alias("topic"))


# ---- windows ---------------------------------------------------------------


@query("SELECT cluster_id, count(*) OVER () AS total FROM clusters WHERE state = 'active' ORDER BY created_at DESC, cluster_id DESC LIMIT 25 OFFSET 25")
def win_01_total_beside_page(t) -> DataFrame:
    return R.page(t.clusters.where("state = 'active'"), 25, C.PAGE_SIZE, F.desc("created_at"), F.desc("cluster_id")).select("cluster_id", "total")


@query("SELECT user_id, cluster_id, feedback_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, cluster_id ORDER BY ts DESC, seq DESC) AS n FROM feedback WHERE feedback_type IN ('thumbs_up', 'thumbs_down')) WHERE n = 1")
def win_02_latest_per_group(t) -> DataFrame:
    return R.latest(t.feedback.where(F.col("feedback_type").isin("thumbs_up", "thumbs_down")), ["user_id", "cluster_id"], F.desc("ts"), F.desc("seq")).select("user_id", "cluster_id", "feedback_type")


@query("SELECT story_id, article_id FROM (SELECT story_id, article_id, row_number() OVER (PARTITION BY story_id ORDER BY published_at DESC, article_id) AS n FROM articles WHERE story_id IS NOT NULL) WHERE n = 1")
def win_03_top_per_story(t) -> DataFrame:
    return R.latest(t.articles.where("story_id IS NOT NULL"), ["story_id"], F.desc("published_at"), F.col("article_id")).select("story_id", "article_id")


@query("SELECT p_name, min(p_partkey) AS first_key FROM part GROUP BY 1")
def win_04_first_wins(t) -> DataFrame:
    return R.latest(t.read("part"), ["p_name"], F.col("p_partkey")).select("p_name", F.col("p_partkey").alias("first_key"))


@query("SELECT event_id, w AS window_ms, n <= 2 AS allowed FROM (SELECT event_id, CAST(epoch_ms(ts) // 3600000 * 3600000 AS BIGINT) AS w, row_number() OVER (PARTITION BY user_id, epoch_ms(ts) // 3600000 ORDER BY ts, event_id) AS n FROM ev)")
def win_05_rate_limit(t) -> DataFrame:
    w = F.unix_millis(F.window("ts", "1 hour")["start"])
    n = F.row_number().over(Window.partitionBy("user_id", "window_ms").orderBy("ts", "event_id"))
    return t.ev.withColumn("window_ms", w).select("event_id", "window_ms", (n <= 2).alias("allowed"))


# ---- orders ----------------------------------------------------------------


@query("SELECT article_id FROM articles ORDER BY published_at DESC, article_id DESC LIMIT 25 OFFSET 50")
def ord_01_archive_page(t) -> DataFrame:
    offset = min(int(60 // C.PAGE_SIZE) * C.PAGE_SIZE, C.MOST_OFFSET)
    return t.articles.orderBy(F.desc("published_at"), F.desc("article_id")).offset(offset).limit(C.PAGE_SIZE).select("article_id")


@query("SELECT cluster_id, topic_id FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY article_count DESC, created_at DESC, cluster_id) AS n FROM clusters WHERE state = 'active') WHERE n <= 5")
def ord_06_plan_top_k(t) -> DataFrame:
    w = Window.partitionBy("topic_id").orderBy(F.desc("article_count"), F.desc("created_at"), "cluster_id")
    return t.clusters.where("state = 'active'").withColumn("n", F.row_number().over(w)).where(F.col("n") <= C.BRIEF_CLUSTERS).select("cluster_id", "topic_id")


@query("SELECT source_id, source_name, topic_id FROM topic_sources ORDER BY topic_id, source_name LIMIT 12")
def ord_09_directory(t) -> DataFrame:
    return t.topic_sources.orderBy("topic_id", "source_name").limit(12).select("source_id", "source_name", "topic_id")


@query("SELECT seq, feedback_type FROM feedback WHERE user_id = 8 ORDER BY ts DESC, seq DESC LIMIT 20")
def ord_10_feedback_events(t) -> DataFrame:
    return t.feedback.where("user_id = 8").orderBy(F.desc("ts"), F.desc("seq")).limit(20).select("seq", "feedback_type")


@query("SELECT topic_id FROM (SELECT topic_id, row_number() OVER (ORDER BY title DESC, topic_id DESC) AS n FROM topics) WHERE n <= 3")
def ord_11_topic_reduction(t) -> DataFrame:
    return t.topics.orderBy(F.desc("title"), F.desc("topic_id")).limit(C.FREE_TOPICS).select("topic_id")


@query("SELECT event_id FROM ev WHERE user_id = 46 ORDER BY ts DESC, event_id DESC LIMIT 10")
def ord_12_recent_runs(t) -> DataFrame:
    return t.ev.where("user_id = 46").orderBy(F.desc("ts"), F.desc("event_id")).limit(10).select("event_id")


@query(
    "SELECT cell, recall, precision_ FROM cells a WHERE NOT EXISTS (SELECT 1 FROM cells b WHERE b.recall >= a.recall AND b.precision_ >= a.precision_ AND (b.recall > a.recall OR b.precision_ > a.precision_))",
    "cells AS (SELECT k AS cell, round(avg(CASE WHEN topic IN ('click', 'purchase') THEN 1.0 ELSE 0.0 END), 6) AS recall, round(avg(CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END), 6) AS precision_ FROM ev GROUP BY 1)",
)
def ord_13_pareto(t) -> DataFrame:
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    cells = t.ev.groupBy(F.col("k").alias("cell")).agg(share(F.col("topic").isin("click", "purchase")).alias("recall"), share(F.col("value") > 20).alias("precision_"))
    return pareto(cells, "recall", "precision_")


pareto = R.pareto


# ---- set operations --------------------------------------------------------


@query("SELECT 'article' AS kind, CAST(article_id AS VARCHAR) AS item_id FROM articles UNION ALL SELECT 'cluster', cluster_id FROM clusters UNION ALL SELECT 'entity', CAST(entity_id AS VARCHAR) FROM entities UNION ALL SELECT 'feedback', CAST(seq AS VARCHAR) FROM feedback UNION ALL SELECT 'text', CAST(doc_id AS VARCHAR) FROM texts")
def set_01_union_all(t) -> DataFrame:
    parts = (("article", t.articles, "article_id"), ("cluster", t.clusters, "cluster_id"), ("entity", t.entities, "entity_id"), ("feedback", t.feedback, "seq"), ("text", t.texts, "doc_id"))
    return reduce(DataFrame.unionByName, [df.select(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("item_id")) for kind, df, c in parts])


SETS = "sets AS (SELECT user_id, list_sort(list_distinct(list(k) FILTER (WHERE topic = 'click'))) AS a, list_sort(list_distinct(list(k) FILTER (WHERE topic = 'view'))) AS b FROM ev GROUP BY 1)"


def sets(t) -> DataFrame:
    of = lambda x: F.sort_array(F.collect_set(F.when(F.col("topic") == x, F.col("k"))))
    return t.ev.groupBy("user_id").agg(of("click").alias("a"), of("view").alias("b"))


@query("SELECT user_id, coalesce(len(list_intersect(a, b)), 0) AS shared, coalesce(len(list_distinct(list_concat(a, b))), 0) AS either_, coalesce(len(a), 0) - coalesce(len(list_intersect(a, b)), 0) AS only_a FROM sets", SETS)
def set_02_03_04_intersect_union_except(t) -> DataFrame:
    size = lambda c: F.size(c).cast("long")
    return sets(t).select("user_id", size(F.array_intersect("a", "b")).alias("shared"), size(F.array_union("a", "b")).alias("either_"), size(F.array_except("a", "b")).alias("only_a"))


@query("SELECT x.user_id AS left_id, y.user_id AS right_id FROM s2 x JOIN s2 y ON x.ks = y.ks AND x.user_id < y.user_id", "s2 AS (SELECT user_id, string_agg(DISTINCT topic, ',' ORDER BY topic) AS ks FROM ev WHERE value > 60 GROUP BY 1)")
def set_05_equality(t) -> DataFrame:
    s = t.ev.where("value > 60").groupBy("user_id").agg(joined("topic").alias("ks"))
    return R.pairs_within(s, ["ks"], "user_id").select(F.col("left").alias("left_id"), F.col("right").alias("right_id"))


@query("SELECT user_id, round(coalesce(len(list_intersect(a, b)) * 1.0 / nullif(len(list_distinct(list_concat(a, b))), 0), 0), 6) AS jaccard FROM sets", SETS)
def set_06_jaccard(t) -> DataFrame:
    from ..functions.similarity import jaccard

    return sets(t).select("user_id", F.round(jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


@query("SELECT source_id, min(topic_id * 100 + position) AS ord FROM topic_sources GROUP BY 1")
def set_07_ordered_distinct(t) -> DataFrame:
    return t.topic_sources.groupBy("source_id").agg(F.min(F.col("topic_id") * 100 + F.col("position")).alias("ord"))
