"""Names, choices, plans, feeds, seeds and publication over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import refresh as H
from ..operators import service as S
from ..streaming.ingest import scratch
from .registry import query

WANTED = "want AS (SELECT c_nationkey AS owner, c_custkey AS id, lower(c_mktsegment) AS base FROM customer), held AS (SELECT DISTINCT s_nationkey AS owner, CASE WHEN s_suppkey % 4 = 0 THEN 'building' ELSE 'machinery-' || CAST(s_suppkey % 4 + 1 AS VARCHAR) END AS slug FROM supplier)"


@query(
    "SELECT CAST(w.owner AS BIGINT) AS owner, w.id, f.slug FROM (SELECT *, row_number() OVER (PARTITION BY owner, base ORDER BY id) AS n FROM want) w JOIN (SELECT owner, base, slug, row_number() OVER (PARTITION BY owner, base ORDER BY i) AS n FROM (SELECT b.owner, b.base, u.i, CASE WHEN u.i = 1 THEN b.base ELSE b.base || '-' || CAST(u.i AS VARCHAR) END AS slug FROM (SELECT owner, base, count(*) AS rows_ FROM want GROUP BY 1, 2) b, unnest(range(1, b.rows_ + 10)) AS u(i)) x WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.owner = x.owner AND h.slug = x.slug)) f ON f.owner = w.owner AND f.base = w.base AND f.n = w.n",
    WANTED,
)
def msc_06_slugs(t) -> DataFrame:
    want = t.read("customer").select(F.col("c_nationkey").cast("long").alias("owner"), F.col("c_custkey").alias("id"), T.slugify(F.col("c_mktsegment")).alias("base"))
    slug = F.when(F.col("s_suppkey") % 4 == 0, "building").otherwise(F.concat(F.lit("machinery-"), (F.col("s_suppkey") % 4 + 1).cast("string")))
    return S.allocate_slugs(want, t.read("supplier").select(F.col("s_nationkey").cast("long").alias("owner"), slug.alias("slug")).distinct())


@query("SELECT p.owner, picked, CASE WHEN picked = 0 THEN 'empty' WHEN kinds < picked THEN 'repeated' WHEN strange THEN 'unknown' WHEN picked <> 3 THEN 'count' WHEN coalesce(h.held, 0) + picked > 12 THEN 'cap' ELSE 'ok' END AS state FROM (SELECT user_id AS owner, count(k) AS picked, count(DISTINCT k) AS kinds, coalesce(bool_or(k >= 90), false) AS strange FROM (SELECT user_id, CASE WHEN topic <> 'error' THEN k END AS k FROM ev WHERE topic IN ('click', 'purchase', 'error')) GROUP BY 1) p LEFT JOIN (SELECT user_id, count(*) AS held FROM ev WHERE topic = 'view' GROUP BY 1) h ON h.user_id = p.owner")
def msc_07_choices(t) -> DataFrame:
    picks = t.ev.where(F.col("topic").isin("click", "purchase", "error")).select(F.col("user_id").alias("owner"), F.when(F.col("topic") != "error", F.col("k")).alias("item"))
    return S.check_choices(picks, t.ev.where("k < 90").select(F.col("k").alias("item")), t.ev.where("topic = 'view'").select(F.col("user_id").alias("owner")), cap=12, exactly=3)


@query("SELECT plan, CASE WHEN n = 0 THEN 'empty' WHEN kinds < n THEN 'repeated' WHEN outside > 0 THEN 'outside' ELSE 'ok' END AS state FROM (SELECT p.user_id AS plan, count(p.k) AS n, count(DISTINCT p.k) AS kinds, count(*) FILTER (WHERE p.k IS NOT NULL AND m.k IS NULL) AS outside FROM (SELECT user_id, user_id % 5 AS t, k FROM ev WHERE topic = 'purchase') p LEFT JOIN (SELECT DISTINCT user_id % 5 AS t, k FROM ev WHERE topic = 'click' AND k % 3 > 0) m ON m.t = p.t AND m.k = p.k GROUP BY 1)")
def msc_10_plan_checks(t) -> DataFrame:
    of = F.col("user_id") % 5
    plans = t.ev.where("topic = 'purchase'").select(F.col("user_id").alias("plan"), of.alias("topic"), F.col("k").alias("item"))
    return S.check_plans(plans, t.ev.where("topic = 'click' AND k % 3 > 0").select(of.alias("topic"), F.col("k").alias("item")))


@query("SELECT feed, items, safe, CASE WHEN items = 0 THEN 'no items' WHEN safe = 0 THEN 'no safe links' WHEN safe < items THEN 'some unsafe links' ELSE 'ok' END AS state FROM (SELECT page_id % 40 AS feed, count(url) AS items, count(*) FILTER (WHERE page_id % 3 <> 0 AND regexp_matches(url, '^https?://[^/?#]+')) AS safe FROM pages GROUP BY 1)")
def msc_14_feed_health(t) -> DataFrame:
    link = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("javascript:"), "url")).otherwise(F.col("url"))
    return S.feed_health(t.read("pages").select((F.col("page_id") % 40).alias("feed"), link.alias("link"), T.safe_external_url(link).alias("safe")))


@query("SELECT p_partkey AS id, CASE WHEN trim(p_name) = '' THEN 'no name' WHEN p_size < 1 THEN 'type' WHEN p_partkey NOT IN (SELECT l_partkey FROM lineitem) THEN 'unknown reference' WHEN count(*) OVER (PARTITION BY p_name, p_brand, p_size) > 1 THEN 'duplicate' ELSE 'ok' END AS state FROM part")
def msc_19_seed_rules(t) -> DataFrame:
    p = t.read("part")
    same = p.groupBy("p_name", "p_brand", "p_size").agg(F.count("*").alias("n"))
    known = t.read("lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("known", F.lit(True))
    rules = (("no name", F.trim("p_name") == ""), ("type", F.col("p_size") < 1), ("unknown reference", F.col("known").isNull()), ("duplicate", F.col("n") > 1))
    return p.join(same, ["p_name", "p_brand", "p_size"]).join(known, "p_partkey", "left").select(F.col("p_partkey").alias("id"), S.first_failure(*rules).alias("state"))


PUBLISHED = "fresh AS (SELECT user_id AS topic_id, k AS cluster, count(*) AS n, bool_or(topic = 'error' AND k > 80) AS bad FROM ev GROUP BY 1, 2), prior AS (SELECT user_id AS topic_id, min(k) AS cluster, CAST(0 AS BIGINT) AS n FROM ev GROUP BY 1), refused AS (SELECT topic_id FROM fresh GROUP BY 1 HAVING bool_or(bad))"


@query("SELECT topic_id, cluster, n FROM fresh WHERE topic_id NOT IN (SELECT topic_id FROM refused) UNION ALL SELECT topic_id, cluster, n FROM prior WHERE topic_id IN (SELECT topic_id FROM refused)", PUBLISHED)
def snk_08_publish_per_topic(t) -> DataFrame:
    """New clusters of a topic come all or not at all."""
    bad = F.bool_or((F.col("topic") == "error") & (F.col("k") > 80)).alias("bad")
    new = t.ev.groupBy(F.col("user_id").alias("topic_id"), F.col("k").alias("cluster")).agg(F.count("*").alias("n"), bad)
    old = t.ev.groupBy(F.col("user_id").alias("topic_id")).agg(F.min("k").alias("cluster")).withColumn("n", F.lit(0).cast("long")).withColumn("bad", F.lit(False))
    return S.publish(new, old, "topic_id", F.col("bad")).drop("bad")


@query("SELECT topic_id, hour, n FROM (SELECT user_id AS topic_id, strftime(ts, '%Y-%m-%d %H') AS hour, count(*) AS n FROM ev GROUP BY 1, 2) WHERE topic_id NOT IN (SELECT user_id FROM ev GROUP BY 1 HAVING max(value) > 95 OR max(value) IS NULL) UNION ALL SELECT user_id, strftime(min(ts), '%Y-%m-%d %H'), CAST(-1 AS BIGINT) FROM ev GROUP BY 1 HAVING max(value) > 95 OR max(value) IS NULL")
def stm_08_hourly_isolated(t) -> DataFrame:
    """Hourly counts by topic; a topic that fails keeps what it had, here one row of -1."""
    hour = F.date_format("ts", "yyyy-MM-dd HH")
    new = t.ev.groupBy(F.col("user_id").alias("topic_id"), hour.alias("hour")).agg(F.count("*").alias("n"), F.max("value").alias("top"))
    old = t.ev.groupBy(F.col("user_id").alias("topic_id")).agg(F.date_format(F.min("ts"), "yyyy-MM-dd HH").alias("hour")).withColumn("n", F.lit(-1).cast("long")).withColumn("top", F.lit(0.0))
    return S.publish(new, old, "topic_id", F.col("top") > 95).drop("top")


def hourly(rows: DataFrame) -> dict[str, DataFrame]:
    """Counts by hour and the highest value of a topic; a purchase above 20 in topics 3 and 11 raises."""
    bad = F.col("topic").isin(3, 11) & F.col("late") & (F.col("type") == "purchase") & (F.col("value") > 20)
    checked = F.when(bad, F.raise_error(F.lit("purchase out of range")).cast("double")).otherwise(F.col("value"))
    hour = F.date_format("ts", "yyyy-MM-dd HH").alias("hour")
    return {"hours": rows.groupBy("topic", hour).agg(F.count("*").alias("n"), F.max(checked).alias("top")), "totals": rows.groupBy("topic").agg(F.sum(F.when(F.col("type") == "click", 1).otherwise(0)).alias("clicks"))}


HALVES = "ts2 AS (SELECT user_id % 16 AS topic, topic AS type, ts, value, ts > (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM ev) AS late FROM ev), failed AS (SELECT DISTINCT topic FROM ts2 WHERE topic IN (3, 11) AND late AND type = 'purchase' AND value > 20), seen AS (SELECT * FROM ts2 WHERE NOT late OR topic NOT IN (SELECT topic FROM failed))"


def halves(t) -> tuple[DataFrame, DataFrame]:
    """The events of the first half of the time, and all of them."""
    a, b = t.ev.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).selectExpr("unix_micros(a) a", "unix_micros(b) b").first()
    middle = F.timestamp_micros(F.lit((a or 0) + ((b or 0) - (a or 0)) // 2))
    rows = t.ev.select((F.col("user_id") % 16).alias("topic"), F.col("topic").alias("type"), "ts", "value", (F.col("ts") > middle).alias("late"))
    return rows.where(~F.col("late")), rows


@query("SELECT h.topic, h.hour, h.n, h.top, c.clicks FROM (SELECT topic, strftime(ts, '%Y-%m-%d %H') AS hour, count(*) AS n, max(value) AS top FROM seen GROUP BY 1, 2) h JOIN (SELECT topic, CAST(count(*) FILTER (WHERE type = 'click') AS BIGINT) AS clicks FROM seen GROUP BY 1) c ON c.topic = h.topic", HALVES)
def stm_08_refreshed_topics(t) -> DataFrame:
    """Two hourly runs over two tables; topics whose second run raises keep both tables of the first."""
    first, both = halves(t)
    folder = scratch(t.spark)
    for rows in (first, both):
        H.refresh(rows, "topic", hourly, folder)
    hours, totals = (H.current(t.spark, folder, x, "topic").drop("run") for x in ("hours", "totals"))
    return hours.join(totals, "topic").select("topic", "hour", "n", "top", "clicks")


@query("SELECT topic, CAST(count(*) FILTER (WHERE type = 'click') AS BIGINT) AS clicks FROM ts2 WHERE NOT late OR topic % 4 > 1 GROUP BY 1 HAVING topic % 4 <> 1", HALVES)
def trd_08_09_read_through(t) -> DataFrame:
    """Topics of the first run are read as stored, asked ones that it lacks are measured over all rows."""
    first, both = halves(t)
    folder = scratch(t.spark)
    H.refresh(first.where("topic % 4 < 2"), "topic", lambda rows: {"totals": hourly(rows)["totals"]}, folder)
    asked = both.select("topic").where("topic % 4 <> 1")
    return H.read_through(both, asked, "topic", lambda rows: {"totals": hourly(rows)["totals"]}, folder, "totals").select("topic", "clicks")
