"""Trends: mention volume, emerging entities, spikes, tiers and rollups for all topics at once.

``mentions`` tables have topic, article, entity and an instant; ``now`` comes as
a one-row DataFrame and is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.dates import ago, day_axis, day_key
from ..functions.numbers import lift


def volume(articles: DataFrame, now: DataFrame, topic: str = "topic", at: str = "ts", story: str = "story_id") -> DataFrame:
    """Articles and distinct stories by topic and UTC day within baseline and observation."""
    span = C.OBSERVATION_DAYS + C.BASELINE_DAYS
    inside = (F.col(at) >= ago(F.col("now"), span)) & (F.col(at) < F.col("now"))
    return articles.join(F.broadcast(now)).where(inside).groupBy(topic, day_key(F.col(at)).alias("slot")).agg(F.count("*").alias("articles"), F.countDistinct(story).alias("stories"))


def zero_filled(counts: DataFrame, topics: DataFrame, now: DataFrame, topic: str = "topic") -> DataFrame:
    """One row for each topic and day of the axis; days without articles are zero."""
    span = C.OBSERVATION_DAYS + C.BASELINE_DAYS
    axis = topics.select(topic).join(F.broadcast(now)).select(topic, F.explode(day_axis(ago(F.col("now"), span), F.col("now"))).alias("slot"))
    return axis.join(counts, [topic, "slot"], "left").select(topic, "slot", F.coalesce("articles", F.lit(0)).alias("articles"), F.coalesce("stories", F.lit(0)).alias("stories"))


def entity_windows(mentions: DataFrame, now: DataFrame, topic: str = "topic", entity: str = "entity", at: str = "ts") -> DataFrame:
    """Mentions in observation and baseline by instant, not by day."""
    a, b = ago(F.col("now"), C.OBSERVATION_DAYS), ago(F.col("now"), C.OBSERVATION_DAYS + C.BASELINE_DAYS)
    inside = mentions.join(F.broadcast(now)).where((F.col(at) >= b) & (F.col(at) < F.col("now")))
    return inside.groupBy(topic, entity).agg(F.count_if(F.col(at) >= a).alias("observed"), F.count_if(F.col(at) < a).alias("baseline"))


def emerging(windows: DataFrame) -> DataFrame:
    """Entities whose daily rate rose enough, with their lift."""
    scored = windows.withColumn("lift", lift(F.col("observed"), C.OBSERVATION_DAYS, F.col("baseline"), C.BASELINE_DAYS))
    return scored.where((F.col("lift") >= C.EMERGING_LIFT) & (F.col("observed") >= C.EMERGING_MENTIONS))


def ranked(entities: DataFrame, topic: str, name: str) -> DataFrame:
    """Place within the topic by lift, mentions, then name in dictionary order."""
    w = Window.partitionBy(topic).orderBy(F.desc("lift"), F.desc("observed"), F.collate(name, "UNICODE"), name)
    return entities.withColumn("place", F.row_number().over(w))


def spikes(series: DataFrame, clusters_by_day: DataFrame, topic: str = "topic") -> DataFrame:
    """Days over 1.5 times the topic's mean, with at least three articles and a cluster of that day."""
    mean = F.avg("articles").over(Window.partitionBy(topic))
    high = series.withColumn("mean", mean).where((F.col("articles") >= C.SPIKE_ARTICLES) & (F.col("articles") > F.col("mean") * C.SPIKE_FACTOR))
    return high.join(clusters_by_day, [topic, "slot"]).drop("mean", "stories")


def for_tier(series: DataFrame, now: DataFrame, tier: str) -> DataFrame:
    """The free tier sees its last three UTC days, today included."""
    if tier != "free":
        return series
    return series.join(F.broadcast(now)).where(F.col("slot") >= day_key(ago(F.col("now"), C.FREE_HISTORY_DAYS - 1))).drop("now")


def rollup_volume(series: DataFrame) -> DataFrame:
    return series.groupBy("slot").agg(F.sum("articles").alias("articles"), F.sum("stories").alias("stories"))


def rollup_entities(ranked_entities: DataFrame, order: DataFrame, topic: str, entity: str) -> DataFrame:
    """Each entity once, from the topic where it rose most (the first topic of equal lifts); ``place`` follows first sight over topics in ``order`` (topic, ord)."""
    seen = ranked_entities.join(order, topic)
    first = F.min(F.struct("ord", "place")).over(Window.partitionBy(entity))
    best = F.row_number().over(Window.partitionBy(entity).orderBy(F.desc("lift"), "ord"))
    return seen.withColumn("first", first).withColumn("_n", best).where("_n = 1").drop("_n", "place", "ord").withColumn("first_ord", F.col("first.ord")).withColumn("first_place", F.col("first.place")).drop("first")
