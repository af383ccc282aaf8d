"""Checks and writes around topics: names, choices, plans, feeds, seeds, publication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def allocate_slugs(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """(owner, id, slug): ``base``, else ``base-2``, ``base-3`` and so on, the first that neither ``held`` nor an earlier row has.

    ``wanted``: owner, id, base, served in order of id.  ``held``: owner, slug.  Of the first
    ``rows + held`` names of a base enough are free, so no step looks at one name after the other.
    """
    mine = wanted.withColumn("n", F.row_number().over(Window.partitionBy("owner", "base").orderBy("id")))
    bases = mine.groupBy("owner", "base").agg(F.max("n").alias("rows"))
    taken = held.distinct().groupBy("owner").agg(F.count("*").alias("taken"))
    names = bases.join(taken, "owner", "left").select("owner", "base", F.explode(F.sequence(F.lit(1), (F.col("rows") + F.coalesce("taken", F.lit(0))).cast("int"))).alias("i"))
    named = names.withColumn("slug", F.when(F.col("i") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", "i")))
    free = named.join(held, ["owner", "slug"], "left_anti").withColumn("n", F.row_number().over(Window.partitionBy("owner", "base").orderBy("i")))
    return mine.join(free, ["owner", "base", "n"]).select("owner", "id", "slug")


def first_failure(*rules: tuple[str, Column]) -> Column:
    """The name of the first rule that a row breaks, or ``ok``."""
    out = F.lit("ok")
    for name, broken in reversed(rules):
        out = F.when(broken, name).otherwise(out)
    return out


def check_choices(picks: DataFrame, known: DataFrame, held: DataFrame, cap: int, exactly: int | None = None) -> DataFrame:
    """(owner, picked, state) of each owner's ``picks`` (owner, item): empty, repeated, unknown, count and cap, in this order."""
    per = picks.join(known.select("item").distinct().withColumn("known", F.lit(True)), "item", "left").groupBy("owner").agg(
        F.count("item").alias("picked"), F.countDistinct("item").alias("kinds"), F.coalesce(F.bool_or(F.col("item").isNotNull() & F.col("known").isNull()), F.lit(False)).alias("strange")
    )
    full = per.join(held.groupBy("owner").agg(F.count("*").alias("held")), "owner", "left")
    count = F.lit(False) if exactly is None else F.col("picked") != exactly
    over = F.coalesce("held", F.lit(0)) + F.col("picked") > cap
    return full.select("owner", "picked", first_failure(("empty", F.col("picked") == 0), ("repeated", F.col("kinds") < F.col("picked")), ("unknown", F.col("strange")), ("count", count), ("cap", over)).alias("state"))


def check_plans(plans: DataFrame, members: DataFrame) -> DataFrame:
    """(plan, state) of plans (plan, topic, item): empty, repeated item, item outside the topic, else ok."""
    inside = members.select("topic", "item").distinct().withColumn("inside", F.lit(True))
    per = plans.join(inside, ["topic", "item"], "left").groupBy("plan").agg(F.count("item").alias("n"), F.countDistinct("item").alias("kinds"), F.count(F.when(F.col("item").isNotNull() & F.col("inside").isNull(), 1)).alias("outside"))
    return per.select("plan", first_failure(("empty", F.col("n") == 0), ("repeated", F.col("kinds") < F.col("n")), ("outside", F.col("outside") > 0)).alias("state"))


def feed_health(items: DataFrame) -> DataFrame:
    """(feed, items, safe, state) of feeds' items (feed, link): links that can be shown, and whether a feed is usable."""
    per = items.groupBy("feed").agg(F.count("link").alias("items"), F.count(F.when(F.col("safe").isNotNull(), 1)).alias("safe"))
    return per.select("feed", "items", "safe", first_failure(("no items", F.col("items") == 0), ("no safe links", F.col("safe") == 0), ("some unsafe links", F.col("safe") < F.col("items"))).alias("state"))


def publish(new: DataFrame, old: DataFrame, topic: str, refused: Column) -> DataFrame:
    """All or nothing by topic: the new rows of topics without a refused row; the old rows of all others.

    One failed topic leaves the rest published, as the decision is an aggregate per topic.
    """
    state = new.groupBy(topic).agg(F.bool_or(F.coalesce(refused, F.lit(True))).alias("refused"))
    good = state.where(~F.col("refused")).select(topic)
    return new.join(good, topic, "left_semi").unionByName(old.join(good, topic, "left_anti"))
