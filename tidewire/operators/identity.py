"""Identity of names as they arrive, and of names already stored.

A short name (one word that may name a person) and the full names that end in it
after a given name are a family.  What a mention is resolved to depends on the
mentions before it, yet needs no walk through them: the first mentions of a
family's full names cut time into stretches, and all mentions of the short name
within one stretch are resolved alike.  So the work is aggregates by key and by
(short name, stretch) and joins of mentions with their results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.entities import DEFAULT, Lexicon, canonical_key, names_nothing
from ..session import checkpoint

#: A key is hot with over one in ``HOT`` of all rows, so fewer than ``HOT`` keys are; rows of hot keys are dealt over ``SALTS``.
HOT = 1000
SALTS = 64
SHORTEST = 3


def may_shorten(key: Column, lex: Lexicon = DEFAULT) -> Column:
    """Whether a key can be the short form of a fuller one."""
    return (F.length(key) >= SHORTEST) & ~key.contains(" ") & ~names_nothing(key, lex) & ~key.isin(*lex.noise_words)


def hot_keys(counts: DataFrame) -> DataFrame:
    """The hot ones of (key, n)."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.where(F.col("n") * HOT > F.lit(total)).select("key")


def _dealt(left: DataFrame, right: DataFrame, hot: DataFrame, how: str, by: str) -> DataFrame:
    """``left`` joined by key with the one row of ``right``; a hot key's rows are dealt by column ``by`` and meet copies of that row."""
    flag = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    many = F.sequence(F.lit(0), F.lit(SALTS - 1))
    rows = left.join(flag, "key", "left").withColumn("_s", F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).otherwise(0)).drop("_hot")
    copies = right.join(flag, "key", "left").withColumn("_s", F.explode(F.when(F.col("_hot"), many).otherwise(F.array(F.lit(0))))).drop("_hot")
    return rows.join(copies, ["key", "_s"], how).drop("_s")


def fuller_names(keys: DataFrame, given: DataFrame) -> DataFrame:
    """Rows of ``keys`` whose key is a given name and one word more, with that word as ``part``."""
    w = F.split("key", " ")
    return keys.where(F.size(w) == 2).withColumn("given", w[0]).withColumn("part", w[1]).join(given.select("given").distinct(), "given", "left_semi").drop("given")


def arrivals(mentions: DataFrame, stored: DataFrame, given: DataFrame, lex: Lexicon = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """The log of ``mentions`` and the entities after them.

    ``mentions``: seq (long, from 0), id (what a new entity would be called), name, kind, key.  ``stored``: id, name,
    kind, key of the entities so far, one row a key.  ``given``: given names.  Other columns are left out.

    Log: seq, key, resolution, entity.  A key that is stored is ``exact``.  A full name whose short form is stored is a
    ``takeover``: that entity gets the longer key and keeps its id, name and kind.  A short name with exactly one full
    name stored is that one (``fuller``).  Everything else is ``new``; so is a short name with several full names, which
    the next full name takes over.  A mention without a key names nothing: resolution and entity are null.

    Mentions are read in order of seq; of equal seq full names come first, then ids.  Calls on successive parts,
    each given the entities of the one before, give what one call on all gives.  Of a family's rows, as many meet in one
    task as there are given names before one word.
    """
    m = mentions.select("seq", "id", "name", "kind", "key")
    named = m.where("key <> ''")
    # Stored rows come before all mentions, full names before short ones.
    held = stored.where("key <> ''").select(F.when(F.col("key").contains(" "), -2).otherwise(-1).cast("long").alias("seq"), "id", "name", "kind", "key")
    both = named.unionByName(held)
    who = F.struct("seq", "id", "name", "kind")
    firsts = checkpoint(both.groupBy("key").agg(F.min(who).alias("first"), F.count("*").alias("n")))
    hot = checkpoint(hot_keys(firsts))

    full = fuller_names(firsts, given).where(may_shorten(F.col("part"), lex))
    bounds = checkpoint(full.groupBy(F.col("part").alias("key")).agg(F.sort_array(F.collect_list(F.struct(F.col("first.seq").alias("at"), F.col("key").alias("full")))).alias("bounds")))
    stretch = lambda b: F.size(F.filter(b, lambda x: x["at"] <= F.col("seq")))

    short = _dealt(both.where(~F.col("key").contains(" ")), bounds, hot, "inner", "seq").select("key", stretch(F.col("bounds")).alias("stretch"), F.size("bounds").alias("last"), who.alias("who"))
    makers = short.groupBy("key", "stretch", "last").agg(F.min("who").alias("maker"))
    makers = checkpoint(makers.where("stretch <> 1 OR maker.seq < 0"))

    slots = bounds.select(F.col("key").alias("part"), F.posexplode("bounds").alias("stretch", "b")).select("part", "stretch", F.col("b.at").alias("at"), F.col("b.full").alias("key"))
    taken = slots.where("at >= 0").join(makers.select(F.col("key").alias("part"), "stretch", "maker"), ["part", "stretch"]).select("key", "maker")
    # Keys other than short names of families: whose row they are.
    plain = firsts.join(bounds.select("key"), "key", "left_anti").join(taken, "key", "left")
    plain = plain.select("key", "first", F.coalesce("maker", "first").alias("row"), F.when(F.col("maker").isNotNull(), "takeover").otherwise("new").alias("how"))
    entities = plain.select("row.id", "row.name", "row.kind", "key").unionByName(makers.where("stretch = last").select("maker.id", "maker.name", "maker.kind", "key"))

    made = makers.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("stretch", F.struct("maker.seq", "maker.id")))).alias("made"))
    only = bounds.select(F.col("bounds")[0]["full"].alias("full"), F.col("key").alias("part"), "bounds").join(plain.select(F.col("key").alias("full"), F.col("row.id").alias("only")), "full")
    families = only.select(F.col("part").alias("key"), "bounds", "only").join(made, "key", "left")
    none = lambda c, like: F.lit(None).cast(like.schema[c].dataType).alias(c)
    target = plain.select("key", F.struct("first.seq", "first.id").alias("first"), F.col("row.id").alias("only"), "how", none("bounds", families), none("made", families))
    target = target.unionByName(families.select("key", F.lit(None).cast(target.schema["first"].dataType).alias("first"), "only", F.lit("fuller").alias("how"), "bounds", "made"))

    met = _dealt(named, target, hot, "inner", "seq").withColumn("maker", F.when(F.col("bounds").isNull(), F.col("first")).otherwise(F.try_element_at("made", stretch(F.col("bounds")))))
    begins = (F.col("maker.seq") == F.col("seq")) & F.col("maker.id").eqNullSafe(F.col("id"))
    how = F.when(F.col("maker").isNull(), "fuller").when(begins, F.when(F.col("bounds").isNull(), F.col("how")).otherwise("new")).otherwise("exact")
    whose = F.when(F.col("bounds").isNull(), F.col("only")).otherwise(F.coalesce("maker.id", "only"))
    log = met.select("seq", "key", how.alias("resolution"), whose.alias("entity"))
    nameless = m.where("key IS NULL OR key = ''").select("seq", "key", F.lit(None).cast("string").alias("resolution"), F.lit(None).cast(m.schema["id"].dataType).alias("entity"))
    return log.unionByName(nameless), entities


def reconcile_stored(entities: DataFrame, links: DataFrame, given: DataFrame, lex: Lexicon = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(id, name, kind, key) with one row a name under the present rules, and (article, entity) links that point to them, once each.

    ``entities``: id, name, kind, key.  Of the rows whose names have one key the row that is stored under it stays, else the one with the
    longest name, else the first id.  A short name beside full names becomes one with the full name that comes first in
    the same order.  A name that names nothing keeps its key, or its id if it has none; so does a row without a name.
    Links to entities that do not exist stay as they are.
    """
    rows = entities.select("id", "name", "kind", "key")
    folded = canonical_key(F.coalesce("name", F.lit("")), lex)
    own = F.coalesce(F.when(F.col("key") != "", F.col("key")), F.col("id").cast("string"))
    rows = rows.withColumn("to", F.when(names_nothing(folded, lex), own).otherwise(folded))
    order = F.struct((~F.col("key").eqNullSafe(F.col("to"))).alias("a"), (-F.length(F.coalesce("name", F.lit("")))).alias("b"), "id", "name", "kind")
    rows = checkpoint(rows.withColumn("order", order))
    live = rows.groupBy(F.col("to").alias("key")).agg(F.min("order").alias("keeper"))
    first = fuller_names(live, given).groupBy(F.col("part").alias("key")).agg(F.min(F.struct("keeper", F.col("key").alias("full"))).alias("first"))
    ends = checkpoint(live.join(first, "key", "left").select("key", F.coalesce("first.full", "key").alias("into"), F.coalesce("first.keeper", "keeper").alias("keeper")))
    kept = ends.where("key = into").select("keeper.id", "keeper.name", "keeper.kind", "key")
    moved = rows.select(F.col("to").alias("key"), F.col("id").alias("entity")).join(ends.select("key", F.col("keeper.id").alias("stands")), "key").where("entity <> stands").select(F.col("entity").alias("key"), "stands")
    used = links.select("article", F.col("entity").alias("key"))
    hot = checkpoint(hot_keys(used.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n"))))
    pointed = _dealt(used, moved, hot, "left", "article").select("article", F.coalesce("stands", "key").alias("entity")).distinct()
    return kept, pointed
