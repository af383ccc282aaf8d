"""Entities, signatures, grouping, streaming and evaluation over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import entities as E
from ..functions import similarity as S
from ..functions import text as T
from ..operators import backfill as K
from ..operators import evaluation as V
from ..operators import grouping as G
from ..operators import identity as N
from ..operators.relational import small
from ..session import checkpoint
from ..streaming import assignment as A
from ..streaming import ingest as I
from .registry import query
from .relational import crossed, members

# ---- text and entities -----------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


@query(f"SELECT doc_id, len(list_filter(regexp_extract_all(lower(title), '[a-z][a-z''-]*'), lambda w: w NOT IN ({_STOP}))) AS n, array_to_string(list_filter(regexp_extract_all(lower(title), '[a-z][a-z''-]*'), lambda w: w NOT IN ({_STOP})), ' ') AS tokens FROM texts")
def txt_01_02_tokens(t) -> DataFrame:
    k = T.tokens(F.col("title"))
    return t.texts.select("doc_id", F.size(k).cast("long").alias("n"), F.array_join(k, " ").alias("tokens"))


@query(f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z][a-z''-]*'), lambda w: w NOT IN ({_STOP})))), ' ') AS words FROM texts")
def txt_03_04_signature(t) -> DataFrame:
    return t.texts.select("doc_id", F.array_join(T.words(T.sentence_tokens(F.col("text"))), " ").alias("words"))


@query()
def txt_05_09_entities(t) -> DataFrame:
    return E.extract(t.texts)


@query("SELECT doc_id, up >= 8 AND up > 3 * (title + 1) AS loud FROM (SELECT doc_id, len(list_filter(w, lambda x: regexp_full_match(x, '[A-Z]{2,}'))) AS up, len(list_filter(w, lambda x: regexp_matches(x, '^[A-Z][A-Za-z]*[a-z]'))) AS title FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM texts))")
def txt_06_shouting(t) -> DataFrame:
    return t.texts.select("doc_id", E.shouting(F.col("text")).alias("loud"))


@query("SELECT entity_id, regexp_replace(trim(regexp_replace(lower(canonical_name), '[^a-z0-9]+', ' ', 'g')), '^((former) )+', '') AS key FROM entities")
def txt_11_canonical_key(t) -> DataFrame:
    return t.entities.select("entity_id", E.canonical_key(F.col("canonical_name")).alias("key"))


@query("SELECT p_type AS name, p_type IN ('STANDARD') AS nothing FROM (SELECT DISTINCT p_type FROM part)")
def txt_12_names_nothing(t) -> DataFrame:
    lex = E.Lexicon(furniture=("standard", "feed"))
    return t.read("part").select(F.col("p_type").alias("name")).distinct().select("name", E.names_nothing(F.lower("name"), lex).alias("nothing"))


NAMES = "keys AS (SELECT DISTINCT p_name AS key FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 2) FROM part WHERE p_partkey < 40), one AS (SELECT split_part(key, ' ', 2) AS part_, min(key) AS fuller FROM keys WHERE key LIKE '% %' AND split_part(key, ' ', 1) = 'small' GROUP BY 1 HAVING count(*) = 1)"


def name_keys(t) -> DataFrame:
    p = t.read("part")
    return p.select(F.col("p_name").alias("key")).unionByName(p.where("p_partkey < 40").select(F.split("p_name", " ")[1].alias("key"))).distinct()


def identities(t) -> DataFrame:
    return E.resolve(name_keys(t), t.spark.createDataFrame([("small",)], "given string"))


@query("SELECT k.key, coalesce(o.fuller, k.key) AS identity FROM keys k LEFT JOIN one o ON o.part_ = k.key", NAMES)
def txt_13_resolve_identity(t) -> DataFrame:
    return identities(t)


@query("SELECT count(*) AS links, count(DISTINCT identity) AS identities FROM (SELECT DISTINCT p.p_partkey % 50 AS article_id, coalesce(o.fuller, k.key) AS identity FROM part p JOIN keys k ON k.key = p.p_name OR k.key = split_part(p.p_name, ' ', 2) LEFT JOIN one o ON o.part_ = k.key)", NAMES)
def txt_14_15_reconcile(t) -> DataFrame:
    p = t.read("part").select((F.col("p_partkey") % 50).alias("article_id"), F.explode(F.array("p_name", F.split("p_name", " ")[1])).alias("key"))
    return E.reconcile(p, identities(t)).agg(F.count("*").alias("links"), F.countDistinct("key").alias("identities"))


NOUN = "split_part(p.p_name, ' ', 2) || CAST(e.user_id % 40 AS VARCHAR)"
MENTIONS = f"""ment AS (SELECT e.event_id AS seq, {NOUN} AS part_, CASE WHEN e.event_id % 3 = 0 THEN {NOUN} ELSE split_part(p.p_name, ' ', 1) || ' ' || {NOUN} END AS key FROM ev e JOIN part p ON p.p_partkey = e.k),
full_ AS (SELECT *, row_number() OVER (PARTITION BY part_ ORDER BY since) AS i FROM (SELECT key, part_, min(seq) AS since FROM ment WHERE split_part(key, ' ', 1) IN ('small', 'red', 'old') GROUP BY 1, 2)),
short_ AS (SELECT m.seq, m.key, count(f.key) AS before FROM ment m LEFT JOIN full_ f ON f.part_ = m.key AND f.since < m.seq WHERE m.key = m.part_ GROUP BY 1, 2),
maker AS (SELECT key, before, min(seq) AS made FROM short_ WHERE before <> 1 GROUP BY 1, 2),
owner AS (SELECT f.*, coalesce(m.made, f.since) AS entity, m.made IS NOT NULL AS took FROM full_ f LEFT JOIN maker m ON m.key = f.part_ AND m.before = f.i - 1),
other AS (SELECT seq, key, min(seq) OVER (PARTITION BY key) AS entity FROM ment WHERE key <> part_ AND key NOT IN (SELECT key FROM full_))"""


def name_mentions(t) -> DataFrame:
    """Events as mentions of names, a third of them short."""
    p = t.read("part").select(F.col("p_partkey").alias("k"), F.split("p_name", " ").alias("w"))
    noun = F.concat(F.col("w")[1], (F.col("user_id") % 40).cast("string"))
    key = F.when(F.col("event_id") % 3 == 0, noun).otherwise(F.concat_ws(" ", F.col("w")[0], noun))
    return t.ev.join(p, "k").select(F.col("event_id").alias("seq"), F.col("event_id").alias("id"), F.concat(F.upper(key), F.lit(" #"), F.col("event_id").cast("string")).alias("name"), F.lit("person").alias("kind"), key.alias("key"))


def given_names(t) -> DataFrame:
    return t.spark.createDataFrame([("small",), ("red",), ("old",)], "given string")


@query(
    "SELECT m.seq, m.key, CASE WHEN m.seq > o.since THEN 'exact' WHEN o.took THEN 'takeover' ELSE 'new' END AS resolution, o.entity FROM ment m JOIN owner o ON o.key = m.key UNION ALL SELECT s.seq, s.key, CASE WHEN s.before = 1 THEN 'fuller' WHEN s.seq = m.made THEN 'new' ELSE 'exact' END, coalesce(m.made, o.entity) FROM short_ s LEFT JOIN maker m ON m.key = s.key AND m.before = s.before LEFT JOIN owner o ON o.part_ = s.key AND o.i = 1 UNION ALL SELECT seq, key, CASE WHEN seq = entity THEN 'new' ELSE 'exact' END, entity FROM other",
    MENTIONS,
)
def txt_13_arrival_log(t) -> DataFrame:
    """What each mention was resolved to when it came."""
    none = t.spark.createDataFrame([], "id long, name string, kind string, key string")
    return N.arrivals(name_mentions(t), none, given_names(t))[0]


@query(
    "SELECT e.id, upper(m.key) || ' #' || CAST(e.id AS VARCHAR) AS name, e.key FROM (SELECT entity AS id, key FROM owner UNION ALL SELECT m.made, m.key FROM maker m WHERE m.before = (SELECT count(*) FROM full_ f WHERE f.part_ = m.key) UNION ALL SELECT DISTINCT entity, key FROM other) e JOIN ment m ON m.seq = e.id",
    MENTIONS,
)
def txt_14_entities_after_two_parts(t) -> DataFrame:
    """The entities after mentions that came in two parts; taken-over ones have longer keys and their first names."""
    m, given = name_mentions(t), given_names(t)
    middle = m.agg(F.max("seq")).first()[0] or 0
    held = t.spark.createDataFrame([], "id long, name string, kind string, key string")
    for part in (m.where(F.col("seq") * 2 <= middle), m.where(F.col("seq") * 2 > middle)):
        held = checkpoint(N.arrivals(part, held, given)[1])
    return held.select("id", "name", "key")


STORED_NAMES = f"""rows_ AS (SELECT e.event_id AS id, {NOUN} AS part_, CASE WHEN e.event_id % 3 = 0 THEN {NOUN} ELSE split_part(p.p_name, ' ', 1) || ' ' || {NOUN} END AS key FROM ev e JOIN part p ON p.p_partkey = e.k),
live AS (SELECT key, part_, min(id) FILTER (WHERE id % 5 = 0) AS good, min(id) AS any_ FROM rows_ GROUP BY 1, 2),
keep AS (SELECT key, part_, coalesce(good, any_) AS id, good IS NULL AS late FROM live),
into_ AS (SELECT k.key, CASE WHEN k.key = k.part_ THEN coalesce((SELECT arg_min(f.key, CAST(f.late AS INT) * 1000000000000 - length(f.key) * 1000000000 + f.id) FROM keep f WHERE f.part_ = k.key AND split_part(f.key, ' ', 1) IN ('small', 'red', 'old') AND f.key <> f.part_), k.key) ELSE k.key END AS into_ FROM keep k)"""


@query("SELECT k.id, k.key, count(DISTINCT u.user_id) AS users FROM rows_ r JOIN into_ i ON i.key = r.key JOIN keep k ON k.key = i.into_ JOIN ev u ON u.event_id = r.id GROUP BY 1, 2", STORED_NAMES)
def txt_15_reconciled(t) -> DataFrame:
    """Stored names made one, and the users linked to each; every fifth row is stored under its key."""
    m = name_mentions(t)
    stored = m.select("id", F.upper("key").alias("name"), "kind", F.when(F.col("id") % 5 == 0, F.col("key")).otherwise("").alias("key"))
    links = m.select(F.col("seq").alias("event_id"), F.col("id").alias("entity")).join(t.ev, "event_id").select(F.col("user_id").alias("article"), "entity")
    kept, pointed = N.reconcile_stored(stored, links, given_names(t))
    users = pointed.groupBy(F.col("entity").alias("id")).agg(F.count("*").alias("users"))
    return kept.select("id", "key").join(users, "id").select("id", "key", "users")


#: Lists that have moved on: words that carry no subject are no names, acronyms are, and names no longer reach over connectors.
REREAD = E.Lexicon(furniture=(*E.DEFAULT.furniture, *T.STOPWORDS), noise_acronyms=(), connectors=(), inner_words=())


@query()
def txt_16_reread_changes(t) -> DataFrame:
    """How many names of each text come and go when the lexicon changes; a text that keeps its names, or has none, has zeros."""
    both = E.extract_each(t.texts, [E.DEFAULT, REREAD]).select("doc_id", "key", "lexicon")
    every = both.unionByName(t.texts.select("doc_id", F.lit(None).cast("string").alias("key"), F.lit(None).cast("int").alias("lexicon")))
    held = every.groupBy("doc_id", "key").agg(F.bool_or(F.col("lexicon") == 0).alias("old"), F.bool_or(F.col("lexicon") == 1).alias("new"))
    return held.groupBy("doc_id").agg(F.count_if(F.col("new") & ~F.col("old")).cast("int").alias("added"), F.count_if(F.col("old") & ~F.col("new")).cast("int").alias("removed"))


# ---- similarity and grouping -----------------------------------------------


def stories(t, signature=T.signature) -> DataFrame:
    """Texts as stories of their source, with signatures."""
    sig = t.texts.select(F.col("source").alias("topic"), F.col("doc_id").alias("story"), F.col("published_at").alias("place"), signature(F.col("text")).alias("s"))
    return sig.select("topic", "story", "place", "s.words", "s.phrases")


WORDS = f"st AS (SELECT source AS topic, doc_id AS story, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z][a-z''-]*'), lambda w: w NOT IN ({_STOP}))) AS words FROM texts), jac AS (SELECT a.topic, a.story AS left_id, b.story AS right_id, len(list_intersect(a.words, b.words)) * 1.0 / len(list_distinct(list_concat(a.words, b.words))) AS j FROM st a JOIN st b ON a.topic = b.topic AND a.story < b.story WHERE len(a.words) + len(b.words) > 0)"


@query("SELECT topic, left_id, right_id, round(j, 6) AS jaccard FROM jac WHERE j >= 0.1", WORDS)
def join_13_self_pairs(t) -> DataFrame:
    """Pairs of a topic with word Jaccard of 0.1."""
    return story_pairs(t).select("topic", F.col("left").alias("left_id"), F.col("right").alias("right_id"), F.round("jaccard", 6).alias("jaccard"))


def story_pairs(t) -> DataFrame:
    terms = F.transform(F.array_distinct(F.flatten(T.sentence_tokens(F.col("text")))), lambda w: F.xxhash64(w)).alias("terms")
    return G.jaccard_pairs(t.texts.select(F.col("source").alias("topic"), F.col("doc_id").alias("story"), terms), 0.1)


@query("SELECT s.story_id, a.article_id FROM (SELECT story_id, min(source_id) AS source_id, min(published_at) AS f, max(published_at) AS l FROM articles WHERE story_id IS NOT NULL AND article_id % 2 = 0 GROUP BY 1) s JOIN articles a ON a.source_id = s.source_id AND a.article_id % 2 = 1 AND s.f >= a.published_at - INTERVAL 72 HOUR AND s.l <= a.published_at + INTERVAL 72 HOUR")
def join_14_candidate_join(t) -> DataFrame:
    held = t.articles.where("story_id IS NOT NULL AND article_id % 2 = 0").groupBy("story_id").agg(F.min("source_id").alias("source_id"), F.min("published_at").alias("first_at"), F.max("published_at").alias("last_at"))
    return crossed(t.articles.where("article_id % 2 = 1").select("article_id", "source_id", "published_at"), held).select("story_id", "article_id")


@query()
def sim_01_02_same_story(t) -> DataFrame:
    pairs = G.scored(stories(t, T.hashed_signature), C.SAME_STORY)
    return pairs.select("topic", "left", "right", F.round("signature", 6).alias("signature"))


@query("SELECT CAST(a.vec_id AS BIGINT) AS left_id, CAST(b.vec_id AS BIGINT) AS right_id, a.vec_id % 7 <> 0 AND b.vec_id % 7 <> 0 AS comparable FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def sim_03_embedding_nulls(t) -> DataFrame:
    e = t.read("embeddings").select(F.col("vec_id").cast("long").alias("id"), F.when(F.col("vec_id") % 7 != 0, F.col("embedding")).alias("v"))
    after = e.select((F.col("id") - 1).alias("id"), F.col("v").alias("w"))
    return e.join(after, "id").select(F.col("id").alias("left_id"), (F.col("id") + 1).alias("right_id"), S.cosine(F.col("v"), F.col("w")).isNotNull().alias("comparable"))


CONT = "w AS (SELECT user_id AS story, k AS entity, 1.0 + k % 3 AS w FROM (SELECT DISTINCT user_id, k FROM ev)), tot AS (SELECT story, sum(w * w) AS total FROM w GROUP BY 1)"


@query("SELECT a.story AS left_id, b.story AS right_id, round(coalesce(sum(a.w * a.w) / least(max(ta.total), max(tb.total)), 0), 6) AS entity FROM w a JOIN w b ON a.entity = b.entity AND b.story = a.story + 1 JOIN tot ta ON ta.story = a.story JOIN tot tb ON tb.story = b.story GROUP BY 1, 2", CONT)
def sim_04_containment(t) -> DataFrame:
    w = t.ev.select(F.col("user_id").alias("story"), F.col("k").alias("entity")).distinct().withColumn("w", 1.0 + F.col("entity") % 3)
    ids = w.select("story").distinct()
    pairs = ids.select(F.col("story").alias("left"), (F.col("story") + 1).alias("right")).join(ids.select(F.col("story").alias("right")), "right", "left_semi")
    return G.containment(w, pairs).select(F.col("left").alias("left_id"), F.col("right").alias("right_id"), F.round("entity", 6).alias("entity"))


@query("SELECT k AS article, user_id AS story FROM (SELECT k, user_id, row_number() OVER (PARTITION BY k ORDER BY score DESC, l DESC, user_id) AS n FROM (SELECT k, user_id, round(max(value) / 100, 2) AS score, max(ts) AS l FROM ev GROUP BY 1, 2) WHERE score >= 0.15) WHERE n = 1")
def sim_05_best_story(t) -> DataFrame:
    s = t.ev.groupBy(F.col("k").alias("article"), F.col("user_id").alias("story")).agg(F.round(F.max("value") / 100, 2).alias("score"), F.max("ts").alias("last"))
    return G.best_story(s).select("article", "story")


def vectors(t) -> DataFrame:
    e = t.read("embeddings")
    return e.select((F.col("vec_id") % 10).cast("long").alias("topic"), F.col("vec_id").cast("long").alias("story"), F.when(F.col("label") == 0, "m0").otherwise(F.when(F.col("vec_id") % 10 < 3, "m1").otherwise("m0")).alias("model"), F.when(F.col("vec_id") % 7 != 0, F.col("embedding")).alias("vector"))


@query("SELECT topic, count(DISTINCT model) AS models, CAST(1 AS BIGINT) AS widths FROM (SELECT CAST(vec_id % 10 AS BIGINT) AS topic, CASE WHEN label = 0 THEN 'm0' WHEN vec_id % 10 < 3 THEN 'm1' ELSE 'm0' END AS model FROM embeddings WHERE vec_id % 7 <> 0) GROUP BY 1 HAVING count(DISTINCT model) > 1")
def sim_06_grp_04_mixed_sets(t) -> DataFrame:
    return G.mixed_sets(vectors(t))


@query("SELECT event_id, value / 100 >= 0.04 AND (CASE WHEN k % 4 = 0 THEN TRUE ELSE k / 100.0 >= 0.55 END) AS both_, value / 100 >= 0.04 OR (CASE WHEN k % 4 = 0 THEN FALSE ELSE k / 100.0 >= 0.55 END) AS either_ FROM ev")
def sim_07_08_gate(t) -> DataFrame:
    sem = F.when(F.col("k") % 4 != 0, F.col("k") / 100.0)
    return t.ev.select("event_id", S.clears_gate(F.col("value") / 100, sem).alias("both_"), S.clears_gate(F.col("value") / 100, sem, gate="either").alias("either_"))


@query("SELECT m.cluster_id, m.story_id, count(DISTINCT ae.entity_id) AS entities FROM (SELECT DISTINCT priority || '-' || CAST(source_id AS VARCHAR) AS cluster_id, story_id, article_id FROM articles WHERE story_id IS NOT NULL) m JOIN article_entities ae ON ae.article_id = m.article_id GROUP BY 1, 2")
def grp_01_grounding(t) -> DataFrame:
    return members(t).join(t.article_entities, "article_id").groupBy("cluster_id", "story_id").agg(F.countDistinct("entity_id").alias("entities"))


@query()
def grp_02_clusters(t) -> DataFrame:
    s = stories(t, T.hashed_signature)
    return G.clusters(s, G.scored(s, C.SIGNATURE_FLOOR))


def story_vectors(t) -> DataFrame:
    """Stories with the vectors of their ids; sources that end in 3 have vectors of two models."""
    e = t.read("embeddings").select(F.col("vec_id").cast("long").alias("story"), F.col("embedding").alias("vector"), (F.col("label") % 2).alias("odd"))
    model = F.when(F.col("topic").endswith("3") & (F.col("odd") == 1), "m1").when(F.col("vector").isNotNull(), "m0")
    return stories(t, T.hashed_signature).join(e, "story", "left").select("topic", "story", "place", "words", "phrases", "vector", model.alias("model"))


@query()
def grp_02_04_gated_clusters(t) -> DataFrame:
    """Both floors of the gate, and topics with vectors of several models refused."""
    return G.formed(story_vectors(t))


@query()
def grp_03_pricing(t) -> DataFrame:
    """How many pairs a topic has, how many are walked, and how many clear the signature floor."""
    s = stories(t)
    n = s.groupBy("topic").agg((F.count("*") * (F.count("*") - 1) / 2).cast("long").alias("pairs"))
    walked = G.walked(s, C.SIGNATURE_FLOOR)
    clear = G.scored(s).groupBy("topic").agg(F.count("*").alias("cleared"))
    return n.join(walked, "topic", "left").join(clear, "topic", "left").select("topic", "pairs", F.coalesce("walked", F.lit(0)).alias("walked"), F.coalesce("cleared", F.lit(0)).alias("cleared"))


def formed_twice(t) -> tuple[DataFrame, DataFrame]:
    """What a topic holds from the mornings, and what its afternoons form: (topic, cluster, story), (topic, old_id, story)."""
    parts = t.ev.select((F.col("user_id") % 5).alias("topic"), F.col("user_id").alias("story"), "k", F.hour("ts").alias("hour"))
    new = parts.where("hour >= 12").select("topic", (F.col("k") % 12).alias("cluster"), "story").distinct()
    held = parts.where("hour < 12").select("topic", F.concat(F.lit("old-"), (F.col("k") % 9).cast("string")).alias("old_id"), "story").distinct()
    return new, held


TWICE = "new AS (SELECT DISTINCT user_id % 5 AS topic, k % 12 AS cluster, user_id AS story FROM ev WHERE hour(ts) >= 12), held AS (SELECT DISTINCT user_id % 5 AS topic, 'old-' || (k % 9) AS old_id, user_id AS story FROM ev WHERE hour(ts) < 12), claims AS (SELECT topic, cluster, old_id, n, size FROM (SELECT new.topic, cluster, old_id, count(*) AS n FROM new JOIN held ON held.topic = new.topic AND held.story = new.story GROUP BY 1, 2, 3) JOIN (SELECT topic AS st, cluster AS sc, count(*) AS size FROM new GROUP BY 1, 2) ON st = topic AND sc = cluster), granted AS (SELECT topic, cluster, old_id FROM (WITH RECURSIVE g AS (SELECT *, FALSE AS won FROM claims UNION ALL SELECT topic, cluster, old_id, n, size, cluster = c AND old_id = o FROM (SELECT *, first_value(cluster) OVER w AS c, first_value(old_id) OVER w AS o FROM g WHERE NOT won WINDOW w AS (PARTITION BY topic ORDER BY n DESC, size DESC, cluster, old_id)) WHERE (cluster = c) = (old_id = o)) SELECT * FROM g) WHERE won)"


@query("SELECT topic, cluster, old_id FROM granted", TWICE)
def grp_05_ord_04_inherit_ids(t) -> DataFrame:
    new, held = formed_twice(t)
    overlap = new.join(held, ["topic", "story"]).groupBy("topic", "cluster", "old_id").agg(F.count("*").alias("n"))
    return G.inherit_ids(overlap, new.groupBy("topic", "cluster").agg(F.count("*").alias("size")))


@query("SELECT n.topic, n.cluster, coalesce(max(g.old_id), 'cluster-' || n.topic || '-' || min(story) || '-' || printf('%016x', CAST(sum(CAST('0x' || substr(md5(CAST(story AS VARCHAR)), 1, 8) AS BIGINT)) AS BIGINT))) AS id, max(g.old_id) IS NOT NULL AS inherited FROM new n LEFT JOIN granted g ON g.topic = n.topic AND g.cluster = n.cluster GROUP BY 1, 2", TWICE)
def grp_05_named_clusters(t) -> DataFrame:
    """Every cluster under the id it inherits, or a new one."""
    return G.named(*formed_twice(t))


@query("SELECT cluster_id, round(article_count / greatest(1.0, (epoch_ms(now) - epoch_ms(created_at)) / 86400000.0), 6) AS velocity, article_count / greatest(1.0, (epoch_ms(now) - epoch_ms(created_at)) / 86400000.0) >= 0.05 AS active, (epoch_ms(now) - epoch_ms(created_at)) <= 86400000 AS over_floor FROM clusters, clock")
def grp_06_07_08_velocity(t) -> DataFrame:
    v = G.velocity(F.col("article_count"), F.col("created_at"), F.col("now"))
    young = F.unix_millis("now") - F.unix_millis("created_at") <= 86_400_000
    return t.clusters.join(F.broadcast(t.clock)).select("cluster_id", F.round(v, 6).alias("velocity"), (v >= 0.05).alias("active"), young.alias("over_floor"))


@query()
def grp_09_10_summaries(t) -> DataFrame:
    """Title, one-liner and up to three bullets, one per article, none said before."""
    ranked = t.texts.select("source", "doc_id", "title", "body", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("published_at"), "doc_id")).alias("r")).where("r <= 8")
    # Sentences of the eight only, and once for all that is read of them.
    ranked = checkpoint(ranked.select("source", "doc_id", "title", T.sentences(F.col("body")).alias("s"), "r"))
    head = ranked.where("r = 1").select("source", "title", F.coalesce(F.try_element_at("s", F.lit(1)), "title").alias("one_liner"))
    said = F.array(T.normalize(F.col("one_liner")), T.normalize(F.col("title")))
    first = ranked.select("source", "r", F.posexplode(F.concat("s", F.array(F.col("title").alias("title")))).alias("i", "bullet"))
    fresh = first.join(head, "source").withColumn("key", T.normalize(F.col("bullet"))).where(~F.array_contains(said, F.col("key")))
    once = fresh.groupBy("source", "key").agg(F.min_by(F.struct("r", "i", "bullet"), F.struct("r", "i")).alias("b"))
    per = once.groupBy("source", F.col("b.r").alias("r")).agg(F.min_by("b.bullet", "b.i").alias("bullet"))
    top = per.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("r"))).where(F.col("n") <= C.MOST_BULLETS)
    bullets = top.groupBy("source").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "bullet"))), lambda x: x["bullet"]), "\n").alias("bullets"))
    return head.join(bullets, "source", "left")


@query("SELECT c.cluster_id, CASE WHEN c.cluster_id IN (SELECT cluster_id FROM clusters WHERE article_count > 120) THEN c.state ELSE 'archive' END AS state FROM clusters c")
def grp_12_archive_excluding(t) -> DataFrame:
    kept = t.clusters.where("article_count > 120").select("cluster_id", F.lit(True).alias("kept"))
    return t.clusters.join(kept, "cluster_id", "left").select("cluster_id", F.when(F.col("kept"), F.col("state")).otherwise("archive").alias("state"))


@query("SELECT a.priority || '-' || CAST(a.source_id AS VARCHAR) AS cluster_id, count(*) AS articles FROM articles a WHERE a.source_id IN (SELECT source_id FROM topic_sources WHERE topic_id = 1) GROUP BY 1")
def grp_13_cluster_articles(t) -> DataFrame:
    followed = t.topic_sources.where("topic_id = 1").select("source_id")
    return t.articles.join(followed, "source_id", "left_semi").groupBy(F.concat("priority", F.lit("-"), F.col("source_id").cast("string")).alias("cluster_id")).agg(F.count("*").alias("articles"))


@query("SELECT priority, article_id, n AS place FROM (SELECT priority, article_id, row_number() OVER (PARTITION BY priority ORDER BY c DESC, published_at DESC, a.article_id) AS n FROM articles a LEFT JOIN (SELECT article_id AS aid, count(*) AS c FROM article_entities GROUP BY 1) e ON e.aid = a.article_id WHERE c IS NOT NULL) WHERE n <= 20")
def ord_05_rank_articles(t) -> DataFrame:
    c = t.article_entities.groupBy("article_id").agg(F.count("*").alias("c"))
    w = Window.partitionBy("priority").orderBy(F.desc("c"), F.desc("published_at"), "article_id")
    return t.articles.join(c, "article_id").withColumn("place", F.row_number().over(w)).where("place <= 20").select("priority", "article_id", "place")


#: Ranges of scores from 0 to 1 that the pairs of a topic are ordered in.
SCORE_RANGES = 10_000


@query("SELECT topic, left_id, right_id, row_number() OVER (PARTITION BY topic ORDER BY j DESC, left_id, right_id) AS place FROM (SELECT topic, round(j, 9) AS j, left_id, right_id FROM jac WHERE j >= 0.1)", WORDS)
def ord_03_candidate_order(t) -> DataFrame:
    """Merge candidates of each topic in order, by ranges of their score: each range is sorted by itself and begins after those above it."""
    j = story_pairs(t).select("topic", F.col("left").alias("left_id"), F.col("right").alias("right_id"), F.round("jaccard", 9).alias("j"))
    j = checkpoint(j.withColumn("range", F.floor(F.col("j") * SCORE_RANGES)))
    above = Window.partitionBy("topic").orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    begins = j.groupBy("topic", "range").agg(F.count("*").alias("n")).select("topic", "range", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("topic", "range").orderBy(F.desc("j"), "left_id", "right_id"))
    return j.withColumn("place", place).join(small(begins), ["topic", "range"]).select("topic", "left_id", "right_id", (F.col("place") + F.col("before")).alias("place"))


# ---- streaming -------------------------------------------------------------


def event_stream(t) -> DataFrame:
    schema = t.spark.read.parquet(f"{t.folder}/events.parquet").schema
    s = I.source(t.spark, t.folder, "events", schema)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT user_id, topic, min(event_id) AS event_id FROM ev GROUP BY 1, 2")
def stm_01_04_exactly_once(t) -> DataFrame:
    stream = event_stream(t).select("user_id", F.col("event_type").alias("topic"), "event_id")
    return I.first_writes(stream, ["user_id", "topic"], ["event_id"], I.scratch(t.spark))


BACK = "p AS (SELECT CAST(user_id AS VARCHAR) AS source, ts, event_id AS seq, topic <> 'error' AS ok FROM ev), g AS (SELECT source, max(seq) FILTER (WHERE ok) AS good FROM p GROUP BY 1), f AS (SELECT p.source, count(*) FILTER (WHERE NOT ok AND (good IS NULL OR seq > good)) AS failures, max(ts) AS l FROM p JOIN g ON g.source = p.source GROUP BY 1)"


@query("SELECT source, failures, CASE WHEN failures > 0 THEN CAST(epoch_ms(l) + least(21600000, 60000 * CAST(pow(2, least(6, greatest(0, failures - 1))) AS BIGINT)) AS BIGINT) END AS next_ms FROM f", BACK)
def stm_03_backoff(t) -> DataFrame:
    polls = t.ev.select(F.col("user_id").cast("string").alias("source"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), (F.col("topic") != "error").alias("ok"))
    return I.backoff_batch(polls)


@query()
def stm_05_06_online_assignment(t) -> DataFrame:
    s = stories(t, T.hashed_signature)
    scores = G.scored(s, C.SAME_STORY, hours=72).select("topic", "left", "right", F.col("signature").alias("score"))
    return I.assign(s.select("topic", F.col("story").alias("article"), F.col("place").alias("at")), scores, "topic")


@query()
def stm_05_06_streamed(t) -> DataFrame:
    """The same over a stream in slices of time, with state, watermark and timers."""
    s = stories(t, T.hashed_signature)
    articles = s.select("topic", F.col("story").cast("long").alias("article"), F.col("place").cast("timestamp").alias("at"), "words", "phrases")
    return A.replayed(articles, I.scratch(t.spark))


@query("SELECT topic, CAST(epoch_ms(ts) // 21600000 * 21600000 AS BIGINT) AS window_ms, count(*) AS n FROM ev GROUP BY 1, 2")
def stm_07_tumbling_windows(t) -> DataFrame:
    folder, spark = I.scratch(t.spark), t.spark
    counts = I.tumbling(event_stream(t).withColumnRenamed("event_type", "topic"), "6 hours", "1 day", "topic")

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.select("topic", F.unix_millis("window.start").alias("window_ms"), "n").write.mode("overwrite").parquet(f"{folder}/windows/batch={batch_id}")

    I.run(counts, sink, folder, "update")
    out = spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/windows")
    return out.groupBy("topic", "window_ms").agg(F.max("n").alias("n"))


@query("SELECT user_id, strftime(ts, '%Y-%m-%d') AS slot, min(event_id) AS claim, min(event_id) FILTER (WHERE topic = 'purchase') AS sent FROM ev GROUP BY 1, 2")
def stm_09_claim_before_send(t) -> DataFrame:
    return t.ev.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("slot")).agg(F.min("event_id").alias("claim"), F.min(F.when(F.col("topic") == "purchase", F.col("event_id"))).alias("sent"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE 3 END AS width FROM documents")
def stm_10_backfill(t) -> DataFrame:
    """A stand-in provider that fails on some texts."""
    items = t.read("documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 11 == 0, "?").otherwise(F.col("text")).alias("text"))

    def provider(texts):
        if "?" in texts:
            raise ValueError("refused")
        return [[float(len(x)), float(x.count(" ")), 1.0] for x in texts]

    return I.backfill(items, provider, 3).select("id", F.when(F.col("vector").isNotNull(), F.size("vector")).alias("width"))


@query("SELECT doc_id AS id, CASE WHEN length(text) % 14 = 7 THEN NULL WHEN text IS NOT NULL THEN 2 END AS width FROM documents")
def stm_10_resumed_backfill(t) -> DataFrame:
    """Two runs: what the first refuses is sent again, what it stored is not."""
    items = t.read("documents").select(F.col("doc_id").alias("id"), "text")

    def refusing(every: int, rest: int):
        def provider(texts):
            if any(len(x) % every == rest for x in texts):
                raise ValueError("refused")
            return [[float(len(x)), 1.0] for x in texts]

        return provider

    folder = I.scratch(t.spark)
    K.resume(items, refusing(2, 1), 2, folder, pages=4)
    return K.resume(items, refusing(7, 0), 2, folder, pages=4).select("id", F.when(F.col("vector").isNotNull(), F.size("vector")).alias("width"))


# ---- evaluation ------------------------------------------------------------

PAIRS = "scores AS (SELECT a.user_id AS left_id, b.user_id AS right_id, (a.user_id + b.user_id) % 3 = 0 AS same_event, round(a.v / 100, 4) AS signature, CASE WHEN a.user_id % 5 = 0 THEN NULL ELSE round(b.v / 100, 4) END AS semantic, round((a.v + b.v) / 200, 4) AS entity FROM (SELECT user_id, round(avg(value), 2) * 2 AS v FROM ev GROUP BY 1) a JOIN (SELECT user_id, round(avg(value), 2) * 2 AS v FROM ev GROUP BY 1) b ON b.user_id = a.user_id + 1)"
MEMBERSHIP = "mem AS (SELECT topic, user_id AS story, max(k) // 5 AS cluster FROM ev GROUP BY 1, 2)"


def scores(t) -> DataFrame:
    v = t.ev.groupBy("user_id").agg((F.round(F.avg("value"), 2) * 2).alias("v"))
    p = v.select(F.col("user_id").alias("left"), F.col("v").alias("a")).join(v.select((F.col("user_id") - 1).alias("left"), F.col("v").alias("b")), "left").withColumn("right", F.col("left") + 1)
    return p.select("left", "right", ((F.col("left") + F.col("right")) % 3 == 0).alias("same_event"), F.round(F.col("a") / 100, 4).alias("signature"), F.when(F.col("left") % 5 != 0, F.round(F.col("b") / 100, 4)).alias("semantic"), F.round((F.col("a") + F.col("b")) / 200, 4).alias("entity"))


def membership(t) -> DataFrame:
    return t.ev.groupBy("topic", F.col("user_id").alias("story")).agg(F.floor(F.max("k") / 5).alias("cluster"))


@query("SELECT ord, CASE WHEN NOT known THEN 'unresolved' WHEN contested THEN 'contested' WHEN again > 1 THEN 'duplicated' ELSE 'usable' END AS state FROM (SELECT ord, k % 10 < 8 AND user_id % 10 < 9 AS known, count(DISTINCT topic = 'view') OVER (PARTITION BY least(k, user_id), greatest(k, user_id)) > 1 AS contested, row_number() OVER (PARTITION BY least(k, user_id), greatest(k, user_id) ORDER BY ord) AS again FROM (SELECT event_id AS ord, k, user_id, topic FROM ev))")
def evl_01_resolve_pairs(t) -> DataFrame:
    p = t.ev.select(F.col("event_id").alias("ord"), F.col("k").alias("left"), F.col("user_id").alias("right"), (F.col("topic") == "view").alias("same_event"))
    left_known = t.ev.select(F.col("k").alias("key")).where("key % 10 < 8").distinct()
    right_known = t.ev.select(F.col("user_id").alias("key")).where("key % 10 < 9").distinct()
    known = p.join(left_known.select(F.col("key").alias("left"), F.lit(True).alias("a")), "left", "left").join(right_known.select(F.col("key").alias("right"), F.lit(True).alias("b")), "right", "left")
    w = Window.partitionBy(F.least("left", "right"), F.greatest("left", "right"))
    state = F.when(F.col("a").isNull() | F.col("b").isNull(), "unresolved").when(F.col("both") > 1, "contested").when(F.col("again") > 1, "duplicated").otherwise("usable")
    return known.withColumn("again", F.row_number().over(w.orderBy("ord"))).withColumn("both", F.size(F.collect_set("same_event").over(w))).select("ord", state.alias("state"))


@query("SELECT round(count(*) FILTER (WHERE same_event AND w) * 1.0 / nullif(count(*) FILTER (WHERE same_event), 0), 6) AS recall, round(count(*) FILTER (WHERE same_event AND w) * 1.0 / nullif(count(*) FILTER (WHERE w), 0), 6) AS precision_, count(*) AS pairs FROM (SELECT s.*, EXISTS (SELECT 1 FROM mem x JOIN mem y ON x.topic = y.topic AND x.cluster = y.cluster WHERE x.story = s.left_id AND y.story = s.right_id) AS w FROM scores s)", f"{PAIRS}, {MEMBERSHIP}")
def evl_02_recall_precision(t) -> DataFrame:
    return V.quality(V.welded(scores(t).select("left", "right", "same_event"), membership(t)))


@query("SELECT count(*) AS clusters, max(n) AS largest, count(*) FILTER (WHERE n = 1) AS singletons, round(count(*) FILTER (WHERE n = 1) * 1.0 / count(*), 6) AS share FROM (SELECT topic, cluster, count(*) AS n FROM mem GROUP BY 1, 2)", MEMBERSHIP)
def evl_03_cluster_stats(t) -> DataFrame:
    return V.cluster_stats(membership(t))


@query("SELECT round(avg(CASE WHEN same_event THEN 1.0 ELSE 0.0 END), 6) AS ceiling FROM scores WHERE entity >= 0.45", PAIRS)
def evl_04_precision_ceiling(t) -> DataFrame:
    return scores(t).where(F.col("entity") >= C.ENTITY_FLOOR).agg(F.round(F.avg(F.when(F.col("same_event"), 1.0).otherwise(0.0)), 6).alias("ceiling"))


@query("SELECT same_event, min(signature) AS signature_low, max(signature) AS signature_high, count(*) FILTER (WHERE signature IS NULL) AS signature_missing, min(semantic) AS semantic_low, max(semantic) AS semantic_high, count(*) FILTER (WHERE semantic IS NULL) AS semantic_missing FROM scores GROUP BY 1", PAIRS)
def evl_05_margins(t) -> DataFrame:
    return V.margins(scores(t))


@query("SELECT same_event, CASE n WHEN 0 THEN 'cleared' WHEN 1 THEN (CASE WHEN a THEN 'signature alone' WHEN b THEN 'semantic alone' ELSE 'entity alone' END) WHEN 2 THEN 'two' ELSE 'all' END AS refused, count(*) AS n FROM (SELECT *, CAST(a AS INT) + CAST(b AS INT) + CAST(c AS INT) AS n FROM (SELECT same_event, NOT signature >= 0.4 AS a, NOT coalesce(semantic >= 0.42, TRUE) AS b, NOT entity >= 0.41 AS c FROM scores)) GROUP BY 1, 2", PAIRS)
def evl_06_refusals(t) -> DataFrame:
    return V.refusals(scores(t), (0.4, 0.42, 0.41))


SWEEP = "cells AS (SELECT CAST(a.f AS DOUBLE) AS signature_floor, CAST(b.f AS DOUBLE) AS semantic_floor, count(*) FILTER (WHERE same_event AND signature >= a.f AND coalesce(semantic >= b.f, TRUE)) AS hits, count(*) FILTER (WHERE signature >= a.f AND coalesce(semantic >= b.f, TRUE)) AS cleared, count(*) FILTER (WHERE same_event) AS same FROM scores, (SELECT unnest([0.36, 0.38, 0.4, 0.42]) AS f) a, (SELECT unnest([0.35, 0.4, 0.45]) AS f) b GROUP BY 1, 2)"


def cells(t) -> DataFrame:
    return V.sweep(scores(t), (0.36, 0.38, 0.4, 0.42), (0.35, 0.4, 0.45))


@query("SELECT signature_floor, semantic_floor, round(hits * 1.0 / nullif(same, 0), 6) AS recall, round(hits * 1.0 / nullif(cleared, 0), 6) AS precision_ FROM cells", f"{PAIRS}, {SWEEP}")
def evl_07_sweep(t) -> DataFrame:
    return cells(t)


@query("SELECT recall, precision_ FROM q a WHERE recall IS NOT NULL AND precision_ IS NOT NULL AND NOT EXISTS (SELECT 1 FROM q b WHERE b.recall >= a.recall AND b.precision_ >= a.precision_ AND (b.recall > a.recall OR b.precision_ > a.precision_))", f"{PAIRS}, {SWEEP}, q AS (SELECT round(hits * 1.0 / nullif(same, 0), 6) AS recall, round(hits * 1.0 / nullif(cleared, 0), 6) AS precision_ FROM cells)")
def evl_08_frontier(t) -> DataFrame:
    from .relational import pareto

    return pareto(cells(t), "recall", "precision_").select("recall", "precision_")


@query("SELECT topic, max(n) AS largest FROM (SELECT topic, cluster, count(*) AS n FROM mem GROUP BY 1, 2) GROUP BY 1", MEMBERSHIP)
def evl_09_largest_by_cell(t) -> DataFrame:
    return membership(t).groupBy("topic", "cluster").agg(F.count("*").alias("n")).groupBy("topic").agg(F.max("n").alias("largest"))


GRID = (*(V.Cell(signature=f) for f in V.SIGNATURE_AXIS), *(V.Cell(semantic=f) for f in V.SEMANTIC_AXIS))


@query()
def evl_07_09_regrouped(t) -> DataFrame:
    """Stories grouped anew at each floor of signatures and of vectors; pairs that share words are one event if their vectors have one label."""
    s = story_vectors(t)
    sound = s.join(G.mixed_sets(s).select("topic"), "topic", "left_anti")
    scores = checkpoint(G.scored(sound, min(V.SIGNATURE_AXIS)))
    of = lambda side: t.read("embeddings").select(F.col("vec_id").cast("long").alias(side), F.col("label").alias(f"{side}_label"))
    pairs = scores.join(of("left"), "left").join(of("right"), "right").select("left", "right", (F.col("left_label") == F.col("right_label")).alias("same_event"))
    return V.by_cell(checkpoint(V.regrouped(sound, scores, GRID)), pairs, GRID)


@query("SELECT topic_id, count(*) AS clusters, CAST(sum(article_count) AS BIGINT) AS articles, count(*) FILTER (WHERE state = 'active') AS active FROM clusters GROUP BY 1")
def evl_10_reports(t) -> DataFrame:
    return t.clusters.groupBy("topic_id").agg(F.count("*").alias("clusters"), F.sum("article_count").alias("articles"), F.count_if(F.col("state") == "active").alias("active"))
