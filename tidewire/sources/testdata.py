"""Views of the news domain over the driver's tables; each has a DuckDB twin in ``CTES``.

Naive timestamps are read as UTC instants.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEEDBACK = {"click": "thumbs_up", "error": "thumbs_down", "purchase": "more_like_this", "view": "less_like_this", "signup": "hide_source"}
KINDS = {"ECONOMY": "org", "SMALL": "person", "MEDIUM": "place", "PROMO": "product", "STANDARD": "concept", "LARGE": "org"}

CTES = f"""
topics AS (SELECT CAST(r_regionkey AS BIGINT) AS topic_id, r_name AS title, CASE WHEN r_regionkey % 2 = 0 THEN 'daily' ELSE 'weekly' END AS cadence FROM region),
topic_sources AS (SELECT CAST(n_regionkey AS BIGINT) AS topic_id, CAST(n_nationkey AS BIGINT) AS source_id, n_name AS source_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS position FROM nation),
articles AS (SELECT o_orderkey AS article_id, CAST(c_nationkey AS BIGINT) AS source_id, o_orderdate AS published_at, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey END AS story_id, o_orderpriority AS priority FROM orders JOIN customer ON o_custkey = c_custkey),
entities AS (SELECT p_partkey AS entity_id, p_name || '#' || CAST(p_partkey AS VARCHAR) AS canonical_name, CASE p_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items())} ELSE 'concept' END AS kind FROM part),
article_entities AS (SELECT DISTINCT l_orderkey AS article_id, l_partkey AS entity_id FROM lineitem),
clock AS (SELECT max(o_orderdate) + INTERVAL 12 HOUR AS now FROM orders),
ev AS (SELECT event_id, ts, user_id, event_type AS topic, value, CAST(regexp_extract(props, '"k":\\s*(\\d+)', 1) AS BIGINT) AS k FROM events),
ev_clock AS (SELECT max(ts) - INTERVAL 12 HOUR AS now FROM events),
feedback AS (SELECT event_id AS seq, user_id, k AS cluster_id, CASE topic {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FEEDBACK.items())} END AS feedback_type, CASE WHEN event_id % 3 = 0 THEN 'global' WHEN event_id % 3 = 1 THEN 'this_topic' END AS scope, k % 25 AS source_id, k % 7 AS topic_id, ts FROM ev),
clusters AS (SELECT o_orderpriority || '-' || CAST(c_nationkey AS VARCHAR) AS cluster_id, CAST(n_regionkey AS BIGINT) AS topic_id, min(o_orderdate) AS created_at, max(o_orderdate) AS last_seen_at, count(*) AS article_count, CASE WHEN count(*) % 3 = 0 THEN 'archive' ELSE 'active' END AS state FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
texts AS (SELECT doc_id, source, lang, text, trim(split_part(text, chr(10), 1), ' ') AS title, CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS body, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id * 37 AS INTEGER)) AS published_at FROM documents)
"""


def _whole_millis(sql: str) -> str:
    """``epoch_ms(x)`` rounds in DuckDB; as ``epoch_us(x) // 1000`` it cuts, as Spark does."""
    out, at = "", 0
    while (i := sql.find("epoch_ms(", at)) >= 0:
        depth, j = 1, i + len("epoch_ms(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            j += 1
        out += sql[at:i] + f"(epoch_us({_whole_millis(sql[i + len('epoch_ms(') : j - 1])}) // 1000)"
        at = j
    return out + sql[at:]


def oracle(body: str, extra: str = "") -> str:
    """DuckDB SQL with the domain's views in front; ``extra`` holds further views."""
    return _whole_millis(f"WITH {CTES.strip()}{', ' + extra if extra else ''}\n{body}")


class Tables:
    """The domain's views on one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def read(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        naive = [f.name for f in df.schema if f.dataType.typeName() == "timestamp_ntz"]
        return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df

    @cached_property
    def topics(self) -> DataFrame:
        return self.read("region").select(F.col("r_regionkey").cast("long").alias("topic_id"), F.col("r_name").alias("title"), F.when(F.col("r_regionkey") % 2 == 0, "daily").otherwise("weekly").alias("cadence"))

    @cached_property
    def topic_sources(self) -> DataFrame:
        from pyspark.sql import Window

        w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
        return self.read("nation").select(F.col("n_regionkey").cast("long").alias("topic_id"), F.col("n_nationkey").cast("long").alias("source_id"), F.col("n_name").alias("source_name"), F.row_number().over(w).cast("long").alias("position"))

    @cached_property
    def articles(self) -> DataFrame:
        customers = self.read("customer").select("c_custkey", "c_nationkey")
        return self.read("orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
            F.col("o_orderkey").alias("article_id"), F.col("c_nationkey").cast("long").alias("source_id"), F.col("o_orderdate").alias("published_at"),
            F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("story_id"), F.col("o_orderpriority").alias("priority"),
        )

    @cached_property
    def entities(self) -> DataFrame:
        kind = F.lit("concept")
        for k, v in KINDS.items():
            kind = F.when(F.col("p_type") == k, v).otherwise(kind)
        return self.read("part").select(F.col("p_partkey").alias("entity_id"), F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string")).alias("canonical_name"), kind.alias("kind"))

    @cached_property
    def article_entities(self) -> DataFrame:
        return self.read("lineitem").select(F.col("l_orderkey").alias("article_id"), F.col("l_partkey").alias("entity_id")).distinct()

    @cached_property
    def clock(self) -> DataFrame:
        return self.read("orders").agg((F.max("o_orderdate") + F.expr("INTERVAL 12 HOURS")).alias("now"))

    @cached_property
    def ev(self) -> DataFrame:
        return self.read("events").select("event_id", "ts", "user_id", F.col("event_type").alias("topic"), "value", F.get_json_object("props", "$.k").cast("long").alias("k"))

    @cached_property
    def ev_clock(self) -> DataFrame:
        return self.read("events").agg((F.max("ts") - F.expr("INTERVAL 12 HOURS")).alias("now"))

    @cached_property
    def feedback(self) -> DataFrame:
        kind = F.create_map(*[F.lit(x) for pair in FEEDBACK.items() for x in pair])[F.col("topic")]
        scope = F.when(F.col("event_id") % 3 == 0, "global").when(F.col("event_id") % 3 == 1, "this_topic")
        return self.ev.select(F.col("event_id").alias("seq"), "user_id", F.col("k").alias("cluster_id"), kind.alias("feedback_type"), scope.alias("scope"), (F.col("k") % 25).alias("source_id"), (F.col("k") % 7).alias("topic_id"), "ts")

    @cached_property
    def clusters(self) -> DataFrame:
        return self.articles.join(self.topic_sources, "source_id").groupBy(F.concat("priority", F.lit("-"), F.col("source_id").cast("string")).alias("cluster_id"), "topic_id").agg(
            F.min("published_at").alias("created_at"), F.max("published_at").alias("last_seen_at"), F.count("*").alias("article_count"), F.when(F.count("*") % 3 == 0, "archive").otherwise("active").alias("state")
        )

    @cached_property
    def texts(self) -> DataFrame:
        first = F.instr("text", "\n")
        return self.read("documents").select(
            "doc_id", "source", "lang", "text", F.trim(F.substring_index("text", "\n", 1)).alias("title"), F.when(first > 0, F.expr("substring(text, instr(text, '\\n') + 1)")).otherwise("").alias("body"),
            F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 37 * 60).alias("published_at"),
        )
