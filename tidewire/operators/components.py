"""Connected components by alternating large-star and small-star steps.

Edges are dealt by their first node and a salt of the second, so a node with a third of all edges
lies in many tasks.  The minimum of a node is taken per salt first, then over its salts, and goes
back to those salts that hold its edges; no more such rows exist than edges.  Lineage is cut after
every round in the shared checkpoint folder, and only a count and a sum of hashes reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint


def _least(edges: DataFrame, salts: int) -> DataFrame:
    """``edges`` (a, b), each with m, the smallest b of its a."""
    dealt = edges.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(salts)).cast("int"))
    part = dealt.groupBy("a", "salt").agg(F.min("b").alias("m"))
    whole = part.groupBy("a").agg(F.min("m").alias("m"), F.collect_list("salt").alias("salts"))  # at most one row per salt
    return dealt.join(whole.select("a", "m", F.explode("salts").alias("salt")), ["a", "salt"]).select("a", "b", "m")


def components(edges: DataFrame, most_rounds: int = 60, salts: int = 64) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), root being the smallest node reachable.

    Nulls, self loops, repeated and reversed edges are allowed; a node with
    only a self loop is its own root.
    """
    edges = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    e = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(most_rounds):
        large = _least(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))), salts)
        e = large.where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct()
        # The smallest neighbour itself becomes the edge from a to m; every other neighbour is linked to m.
        e = checkpoint(_least(e, salts).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return nodes.join(e.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
        mark = now
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")
