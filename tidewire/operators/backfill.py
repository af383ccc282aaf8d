"""Vectors for what lacks them, in pages by key that a killed run leaves whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.ingest import backfill

STORED = "id long, vector array<float>, digest string"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _runs(spark: SparkSession, folder: str) -> list[int]:
    """The runs that have begun, whether or not they ended."""
    n = 0
    while _exists(spark, f"{folder}/run={n}"):
        n += 1
    return list(range(n))


def _pages(spark: SparkSession, folder: str, run: int) -> list[str]:
    """The pages of a run that are whole: those that a job has ended."""
    count = spark.read.schema("page long, low long").parquet(f"{folder}/run={run}/plan").count() if _exists(spark, f"{folder}/run={run}/plan/_SUCCESS") else 0
    paths = [f"{folder}/run={run}/page={i}" for i in range(count)]
    return [p for p in paths if _exists(spark, f"{p}/_SUCCESS")]


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """(id, vector, digest): the last vector of each id, with the digest of the text that it is of; a row without a vector is no answer."""
    parts = [(run, p) for run in _runs(spark, folder) for p in _pages(spark, folder, run)]
    if not parts:
        return spark.createDataFrame([], STORED)
    by_run: dict[int, list[str]] = {}
    for run, p in parts:
        by_run.setdefault(run, []).append(p)
    rows = None
    for run, paths in by_run.items():
        one = spark.read.schema(STORED).parquet(*paths).where("vector IS NOT NULL").withColumn("run", F.lit(run))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("id").agg(F.max_by(F.struct("vector", "digest"), "run").alias("at")).select("id", "at.vector", "at.digest")


def resume(items: DataFrame, provider: Callable[[list[str]], list[list[float]]], width: int, folder: str, pages: int = 16, batch: int = 256) -> DataFrame:
    """(id, vector) of all ``items`` (id, text) after going on where the last call ended; null where the provider refused.

    ``folder`` lies where driver and executors both reach it.  A run first writes the ranges of its pages, then each
    page as a table that counts once its job has ended.  A call after a kill takes up the unfinished run: it skips
    the whole pages and does the others, so a stored row is not sent again; at most the page under way is.  Once a run is
    whole, the next call begins a new one, for rows that are new, were refused, or whose text is another since.
    Ids outside the ranges of the plan belong to the first and last page.  Ids are unique, and a row without one gets
    no vector.  One run at a time has the folder.
    """
    spark = items.sparkSession
    texts = items.select("id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    runs = _runs(spark, folder)
    run = runs[-1] if runs else 0
    base = f"{folder}/run={run}"
    planned = _exists(spark, f"{base}/plan/_SUCCESS")
    if planned and len(_pages(spark, folder, run)) == spark.read.parquet(f"{base}/plan").count():
        run, planned = run + 1, False
        base = f"{folder}/run={run}"
    if not planned:
        # Bounds by rank of the ids; equal bounds fall together.
        cuts = sorted({int(x) for x in items.approxQuantile("id", [i / pages for i in range(1, pages)], 0.001)}) if pages > 1 else []
        plan = [(0, None), *[(i + 1, c) for i, c in enumerate(cuts)]]
        spark.createDataFrame(plan, "page long, low long").coalesce(1).write.mode("overwrite").parquet(f"{base}/plan")
    lows = [r.low for r in spark.read.parquet(f"{base}/plan").orderBy("page").collect()]
    for i, low in enumerate(lows):
        if _exists(spark, f"{base}/page={i}/_SUCCESS"):
            continue
        inside = texts if low is None else texts.where(F.col("id") >= low)
        inside = inside if i + 1 == len(lows) else inside.where(F.col("id") < lows[i + 1])
        held = stored(spark, folder).select("id", "digest")
        todo = inside.join(held, ["id", "digest"], "left_anti")
        made = backfill(todo, provider, width, batch).join(todo.select("id", "digest"), "id")
        made.select("id", "vector", "digest").write.mode("overwrite").parquet(f"{base}/page={i}")
    return texts.join(stored(spark, folder), ["id", "digest"], "left").select("id", "vector")
