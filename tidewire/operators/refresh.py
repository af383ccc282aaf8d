"""Tables that are measured anew for all topics at once, where a topic that fails keeps what it had.

A folder holds runs; a run holds shares of the topics, told apart by bits of the topic's hash; a share holds one
table for each kind of row and, written last, the list of its topics.  A share counts once that list is whole, so all tables of a
topic change together, and a crash leaves the rows of the runs before.  Every call is a new run, so shares that
were written stay as they are; the next run stands in front of them.  One run at a time has the folder.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .backfill import _exists
from .relational import small

TOPICS = "topics"
ERRORS = "errors"


def _inside(topic: str, bits: int, rest: int) -> Column:
    return F.col(topic).isNotNull() & (F.pmod(F.xxhash64(topic), F.lit(1 << bits)) == rest) if bits else F.col(topic).isNotNull()


def refresh(rows: DataFrame, topic: str, measure: Callable[[DataFrame], dict[str, DataFrame]], folder: str, most_failures: int = 100) -> DataFrame:
    """(topic, error) of the topics that could not be measured, after writing all others to a new run in ``folder``.

    ``measure`` turns rows of some topics into tables by name, each with the column ``topic``; it sees whole topics, and
    several at once.  All topics are one share at first.  A share whose jobs fail, for whatever reason, is halved by one
    more bit of its topics' hash, until a topic that fails is alone, so f failures among n topics take some 2 f log2(n) jobs.  More
    than ``most_failures`` failing topics mean that it is not the topics that fail: the last error is raised.  Shares
    written by then stay, and topics without one keep the rows of earlier runs.

    A topic that has rows and is measured without giving any has none afterwards; a topic without rows is not part of the run.
    Rows without a topic are left out.
    """
    spark = rows.sparkSession
    schema = rows.select(topic).schema
    base = f"{folder}/run={max(_runs(spark, folder), default=-1) + 1}"
    failed: list[tuple] = []
    shares = [(0, 0)]
    while shares:
        bits, rest = shares.pop()
        mine = rows.where(_inside(topic, bits, rest))
        path = f"{base}/share={bits}-{rest}"
        try:
            for name, table in measure(mine).items():
                if name in (TOPICS, ERRORS):
                    raise ValueError(f"a table cannot be called {name}")
                table.where(F.col(topic).isNotNull()).hint("rebalance").write.mode("overwrite").parquet(f"{path}/{name}")
            mine.select(topic).distinct().write.mode("overwrite").parquet(f"{path}/{TOPICS}")
        except (PySparkException, Py4JJavaError) as error:
            # Two topics tell whether one is alone; the full hash tells all others apart.
            some = mine.select(topic).distinct().limit(2).collect()
            if len(some) > 1 and bits < 62:
                shares += [(bits + 1, rest + (1 << bits)), (bits + 1, rest)]
                continue
            failed += [(r[0], str(error).split("\n")[0][:500]) for r in some]
            if not some or len(failed) > most_failures:
                raise
    errors = spark.createDataFrame(failed, f"{schema[0].name} {schema[0].dataType.simpleString()}, error string")
    errors.coalesce(1).write.mode("overwrite").parquet(f"{base}/{ERRORS}")
    return spark.read.schema(errors.schema).parquet(f"{base}/{ERRORS}")


def _matching(spark: SparkSession, pattern: str) -> list[str]:
    p = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or []
    return [str(f.getPath().toString()) for f in found]


def _runs(spark: SparkSession, folder: str) -> list[int]:
    """The runs that have begun, whether or not they ended."""
    return sorted(int(x.rsplit("run=", 1)[1]) for x in _matching(spark, f"{folder}/run=*"))


def _shares(spark: SparkSession, folder: str) -> list[tuple[int, str]]:
    """(run, path) of the shares whose list of topics is whole."""
    paths = [x.rsplit(f"/{TOPICS}/", 1)[0] for x in _matching(spark, f"{folder}/run=*/share=*/{TOPICS}/_SUCCESS")]
    return [(int(x.rsplit("/run=", 1)[1].split("/")[0]), x) for x in paths]


def _read(spark: SparkSession, shares: list[tuple[int, str]], table: str) -> DataFrame | None:
    by_run: dict[int, list[str]] = {}
    for run, path in shares:
        if _exists(spark, f"{path}/{table}/_SUCCESS"):
            by_run.setdefault(run, []).append(f"{path}/{table}")
    parts = [spark.read.parquet(*paths).withColumn("run", F.lit(run)) for run, paths in sorted(by_run.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None


def current(spark: SparkSession, folder: str, table: str, topic: str) -> DataFrame:
    """The rows of ``table`` from each topic's last whole run, with the number of that run as ``run``."""
    shares = _shares(spark, folder)
    topics, rows = _read(spark, shares, TOPICS), _read(spark, shares, table)
    if topics is None or rows is None:
        raise ValueError(f"{folder} has no whole run with {table}")
    last = topics.groupBy(topic).agg(F.max("run").alias("run"))
    return rows.join(small(last), [topic, "run"], "left_semi")


def prune_runs(spark: SparkSession, folder: str, topic: str) -> list[int]:
    """Deletes the runs that no topic reads any more, and returns their numbers."""
    shares = _shares(spark, folder)
    topics = _read(spark, shares, TOPICS)
    if topics is None:
        return []
    used = {r[0] for r in topics.groupBy(topic).agg(F.max("run").alias("run")).select("run").distinct().collect()}
    gone = sorted({run for run, _ in shares} - used)
    for run in gone:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/run={run}")
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return gone


def read_through(rows: DataFrame, asked: DataFrame, topic: str, measure: Callable[[DataFrame], dict[str, DataFrame]], folder: str, table: str) -> DataFrame:
    """``current`` of the topics in ``asked``, after measuring those of them that have rows and no run yet."""
    spark = rows.sparkSession
    wanted = asked.select(topic).distinct()
    topics = _read(spark, _shares(spark, folder), TOPICS)
    missing = wanted if topics is None else wanted.join(topics.select(topic).distinct(), topic, "left_anti")
    todo = rows.join(small(missing), topic, "left_semi")
    if topics is None or not todo.isEmpty():
        refresh(todo, topic, measure, folder)
    return current(spark, folder, table, topic).join(small(wanted), topic, "left_semi")
