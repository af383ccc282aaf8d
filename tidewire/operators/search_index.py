"""A search index over archive items that follows their changes.

Every version of an item has a number, a ``chunk`` and an ``offset`` below
``CHUNK`` in it.  A posting is a term's sorted offsets in one chunk, so a list is
framed by its chunk and skipped by it, and the lists of several terms meet by
chunk: a common word is as many rows as there are chunks, and none grows beyond
``CHUNK`` numbers.  Postings lie in folders by a hash of their term; a search
reads those of its terms only.  Topics, sources and entities are kept alike, to
count what a search found without reading the items.

A batch of changes adds the new versions with their postings, and tombstones for
the numbers that it replaces or deletes.  Each batch writes its own folders and
looks at earlier batches only, so one that is run again replaces itself.
:meth:`Index.compact` merges all batches so far into a generation without dead
numbers; readers see it once its mark is written, which is last.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

KEY = ["kind", "item_id", "topic_id"]
CHUNK, BUCKETS, PARTS = 1 << 15, 64, 4
_POSTING = "term string, chunk long, offsets array<int>, bucket int"
_FACET = "facet string, value string, chunk long, offsets array<int>"
_DEAD = "chunk long, offset int"


def words(title: str = "title", body: str = "body") -> Column:
    """The whole words of title and body, folded, each once."""
    text = F.lower(F.concat_ws(" ", title, body))
    return F.array_distinct(F.filter(F.split(text, r"[^\p{L}\p{N}_]+"), lambda w: w != ""))


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _listed(rows: DataFrame, *keys: str) -> DataFrame:
    """Sorted offsets by keys and chunk; a group has at most CHUNK."""
    return rows.groupBy(*keys, "chunk").agg(F.sort_array(F.collect_set("offset")).alias("offsets"))


def _postings(items: DataFrame) -> DataFrame:
    """(term, chunk, offsets) of items with chunk and offset: a row for each term and chunk of an Arrow batch, not for each word of an item."""

    def lists(batches):
        for b in batches:
            row, words = pc.list_parent_indices(b.column(2)).to_numpy(), b.column(2).flatten().dictionary_encode()
            if not len(row):
                continue
            code, chunk, offset = words.indices.to_numpy(), b.column(0).to_numpy()[row], b.column(1).to_numpy()[row]
            order = np.lexsort((offset, chunk, code))
            code, chunk, offset = code[order], chunk[order], offset[order]
            first = np.flatnonzero(np.append(True, (np.diff(code) != 0) | (np.diff(chunk) != 0)))
            offsets = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), pa.array(offset, pa.int32()))
            yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(code[first])), pa.array(chunk[first], pa.int64()), offsets], ["term", "chunk", "offsets"])

    return items.select("chunk", "offset", words().alias("words")).mapInArrow(lists, "term string, chunk long, offsets array<int>")


class Index:
    """``folder`` is shared by the cluster; ``schema`` is that of the items (kind, item_id, topic_id, title, body, source_ids, entity_ids and any others)."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        self.tables = {"items": f"{fields}, chunk long, offset int", "postings": _POSTING, "facets": _FACET, "dead": _DEAD}

    def _state(self) -> tuple[int, int]:
        """The last generation and the last batch in it; -1 where there is none."""
        try:
            row = self.spark.read.schema("upto long, generation long").parquet(f"{self.folder}/state").agg(F.max(F.struct("generation", "upto")).alias("s")).first()["s"]
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            row = None
        return (row["generation"], row["upto"]) if row else (-1, -1)

    def _table(self, name: str, below: int | None = None) -> DataFrame:
        """Rows of the last generation and of the batches after it (before ``below``)."""
        generation, upto = self._state()
        # Nothing, which the optimiser knows to be nothing.
        out = self.spark.range(1).where(F.lit(False)).select(F.from_json(F.lit("{}"), self.tables[name]).alias("x")).select("x.*")
        for kind, keep in (("batch", F.col("batch") > upto), ("generation", F.col("generation") == generation)):
            try:
                rows = self.spark.read.schema(f"{self.tables[name]}, {kind} long").parquet(f"{self.folder}/{name}/{kind}")
            except AnalysisException as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                continue
            rows = rows.where(keep)
            if kind == "batch" and below is not None:
                rows = rows.where(F.col("batch") < below)
            out = out.unionByName(rows.drop(kind))
        return out

    def _write(self, name: str, rows: DataFrame, place: str) -> None:
        if name == "postings":
            # Dealt by parts of buckets, the lists of a term and chunk meet, are merged and sorted in one shuffle.
            dealt = rows.withColumns({"bucket": _bucket(F.col("term")), "part": F.pmod(F.xxhash64("term"), F.lit(PARTS * BUCKETS))}).repartition("bucket", "part")
            rows = dealt.groupBy("bucket", "part", "term", "chunk").agg(F.sort_array(F.flatten(F.collect_list("offsets"))).alias("offsets")).drop("part").sortWithinPartitions("bucket", "term", "chunk")
            rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{name}/{place}")
        else:
            rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/{place}")

    def apply(self, changes: DataFrame, batch: int) -> None:
        """One batch of changes: items, with ``deleted`` (boolean) and ``seq`` (the last of a key counts)."""
        if batch <= self._state()[1]:
            return  # merged into a generation, so it was applied as a whole
        place = f"batch/batch={batch}"
        columns = [f.name for f in self.schema]
        last = changes.groupBy(*KEY).agg(F.max_by(F.struct("deleted", *[c for c in columns if c not in KEY]), "seq").alias("x"))
        new = last.where("NOT x.deleted").select(*(F.col(c) if c in KEY else F.col(f"x.{c}").alias(c) for c in columns))
        at = F.monotonically_increasing_id()
        # Numbers hold from when they are written; what follows reads them from there.
        new = new.withColumn("at", at).select(*columns, (F.lit(batch << 40) + F.shiftright("at", 33) * (1 << 16) + F.shiftright(F.col("at").bitwiseAND(F.lit((1 << 33) - 1)), 15)).alias("chunk"), F.col("at").bitwiseAND(F.lit(CHUNK - 1)).cast("int").alias("offset"))
        self._write("items", new, place)
        new = self.spark.read.schema(self.tables["items"]).parquet(f"{self.folder}/items/{place}")
        held = self._table("items", batch).select(*KEY, "chunk", "offset")
        self._write("dead", held.join(last.select(*KEY), KEY, "left_semi").select("chunk", "offset").join(self._table("dead", batch), ["chunk", "offset"], "left_anti"), place)
        self._write("postings", _postings(new), place)
        values = (("topic", F.array(F.col("topic_id"))), ("source", F.col("source_ids")), ("entity", F.col("entity_ids")))
        told = [new.select("chunk", "offset", F.lit(name).alias("facet"), F.explode(F.transform(v, lambda x: x.cast("string"))).alias("value")) for name, v in values]
        self._write("facets", _listed(told[0].unionByName(told[1]).unionByName(told[2]).where("value IS NOT NULL"), "facet", "value"), place)

    def compact(self, upto: int) -> None:
        """Merges the generation and the batches up to ``upto`` into the next generation, without dead numbers."""
        generation = self._state()[0] + 1
        place = f"generation/generation={generation}"
        dead = self._dead(upto + 1)
        items = self._table("items", upto + 1)
        self._write("items", items.join(self._table("dead", upto + 1), ["chunk", "offset"], "left_anti"), place)
        for name, keys in (("postings", ["term"]), ("facets", ["facet", "value"])):
            rows = self._table(name, upto + 1).join(dead, "chunk", "left")
            self._write(name, rows.select(*keys, "chunk", self._alive().alias("offsets")).where("size(offsets) > 0"), place)
        self.spark.range(1).select(F.lit(upto).cast("long").alias("upto"), F.lit(generation).cast("long").alias("generation")).write.mode("overwrite").parquet(f"{self.folder}/state/mark={generation}")

    def _dead(self, below: int | None = None) -> DataFrame:
        return self._table("dead", below).groupBy("chunk").agg(F.collect_set("offset").alias("gone"))

    @staticmethod
    def _alive() -> Column:
        return F.when(F.col("gone").isNull(), F.col("offsets")).otherwise(F.array_except("offsets", "gone"))

    def hits(self, terms: list[str]) -> DataFrame:
        """(chunk, offsets): live numbers of the items that hold all terms; without terms, of all items."""
        terms = sorted({t.lower() for t in terms})
        if not terms:
            rows = _listed(self._table("items").select("chunk", "offset"))
        else:
            # The buckets are constants to the optimiser, so other folders are not listed.
            own = self._table("postings").where(F.col("bucket").isin([_bucket(F.lit(t)) for t in terms]) & F.col("term").isin(terms))
            met = own.groupBy("chunk").agg(F.collect_list("offsets").alias("lists")).where(F.size("lists") == len(terms))
            rows = met.select("chunk", F.aggregate(F.slice("lists", 2, len(terms)), F.col("lists")[0], lambda a, b: F.array_intersect(a, b)).alias("offsets"))
        return rows.join(self._dead(), "chunk", "left").select("chunk", self._alive().alias("offsets")).where("size(offsets) > 0")

    def search(self, terms: list[str]) -> DataFrame:
        """The live items that hold all terms."""
        found = self.hits(terms).select("chunk", F.explode("offsets").alias("offset"))
        return self._table("items").join(found, ["chunk", "offset"]).drop("chunk", "offset")

    def facets(self, hits: DataFrame) -> DataFrame:
        """(facet, value, n): how many of the items that ``hits`` names have each topic, source and entity, by intersection of lists."""
        both = self._table("facets").join(hits.withColumnRenamed("offsets", "found"), "chunk")
        n = both.select("facet", "value", F.size(F.array_intersect("offsets", "found")).cast("long").alias("n"))
        return n.groupBy("facet", "value").agg(F.sum("n").alias("n")).where("n > 0")
