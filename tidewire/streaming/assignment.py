"""Articles to stories, one after the other in the order of time, over a stream.

An article joins the best story of its topic that scores ``SAME_STORY`` or more
and whose first article is at most 72 hours older; else it opens a story.  A story
is scored by its first article.  So an article's answer needs the stories of the
72 hours before it, and those need theirs: within a topic the order of time cannot
be cut, but what is kept is bounded by the window.

State lives per topic in RocksDB: articles that wait, and stories in reach.  The
watermark says when all articles up to an instant are there; an event-time timer
then takes all waiting ones before it in order, so the answer does not depend on
how the stream was cut into batches, nor on restarts.  Articles wait in chunks, each
sorted and read when its turn comes.  A topic has a timer for the first article that waits and one for the
first story that falls out of reach, so a batch calls it once or twice, however many
hours it spans.  An article later than ``late`` would be dropped by Spark (to the hour);
:func:`finish` raises if one was, rather than return part of the answer.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from heapq import heappop, heapreplace
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .. import constants as C

HOUR = 3_600_000
#: The stream's clock: an hour is a second, so that pandas, which holds times up to 2262, takes articles of any time.
TICK = 1000
#: State that several timers and ordered keys need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Articles that wait under one key of the state.
CHUNK = 64
_STORY = "first long, last long, words binary, phrases binary"


def _told(rows: list[tuple]) -> pd.DataFrame:
    """Rows of (topic, article, story) with plain columns, as the state's Arrow writer asks."""
    topic, article, story = zip(*rows, strict=True) if rows else ((), (), ())
    return pd.DataFrame({"topic": pd.Series(topic, dtype=object), "article": pd.Series(article, dtype="int64"), "story": pd.Series(story, dtype="int64")})


def _packed(rows: list[tuple]) -> bytes:
    """Rows of (ms, article, words, phrases) as 64-bit numbers: how many, the columns, sizes of lists, lists."""
    ms, article, *lists = zip(*rows, strict=True)
    lists = [[np.asarray(x, np.int64) for x in of] for of in lists]
    return np.concatenate([np.array([len(rows), *ms, *article, *(len(x) for of in lists for x in of)], np.int64), *lists[0], *lists[1]]).tobytes()


def _unpacked(data: bytes) -> Iterator[tuple]:
    flat = np.frombuffer(data, np.int64)
    n = int(flat[0])
    ms, article = (flat[1 + k * n : 1 + (k + 1) * n].tolist() for k in (0, 1))
    lists = np.split(flat[1 + 4 * n :], np.cumsum(flat[1 + 2 * n : 1 + 4 * n])[:-1])
    return zip(ms, article, lists[:n], lists[n:], strict=True)


class Board:
    """The stories in reach of one topic, in the order in which they opened, and which of them share a term with an article."""

    def __init__(self):
        self.held: list[tuple] = []
        self._index()

    def _index(self) -> None:
        held, self.held = self.held, []
        self.ids, self.first, self.last, self.size = [], [], [], ([], [])
        self.posting: tuple[dict[int, list[int]], dict[int, list[int]]] = ({}, {})
        for story in held:
            self.add(*story)

    def add(self, story: int, first: int, last: int, words: np.ndarray, phrases: np.ndarray) -> None:
        at = len(self.ids)
        self.held.append((story, first, last, words, phrases))
        self.ids.append(story)
        self.first.append(first)
        self.last.append(last)
        for posting, size, terms in zip(self.posting, self.size, (words, phrases), strict=True):
            own = set(terms.tolist())
            size.append(len(own))
            for term in own:
                posting.setdefault(term, []).append(at)

    def joined(self, at: int, ms: int) -> None:
        story, first, last, words, phrases = self.held[at]
        self.last[at] = max(last, ms)
        self.held[at] = (story, first, self.last[at], words, phrases)

    def forget(self, before: int, spare: int = 0) -> None:
        """Leaves out the stories that opened before an instant; with ``spare`` only once they are more than that and than the others."""
        gone = bisect_left(self.first, before)
        if gone > spare and (not spare or 2 * gone > len(self.first)):
            self.held = self.held[gone:]
            self._index()

    def best(self, ms: int, words: np.ndarray, phrases: np.ndarray, reach: int) -> int:
        """Place of the story that the article joins, or -1: highest score, then latest story, then smallest id."""
        n = len(self.ids)
        if not n:
            return -1
        score = np.zeros(n)
        for posting, size, terms, weight in zip(self.posting, self.size, (words, phrases), (C.WORD_WEIGHT, 1 - C.WORD_WEIGHT), strict=True):
            own = set(terms.tolist())
            met = [posting[t] for t in own if t in posting]
            common = np.bincount(list(chain.from_iterable(met)), minlength=n) if met else np.zeros(n, np.int64)
            score = score + weight * (common / np.maximum(1, np.array(size) + len(own) - common))
        ok = np.flatnonzero((score >= C.SAME_STORY) & (np.array(self.first) >= ms - reach))
        return max(ok.tolist(), key=lambda i: (score[i], self.last[i], -self.ids[i]), default=-1)


class Assigner(StatefulProcessor):
    def __init__(self, hours: int, tick: int = HOUR):
        self.reach, self.tick = hours * HOUR, tick

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ms long, article long, place long", "rows binary")
        self.stories = handle.getMapState("stories", "story long", _STORY)

    def _after(self, ms: int) -> None:
        """A timer at the first full hour after ``ms``; asking for one again changes nothing."""
        self.handle.registerTimer((int(ms) // HOUR + 1) * self.tick)

    def _wait(self, rows: list[tuple]) -> None:
        """Keeps sorted rows under their first."""
        key = (*rows[0][:2], 0)
        while self.waiting.containsKey(key):
            key = (*key[:2], key[2] + 1)
        self.waiting.updateValue(key, (_packed(rows),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = []
        for pdf in rows:
            pdf = pdf[pdf.article.notna()]  # a row without an article only moves the clock
            told = sorted(zip(pdf.ms.astype("int64").tolist(), pdf.article.astype("int64").tolist(), pdf.words, pdf.phrases, strict=True), key=lambda r: r[:2])
            for k in range(0, len(told), CHUNK):
                self._wait(told[k : k + CHUNK])
            first += [ms for ms, *_ in told[:1]]
        if first:
            self._after(min(first))
        yield _told([])

    def _due(self, now: int) -> Iterator[tuple]:
        """The articles before ``now`` in order, which wait no longer; a chunk is read when its turn comes."""
        chunks = sorted(tuple(k) for k in self.waiting.keys())
        heap, open_, told = [(ms, article, i) for i, (ms, article, _) in enumerate(chunks) if ms < now], {}, None
        while heap:
            ms, article, i = heap[0]
            if i not in open_:
                rows = _unpacked(bytes(self.waiting.getValue(chunks[i])[0]))
                open_[i] = [next(rows), rows]
            row, rows = open_[i]
            if (ms, article) != told:
                told = (ms, article)
                yield row
            row = next(rows, None)
            if row is not None and row[0] < now:
                open_[i][0] = row
                heapreplace(heap, (*row[:2], i))
                continue
            heappop(heap)
            del open_[i]
            self.waiting.removeKey(chunks[i])
            if row is not None:
                self._wait([row, *rows])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # No article before the watermark is still to come.
        now = timerValues.getCurrentWatermarkInMs() * (HOUR // self.tick)
        stored = {k[0]: (*v[:2], *(np.frombuffer(bytes(x), np.int64) for x in v[2:])) for k, v in ((k, tuple(v)) for k, v in self.stories.iterator())}
        board, out = Board(), []
        for story, value in sorted(stored.items(), key=lambda x: (x[1][0], x[0])):
            board.add(story, *value)
        for ms, article, words, phrases in self._due(now):
            board.forget(ms - self.reach, spare=32)
            at = board.best(ms, words, phrases, self.reach)
            if at < 0:
                board.add(article, ms, ms, words, phrases)
                at = len(board.ids) - 1
            board.joined(at, ms)
            out.append((key[0], article, board.ids[at]))
        board.forget(now - self.reach)
        held = {story: value for story, *value in board.held}
        for story in stored.keys() - held.keys():
            self.stories.removeKey((story,))
        for story, (first, last, words, phrases) in held.items():
            if (first, last) != stored.get(story, ())[:2]:
                self.stories.updateValue((story,), (first, last, words.tobytes(), phrases.tobytes()))
        waiting = min((k[0] for k in self.waiting.keys()), default=None)
        if waiting is not None:
            self._after(waiting)
        if board.first:
            self._after(board.first[0] + self.reach)
        yield _told(out)

    def close(self) -> None:
        pass


def online(articles: DataFrame, late: str, hours: int = 72) -> DataFrame:
    """(topic, article, story) over a stream of (topic, article, at, words, phrases): ids and hashed terms are long, ``at`` a timestamp."""
    articles.sparkSession.conf.set(*STORE)
    topic = articles.schema["topic"].dataType.simpleString()
    waits = articles.sparkSession.sql(f"SELECT unix_millis(timestamp_millis(0) + INTERVAL {late})").first()[0]
    rows = articles.withColumn("ms", F.unix_millis("at")).withColumn("at", F.timestamp_seconds(F.floor(F.col("ms") / HOUR)))
    rows = rows.withWatermark("at", f"{-(-waits * TICK // HOUR)} milliseconds")
    return rows.groupBy("topic").transformWithStateInPandas(Assigner(hours, TICK), f"topic {topic}, article long, story long", "Append", "EventTime")


def finish(stream: DataFrame, folder: str) -> DataFrame:
    """Runs all that is available of :func:`online` into a table in ``folder``; a batch run again replaces itself."""
    spark, path, schema = stream.sparkSession, f"{folder}/stories", stream.schema

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = stream.writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    dropped = sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)
    if dropped:
        raise ValueError(f"{dropped} articles came later than the stream waits for")
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def replayed(articles: DataFrame, folder: str, slices: int = 4, hours: int = 72, files: int = 64) -> DataFrame:
    """:func:`online` over a table: its articles are written in slices of time, one folder of files each, and read back as a stream.

    A batch may end within a slice, whose files are in no order: the stream waits for the width of a slice.
    Articles without a time are near no other and open stories of their own.
    """
    spark = articles.sparkSession
    held = articles.where("at IS NOT NULL").withColumn("ms", F.unix_millis("at"))
    cuts = held.agg(F.percentile_approx("ms", [i / slices for i in range(1, slices)], 10_000).alias("cuts"), F.min("ms").alias("first"), F.max("ms").alias("last")).first()
    if cuts["last"] is None:
        return articles.select("topic", "article", F.col("article").alias("story"))
    inner = sorted(set(cuts["cuts"]))
    bounds, edges = [None, *inner, None], [cuts["first"], *inner, cuts["last"]]
    late = max(z - a for a, z in zip(edges[:-1], edges[1:], strict=True)) + 2 * HOUR
    schema = articles.schema
    for i, (a, z) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        part = held if a is None else held.where(F.col("ms") > a)
        part = part if z is None else part.where(F.col("ms") <= z)
        part.drop("ms").write.parquet(f"{folder}/in/slice-{i:05}")
    # A row that moves the clock past everything that waits.
    end = spark.range(1).select(F.timestamp_millis(F.lit(cuts["last"] + late + (hours + 48) * HOUR)).alias("at"))
    end.select(*(F.col("at") if f.name == "at" else F.lit(None).cast(f.dataType).alias(f.name) for f in schema)).write.parquet(f"{folder}/in/slice-end")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "part*").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files).parquet(f"{folder}/in")
    told = finish(online(stream, f"{late} milliseconds", hours), folder)
    return told.unionByName(articles.where("at IS NULL").select("topic", "article", F.col("article").alias("story")))
