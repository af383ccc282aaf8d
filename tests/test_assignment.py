"""Online assignment as a stream: any cut into batches, and any restart, gives the answer of one pass in the order of time."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest

from tidewire import constants as C
from tidewire.streaming import assignment, ingest

SCHEMA = "topic string, article long, at timestamp, words array<long>, phrases array<long>"
T0 = dt.datetime(2024, 3, 1, tzinfo=dt.UTC)


def articles(seed, n=70):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        base = r.choice([0, 100, 200])
        words = sorted({base + r.randrange(9) for _ in range(r.randrange(0, 7))})
        rows.append((r.choice("ab"), i, T0 + dt.timedelta(minutes=r.randrange(0, 9 * 24 * 60, 30)), words, [w * 7 for w in words if r.random() < 0.5]))
    return sorted(rows, key=lambda x: (x[2], x[1]))


def plain(rows, hours=72):
    def jac(a, b):
        a, b = set(a), set(b)
        return len(a & b) / max(1, len(a | b))

    out, stories = {}, {}
    for topic, i, at, words, phrases in rows:
        best = None
        for s, (t, first, last, w, p) in stories.items():
            score = C.WORD_WEIGHT * jac(words, w) + (1 - C.WORD_WEIGHT) * jac(phrases, p)
            if t == topic and score >= C.SAME_STORY and first >= at - dt.timedelta(hours=hours):
                best = max(best or (score, last, -s), (score, last, -s))
        if best is None:
            stories[i] = (topic, at, at, words, phrases)
            out[i] = i
        else:
            s = -best[2]
            stories[s] = (*stories[s][:2], at, *stories[s][3:])
            out[i] = s
    return out


def written(spark, folder, batches):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/articles-{k:03}")


def run(spark, folder):
    stream = ingest.source(spark, f"{folder}/in", "part", SCHEMA)
    return {r.article: r.story for r in assignment.finish(assignment.online(stream, "6 hours"), str(folder)).collect()}


CLOCK = [(None, None, T0 + dt.timedelta(days=30), None, None)]


@pytest.mark.parametrize("cuts", [1, 4])
def test_stream_equals_one_pass_in_the_order_of_time(spark, tmp_path, cuts):
    rows = articles(cuts)
    size = -(-len(rows) // cuts)
    batches = [rows[i : i + size] for i in range(0, len(rows), size)]
    for b in batches:
        random.Random(1).shuffle(b)
    written(spark, tmp_path, [*batches, CLOCK])
    assert run(spark, tmp_path) == plain(rows)


def test_stream_goes_on_after_a_restart_and_waits_for_what_is_late(spark, tmp_path):
    rows = articles(9)
    i = next(i for i in range(30, len(rows)) if dt.timedelta(0) < rows[i][2] - rows[i - 1][2] <= dt.timedelta(hours=5))
    # The article before the last of the first batch comes with the next one, within the six hours that the stream waits.
    early, held, later = [*rows[: i - 1], rows[i]], rows[i - 1], rows[i + 1 :]
    written(spark, tmp_path, [early])
    first = run(spark, tmp_path)
    want = plain(rows)
    assert set(first) < set(want) and all(want[k] == v for k, v in first.items())
    for k, b in enumerate([[held, *later[:5]], later[5:], CLOCK]):
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/more-{k}")
    assert run(spark, tmp_path) == want


def test_what_comes_too_late_is_an_error_and_not_lost(spark, tmp_path):
    rows = articles(3)
    written(spark, tmp_path, [rows[10:], CLOCK, rows[:10]])
    with pytest.raises(ValueError, match="later than"):
        run(spark, tmp_path)


def test_a_table_as_a_stream_equals_the_batch_fold(spark, data):
    """On the tables, whole texts: the stream and the fold over pieces of pairs agree."""
    from tidewire import plans

    got = {(r.topic, r.article): r.story for r in plans.QUERIES["stm_05_06_streamed"](spark, data).collect()}
    want = {(r.topic, r.article): r.story for r in plans.QUERIES["stm_05_06_online_assignment"](spark, data).collect()}
    assert got == want and len(set(want.values())) < len(want)


def test_a_table_without_rows_or_times(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert assignment.replayed(empty, str(tmp_path / "a")).count() == 0
    rows = articles(5)
    df = spark.createDataFrame(rows, SCHEMA).unionByName(spark.createDataFrame([("a", 99, None, [1], [])], SCHEMA))
    got = {r.article: r.story for r in assignment.replayed(df.repartition(3), str(tmp_path / "b"), slices=3, files=2).collect()}
    assert got == plain(rows) | {99: 99}


def test_a_batch_calls_a_topic_once_however_many_hours_wait(spark, tmp_path, monkeypatch):
    """Articles of nine days that come due at once are one call of a timer, and chunks are read in order and cut at the watermark."""
    monkeypatch.setattr(assignment, "CHUNK", 5)

    class State(dict):
        removeKey, containsKey, updateValue, getValue, iterator = dict.__delitem__, dict.__contains__, dict.__setitem__, dict.__getitem__, dict.items

    class Handle:
        def __init__(self):
            self.timers = set()

        def getMapState(self, *_):
            return State()

        def registerTimer(self, ms):
            self.timers.add(ms)

    class Clock:
        def __init__(self, now):
            self.now = now

        def getCurrentWatermarkInMs(self):
            return self.now

    rows = [r for r in articles(4) if r[0] == "a"]
    ms = [int(r[2].timestamp() * 1000) for r in rows]
    handle, worker = Handle(), assignment.Assigner(72)
    worker.init(handle)
    frame = pd.DataFrame({"ms": ms, "article": [r[1] for r in rows], "words": [np.array(r[3], np.int64) for r in rows], "phrases": [np.array(r[4], np.int64) for r in rows]})
    frame = frame.sample(frac=1, random_state=1)
    got = {}
    for part in (frame[::2], frame[1::2]):  # chunks that overlap
        list(worker.handleInputRows(("a",), iter([part]), None))
    assert len(handle.timers) <= 2 and min(ms) < max(handle.timers) <= min(ms[:2]) + 9 * 24 * assignment.HOUR
    for now in (ms[len(ms) // 2], ms[-1] + assignment.HOUR, ms[-1] + 80 * assignment.HOUR):
        for pdf in worker.handleExpiredTimer(("a",), Clock(now), None):
            assert set(pdf.article) == {a for a, m in zip([r[1] for r in rows], ms, strict=True) if m < now and a not in got}
            got |= dict(zip(pdf.article, pdf.story, strict=True))
        assert all(m >= now - 72 * assignment.HOUR for m, *_ in worker.stories.values())
    assert got == plain(rows) and not worker.waiting and not worker.stories
    assert len(handle.timers) <= 6
