"""Streams over several triggers, with rows that come late, against the batch forms."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pagelake.operators import attempts
from pagelake.session import scratch_path
from pagelake.streaming import jobs

from .test_goldens import attempts_log

ATTEMPT = "batch_id long, ts timestamp, event_id long, ok boolean, cancel boolean"


def drained(spark, parts, make, schema=ATTEMPT):
    """Last row of every batch, all rows of all triggers, and the stream's state folder, one file a trigger."""
    folder, state = scratch_path(spark, "in"), scratch_path(spark, "state")
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(folder)
    last, every = {}, []

    def keep(batch, _):
        for r in batch.collect():
            last[r.batch_id] = tuple(r)
            every.append(tuple(r))

    q = make(src).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return last, every, state


@pytest.mark.parametrize("seed, total", [(1, 6), (2, 2), (3, 99)])
def test_late_attempts_over_triggers(spark, seed, total):
    rows = attempts_log(seed)
    random.Random(seed).shuffle(rows)  # every trigger has attempts from all over the log
    log = spark.createDataFrame(rows, ATTEMPT).selectExpr("*", "event_id % 1000 + 1 AS seq")
    want = {(r.batch_id, r.n_pages, r.status, r.failed_page) for r in attempts.batch_summary(log, total, chunk=4).collect()}
    last, every, _ = drained(spark, [rows[k::5] for k in range(5)], lambda s: jobs.scan_batch_collector(s, total))
    assert set(last.values()) == want and len(every) > len(last)


def test_state_is_empty_after_the_end(spark):
    t = dt.datetime(2024, 1, 1)
    at = lambda s: t + dt.timedelta(seconds=s)
    one = [(1, at(0), 0, True, False), (1, at(30), 3, True, False), (2, at(5), 0, True, False)]
    two = [(1, at(10), 1, False, False), (1, at(20), 2, False, False), (2, at(40), 1, True, False), (4, None, 9, True, False)]  # late, but in time
    three = [(1, at(200), 4, True, False), (2, at(210), 2, True, True)]
    four = [(3, at(9000), 0, True, False)]
    last, every, state = drained(spark, [one, two, three, four], lambda s: jobs.scan_batch_collector(s, 3, idle_ms=600_000, late="1 minute"))
    assert last[1] == (1, 3, "finished", None) and last[2] == (2, 3, "cancelled", None) and last[3] == (3, 1, "open", None)
    assert not any(r[2] == "abandoned" for r in every if r[0] in (1, 2))
    left = lambda name: sorted(r.key.batch_id for r in spark.read.format("statestore").option("path", state).option("stateVarName", name).load().select("key").distinct().collect())
    assert left("progress") in ([3], [3, 4]) and left("waiting") in ([3], [3, 4])


def test_silent_batch_is_abandoned(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [[(1, t, 0, True, False)], [(2, t + dt.timedelta(hours=9), 0, True, False)], [(2, t + dt.timedelta(hours=9, seconds=1), 1, True, False)]]
    last, _, _ = drained(spark, rows, lambda s: jobs.scan_batch_collector(s, 5, idle_ms=60_000, late="1 second"))
    assert last[1] == (1, 1, "abandoned", None) and last[2] == (2, 2, "open", None)


def test_a_hot_batch_keeps_bounded_state(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, t + dt.timedelta(seconds=5000 - k), 5000 - k, True, k == 4999) for k in range(5000)]
    last, _, state = drained(spark, [rows[k::3] for k in range(3)], lambda s: jobs.scan_batch_collector(s, 4))
    assert last == {1: (1, 1, "cancelled", None)}
    assert spark.read.format("statestore").option("path", state).option("stateVarName", "waiting").option("flattenCollectionTypes", "true").load().count() <= 12


def test_frame_corners_stream_equals_table(spark):
    t = dt.datetime(2024, 1, 1)
    pixels = []
    for doc in range(12):  # a bright sheet on a dark ground, another place for each frame; frame 5 has no raster, 6 is blank
        if doc != 5:
            for y in range(60):
                pixels.append((doc, 1, y, [220 if doc != 6 and 8 + doc <= y < 48 and 6 + doc <= x < 40 + doc else 30 for x in range(70)]))
    lines = spark.createDataFrame(pixels, "doc_id long, page_no int, y int, px array<int>")
    frames = [(doc, "ab"[doc % 2], t + dt.timedelta(milliseconds=150 * doc)) for doc in range(12)]
    schema = "doc_id long, camera string, ts timestamp"
    want = jobs.frame_corners(jobs.newest_frames(spark.createDataFrame(frames, schema)), lines)
    folder, out = scratch_path(spark, "frames"), scratch_path(spark, "corners")
    for part in (frames[:6:2], frames[1:6:2] + frames[7:8], frames[6:7] + frames[8:], [(99, "clock", t + dt.timedelta(hours=1))]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    jobs.frame_corner_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder), lines, out)
    got = spark.read.parquet(out).drop("batch")
    shown = lambda df: sorted(str((r.camera, r.tick, r.doc_id, r.doc_quad)) for r in df.collect())
    assert shown(got) == shown(want) and len(shown(want)) >= 5
