"""Incremental forms of intake, debounce, batch collection and hand-off."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..functions import names as n
from ..operators import attempts as a
from ..operators.intake import validate_upload
from ..session import cut_lineage, scratch_path
from ..sources.folders import folder_stream


def intake_rules(files: DataFrame) -> DataFrame:
    """Visible files with their kind and the reason a file is refused; valid on streams."""
    visible = files.where("name NOT LIKE '.%'").withColumn("kind", F.expr(n.file_kind("name")))
    return validate_upload(visible)


def intake_stream(spark: SparkSession, folder: str, settle_ms: int = 10_000) -> DataFrame:
    """Files arriving in the intake folder, ``_`` names included; half-written ones are hidden by name."""
    return intake_rules(folder_stream(spark, folder, settle_ms).drop("depth"))


def drain(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a stream over everything available into the shared folder and read the result."""
    spark = stream.sparkSession
    out, state = scratch_path(spark, label), scratch_path(spark, f"{label}-state")
    q = (
        stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", state)
        .trigger(availableNow=True).start(out)
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def drain_batches(stream: DataFrame, label: str, handle: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    q = (
        stream.writeStream.outputMode(mode).foreachBatch(handle)
        .option("checkpointLocation", scratch_path(stream.sparkSession, f"{label}-state")).trigger(availableNow=True).start()
    )
    q.awaitTermination()


def debounced_profile(changes: DataFrame, keys: list[str], gap: str = "800 milliseconds", late: str | None = None) -> DataFrame:
    """Upload points of each owner: after ``gap`` of silence the stored value of every key.

    Works on tables and streams. On a stream ``late`` (the watermark) is our own
    rule: how long a straggler may still extend its session. A stream gives the
    keys that changed; ``carry_forward`` over its results adds the others, as is
    done here for a table. Sessions are merged inside each task before they meet.
    """
    changes.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    if changes.isStreaming:
        changes = changes.withWatermark("ts", late or gap)
    latest = [
        F.expr(f"max_by(CASE WHEN key = '{k}' THEN value END, CASE WHEN key = '{k}' THEN struct(ts, seq) END)").alias(k)
        for k in keys
    ]
    flushed = changes.groupBy("owner", F.session_window("ts", gap).alias("_w")).agg(
        F.count(F.lit(1)).alias("n_changes"), *latest
    ).select("owner", F.col("_w.end").alias("flush_at"), "n_changes", *keys)
    return flushed if changes.isStreaming else carry_forward(flushed, keys)


def carry_forward(flushed: DataFrame, keys: list[str]) -> DataFrame:
    """Upload points with every key's last value up to then; null only before a key's first change."""
    past = W.partitionBy("owner").orderBy("flush_at").rowsBetween(W.unboundedPreceding, W.currentRow)
    return flushed.withColumns({k: F.last(k, ignorenulls=True).over(past) for k in keys})


def coalesced_requests(requests: DataFrame, gap: str = "350 milliseconds", late: str | None = None) -> DataFrame:
    """Debounced runs per requester: one run after each pause, with the last values asked for."""
    if requests.isStreaming:
        requests = requests.withWatermark("ts", late or gap)
    return requests.groupBy("owner", F.session_window("ts", gap).alias("_w")).agg(
        F.count(F.lit(1)).alias("n_requests"), F.max_by("value", F.struct("ts", "seq")).alias("value")
    ).select("owner", F.col("_w.end").alias("run_at"), "n_requests", "value")


def collapse_pending(batch: DataFrame) -> DataFrame:
    """Requests that piled up while a run was busy: one more run, with the newest values."""
    return batch.groupBy("owner").agg(
        F.count(F.lit(1)).alias("n_requests"), F.max_by("value", F.struct("ts", "seq")).alias("value")
    )


_SUMMARY = "batch_id long, n_pages long, status string, failed_page long"
_ATTEMPT = "at_us long, event_id long, ok boolean, cancel boolean"
_PROGRESS = "pages long, streak long, status string, seen long, settle_at long, idle_at long"
_MOST = (1 << 63) - 1


def _advance(so_far: tuple, rows: list[tuple], total: int, first_tries: int) -> tuple:
    """(pages, failures in a row, status, attempts seen) after ``rows``, which are in order of time."""
    pages, streak, status, seen = so_far
    for _, _, ok, cancel in rows:
        if status != "open":
            break
        seen += 1
        pages, streak = (pages + 1, 0) if ok else (pages, streak + 1)
        if not ok and seen == 1 and first_tries == 1:
            status = "failed"
        elif cancel:
            status = "cancelled"
        elif streak == a.TRIES:
            status = "failed"
        elif pages == total:
            status = "finished"
    return pages, streak, status, seen


class BatchCollector(StatefulProcessor):
    """Attempts of one scan batch, put in order of time however late they come.

    ``progress`` holds what is settled: attempts that the watermark has passed. Later ones
    wait in the list ``waiting``. A page is over after three attempts, so no more than 3 x total
    attempts can count; only the earliest so many are kept, and neither the state nor the
    memory of a call grows with a hot batch. Two timers by event time: when the watermark passes what
    waits, it is settled; after ``idle_ms`` of silence the batch is reported as abandoned if it is still
    open, and everything about it is forgotten.
    """

    def __init__(self, total: int, first_tries: int, idle_ms: int | None):
        self.total, self.first_tries, self.idle_ms = total, first_tries, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", _PROGRESS)
        self.waiting = handle.getListState("waiting", _ATTEMPT)

    def _load(self) -> tuple[tuple, int | None, int | None, list[tuple]]:
        *so_far, settle_at, idle_at = self.progress.get() or (0, 0, "open", 0, None, None)
        return tuple(so_far), settle_at, idle_at, [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []

    def _store(self, so_far: tuple, held: list[tuple], settle_at: int | None, idle_at: int | None) -> None:
        self.progress.update((*so_far, settle_at, idle_at))
        if held:
            self.waiting.put(held)
        else:
            self.waiting.clear()

    def _timer(self, old: int | None, new: int | None) -> int | None:
        if old != new:
            if old is not None:
                self.handle.deleteTimer(old)
            if new is not None:
                self.handle.registerTimer(new)
        return new

    def _summary(self, key: tuple, so_far: tuple) -> pd.DataFrame:
        pages, _, status, _ = so_far
        failed = pages + 1 if status == "failed" else None
        return pd.DataFrame({"batch_id": [key[0]], "n_pages": [pages], "status": [status], "failed_page": pd.array([failed], "Int64")})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        so_far, settle_at, idle_at, held = self._load()
        room, newest = (3 * self.total - so_far[3] if so_far[2] == "open" else 0), idle_at - self.idle_ms if idle_at else 0
        for chunk in rows:
            at = chunk["ts"].astype("datetime64[us]").astype("int64").where(chunk["ts"].notna(), _MOST)
            stamps = at[at < _MOST]
            newest = max(newest, int(stamps.max()) // 1000 if len(stamps) else 0)
            held = heapq.nsmallest(room, [*held, *zip(at.tolist(), chunk["event_id"].tolist(), chunk["ok"].tolist(), chunk["cancel"].tolist())])
        if self.idle_ms:
            settle_at = self._timer(settle_at, min((r[0] // 1000 + 1 for r in held if r[0] < _MOST), default=None))
            idle_at = self._timer(idle_at, newest + self.idle_ms)
        self._store(so_far, held, settle_at, idle_at)
        yield self._summary(key, _advance(so_far, held, self.total, self.first_tries))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        so_far, settle_at, idle_at, held = self._load()
        passed = timerValues.getCurrentWatermarkInMs()
        if idle_at is None:
            return
        if passed >= idle_at:
            so_far = _advance(so_far, sorted(held), self.total, self.first_tries)
            self._timer(settle_at, None)
            if expiredTimerInfo.getExpiryTimeInMs() != idle_at:
                self._timer(idle_at, None)
            self.progress.clear()
            self.waiting.clear()
            if so_far[2] == "open":
                yield self._summary(key, (*so_far[:2], "abandoned", 0))
            return
        due = sorted(r for r in held if r[0] // 1000 < passed)
        so_far = _advance(so_far, due, self.total, self.first_tries)
        held = [r for r in held if r[0] // 1000 >= passed] if so_far[2] == "open" else []
        settle_at = min((r[0] // 1000 + 1 for r in held if r[0] < _MOST), default=None)
        if settle_at:
            self.handle.registerTimer(settle_at)
        self._store(so_far, held, settle_at, idle_at)


def scan_batch_collector(
    attempts: DataFrame, total: int = a.MAX_PAGES, first_tries: int = 1, idle_ms: int | None = None, late: str = "10 minutes"
) -> DataFrame:
    """Running summary of every scan batch from a stream of attempts.

    Each trigger emits the batches it touched, as they stand with all attempts known so far put
    in order of time (then event_id; without a time, last): what comes in a later trigger may change the result, and the last
    row of a batch equals the batch form. Without ``idle_ms`` nothing is ever too late. With it
    (our rule), attempts may be ``late`` behind the newest one; a batch that stays silent for ``idle_ms`` in event
    time is reported as abandoned and forgotten. State is kept in RocksDB.
    """
    attempts.sparkSession.conf.set(
        "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = attempts.select("batch_id", "ts", "event_id", "ok", "cancel")
    if idle_ms:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy("batch_id").transformWithStateInPandas(
        BatchCollector(total, first_tries, idle_ms), _SUMMARY, "Update", "EventTime" if idle_ms else "None")


def newest_frames(frames: DataFrame, gap: str = "350 milliseconds", late: str = "1 second") -> DataFrame:
    """The newest frame of each camera per tick; only its reference is aggregated."""
    if frames.isStreaming:
        frames = frames.withWatermark("ts", late)
    return frames.groupBy("camera", F.window("ts", gap).alias("_w")).agg(
        F.max_by("doc_id", F.struct("ts", "doc_id")).alias("doc_id")
    ).select("camera", F.col("_w.start").alias("tick"), "doc_id")


def frame_corners(picked: DataFrame, lines: DataFrame, max_edge: int = 320) -> DataFrame:
    """Document corners of the picked frames; frames without a raster are skipped."""
    from ..operators.detect import detect_document

    wanted = lines.join(picked.select("doc_id"), "doc_id", "left_semi")
    return picked.join(detect_document(wanted, max_edge), "doc_id")


def frame_corner_stream(frames: DataFrame, lines: DataFrame, out: str, gap: str = "350 milliseconds", late: str = "1 second", max_edge: int = 320) -> None:
    """Corners of each camera's newest frame per tick, continuously, into parquet below ``out``.

    The stream carries references to frames only. When a tick is closed, its frames' rasters
    are read: the key range of the micro-batch goes to the scan as a filter, so that of a raster table in order of
    doc_id only the row groups of these frames are read. A repeated micro-batch replaces its own
    folder. Frames without a raster, or without a document on it, are skipped.
    """

    def detect(batch: DataFrame, batch_id: int) -> None:
        picked = cut_lineage(batch, "picked")
        low, high = picked.agg(F.min("doc_id"), F.max("doc_id")).first()
        if low is not None:
            near = lines.where(F.col("doc_id").between(low, high))
            frame_corners(picked, near, max_edge).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    drain_batches(newest_frames(frames, gap, late), "corners", detect)


def auto_handoff_stream(results: DataFrame, folder: str, receipts: str) -> None:
    """Deliver each micro-batch of finished results; repeated batches overwrite the same receipts."""
    from ..sinks.files import handoff

    def deliver(batch: DataFrame, batch_id: int) -> None:
        done, _ = handoff(batch, folder)
        done.write.mode("overwrite").parquet(f"{receipts}/batch={batch_id}")

    drain_batches(results, "handoff", deliver)
