"""Job events as streams (ST1-ST5, X1, X2).

Windowed counts with a watermark are an extension: the job log itself has no late-data rule.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor, wait

import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..schemas import LOG
from ..session import ship

CREEP_CAP, IDLE_MS = 90, 2000


def read_log(spark: SparkSession, folder: str, schema: str = LOG, files_per_trigger: int = 100) -> DataFrame:
    """ST1: the append-only job log as a stream of its JSON files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def latest_state(events: DataFrame, key: str = "file_id", at: str = "updated_at") -> DataFrame:
    """ST2: the last event of each file, for update mode."""
    values = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*values), F.col(at)).alias("e")).select(key, "e.*")


def held_progress(events: DataFrame, key: str = "file_id", order: str = "seq", progress: str = "progress", cap: int = 100) -> DataFrame:
    """ST3, ST5: progress that never falls, per file, across batches: (key, seq, progress, shown).

    Rows are in order of ``order`` within a batch; what a later batch brings counts as newer, whatever its ``order``.
    """

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        top = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values("seq")
        rows["shown"] = rows["progress"].fillna(0).cummax().clip(lower=top, upper=cap).astype("int64")
        state.update((int(max(top, rows["shown"].max())),))
        rows["key"] = name[0]
        yield rows[["key", "seq", "progress", "shown"]]

    ship(events.sparkSession)
    source = events.select(F.col(key).cast("string").alias("key"), F.col(order).cast("bigint").alias("seq"), F.col(progress).cast("double").alias("progress"))
    out = source.groupBy("key").applyInPandasWithState(step, "key string, seq bigint, progress double, shown bigint", "top bigint", "append", GroupStateTimeout.NoTimeout)
    return out.withColumnRenamed("key", key)


class Creep(StatefulProcessor):
    """ST3, ST5: held progress that creeps up by one when nothing has come for a while, up to a cap.  Needs RocksDB state."""

    def __init__(self, cap: int = CREEP_CAP, idle_ms: int = IDLE_MS):
        self.cap, self.idle_ms = cap, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.top = handle.getValueState("top", "top bigint")

    def _value(self) -> int:
        return self.top.get()[0] if self.top.exists() else 0

    def _wait(self, timers) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        top = self._value()
        for frame in rows:
            top = max(top, int(frame["progress"].fillna(0).max()))
        self.top.update((top,))
        self._wait(timerValues)
        yield pd.DataFrame({"key": [key[0]], "shown": [min(top, 100)]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        top = self._value()
        if top < self.cap:
            self.top.update((top + 1,))
            self._wait(timerValues)
            yield pd.DataFrame({"key": [key[0]], "shown": [top + 1]})

    def close(self) -> None:
        pass


def creeping_progress(events: DataFrame, key: str = "file_id", progress: str = "progress", cap: int = CREEP_CAP, idle_ms: int = IDLE_MS) -> DataFrame:
    """ST3: (key, shown) with processing-time creep."""
    ship(events.sparkSession)
    source = events.select(F.col(key).cast("string").alias("key"), F.col(progress).cast("double").alias("progress"))
    return source.groupBy("key").transformWithStateInPandas(Creep(cap, idle_ms), "key string, shown bigint", "Update", "ProcessingTime")


def windowed_failures(events: DataFrame, at: str = "started_at", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """An extension: failures of each stage in windows of time, with a watermark."""
    return events.where("status = 'failed'").withWatermark(at, late).groupBy(F.window(at, width), "stage").agg(F.count("*").alias("failures"))


def run_available(out: DataFrame, checkpoint: str, mode: str = "append", sink: Callable[[DataFrame, int], None] | None = None, table: str | None = None) -> StreamingQuery:
    """Process what is there, then end: into a function of each batch, or a table in memory."""
    writer = out.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (writer.foreachBatch(sink) if sink else writer.format("memory").queryName(table)).start()


class ProgressHook(StreamingQueryListener):
    """Calls ``progress`` with what each batch of any query did, and stops the query once ``should_cancel`` says so."""

    def __init__(self, spark: SparkSession, progress: Callable[[dict], None] | None = None, should_cancel: Callable[[], bool] | None = None):
        self.spark, self.progress, self.should_cancel = spark, progress, should_cancel

    def onQueryStarted(self, event) -> None:
        self._say({"event": "started", "id": str(event.id)})

    def onQueryProgress(self, event) -> None:
        done = event.progress
        self._say({"event": "progress", "id": str(done.id), "batch": done.batchId, "rows": done.numInputRows})
        if self.should_cancel is not None and self.should_cancel():
            query = self.spark.streams.get(str(done.id))
            if query is not None:
                query.stop()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._say({"event": "ended", "id": str(event.id), "error": event.exception})

    def _say(self, what: dict) -> None:
        if self.progress is not None:
            self.progress(what)


def run_items(items: list[str], work: Callable[[str], None], progress: Callable[[dict], None] | None = None, should_cancel: Callable[[], bool] | None = None) -> dict[str, str]:
    """X2, ST4 for jobs of several recordings: the outcome of each item; what follows a cancellation is not begun, a failure stops nothing."""
    out: dict[str, str] = {}
    for k, item in enumerate(items):
        if should_cancel is not None and should_cancel():
            out |= dict.fromkeys(items[k:], "cancelled")
            break
        try:
            work(item)
            out[item] = "ok"
        except Exception as error:  # the outcome of the item is its error
            out[item] = f"failed: {error}"
        if progress is not None:
            progress({"item": item, "status": out[item], "progress": (k + 1) * 100 // len(items)})
    return out


def run_tagged(spark: SparkSession, jobs: dict[str, Callable[[], None]], should_cancel: Callable[[str], bool] | None = None, workers: int = 4, poll: float = 0.1) -> dict[str, str]:
    """X2, ST4: Spark work of several recordings at a time, each under a tag of its own, and cancelled by it from outside.

    ``should_cancel`` is asked for each item again and again, from another thread; where it says so, the Spark jobs under
    the item's tag are interrupted and the others go on.  The outcome of each item: ok, cancelled, or failed with its error.
    """
    run, context = uuid.uuid4().hex, spark.sparkContext
    state: dict[str, str] = dict.fromkeys(jobs, "waiting")
    wanted = should_cancel or (lambda item: False)
    over = threading.Event()

    def one(item: str) -> None:
        tag = f"{run}-{list(jobs).index(item)}"
        if wanted(item):
            state[item] = "cancelled"
            return
        context.addJobTag(tag)
        state[item] = "running"
        try:
            jobs[item]()
            state[item] = "ok"
        except Exception as error:  # the outcome of the item is its error
            state[item] = "cancelled" if state[item] == "stopping" else f"failed: {error}"
        finally:
            context.removeJobTag(tag)

    def watch() -> None:
        while not over.wait(poll):
            for k, item in enumerate(jobs):
                if state[item] in ("running", "stopping") and wanted(item):
                    state[item] = "stopping"
                    context.cancelJobsWithTag(f"{run}-{k}")  # again, for a job that began after the last time

    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        with ThreadPoolExecutor(workers) as pool:
            # a wrapper an item: each has local properties, and so tags, of its own
            wait([pool.submit(inheritable_thread_target(spark)(one), item) for item in jobs])
    finally:
        over.set()
        watcher.join()
    return state


def stop(query: StreamingQuery) -> None:
    """ST4: cancel a running query."""
    if query.isActive:
        query.stop()


def transcribe(audio: DataFrame, model: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str = "interview_id string, variant string, document string") -> DataFrame:
    """The seam for a recogniser: a function on Arrow batches that returns JSON documents, with a variant's name."""
    return audio.mapInPandas(model, schema)
