"""Keyed state with lists, event-time timers and expiry.

Ticks are event time: tick n is n + 1 seconds after the epoch, where watermarks start, and a stream's watermark says which ticks are over.  What is kept of a key is bounded: a job's last logs, two ticks of a
dispute, one of an entry; it goes when its timer falls due.  Rows of one batch are taken in their own order, and rows that come again change nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType

from skein.session import shared_folder

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Logs kept of a job, ticks after which a dispute is acted on, and how long an entry lives.
LAST_LOGS, GRACE, LIFE = 80, 300, 80

EVENT = "type string, message string, status string, currentStage string, error string, progress struct<matchesSaved: bigint>"
JOB = "job string, status string, stage string, error string, saved long, logs array<string>"


def parsed(lines: DataFrame, prefix: str = "@@EVENT@@") -> DataFrame:
    """job, at, type, message, status, stage, error, saved of lines (job, at, value) that hold the prefix and a JSON object; other lines go."""
    body = F.from_json(F.regexp_extract("value", rf"^{prefix}\s*(\{{.*\}})$", 1), EVENT)
    return lines.select(F.col("job").cast("string").alias("job"), F.col("at").cast("long").alias("at"), body.alias("e")).filter("e.type is not null").select(
        "job", "at", "e.type", "e.message", "e.status", F.col("e.currentStage").alias("stage"), "e.error", F.col("e.progress.matchesSaved").alias("saved")
    )


def _text(value: Any) -> str | None:
    return None if value is None or value != value else str(value)


class JobFolder(StatefulProcessor):
    """What a job's events come to: its latest status, stage, error and progress, and its last logs."""

    def __init__(self, most: int = LAST_LOGS):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.logs = handle.getListState("logs", "at long, message string")
        self.facts = handle.getValueState("facts", "status string, stage string, error string, saved long, seen long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        status, stage, error, saved, seen = self.facts.get() if self.facts.exists() else (None, None, None, None, -1)
        held = {int(at): message for at, message in self.logs.get()}
        new = pd.concat(list(rows)).sort_values("at")
        for r in new.to_dict("records"):
            at = int(r["at"])
            if r["type"] == "log":
                held[at] = _text(r["message"]) or ""
            elif at > seen:
                stage, seen = _text(r["stage"]) or stage, at
                if r["type"] == "status":
                    status, error = _text(r["status"]) or status, _text(r["error"])
                elif r["type"] == "progress" and _text(r["saved"]) is not None:
                    saved = int(r["saved"])
        last = sorted(held.items())[-self.most :]
        self.logs.put([(at, message) for at, message in last]) if last else None
        self.facts.update((status, stage, error, saved, seen))
        yield pd.DataFrame({"job": [key[0]], "status": [status], "stage": [stage], "error": [error], "saved": pd.array([saved], "Int64"), "logs": [[m for _, m in last]]})

    def close(self) -> None:
        pass


def job_snapshots(events: DataFrame, most: int = LAST_LOGS) -> DataFrame:
    """The state of each job after each batch of its parsed events; the last row of a job is its state."""
    return events.groupBy("job").transformWithStateInPandas(JobFolder(most), JOB, "Update", "None")


def instant(tick: int) -> int:
    """The event time of a tick, in milliseconds."""
    return (tick + 1) * 1000


ACT = "a long, b long, first_tick long, tick long"


class DisputeRegistry(StatefulProcessor):
    """Since when a pair has been in dispute without a break.  Reports it once, when the grace is over; forgets it when a tick is over that the pair was not in."""

    def __init__(self, grace: int = GRACE):
        self.grace = grace

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "first long, last long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first, last = self.run.get() if self.run.exists() else (None, None)
        if last is not None:
            self.handle.deleteTimer(instant(int(last) + 1))
        due = []
        for tick in sorted({int(t) for f in rows for t in f["tick"]}):
            if last is not None and tick <= last:
                continue
            if last is None or tick > last + 1:
                first = tick
            last = tick
            if tick - first == self.grace:
                due.append((key[0], key[1], first, tick))
        self.run.update((int(first), int(last)))
        self.handle.registerTimer(instant(int(last) + 1))
        yield pd.DataFrame(due, columns=["a", "b", "first_tick", "tick"])

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.run.clear()
        yield pd.DataFrame([], columns=["a", "b", "first_tick", "tick"])

    def close(self) -> None:
        pass


def in_event_time(ticks: DataFrame, late: int) -> DataFrame:
    """ticks with their event time, and a watermark so many ticks behind the last."""
    return ticks.withColumn("ts", F.timestamp_seconds(F.col("tick") + 1)).withWatermark("ts", f"{late} seconds")


def dispute_acts(ticks: DataFrame, grace: int = GRACE, late: int = 10) -> DataFrame:
    """a, b, first_tick, tick: disputes (a, b, tick rows: the ticks in which a pair is in dispute) whose grace ended at tick."""
    return in_event_time(ticks, late).groupBy("a", "b").transformWithStateInPandas(DisputeRegistry(grace), ACT, "Append", "EventTime")


EXPIRED = "entry long, since long, until long"


class Integrations(StatefulProcessor):
    """Entries that live so many ticks since they last began, and are reported when these are over."""

    def __init__(self, life: int = LIFE):
        self.life = life

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.since = handle.getValueState("since", "tick long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        before = int(self.since.get()[0]) if self.since.exists() else None
        latest = max(int(t) for f in rows for t in f["tick"])
        if before is None or latest > before:
            if before is not None:
                self.handle.deleteTimer(instant(before + self.life))
            self.since.update((latest,))
            self.handle.registerTimer(instant(latest + self.life))
        yield pd.DataFrame([], columns=["entry", "since", "until"])

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        since = int(self.since.get()[0])
        self.since.clear()
        yield pd.DataFrame([(key[0], since, since + self.life)], columns=["entry", "since", "until"])

    def close(self) -> None:
        pass


def expired_entries(entries: DataFrame, life: int = LIFE, late: int = 10) -> DataFrame:
    """entry, since, until: entries (entry, tick) whose life is over."""
    return in_event_time(entries, late).groupBy("entry").transformWithStateInPandas(Integrations(life), EXPIRED, "Append", "EventTime")


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Within it, streams keep their state in the store that keyed state with timers needs."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def drained(stream: DataFrame, mode: str = "append", progress: list | None = None) -> DataFrame:
    """All rows that a stream gives for what is there now, with the number of their batch, each batch written once to the shared folder.  progress takes the last report of the stream."""
    spark, out = stream.sparkSession, f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    schema = stream.schema

    def write(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/rows/{batch}")
        batches.append(batch)

    batches: list[int] = []
    with keyed_state(spark):
        query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    if progress is not None:
        progress.append(query.lastProgress)
    if not batches:
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(0))
    return spark.read.schema(schema.add("batch", IntegerType())).parquet(*[f"{out}/rows/{b}" for b in dict.fromkeys(batches)])
