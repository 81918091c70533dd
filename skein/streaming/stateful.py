"""Streaming: windows, deduplication, running pair counts and means, capped histories, border pressure."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WAR, DECAY, MOST = 80, 2, 200


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return _watermarked(events, late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "2 hours", step: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return _watermarked(events, late).groupBy(F.window("ts", size, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return _watermarked(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def _watermarked(events: DataFrame, late: str) -> DataFrame:
    """Watermarks need a timestamp with a zone; batches keep theirs."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def deduplicated(events: DataFrame, key: str = "event_id", late: str = "1 day") -> DataFrame:
    return _watermarked(events, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def running_means(events: DataFrame) -> DataFrame:
    """user_id, n, mean: the mean so far, as a running sum."""
    return events.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


def running_pairs(pairs: DataFrame) -> DataFrame:
    """src, dst, total of pair rows (src, dst) so far."""
    return pairs.groupBy("src", "dst").agg(F.count("*").alias("total"))


def step_pressure(state: tuple[int, bool, int], tick: int, adjacent: bool) -> tuple[tuple[int, bool, int] | None, bool]:
    """The state (pressure, announced, tick) of a pair after a tick, and whether tension is announced; None where the pair is forgotten.

    Ticks between the last one and this count as apart."""
    pressure, told, last = state
    for _ in range(max(0, tick - last - 1)):
        if pressure < WAR:
            told = False
        if pressure <= DECAY:
            pressure, told = 0, told and pressure >= WAR
            break
        pressure -= DECAY
    if not adjacent:
        told = told and pressure >= WAR
        pressure = 0 if pressure <= DECAY else pressure - DECAY
        return ((pressure, told, tick) if pressure else None), False
    after = min(MOST, pressure + 1)
    fire = pressure < WAR <= after and not told
    return (after, told or fire, tick), fire


PRESSURE = "a long, b long, tick long, pressure int"


def _pressure(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = state.get if state.exists else (0, False, None)
    ticks = sorted({(int(t), bool(x)) for f in frames for t, x in zip(f["tick"], f["adjacent"], strict=True)})
    out = []
    for tick, adjacent in ticks:
        if held[2] is not None and tick <= held[2]:
            continue  # a replayed tick changes nothing
        new, fire = step_pressure((held[0], held[1], tick - 1 if held[2] is None else held[2]), tick, adjacent)
        held = new or (0, False, tick)
        if fire:
            out.append((key[0], key[1], tick, held[0]))
    if held[0]:
        state.update((int(held[0]), bool(held[1]), int(held[2])))
    elif state.exists:
        state.remove()
    yield pd.DataFrame(out, columns=["a", "b", "tick", "pressure"])


def border_pressure(ticks: DataFrame) -> DataFrame:
    """a, b, tick, pressure where the tension of a pair crosses WAR.  ticks: a, b, tick, adjacent.  Works on streams; state is three numbers a pair under pressure, and none for a pair whose pressure is gone."""
    return ticks.groupBy("a", "b").applyInPandasWithState(_pressure, PRESSURE, "pressure int, told boolean, tick long", "append", GroupStateTimeout.NoTimeout)


def _capped(most: int):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        held = sorted({*held, *(int(x) for f in frames for x in f["event_id"])})[-most:]
        state.update((held,))
        yield pd.DataFrame({"user_id": [key[0]], "kept": [len(held)], "oldest": [held[0]], "newest": [held[-1]]})

    return run


def recent_history(events: DataFrame, most: int = 200) -> DataFrame:
    """user_id, kept, oldest, newest: each user's last `most` event ids."""
    return events.groupBy("user_id").applyInPandasWithState(_capped(most), "user_id long, kept long, oldest long, newest long", "ids array<long>", "update", GroupStateTimeout.NoTimeout)


def disputes(ticks: DataFrame, grace: int = 300) -> DataFrame:
    """a, b, first_tick, last_tick, ready: unbroken runs of adjacent ticks, and whether a run outlasted the grace.  The batch form of the dispute registry."""
    on = ticks.filter("adjacent").select("a", "b", "tick").distinct()
    from pyspark.sql import Window

    w = Window.partitionBy("a", "b").orderBy("tick")
    run = F.col("tick") - F.row_number().over(w)
    return on.withColumn("run", run).groupBy("a", "b", "run").agg(F.min("tick").alias("first_tick"), F.max("tick").alias("last_tick")).select("a", "b", "first_tick", "last_tick", (F.col("last_tick") - F.col("first_tick") >= grace).alias("ready"))


def unexpired(entries: DataFrame, tick: int, life: int = 75, spare: int = 5) -> DataFrame:
    return entries.filter(F.col("since") + life + spare > tick)


def job_snapshot(lines: DataFrame, k: int = 80) -> DataFrame:
    """From prefixed JSON lines (at, value): the latest status, latest progress, and the last k log messages."""
    body = F.from_json(F.regexp_extract("value", r"^@@EVENT@@\s*(\{.*\})$", 1), "type string, message string, status string, saved long")
    ev = lines.select("at", body.alias("e")).filter("e.type is not null").select("at", "e.*")
    logs = ev.filter("type = 'log'").orderBy(F.desc("at")).limit(k)
    return ev.agg(F.max_by("status", F.when(F.col("type") == "status", F.col("at"))).alias("status"), F.max_by("saved", F.when(F.col("type") == "progress", F.col("at"))).alias("saved")).crossJoin(logs.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "message"))), lambda x: x["message"]).alias("logs")))
