"""Keyed state on replayed files against its plain meaning, and that it goes when it is over."""

import json
import random

from skein.streaming import processors
from skein.streaming.stateful import disputes


def pieces(spark, folder, rows, schema, parts=3):
    """A stream of files, one a batch, in the order of the rows."""
    size = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_jobs_keep_their_last_logs_and_latest_facts(spark, tmp_path):
    rows, want = [], {}
    for at in range(60):
        job = f"j{at % 2}"
        kind = ("log", "log", "progress", "status", "other")[(at // 2) % 5]
        event = {"type": kind, "message": f"m{at}", "status": f"s{at}", "currentStage": f"g{at}", "error": None, "progress": {"matchesSaved": at}}
        rows.append((job, at, "@@EVENT@@ " + json.dumps(event) if at != 20 else "no event"))
        if at != 20:
            own = want.setdefault(job, {"logs": []})
            if kind == "log":
                own["logs"] = [*own["logs"], f"m{at}"][-4:]
            else:
                own["stage"] = f"g{at}"
                own.update({"progress": {"saved": at}, "status": {"status": f"s{at}"}}.get(kind, {}))
    lines = pieces(spark, tmp_path / "in", rows + rows[-5:], "job string, at long, value string")
    found = processors.drained(processors.job_snapshots(processors.parsed(lines), most=4), "update").orderBy("batch").collect()
    last = {r.job: r for r in found}
    for job, own in want.items():
        assert (list(last[job].logs), last[job].status, last[job].stage, last[job].saved) == (own["logs"], own["status"], own["stage"], own["saved"])


def test_disputes_are_acted_on_once_and_forgotten(spark, tmp_path):
    rng = random.Random(2)
    rows = sorted({(a, 9, t) for a in range(3) for t in range(60) if rng.random() < 0.85}, key=lambda r: r[2])
    batch = spark.createDataFrame(rows, "a long, b long, tick long")
    late = [*rows, (7, 9, 200)]  # its tick makes all others over
    progress: list = []
    got = processors.drained(processors.dispute_acts(pieces(spark, tmp_path / "in", late, "a long, b long, tick long"), grace=5), progress=progress).collect()
    runs = [r for r in disputes(batch.selectExpr("*", "true AS adjacent"), 5).collect() if r.ready]
    assert sorted((r.a, r.b, r.first_tick, r.tick) for r in got) == sorted((r.a, r.b, r.first_tick, r.first_tick + 5) for r in runs) and runs
    store = progress[-1]["stateOperators"][0] if isinstance(progress[-1], dict) else progress[-1].stateOperators[0]
    kept = store["numRowsTotal"] if isinstance(store, dict) else store.numRowsTotal
    assert kept <= 3  # the one pair whose tick is not over yet, with its timer


def test_entries_end_after_their_life(spark, tmp_path):
    rows = [(1, 0), (2, 5), (1, 30), (3, 90), (2, 5), (4, 200), (5, 400)]
    got = processors.drained(processors.expired_entries(pieces(spark, tmp_path / "in", rows, "entry long, tick long", parts=4), life=80, late=1))
    assert {(r.entry, r.since, r.until) for r in got.collect()} == {(1, 30, 110), (2, 5, 85), (3, 90, 170), (4, 200, 280)}
