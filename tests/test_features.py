"""Scores, scalar functions, sources, sinks, layout and streams."""

import json
import math

import pytest
from pyspark.sql import functions as F

from skein.functions import scalars
from skein.operators import layout, scoring, serving, simulation_log
from skein.sources import matches, sinks
from skein.streaming import stateful


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_names_and_roles(spark):
    df = spark.createDataFrame([('["A","B"]', " mid "), ("[]", "adc"), ('[" "]', None), ("no json", "x"), (None, "Utility")], "names string, role string")
    got = values(df, scalars.latest_name(F.col("names")), scalars.role_of(F.col("role")))
    assert got == [("B", "MIDDLE"), (scalars.NO_NAME, "BOTTOM"), (scalars.NO_NAME, "UNKNOWN"), (scalars.NO_NAME, "UNKNOWN"), (scalars.NO_NAME, "UTILITY")]


def test_hash_and_bits(spark):
    def fnv(text):
        h = 2166136261
        for b in text.encode():
            h = (h ^ b) * 16777619 % 2**32
        return h

    words = ["", "a", "foobar", "éß"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in values(df, scalars.fnv1a32(F.col("w")))] == [fnv(w) for w in words]
    packed = scalars.pack_edge(F.lit(5), F.lit(True))
    assert values(spark.range(1), packed, *scalars.unpack_edge(packed)) == [(11, 5, True)]


def test_score_v1_matches_a_plain_computation(spark):
    row = ("top", 1800, 10.0, 2.0, 5.0, 12000.0, 9000.0, 20.0)
    df = scoring.with_fields(spark.createDataFrame([row], "teamPosition string, duration long, kills double, deaths double, assists double, goldEarned double, goldSpent double, visionScore double"), scoring.STAT_FIELDS)
    got = scoring.score_v1(df).first()
    want = (10 + 5 * 0.965 - 0.5) * 1.1 + (12000 / 30 / 10 + 0.75 * 0.5) * 1.05 + 20 * 0.15 * 0.9
    assert got.opscore == pytest.approx(want) and got.feedscore == pytest.approx(2 - 15 * 0.35) and got.role == "TOP"


def test_curve_hits_its_anchors(spark):
    got = values(spark.createDataFrame([(1.0,), (0.0,), (100.0,)], "r double"), scoring.curve(F.col("r")), scoring.falling_curve(F.col("r")))
    assert got[0] == pytest.approx((0.7, 0.7)) and got[1] == pytest.approx((0.0, 2.2)) and got[2][0] == pytest.approx(2.2)


def test_score_v2_bounds(spark, sf):
    from skein.plans.more import line_stats

    df = scoring.score_v2(line_stats(spark, sf))
    low, high, risk = df.agg(F.min("opscore"), F.max("opscore"), F.max("feed_risk")).first()
    assert 0 <= low <= high <= 10 and risk <= 10


def match(i, ids, **more):
    people = [{"puuid": p, "teamId": 100 if k < 5 else 200, "kills": k, "deaths": 1, "assists": 2} if p else {"teamId": 100} for k, p in enumerate(ids)]
    return {"metadata": {"matchId": i, "participants": [p for p in ids if p]}, "info": {"queueId": 420, "gameCreation": 1000, "gameDuration": 1800, "participants": people} | more}


def test_match_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(match("a", ["x", "y", None])))
    (tmp_path / "bad.json").write_text("{not json")
    (tmp_path / "none.json").write_text(json.dumps({"metadata": {"matchId": "n"}}))
    (tmp_path / "other.txt").write_text("{}")
    found = matches.read_matches(spark, str(tmp_path))
    assert [r.match_id for r in found.collect()] == ["a"]
    assert values(matches.participants(found), "match_id", "pos", "player_id", "team") == [("a", 0, "x", 100), ("a", 1, "y", 100)]
    assert matches.matches_with(found, "x").count() == 1 and matches.matches_with(found, "q").count() == 0
    assert matches.quality_gate(found, 2000, [420]).first().reject_reason == "too few participants"
    assert matches.quality_gate(found, 2000, [440]).first().reject_reason == "queue"
    assert matches.stats(found).count() == 2


def test_markdown_documents(spark, tmp_path):
    (tmp_path / "d.md").write_text("# Title\n\n> quote\nFirst prose line.\n")
    r = matches.markdown_documents(spark, str(tmp_path)).first()
    assert (r.title, r.summary) == ("Title", "First prose line.")


def test_mock_matches(spark):
    df = matches.mock_matches(spark, matches=30)
    assert df.groupBy("match_id").count().select(F.min("count"), F.max("count")).first() == (10, 10)


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "clusters")
    a = spark.createDataFrame([("c1", 3)], "cluster_id string, size int")
    sinks.replace_clusters(a, path, "x")
    sinks.replace_clusters(a.withColumn("size", F.lit(4)), path, "y")
    sinks.replace_clusters(a.withColumn("size", F.lit(5)), path, "x")
    assert sorted(values(spark.read.parquet(path), "cluster_type", "size")) == [("x", 5), ("y", 4)]
    assert sorted(map(tuple, sinks.evolve(a, spark.createDataFrame([("c2",)], "cluster_id string"), {"size": 0}).collect())) == [("c1", 3), ("c2", 0)]
    nodes = spark.createDataFrame([("a", 1.0, 2.0, 1, 1, 0, 3, 3, 0), ("b", 3.0, 4.0, 1, 0, 1, 3, 0, 3)], "node string, px double, py double, degree int, ally_degree int, enemy_degree int, support int, ally_support int, enemy_support int")
    edges = spark.createDataFrame([("a", "b", 3, "enemy")], "src string, dst string, total long, relation string")
    sinks.write_graph(nodes, edges, str(tmp_path / "g"))
    names, data = sinks.read_graph(str(tmp_path / "g"))
    assert names == ["a", "b"] and data["props.u32"].tolist() == [7] and data["positions.f32"].tolist() == [[1, 2], [3, 4]] and data["edges.u32"].tolist() == [[0, 1]]
    text = sinks.summary_markdown("d|s", {"edges": 1}, spark.createDataFrame([("k", 2, 1, 1, 0.5)], "comp string, members int, cross_ally int, neighbours int, score double"))
    assert "d\\|s" in text and "| k | 2 | 1 | 1 | 0.5000 |" in text


def test_layout(spark):
    pts = layout.sphere_points(spark.range(5), "id", 5).collect()
    assert all(math.isclose(r.x**2 + r.y**2 + r.z**2, 1, abs_tol=1e-9) for r in pts)
    assert tuple(layout.sphere_points(spark.range(1), "id", 1).first())[1:] == (0, 1, 0)
    members = layout.sphere_members(spark.createDataFrame([("n", 0.0, 1.0, 0.0, 0, 1), ("m", 0.0, 1.0, 0.0, 1, 3)], "node string, x double, y double, z double, offset int, size int"))
    assert all(abs(math.sqrt(r.px**2 + r.py**2 + r.pz**2) - 100) < 1 for r in members.collect())
    angles = layout.orbit_angles([{"comp": k, "score": 1.0 / k, "members": 1, "radius": 500.0} for k in (1, 2, 3)], {(1, 2): 3})
    assert len(set(angles.values())) == 3


def test_js_round(spark):
    assert values(spark.createDataFrame([(2.5,), (-2.5,), (1.25,)], "x double"), serving.js_round(F.col("x"))) == [(3.0,), (-2.0,), (1.0,)]


def test_lineage_of_a_long_chain(spark):
    df = spark.createDataFrame([(k, k - 1 if k else simulation_log.ABSENT) for k in range(300)], "entity_id long, parent_a long")
    assert {(r.seed, r.depth - r.entity) for r in simulation_log.lineage(df).collect()} == {(0, 0)}


def test_last_argmax_takes_the_last_of_equals(spark):
    assert values(spark.createDataFrame([(1, 2, 2)], "a int, b int, c int"), simulation_log.last_argmax(["a", "b", "c"])) == [("c",)]


# --- streams ------------------------------------------------------------------------------------------------------------

def drain(query):
    query.processAllAvailable()
    query.stop()


def fold_pressure(ticks):
    """One tick after the other, as plainly as can be."""
    pressure, told, out = 0, False, []
    for tick, adjacent in ticks:
        if adjacent:
            before = pressure
            pressure = min(stateful.MOST, pressure + 1)
            if before < stateful.WAR <= pressure and not told:
                told = True
                out.append((tick, pressure))
        elif pressure:
            if pressure < stateful.WAR:
                told = False
            pressure = 0 if pressure <= stateful.DECAY else pressure - stateful.DECAY
        elif not pressure:
            told = False
    return out


def test_border_pressure_fires_once_and_rearms(spark, tmp_path):
    plan = [True] * 100 + [False] * 45 + [True] * 120 + [False] * 5 + [True] * 40
    want = fold_pressure(list(enumerate(plan)))
    assert len(want) >= 2
    rows = [(1, 2, t, x) for t, x in enumerate(plan)]
    src = tmp_path / "ticks"
    for k in range(0, len(rows), 60):
        spark.createDataFrame(rows[k : k + 60], "a long, b long, tick long, adjacent boolean").coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema("a long, b long, tick long, adjacent boolean").parquet(str(src))
    drain(stateful.border_pressure(stream).writeStream.format("memory").queryName("pressure").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start())
    assert sorted((r.tick, r.pressure) for r in spark.table("pressure").collect()) == want


def test_stream_windows_equal_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    src = str(tmp_path / "ev")
    events.orderBy("ts").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(events.schema).parquet(src)
    drain(stateful.tumbling(stream).writeStream.format("memory").queryName("tumbling").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start())
    plain = lambda df: sorted(map(tuple, df.withColumn("window_start", F.col("window_start").cast("string")).collect()))
    assert plain(spark.table("tumbling")) == plain(stateful.tumbling(events))


def test_recent_history_is_capped(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id")
    events.coalesce(1).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    drain(stateful.recent_history(stream, 5).writeStream.format("memory").queryName("recent").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start())
    newest = {r.user_id: r.m for r in events.groupBy("user_id").agg(F.max("event_id").alias("m")).collect()}
    got = {r.user_id: (r.kept, r.newest) for r in spark.table("recent").collect()}
    assert got == {u: (min(5, events.filter(F.col("user_id") == u).count()), m) for u, m in newest.items()}


def test_job_snapshot(spark):
    lines = [(1, '@@EVENT@@ {"type":"log","message":"a"}'), (2, '@@EVENT@@ {"type":"status","status":"running"}'), (3, "noise"), (4, '@@EVENT@@ {"type":"progress","saved":7}'), (5, '@@EVENT@@ {"type":"status","status":"done"}'), (6, '@@EVENT@@ {"type":"log","message":"b"}')]
    r = stateful.job_snapshot(spark.createDataFrame(lines, "at int, value string")).first()
    assert (r.status, r.saved, r.logs) == ("done", 7, ["a", "b"])
