"""Collecting with resumption and quarantine, schedules, tiers, numbers, imports, exports of the sphere, and notes on runs."""

import json

import pytest
from pyspark.sql import functions as F

from skein.operators import components, paths, simulation_log
from skein.sources import sinks
from skein.streaming import ingest

NOW = 1_700_000_000_000
PAIR = "src string, dst string, ally long, enemy long, total long, relation string"


def document(match, queue=420, created=NOW, kills=1, players=10):
    who = [{"puuid": f"p{i}", "teamId": 100, "kills": kills, "deaths": 0, "assists": 2} for i in range(players)]
    return {"metadata": {"matchId": match, "participants": [w["puuid"] for w in who]}, "info": {"queueId": queue, "gameCreation": created, "gameDuration": 1800, "participants": who}}


def put(folder, name, value):
    (folder / name).write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")


def test_collecting_goes_on_and_sets_aside(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    put(src, "a.json", document("m1"))
    put(src, "b.json", document("m2", queue=1))
    put(src, "c.json", "{no json")
    put(src, "d.json", document("m3", created=NOW - 400 * 86_400_000))
    assert ingest.collect(spark, str(src), out, NOW, [420], files=2) == {"matches": 1, "quarantine": 2}
    put(src, "e.json", document("m1"))  # stored before
    put(src, "f.json", document("m4"))
    put(src, "g.json", document("m4"))  # twice in one batch, or one batch after the other
    put(src, "h.json", document("m5", players=4))
    put(src, "i.json", document("m6", kills=None))
    assert ingest.collect(spark, str(src), out, NOW, [420], files=3) == {"matches": 2, "quarantine": 4}
    assert ingest.collect(spark, str(src), out, NOW, [420]) == {"matches": 2, "quarantine": 4}
    assert sorted(r.match_id for r in spark.read.parquet(f"{out}/matches").collect()) == ["m1", "m4"]
    aside = {r.match_id: r.reject_reason for r in spark.read.parquet(f"{out}/quarantine").collect()}
    assert aside == {"m2": "queue", "m3": "too old", "m5": "too few participants", "m6": "incomplete participant"}


def test_schedule(spark):
    ticks = spark.createDataFrame([(0,), (9,), (60,), (None,)], "tick long")
    got = sorted(map(tuple, ingest.due(ticks, {"a": 20, "b": 30, "c": 50}).collect()))
    assert got == [(60, "a"), (60, "b")]


def test_tiers_and_roles(spark):
    df = spark.createDataFrame([(2, 999, 0.0, 0.0), (3, 1000, 1.0, 1.0), (25, 3000, 2.0, 1.0), (50, 7000, None, 1.0), (100, 15000, None, None), (None, None, 0.0, -1.0)], "n int, pop int, x double, y double")
    tier, roles = simulation_log.polity_tier, simulation_log.specialisation(["x", "y"])
    got = df.select(tier(F.col("n"), simulation_log.TIER_MEMBERS), tier(F.col("pop"), simulation_log.TIER_POPULATION), roles).collect()
    names = ["Tribe", "City", "Duchy", "Kingdom", "Empire", "Tribe"]
    assert [r[0] for r in got] == names and [r[1] for r in got] == names
    assert [r[2] for r in got] == ["Generalist", "y", "x", "y", "Generalist", "Generalist"]


def test_numbers_follow_the_order(spark):
    got = simulation_log.numbered(spark.range(1000).select((F.col("id") * 7 % 1000).alias("tick")), ["tick"], 5).collect()
    assert sorted((r.tick, r.event_id) for r in got) == [(k, k + 5) for k in range(1000)]
    assert simulation_log.numbered(spark.range(0).select(F.col("id").alias("tick")), ["tick"]).count() == 0


def test_import_keeps_what_is_stored(spark):
    stored = spark.createDataFrame([(1, "old")], "id int, name string")
    rows = spark.createDataFrame([(1, "new", 0), (2, "b", 2), (2, "a", 1), (None, "n", 1)], "id int, name string, at int")
    got = sinks.insert_or_ignore(stored, rows, ["id"], ["at"])
    assert got.columns == ["id", "name"] and sorted(map(tuple, got.collect())) == [(1, "old"), (2, "a")]
    touched = sinks.touch(stored, "2024-01-02 03:04:05").first()
    assert str(touched.updated_at) == "2024-01-02 03:04:05" and sinks.touch(stored).first().updated_at is not None


def test_sphere_buffers_and_report(spark, tmp_path):
    nodes = spark.createDataFrame([("b", 1.0, 2.0, 3.0, 1, 1, 0, 3, "B", None), ("a", 4.0, 5.0, 6.0, 1, 1, 0, 3, "A", "k")], "node string, px double, py double, pz double, degree int, ally_degree int, enemy_degree int, support int, label string, comp string")
    edges = spark.createDataFrame([("a", "b", 3, "ally")], "src string, dst string, total long, relation string")
    clusters = spark.createDataFrame([("k", 2)], "comp string, members int")
    manifest = sinks.write_graph(nodes, edges, str(tmp_path), about=("label", "comp"), clusters=clusters, **sinks.SPHERE)
    assert manifest["ally_edges"] == 1 and manifest["bytes"] == {"positions.f32": 24, "metrics.u32": 32, "edges.u32": 8, "props.u32": 4}
    names, data = sinks.read_graph(str(tmp_path))
    assert names == ["a", "b"] and data["positions.f32"].tolist() == [[4, 5, 6], [1, 2, 3]] and data["props.u32"].tolist() == [6]
    assert json.loads((tmp_path / "nodes_about.json").read_text()) == {"comp": ["k", None], "label": ["A", "B"]}
    assert json.loads((tmp_path / "clusters.json").read_text()) == [{"comp": "k", "members": 2}]
    with pytest.raises(ValueError):
        sinks.write_graph(nodes, edges, str(tmp_path), most=3, clusters=clusters, **sinks.SPHERE)

    pairs = spark.createDataFrame([("a", "b", 3, 0, 3, "ally"), ("c", "d", 2, 0, 2, "ally"), ("b", "c", 1, 0, 1, "ally"), ("a", "e", 0, 2, 2, "enemy")], PAIR)
    members = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c"), ("d", "c"), ("e", "e"), ("f", "e")], "node string, comp string")
    scale = components.scale(pairs, members)
    assert scale.first().asDict() == {"nodes": 5, "edges": 4, "ally_ratio": 0.75, "enemy_ratio": 0.25, "mean_support": 2.0, "clusters": 3, "largest_cluster": 2, "mean_cluster": 2.0, "tied_clusters": 2, "outer_clusters": 1}
    assert set(components.scale(pairs.limit(0), members.limit(0)).first()) == {0}
    text = sinks.full_report("d", "2024-01-02 03:04", scale, components.orbits(pairs, members), str(tmp_path / "r"))
    assert "- ally_ratio: 0.7500" in text and "| a | 2 | 1 | 1 |" in text
    assert (tmp_path / "r" / "summary.md").read_text() == text == (tmp_path / "r" / "summary-2024-01-02-03-04.md").read_text()


def test_highlights(spark, tmp_path):
    members = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")], "node string, comp string")
    players = spark.createDataFrame([("a", None, None), ("b", 2.0, 1.0), ("c", 2.0, 3.0)], "id string, opscore double, feedscore double")
    got = {r.node: (r.best_op, r.worst_feed) for r in components.highlights(members, players).collect()}
    assert got == {"a": (False, False), "b": (True, False), "c": (False, True), "x": (False, False), "y": (False, False)}
    assert components.best_and_worst(members, players, largest_id_wins=True).first()[1:] == ("c", "c")
    sinks.write_highlights(members, players, str(tmp_path / "h"))
    assert spark.read.json(str(tmp_path / "h")).filter("best_op").first().node == "b"


def test_runs_are_compared_with_notes(spark):
    near = spark.createDataFrame([("a", "b", 1, 0, 1, "ally"), ("b", "c", 1, 0, 1, "ally"), ("a", "c", 0, 1, 1, "enemy"), ("c", "d", 0, 4, 4, "enemy")], PAIR)
    rows = paths.compare(spark, near, "a", "c").collect()
    assert {r.algorithm for r in rows} == set(paths.ALGORITHMS)
    assert {(r.found, r.hops, r.note) for r in rows} == {(True, 2, "shorter with enemy edges")}
    rows = {r.algorithm: r for r in paths.compare(spark, near, "a", "b", "battle-path").collect()}
    assert rows["bfs"].note == "no gain from enemy edges" and rows["bfs"].warnings == ["enemy edges are in use"]
    assert rows["dijkstra"].warnings == ["enemy edges are in use", "stronger edges are cheaper"] and rows["bfs"].ms >= 0
    row = paths.compare(spark, near, "a", "d").first()
    assert (row.found, row.hops, row.note) == (False, None, "enemy edges connect") and row.warnings == ["no such node in this graph"]


def test_collecting_from_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert ingest.collect(spark, str(tmp_path / "in"), str(tmp_path / "out"), NOW, [420]) == {"matches": 0, "quarantine": 0}


def test_broken_files_and_equal_ids(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    one = lambda n: {"metadata": {"matchId": "same", "participants": []}, "info": {"queueId": 420, "gameCreation": NOW, "gameDuration": n, "participants": [{"puuid": f"p{k}", "teamId": 100, "kills": 1, "deaths": 1, "assists": 1} for k in range(10)]}}
    (src / "b.json").write_text(json.dumps(one(2)))
    (src / "a.json").write_text(json.dumps(one(1)))
    (src / "c.json").write_text('{"metadata": ')
    (src / "d.json").write_text('{"other": 1}')
    assert ingest.collect(spark, str(src), out, NOW, [420]) == {"matches": 1, "quarantine": 0}
    kept = spark.read.parquet(f"{out}/matches").first()
    assert (kept.match_id, kept.file, kept.duration) == ("same", "a.json", 1)
    assert {r.file for r in spark.read.parquet(f"{out}/broken").collect()} == {"c.json", "d.json"}
