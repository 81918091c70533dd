"""What keeps the steps of large tables bounded."""

import random
import tracemalloc

from pyspark.sql import functions as F

from skein import session
from skein.operators import assortativity, centrality, components, paths, projection
from skein.plans import graph, searches
from skein.session import reaching
from skein.sources import tables


def plan(df, capsys) -> str:
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_drawn_values_are_not_broadcast(spark, capsys):
    own = spark.range(40).selectExpr("id AS place", "id * 0.5 AS value").repartition(3)
    drawn = assortativity.drawn_values(own, 40, 6, 7)
    assert "Broadcast" not in plan(drawn, capsys)
    want = {(run, place, origin * 0.5) for run in range(1, 7) for place, origin in enumerate(assortativity.Lcg(7).ahead((run - 1) * 39).permutation(40))}
    assert {(r.run, r.place, float(r.value)) for r in drawn.collect()} == want


def test_tasks_of_the_pairs_grow_with_the_lines(spark, sf, monkeypatch):
    want = sorted(projection.pair_relations(tables.participants(spark, sf)).collect())
    monkeypatch.setattr(tables, "LINES_A_TASK", 500)
    lines = tables.table(spark, sf, "lineitem").count()
    found = graph.pairs_of(spark, sf)
    assert found.rdd.getNumPartitions() == tables.tasks(spark, sf) == -(-lines // 500)
    assert sorted(found.collect()) == want


def test_lines_are_dealt_out_by_player_as_many_as_of_matches(spark, sf, monkeypatch, capsys):
    want = sorted(tables.players(spark, sf).collect())
    monkeypatch.setattr(tables, "LINES_A_TASK", 500)
    found = tables.players(spark, sf)
    assert "hashpartitioning(l_partkey#" in (held := plan(found, capsys)) and f", {tables.tasks(spark, sf)}), REPARTITION_BY_NUM" in held
    assert sorted(found.collect()) == want


def test_steps_of_hops_are_dealt_out_by_the_rows_they_make(spark, monkeypatch, capsys):
    links = spark.createDataFrame([(a, b) for k in range(12) for a, b in ((k, (k + 1) % 12), ((k + 1) % 12, k))], "src long, dst long")
    want = sorted(components.hops(links).collect())
    assert len(want) == 144 and max(r.hops for r in want) == 6
    monkeypatch.setattr(components, "STEP_ROWS", 3)
    made, real = [], components._reached
    monkeypatch.setattr(components, "_reached", lambda step, edge, rows: (made.append(rows), real(step, edge, rows))[1])
    assert sorted(components.hops(links).collect()) == want
    assert made == [24, 48, 48, 48, 48, 48, 24]
    edge = links.selectExpr("src AS dst", "dst AS next")
    assert "hashpartitioning(dst#" in (held := plan(real(links, edge, 48), capsys)) and ", 16), REPARTITION_BY_NUM" in held
    assert "REPARTITION_BY_NUM" not in plan(real(links, edge, 9), capsys)


def ring(spark, *rings):
    """Pairs of rings of nodes, not tied to each other."""
    rows = [(*sorted((r[k], r[(k + 1) % len(r)])), 2, 0, 2, "ally") for r in rings for k in range(len(r))]
    return spark.createDataFrame(rows, "src long, dst long, ally long, enemy long, total long, relation string").coalesce(1)


def test_cost_towards_stays_in_the_component_of_its_source(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(searches.search, "landmark_table", lambda edges, marks, f=searches.search.landmark_table: (seen.append(edges.select("node").distinct().count()), f(edges, marks))[1])
    monkeypatch.setattr(searches, "kept_pairs", lambda s, d: ring(s, [1, 2, 3, 9], [4, 5, 6, 7]))
    (row,) = searches.cost_towards(spark, "").collect()
    assert (row.source, row.target, row.cost) == (1, 9, 500_000) and seen == [4]
    monkeypatch.setattr(searches, "kept_pairs", lambda s, d: ring(s, [1, 2, 3, 4], [5, 6, 7, 9]))
    assert searches.cost_towards(spark, "").collect() == [] and seen == [4]


def test_sampled_betweenness_takes_edges_in_reach_alone(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(centrality, "dependencies_of", lambda edges, sources, f=centrality.dependencies_of: (seen.append(edges.count()), f(edges, sources))[1])
    labels = spark.createDataFrame([], "node long, label string")
    found = centrality.betweenness_by_joins(ring(spark, [1, 2, 3, 9], [4, 5, 6, 7]), labels, "battle-path", False, sources=1, rows_at_once=1).collect()
    assert seen == [8] and sorted(r.raw for r in found) == [0, 0, 0, 0, 0, 0, 2, 2]


def test_rounds_of_small_fronts_leave_the_edges_where_they_are(spark, capsys):
    edges = projection.symmetric(ring(spark, list(range(9)))).select("node", "other")
    front = spark.range(3).withColumnRenamed("id", "node").hint("merge")
    assert "BroadcastHashJoin" in plan(reaching(spark.range(3).withColumnRenamed("id", "node"), edges, 3), capsys)
    assert "SortMergeJoin" in plan(reaching(front, edges, 500_001), capsys)


def test_traced_searches_read_what_they_ask_for(spark, monkeypatch):
    p = ring(spark, list(range(12)), list(range(20, 26))).cache()
    held = paths.Graph.of(p, "battle-path")
    monkeypatch.setattr(paths.Graph, "of", None)
    monkeypatch.setattr(paths.Fetched, "AT_ONCE", 2)
    for target in (5, 23):
        for r in paths.run(spark, p, 0, target, modes=("battle-path",), landmarks=[3, 22]).collect():
            want = paths.search(held, r.algorithm, 0, target, True, 50_000, [3, 22])
            assert (r.status, r.cost, r.visited, r.n_steps, r.path) == (want.status, want.cost, want.visited, len(want.steps), [str(x) for x in want.path])
            assert [(s.action, s.node) for s in r.steps] == [(a, str(n)) for a, n in want.steps]


def test_betweenness_of_equal_costs_writes_levels_alone(spark, monkeypatch):
    p = ring(spark, [1, 2, 3, 9, 11], [4, 5, 6, 7])
    labels = spark.createDataFrame([], "node long, label string")
    key = lambda r: (r.node, r.degree, r.strength, round(r.raw, 9))
    want = sorted(map(key, centrality.betweenness(p, labels, "battle-path", False).collect()))
    monkeypatch.setattr(centrality, "shortest_edges", None)
    for rows in (1, 200_000_000):
        assert sorted(map(key, centrality.betweenness_by_joins(p, labels, "battle-path", False, rows_at_once=rows).collect())) == want


def test_neighbours_read_for_searches_are_held_as_arrays(spark):
    n = 60_000
    rows = spark.range(n).selectExpr("0L AS node", "id + 1 AS other", "1L AS w", "id % 9 AS total", "IF(id % 2 = 0, 'ally', 'enemy') AS relation")
    near = paths.Fetched(rows)
    near.heard = dict.fromkeys(range(1, n + 1))  # counted apart
    tracemalloc.start()
    try:
        near.read([0])
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert held < 40 * n
    assert near[0] == [(x + 1, 1, "enemy" if x % 2 else "ally") for x in sorted(range(n), key=lambda x: (-(x % 9), x))]
    assert near.get(5) is None and 5 not in near and near[5] == [] and 0 in near and 5 not in near.heard


def test_neighbours_may_have_names(spark):
    rows = spark.createDataFrame([("a", "b", 2, 2, "ally"), ("a", "c", 1, 3, "enemy"), ("b", "a", 2, 2, "ally"), ("c", "a", 1, 3, "enemy")], "node string, other string, w long, total long, relation string")
    near = paths.Fetched(rows)
    assert near["a"] == [("c", 1, "enemy"), ("b", 2, "ally")] and list(near.heard) == ["c", "b"]
    assert near["b"] == [("a", 2, "ally")] and not near.heard and near.keys() == {"a", "b", "c"}


def test_shuffle_files_go_when_a_computation_is_written(spark):
    before, held = spark.conf.get(session.CLEANED), []
    root = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {x for x in root.getAllFiles().mkString("\n").split("\n") if "shuffle_" in x}
    old = files()
    held.append(session.cut(spark.range(2000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))))
    assert files() <= old and sorted(r.n for r in held[0].collect())[-1] == 286
    assert spark.conf.get(session.CLEANED) == before


def test_components_of_many_edges_contract_some_first(spark, monkeypatch):
    rng = random.Random(3)
    rows = {(rng.randrange(40 * k, 40 * k + 40), rng.randrange(40 * k, 40 * k + 40)) for k in range(5) for _ in range(120)} | {(300, 300), (310, 311), (0, 0)}
    edges = spark.createDataFrame(sorted(rows), "src long, dst long").coalesce(1)
    want = sorted(components.connected_components(edges).collect())
    monkeypatch.setattr(components, "MANY", 50)
    made, real = [], components._contracted
    monkeypatch.setattr(components, "_contracted", lambda now, total: (made.append(total), real(now, total))[1])
    for hub in (components.HUB, 4):
        monkeypatch.setattr(components, "HUB", hub)
        assert sorted(components.connected_components(edges).collect()) == want
    assert len(made) == 4 and 0 < made[0] < len(rows) / 8
    assert components.connected_components(edges.limit(0)).collect() == []


def test_cost_towards_does_not_write_the_edges_again(spark, monkeypatch):
    made, real = [], paths.cut
    monkeypatch.setattr(paths, "cut", lambda df: (made.append(df.columns), real(df))[1])
    monkeypatch.setattr(searches, "kept_pairs", lambda s, d: ring(s, [1, 2, 3, 4], [5, 6, 7, 9]))
    assert searches.cost_towards(spark, "").collect() == []
    assert made and all(x == ["node", "level"] for x in made)
