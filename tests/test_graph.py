"""Graph operators on small fixtures and against brute force."""

import heapq
import itertools
import math
import random
from collections import Counter

import pytest

from skein.operators import assortativity, balance, centrality, components, groups, paths, projection

PAIR = "src string, dst string, ally long, total long"


def pairs(spark, rows):
    df = spark.createDataFrame([(min(a, b), max(a, b), x, n) for a, b, x, n in rows], PAIR).withColumn("enemy", projection.F.col("total") - projection.F.col("ally"))
    return df.withColumn("relation", projection.relation("ally", "enemy"))


def labels(spark, p):
    return projection.symmetric(p.select("src", "dst")).select("node", projection.F.col("node").alias("label")).distinct()


def test_pairs_count_positions_and_repeats(spark):
    parts = spark.createDataFrame([("m", 0, "a", 1), ("m", 1, "b", 1), ("m", 2, "c", 2), ("m", 3, "a", 2)], "match_id string, pos int, player_id string, team int")
    got = {(r.src, r.dst): (r.ally, r.enemy, r.total, r.relation) for r in projection.pair_relations(parts).collect()}
    assert got == {("a", "b"): (1, 1, 2, "ally"), ("a", "c"): (1, 1, 2, "ally"), ("a", "a"): (0, 1, 1, "enemy"), ("b", "c"): (0, 1, 1, "enemy")}


def test_modes_and_costs(spark):
    p = pairs(spark, [("a", "b", 0, 3), ("b", "c", 2, 4)])
    rows = {r["mode"]: (r.candidates, r.supported, r.evidence) for r in projection.mode_summary(p, 2).collect()}
    assert rows == {"social-path": (1, 1, 2), "battle-path": (2, 2, 7)}
    assert [r.c for r in spark.range(0, 4).select(projection.traversal_cost(projection.F.col("id")).alias("c")).orderBy("id").collect()] == [1000000, 1000000, 500000, 333334]


def test_connected_subgraph_keeps_weaker_edges_between_kept_nodes(spark):
    p = pairs(spark, [("a", "b", 3, 3), ("b", "c", 3, 3), ("a", "c", 1, 1), ("c", "d", 1, 1)])
    assert {(r.src, r.dst) for r in projection.connected_subgraph(p, 3).collect()} == {("a", "b"), ("b", "c"), ("a", "c")}


def brute_components(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(80)] + [(k, k + 1) for k in range(200, 260)] + [(500, 500)]
    got = {r.node: r.comp for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == brute_components(edges)


def test_components_of_nothing(spark):
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_bounded_groups_divide_a_chain(spark):
    p = pairs(spark, [(f"p{k:02d}", f"p{k + 1:02d}", 2, 2) for k in range(24)])
    players = spark.createDataFrame([(f"p{k:02d}", 1) for k in range(25)] + [("z", 1)], "id string, match_count int")
    rows = groups.bounded_groups(p, players).collect()
    sizes = Counter(r.group for r in rows)
    assert len(rows) == 26 and max(sizes.values()) <= 20 and sum(sizes.values()) == 26
    assert all(r["size"] == sizes[r.group] for r in rows)


def test_triads_of_a_signed_clique(spark):
    signs = [("a", "b", 1), ("a", "c", 1), ("b", "c", -1), ("a", "d", -1), ("b", "d", -1), ("c", "d", 1)]
    found = balance.triads(spark.createDataFrame(signs, "src string, dst string, sign int"))
    got = {r.pattern: r.triads for r in balance.distribution(found).collect()}
    assert got == {"+++": 0, "++-": 2, "+--": 2, "---": 0}
    top = balance.node_summary(found).collect()
    assert sum(r.total for r in top) == 12


def test_triads_against_brute_force(spark):
    rng = random.Random(5)
    edges = {(a, b): rng.choice((1, -1)) for a, b in itertools.combinations(range(14), 2) if rng.random() < 0.5}
    found = balance.triads(spark.createDataFrame([(a, b, s) for (a, b), s in edges.items()], "src long, dst long, sign int")).collect()
    want = {(a, b, c): sum(edges[e] < 0 for e in ((a, b), (a, c), (b, c))) for a, b, c in itertools.combinations(range(14), 3) if {(a, b), (a, c), (b, c)} <= edges.keys()}
    assert {(r.a, r.b, r.c): r.negatives for r in found} == want


def test_sign_policies(spark):
    df = spark.createDataFrame([(4, 1), (1, 4), (2, 2)], "ally int, enemy int")
    for policy, last in (("exclude", None), ("ally", 1), ("enemy", -1)):
        assert [r.s for r in df.select(balance.sign(policy).alias("s")).collect()] == [1, -1, last]


METRIC = "id string, opscore double, feedscore double, match_count int"


def test_assortativity_counters(spark):
    p = pairs(spark, [("a", "b", 3, 3), ("a", "c", 0, 2), ("b", "c", 1, 2)])
    players = spark.createDataFrame([("a", 1.0, 10.0, 5), ("b", 2.0, 20.0, 5), ("c", 3.0, None, 2)], METRIC)
    member = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2")], "node string, comp string")
    rows = {(r["mode"], r.metric): r for r in assortativity.assortativity(p, players, member, 1, 3).collect()}
    feed, op = rows["battle-path", "feedscore"], rows["battle-path", "opscore"]
    assert (feed.candidates, feed.analyzed, feed.missing_metric, feed.low_match_count) == (3, 1, 2, 0)
    assert (op.candidates, op.analyzed, op.missing_metric, op.low_match_count) == (3, 1, 0, 2)
    assert op.global_r == pytest.approx(-1.0)


def test_pearson_without_variance_is_null(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "x double, y double")
    assert df.agg(assortativity.pearson(projection.F.lit(True), projection.F.col("x"), projection.F.col("y")).alias("r")).first().r is None


def test_permutations_are_seeded(spark):
    assert assortativity.Lcg(0).state == 1
    assert sorted(assortativity.Lcg(3).shuffled(list(range(10)))) == list(range(10))
    e = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    v = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "id string, value double")
    one, two = (assortativity.permutation_test(e, v, 16, 7).first() for _ in range(2))
    assert one == two and one.edges == 2 and one.valid + one.undefined == 16


def test_betweenness_of_known_graphs(spark):
    path = pairs(spark, [("a", "b", 1, 1), ("b", "c", 1, 1), ("c", "d", 1, 1)])
    raw = {r.node: r.raw for r in centrality.betweenness(path, labels(spark, path)).collect()}
    assert raw == {"a": 0, "b": 2, "c": 2, "d": 0}
    star = pairs(spark, [("center", x, 1, 1) for x in "abc"])
    top = centrality.betweenness(star, labels(spark, star)).orderBy("rank").first()
    assert (top.node, top.raw, top.normalised) == ("center", 3, 1)
    heavy = pairs(spark, [("a", "b", 10, 10), ("b", "c", 10, 10), ("a", "c", 1, 1)])
    for weighted, want in ((True, 1), (False, 0)):
        assert {r.node: r.raw for r in centrality.betweenness(heavy, labels(spark, heavy), weighted=weighted).collect()}["b"] == want
    bridge = pairs(spark, [(x, y, 1, 1) for x, y in ("ab", "ac", "bc", "de", "df", "ef")] + [("c", "m", 1, 1), ("d", "m", 1, 1)])
    assert centrality.betweenness(bridge, labels(spark, bridge)).orderBy("rank").first().node == "m"


def dijkstra(g, source):
    dist, heap = {source: 0}, [(0, source)]
    while heap:
        d, at = heapq.heappop(heap)
        if d > dist[at]:
            continue
        for other, w, _ in g.near[at]:
            new = d + g.cost(w, True)
            if new < dist.get(other, math.inf):
                dist[other] = new
                heapq.heappush(heap, (new, other))
    return dist


def test_distances_and_searches_agree(spark):
    rng = random.Random(9)
    p = pairs(spark, [(f"n{a:02d}", f"n{b:02d}", rng.randint(1, 6), 6) for a, b in itertools.combinations(range(24), 2) if rng.random() < 0.12])
    g = paths.Graph.of(p, "social-path")
    source = min(g.near)
    want = dijkstra(g, source)
    got = {r.node: r.distance for r in paths.distances(paths.allowed(p, "social-path"), spark.createDataFrame([(source,)], "node string")).collect()}
    assert got == want
    levels = {r.node: r.level for r in paths.bfs_levels(projection.symmetric(p), spark.createDataFrame([(source,)], "node string")).collect()}
    for target in want:
        if target != source:
            assert paths.search(g, "dijkstra", source, target).cost == want[target]
            assert paths.search(g, "astar", source, target).cost == want[target]
            assert paths.search(g, "bfs", source, target).cost == levels[target]
            both = paths.search(g, "bidirectional", source, target)
            assert both.status == "found" and both.path[0] == source and both.path[-1] == target


def test_weighted_route_takes_the_strong_way(spark):
    p = pairs(spark, [("source", "target", 1, 1), ("bridge", "source", 10, 10), ("bridge", "target", 10, 10)])
    g = paths.Graph.of(p, "social-path")
    assert paths.search(g, "dijkstra", "source", "target").path == ["source", "bridge", "target"]
    assert paths.search(g, "bfs", "source", "target").path == ["source", "target"]
    assert paths.search(g, "bfs", "source", "nobody").status == "unknown_node"
    with pytest.raises(ValueError):
        paths.search(g, "other", "source", "target")
    apart = paths.Graph.of(pairs(spark, [("a", "source", 1, 1), ("b", "target", 1, 1)]), "social-path")
    assert paths.search(apart, "astar", "source", "target").status == "not_found"
