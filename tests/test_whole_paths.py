"""The path queries over all pairs, those that met once too."""

import heapq

from skein import catalog

LINE = "l_orderkey long, l_partkey long, l_linenumber int, l_discount double"
PART = "p_partkey long, p_name string, p_brand string, p_type string, p_retailprice double"


def lines(spark, folder, orders):
    rows = [(k, part, 2 * n + 1, 0.05) for k, parts in enumerate(orders) for n, part in enumerate(parts)]
    spark.createDataFrame(rows, LINE).write.parquet(f"{folder}/lineitem.parquet")
    nodes = sorted({part for parts in orders for part in parts})
    spark.createDataFrame([(k, f"n{k}", "b", "t", float(k)) for k in nodes], PART).write.parquet(f"{folder}/part.parquet")
    return str(folder)


#: 1 = 2 - 3 = 4 - 5 = 6: a pair joined by = met twice, one joined by - once.
CHAIN = [(1, 2), (1, 2), (2, 3), (3, 4), (3, 4), (4, 5), (5, 6), (5, 6)]


def brute_distances(orders, source):
    met = {}
    for a, b in orders:
        met[a, b] = met[b, a] = met.get((a, b), 0) + 1
    dist, heap = {source: 0}, [(0, source)]
    while heap:
        d, at = heapq.heappop(heap)
        for (a, b), n in met.items():
            if a == at and d + -(-1_000_000 // n) < dist.get(b, 1 << 60):
                dist[b] = d + -(-1_000_000 // n)
                heapq.heappush(heap, (dist[b], b))
    return dist


def test_chain_with_pairs_that_met_once(spark, tmp_path):
    sf, q = lines(spark, tmp_path, CHAIN), catalog.QUERIES
    assert {r.node: r.distance for r in q["weighted_distance"](spark, sf).collect()} == brute_distances(CHAIN, 1)
    assert {r.node: r.level for r in q["bfs_levels_all"](spark, sf).collect()} == {k: k - 1 for k in range(1, 7)}
    assert {(r.src, r.dst): r.hops for r in q["cluster_hops_all"](spark, sf).collect()} == {(a, b): abs(a - b) // 2 for a in (1, 3, 5) for b in (1, 3, 5)}
    runs = q["path_comparison"](spark, sf).collect()
    assert len(runs) == 8 and {(r.status, r.hops) for r in runs} == {("found", 5)}
    assert {(r.src, r.dst) for r in q["path_snapshot"](spark, sf).collect()} == {(k, k + 1) for k in range(1, 6)}
    assert [tuple(r) for r in q["hops_from_both_ends"](spark, sf).collect()] == [(1, 6, 5)]
    assert [tuple(r) for r in q["cost_towards"](spark, sf).collect()] == [(1, 6, brute_distances(CHAIN, 1)[6])]
    assert {(r.node, r.level, r.parent) for r in q["bfs_parents"](spark, sf).collect()} == {(k, k - 1, k - 1 or None) for k in range(1, 7)}


def test_snapshot_finds_paths_of_more_than_5000_expansions(spark, tmp_path):
    sf = lines(spark, tmp_path, [(2, k) for k in range(3, 5200)] + [(1, 2)])
    assert (2, 5199) in {(r.src, r.dst) for r in catalog.QUERIES["path_snapshot"](spark, sf).collect()}
