"""Searches by joins against plain queues and heaps on random graphs."""

import heapq
import random
from collections import deque

import pytest

from skein.operators import components, paths, projection, search


def graph(spark, seed, n=40, p=0.08, most=6):
    rng = random.Random(seed)
    rows = []
    for a in range(n):
        for b in range(a + 1, n):
            if rng.random() < p:
                ally = rng.randint(0, most)
                enemy = rng.randint(0 if ally else 1, 3)
                rows.append((a, b, ally, enemy, ally + enemy, "ally" if ally >= enemy else "enemy"))
    return rows, spark.createDataFrame(rows, "src long, dst long, ally long, enemy long, total long, relation string")


def near(rows):
    out = {}
    for a, b, _, _, total, _ in rows:
        out.setdefault(a, []).append((-total, b))
        out.setdefault(b, []).append((-total, a))
    return {a: [b for _, b in sorted(own)] for a, own in out.items()}


def queue(rows, source):
    """node: (level, parent, place in its level)."""
    found, line, counts = {source: (0, None, 1)}, deque([source]), {0: 1}
    adjacent = near(rows)
    while line:
        at = line.popleft()
        for other in adjacent.get(at, []):
            if other not in found:
                level = found[at][0] + 1
                counts[level] = counts.get(level, 0) + 1
                found[other] = (level, at, counts[level])
                line.append(other)
    return found


def costs(rows, source):
    adjacent = {}
    for a, b, _, _, total, _ in rows:
        c = -(-1_000_000 // total)
        adjacent.setdefault(a, []).append((b, c))
        adjacent.setdefault(b, []).append((a, c))
    dist, heap = {source: 0}, [(0, source)]
    while heap:
        d, at = heapq.heappop(heap)
        if d > dist[at]:
            continue
        for other, c in adjacent.get(at, []):
            if d + c < dist.get(other, 1 << 60):
                dist[other] = d + c
                heapq.heappush(heap, (d + c, other))
    return dist


@pytest.mark.parametrize("seed", [1, 2])
def test_queue_tree_and_paths(spark, seed):
    rows, pairs = graph(spark, seed)
    source = min(r[0] for r in rows)
    want = queue(rows, source)
    tree = search.queue_tree(projection.symmetric(pairs), source)
    assert {r.node: (r.level, r.parent, r.place) for r in tree.collect()} == want
    steps = search.with_relations(search.paths_of(tree, tree.select("node")), pairs).collect()
    relation = {(a, b): r for a, b, _, _, _, r in rows}
    got = {}
    for r in sorted(steps, key=lambda r: (r.target, r.place)):
        got.setdefault(r.target, []).append((r.node, r.relation))
    for node in want:
        path = [node]
        while want[path[-1]][1] is not None:
            path.append(want[path[-1]][1])
        path.reverse()
        assert got[node] == [(x, relation[min(x, y), max(x, y)] if k else None) for k, (y, x) in enumerate(zip([None, *path], path, strict=False))]
    traced = paths.Graph.of(pairs, "battle-path")
    far = max(want, key=lambda x: (want[x][0], x))
    assert paths.search(traced, "bfs", source, far).path == [x for x, _ in got[far]]


@pytest.mark.parametrize("seed", [3, 4])
def test_from_both_ends_is_a_shortest_path(spark, seed):
    rows, pairs = graph(spark, seed, p=0.06)
    edges, nodes = projection.symmetric(pairs), sorted({x for r in rows for x in r[:2]})
    known = {frozenset(r[:2]) for r in rows}
    for source, target in ((nodes[0], nodes[-1]), (nodes[3], nodes[-4]), (nodes[5], nodes[5]), (nodes[1], 10_000)):
        hops = queue(rows, source).get(target)
        got = [r.node for r in search.from_both_ends(edges, source, target).orderBy("place").collect()]
        if hops is None:
            assert got == []
        else:
            assert len(got) == hops[0] + 1 and got[0] == source and got[-1] == target and all(frozenset(e) in known for e in zip(got, got[1:], strict=False))


@pytest.mark.parametrize("seed", [5, 6])
def test_towards_finds_the_cheapest_path_with_fewer_rows(spark, seed):
    rows, pairs = graph(spark, seed, n=60, p=0.06)
    source, target = min(r[0] for r in rows), max(r[1] for r in rows)
    edges = paths.allowed(pairs, "battle-path")
    members = components.connected_components(pairs.filter("ally >= 3").select("src", "dst"))
    marks = [r.node for r in components.landmarks(pairs, members, components.bridges(pairs, members), 8).collect()]
    table, names = search.landmark_table(edges, marks)
    for r in table.collect():
        for m, n in zip(marks, names, strict=True):
            assert r[n] == costs(rows, m).get(r.node)
    want = costs(rows, source)
    blind = search.towards(edges, source, target, table.limit(0), [])
    guided = search.towards(edges, source, target, table, names)
    both = search.towards(edges, source, target, table, names, search.hops_to(pairs, members, target))
    assert blind.cost == guided.cost == both.cost == want.get(target)
    assert both.relaxed <= guided.relaxed < blind.relaxed
    price = {frozenset(r[:2]): -(-1_000_000 // r[4]) for r in rows}
    for route in (blind, both):
        path = [r.node for r in route.path.orderBy("place").collect()]
        assert path[0] == source and path[-1] == target and sum(price[frozenset(e)] for e in zip(path, path[1:], strict=False)) == route.cost
    assert search.towards(edges, source, 10_000, table, names).cost is None


def test_cluster_hops_never_exceed_steps(spark):
    rows, pairs = graph(spark, 8, n=50, p=0.05)
    members = components.connected_components(pairs.filter("ally >= 4").select("src", "dst"))
    target = rows[0][0]
    steps = queue(rows, target)
    got = {r.node: r.hops for r in search.hops_to(pairs, members, target).collect()}
    assert set(got) == set(steps) and all(got[x] <= steps[x][0] for x in got) and got[target] == 0


def test_one_way_levels(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 4)], "node long, other long")
    assert {r.node: r.level for r in paths.bfs_levels(edges, edges.filter("node = 1").select("node")).collect()} == {1: 0, 2: 1, 3: 2, 4: 3}


def test_hops_of_named_sources(spark):
    links = spark.createDataFrame([(a, b) for k in range(6) for a, b in ((k, k + 1), (k + 1, k))], "src long, dst long")
    got = components.hops(links, links.filter("src = 2").select("src")).collect()
    assert {(r.src, r.dst, r.hops) for r in got} == {(2, k, abs(k - 2)) for k in range(7)}
