"""betweenness takes every pair with ally evidence, and a graph too large to broadcast goes by joins."""

import random

import numpy as np
import pytest

from skein import catalog
from skein.operators import centrality
from skein.plans.graph import pairs_of
from tests.test_real_pairs import adjacency, dijkstra


def price(w):
    return -(-1_000_000 // w)


def brandes(near, sources):
    """Dependencies of the sources, summed; edges cost price(weight)."""
    total = dict.fromkeys(near, 0.0)
    for s in sources:
        dist = dijkstra(near, s, price)
        order = sorted(dist, key=dist.get)
        before = {x: [y for y, w in near[x].items() if dist[y] + price(w) == dist[x]] for x in order}
        sigma, delta = {s: 1.0}, dict.fromkeys(order, 0.0)
        for x in order[1:]:
            sigma[x] = sum(sigma[y] for y in before[x])
        for x in order[:0:-1]:
            for y in before[x]:
                delta[y] += sigma[y] / sigma[x] * (1 + delta[x])
            total[x] += delta[x]
    return total


def test_betweenness_takes_edges_of_any_support(spark, sf):
    near = adjacency([r.asDict() for r in pairs_of(spark, sf).collect()], "ally")
    got = {r.node: (r.raw, r.degree) for r in catalog.QUERIES["betweenness"](spark, sf).collect()}
    want = brandes(near, near)
    assert got.keys() == near.keys() and all(got[x][1] == len(near[x]) and got[x][0] == pytest.approx(want[x] / 2) for x in near)


@pytest.mark.parametrize("most", [3, 100_000])
def test_sources_that_go_together_add_up(monkeypatch, most):
    monkeypatch.setattr(centrality, "AT_ONCE", most)
    rng = random.Random(5)
    near = {k: {} for k in range(30)}
    for a in range(30):
        for b in range(a):
            if rng.random() < 0.15:
                near[a][b] = near[b][a] = rng.choice([1, 1, 2, 3, 7])
    start = np.cumsum([0, *(len(near[k]) for k in range(30))])
    other, cost = (np.array([x for k in range(30) for x in own(k)]) for own in (lambda k: sorted(near[k]), lambda k: [price(near[k][x]) for x in sorted(near[k])]))
    want = brandes(near, range(10))
    assert centrality.dependencies(start, other, cost, np.arange(10)) == pytest.approx([want[k] for k in range(30)])


def test_graphs_too_large_to_broadcast_go_by_joins(spark):
    pairs = spark.createDataFrame([(a, a + 1, 1, 0, 1, "ally") for a in range(3)], "src long, dst long, ally long, enemy long, total long, relation string")
    labels = spark.createDataFrame([], "node long, label string")
    assert sorted((r.node, r.raw) for r in centrality.betweenness(pairs, labels, most_edges=2).collect()) == [(0, 0), (1, 2), (2, 2), (3, 0)]
