"""The edges shown with a path, by hand and against a plain version."""

import random

import pytest

from skein.operators import components

PAIRS = "src long, dst long, ally long, enemy long, total long, relation string"


def frames(spark, pairs, comp, path, visited, bridges=(), stars=()):
    rows = [(a, b, w, e, w + e, "ally" if w >= e else "enemy") for a, b, w, e in pairs]
    nodes = lambda x: spark.createDataFrame([(n,) for n in x], "node long")
    return spark.createDataFrame(rows, PAIRS), spark.createDataFrame(list(comp.items()), "node long, comp long"), spark.createDataFrame(list(enumerate(path)), "place int, node long"), nodes(visited), nodes(bridges), nodes(stars)


def shown(spark, *args, **how):
    return {(r.src, r.dst): (r.relation, r.weight) for r in components.snapshot(*frames(spark, *args), **how).collect()}


def test_edges_between_clusters_hide_beside_a_path(spark):
    pairs = [(1, 2, 3, 0), (2, 3, 2, 0), (4, 5, 2, 1), (1, 4, 0, 2), (2, 5, 1, 1)]
    comp = {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}
    assert shown(spark, pairs, comp, [1, 4], [1, 4], mode="battle-path") == {(1, 2): ("ally", 3), (2, 3): ("ally", 2), (4, 5): ("ally", 3), (1, 4): ("enemy", 2)}
    assert (2, 5) in shown(spark, pairs, comp, [], [1, 4], mode="battle-path", ends=(1, 4))
    social = shown(spark, pairs, comp, [1, 4], [], mode="social-path")
    assert social[1, 4] == ("ally", 1) and social[4, 5] == ("ally", 2)


def test_visited_nodes_bring_their_clusters_and_order_decides(spark):
    pairs = [(10, k, 5 if k < 14 else 1, 0) for k in range(11, 20)] + [(1, 2, 1, 0)]
    comp = {**dict.fromkeys(range(10, 20), 10), 1: 1, 2: 1}
    near = {r.node for r in components.shown_members(*frames(spark, pairs, comp, [1, 2], [])[:2], frames(spark, pairs, comp, [], [10])[3], *frames(spark, pairs, comp, [], [], [19], [18])[4:], k=4).filter("comp = 10").collect()}
    assert near == {10, 19, 18, 11}
    assert set(shown(spark, pairs, comp, [1, 2], [10], [19], [18], k=4)) == {(1, 2), (10, 11), (10, 18), (10, 19)}


@pytest.mark.parametrize("mode", ["social-path", "battle-path"])
def test_snapshot_against_a_plain_version(spark, mode):
    rng = random.Random(6)
    pairs = [(a, b, rng.randint(0, 4), rng.randint(1, 4)) for a in range(30) for b in range(a + 1, 30) if rng.random() < 0.2]
    comp = {n: n // 8 for n in range(28)}
    by = {p[:2]: p for p in pairs}
    path = next([a, b, c] for a, b in by for c in range(30) if (min(b, c), max(b, c)) in by and c not in (a, b))
    visited, bridges, stars = [29, 3, 25, 7, 14], [5, 22], [6]
    preferred = {*path, *sorted(visited)[:3]}
    strength = {n: sum(w + e for a, b, w, e in pairs if n in (a, b)) for n in range(30)}
    kept = set(preferred)
    for c in {comp[n] for n in preferred if n in comp}:
        own = sorted((n for n in comp if comp[n] == c), key=lambda n: (n not in preferred, n not in bridges, n not in stars, -strength[n], n))
        kept |= set(own[: max(2, len(preferred))])
    steps = {(min(e), max(e)) for e in zip(path, path[1:], strict=False)}
    want = {}
    for a, b, w, e in pairs:
        if a in kept and b in kept and ((a, b) in steps or (comp.get(a) == comp.get(b) and (mode == "battle-path" or w > 0))):
            want[a, b] = ("ally", max(1, w)) if mode == "social-path" else ("ally" if w >= e else "enemy", w + e)
    assert shown(spark, pairs, comp, path, visited, bridges, stars, mode=mode, k=2, most_visited=3) == want
