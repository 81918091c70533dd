"""Graph operators that keep the graph in Spark, against plain versions."""

import contextlib
import io
import itertools
import math
import random

import numpy as np
import pytest

from skein.operators import assortativity, centrality, groups
from tests.test_searches import graph


@pytest.fixture
def light(spark, monkeypatch):
    """One partition, and rounds kept on the driver, for the rounds are many and small."""
    for m in (groups, centrality):
        monkeypatch.setattr(m, "cut", lambda df: spark.createDataFrame(df.toArrow()))
    held = {"spark.sql.shuffle.partitions": "1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


# --- bounded groups -----------------------------------------------------------------------------------------------------

def weights(ties):
    near = {}
    for a, b, w in ties:
        near.setdefault(a, {})[b] = w
        near.setdefault(b, {})[a] = w
    return near


def standing(near, free, x):
    own = [w for y, w in near.get(x, {}).items() if y in free]
    return -len(own), -sum(own)


def one_after_the_other(ties, matches, most):
    """Groups grown one at a time from the best node left."""
    near, free, out = weights(ties), set(matches), {}
    while free:
        seed = min(free, key=lambda x: (*standing(near, free, x), -matches[x], x))
        group = [seed]
        free.discard(seed)
        while len(group) < most:
            held = {x: sum(near[x].get(g, 0) for g in group) for x in free if any(g in near.get(x, {}) for g in group)}
            if not held:
                break
            new = min(held, key=lambda x: (-held[x], -near[x].get(seed, 0), *standing(near, free, x), x))
            group.append(new)
            free.discard(new)
        out.update(dict.fromkeys(group, seed))
    return out


def side_by_side(ties, matches, most):
    """The rule of the rounds."""
    near, head = weights(ties), dict.fromkeys(matches)
    while None in head.values():
        free = {x for x, h in head.items() if h is None}
        key = {x: (*standing(near, free, x), -matches[x], x) for x in free}
        seeds = [x for x in free if all(key[x] < key[y] for y in near.get(x, {}) if y in free)]
        for x in seeds:
            head[x] = x
        while True:
            free, wanted = {x for x, h in head.items() if h is None}, {}
            for s in seeds:
                group = [x for x, h in head.items() if h == s]
                held = {x: sum(near[x].get(g, 0) for g in group) for x in free if any(g in near.get(x, {}) for g in group)}
                if held and len(group) < most:
                    new = min(held, key=lambda x: (-held[x], -near[x].get(s, 0), *standing(near, free, x), x))
                    wanted.setdefault(new, []).append((-held[new], s))
            if not wanted:
                break
            for x, takers in wanted.items():
                head[x] = min(takers)[1]
    return head


def divided(spark, ties, matches, most):
    both = [(a, b, w) for a, b, w in ties] + [(b, a, w) for a, b, w in ties]
    found = groups.divided(spark.createDataFrame(both, "node long, other long, w long"), spark.createDataFrame(list(matches.items()), "node long, matches long"), most)
    return {r.node: r["head"] for r in found.collect()}


def test_groups_equal_growing_them_in_turn_where_none_compete(light):
    chain = [(k, k + 1, 2) for k in range(1, 7)]
    matches = dict.fromkeys(range(1, 8), 1)
    assert divided(light, chain, matches, 4) == one_after_the_other(chain, matches, 4)
    wheel = [(0, k, 2 + k % 3) for k in range(1, 7)] + [(k, k + 1, 4) for k in range(1, 6)]
    matches = dict.fromkeys(range(7), 2)
    assert divided(light, wheel, matches, 4) == one_after_the_other(wheel, matches, 4)


@pytest.mark.parametrize("seed", [1])
def test_groups_follow_the_rule_of_rounds(light, seed):
    rng = random.Random(seed)
    ties = [(a, b, rng.randint(2, 4)) for a, b in itertools.combinations(range(16), 2) if rng.random() < 0.18]
    matches = {k: rng.randint(0, 2) for k in range(18)}
    got = divided(light, ties, matches, 4)
    assert got == side_by_side(ties, matches, 4)
    assert max(list(got.values()).count(h) for h in got.values()) <= 4


# --- betweenness --------------------------------------------------------------------------------------------------------

def named(spark, rows):
    return spark.createDataFrame([(a, b, w, 0, w, "ally") for a, b, w in rows], "src string, dst string, ally long, enemy long, total long, relation string")


def both(spark, pairs, **how):
    labels = spark.createDataFrame([], f"node {dict(pairs.dtypes)['src']}, label string")
    key = lambda r: (r.node, r.label, r.degree, r.strength, round(r.raw, 9), round(r.normalised, 9))
    return sorted(map(key, centrality.betweenness(pairs, labels, **how).collect())), sorted(map(key, centrality.betweenness_by_joins(pairs, labels, **how).collect()))


def test_joins_give_the_betweenness_of_known_graphs(light):
    path = named(light, [("a", "b", 1), ("b", "c", 1), ("c", "d", 1)])
    star = named(light, [("center", x, 1) for x in "abc"])
    heavy = named(light, [("a", "b", 10), ("b", "c", 10), ("a", "c", 1)])
    bridge = named(light, [(x, y, 1) for x, y in ("ab", "ac", "bc", "de", "df", "ef")] + [("c", "m", 1), ("d", "m", 1)])
    for g, weighted in ((star, False), (heavy, True), (heavy, False), (bridge, True)):
        plain, joined = both(light, g, weighted=weighted)
        assert plain == joined
    labels = light.createDataFrame([], "node string, label string")
    assert [r.raw for r in centrality.betweenness_by_joins(path, labels).orderBy("node").collect()] == [0, 2, 2, 0]
    assert centrality.betweenness_by_joins(path.limit(0), labels).collect() == []


@pytest.mark.parametrize("weighted", [True, False])
def test_joins_give_the_betweenness_of_random_graphs(light, weighted):
    _, pairs = graph(light, 11, n=24, p=0.12)
    plain, joined = both(light, pairs, mode="battle-path", weighted=weighted)
    assert plain == joined and any(r[4] for r in plain)


def test_batches_and_samples(light):
    rows, pairs = graph(light, 12, n=24, p=0.15)
    labels = light.createDataFrame([], "node long, label string")
    run = lambda **how: {r.node: r.normalised for r in centrality.betweenness_by_joins(pairs, labels, "battle-path", False, **how).collect()}
    whole, parts, some = run(), run(rows_at_once=2 * 2 * len(rows) * 6), run(sources=8)
    assert whole.keys() == parts.keys() == some.keys() and all(math.isclose(whole[k], parts[k], abs_tol=1e-9) for k in whole)
    assert max(abs(whole[k] - some[k]) for k in whole) <= centrality.sampling_error(8, len(whole))
    assert 0 < centrality.sampling_error(4000, 10**6) < 0.06


# --- permutations -------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("seed", [0, 1, 7, 2**63 + 11])
def test_permutations_are_those_of_one_generator(spark, seed):
    for n, runs in ((1, 3), (2, 4), (57, 6)):
        rng, values = assortativity.Lcg(seed), list(range(n))
        want = {run: rng.shuffled(values) for run in range(1, runs + 1)}
        got = {}
        for r in assortativity.permutations(spark, n, runs, seed).collect():
            got.setdefault(r.run, {})[r.place] = r.origin
        assert {run: [own[k] for k in range(n)] for run, own in got.items()} == want
    for steps in (0, 1, 5, 1000):
        a, b = assortativity.Lcg(seed), assortativity.Lcg(seed)
        for _ in range(steps):
            a.below(10)
        assert a.state == b.ahead(steps).state
        if steps:
            assert int(assortativity.Lcg(seed).states(steps)[-1]) == a.state


def test_blocks_of_states_do_not_matter():
    assert (assortativity.Lcg(5).permutation(500) == assortativity.Lcg(5).permutation(500, block=7)).all()
    assert assortativity.Lcg(5).permutation(500).tolist() == assortativity.Lcg(5).shuffled(list(range(500)))


def plain_test(rows, values, runs, seed):
    ids = sorted(k for k, v in values.items() if v is not None)
    rng, own = assortativity.Lcg(seed), [values[k] for k in ids]

    def r(v):
        at = dict(zip(ids, v, strict=True))
        ends = [(at[a], at[b]) for a, b in rows if a in at and b in at]
        x = np.array([*ends, *[(b, a) for a, b in ends]])
        return float(np.corrcoef(x[:, 0], x[:, 1])[0, 1])

    observed, null = r(own), [r(rng.shuffled(own)) for _ in range(runs)]
    return observed, np.mean(null), np.std(null), (sum(x >= observed for x in null) + 1) / (runs + 1)


def test_permutation_test_equals_a_plain_run(spark):
    rows, pairs = graph(spark, 21, n=30, p=0.2)
    rng = random.Random(4)
    values = {k: None if k == 5 else rng.random() for k in range(30)}
    got = assortativity.permutation_test(pairs, spark.createDataFrame(list(values.items()), "id long, value double"), 20, 7).first()
    observed, mean, spread, p = plain_test([r[:2] for r in rows], values, 20, 7)
    assert got.observed == pytest.approx(observed) and got.null_mean == pytest.approx(mean) and got.null_stddev == pytest.approx(spread) and got.p_upper == p and got.valid == 20


# --- assortativity ------------------------------------------------------------------------------------------------------

def test_assortativity_sums_before_it_exchanges_its_four_groups(spark):
    _, pairs = graph(spark, 31)
    players = spark.createDataFrame([(k, k * 1.5, k % 7 * 1.0, 5) for k in range(40)], "id long, opscore double, feedscore double, match_count long")
    member = spark.createDataFrame([(k, k % 3) for k in range(40)], "node long, comp long")
    out = assortativity.assortativity(pairs, players, member)
    held = io.StringIO()
    with contextlib.redirect_stdout(held):
        out.explain()
    lines = [x.strip() for x in held.getvalue().splitlines()]
    at = [k for k, x in enumerate(lines) if "Exchange hashpartitioning(mode" in x and "metric" in x]
    assert any("HashAggregate" in lines[k + 1] and "partial_count" in lines[k + 1] for k in at)
    below = lines[at[0] :] if "partial_count" in lines[at[0] + 1] else lines[at[-1] :]
    assert not any("Join" in x and "mode" in x for x in below)
    assert len(out.collect()) == 4
    empty = assortativity.assortativity(pairs.limit(0), players, member).collect()
    assert len(empty) == 4 and {(r.candidates, r.analyzed, r.global_edges, r.global_r) for r in empty} == {(0, 0, 0, None)}
