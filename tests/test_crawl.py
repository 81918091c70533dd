"""The crawl against a plain queue, its limits, and that it goes on where it stopped."""

import random
from collections import deque

import pytest

from skein.operators import crawl


def tables(seed, players=30, matches=40):
    rng = random.Random(seed)
    rows = [(m, pos, p, 100 * (pos % 2)) for m in range(matches) for pos, p in enumerate(rng.sample(range(players), rng.randint(2, 5)))]
    return rows, {m: rng.randint(1, 9) for m in range(matches)}


def plain(rows, created, seeds, policy, max_players, max_matches, seed_matches, player_matches):
    of, side = {}, {}
    for m, _, p, team in rows:
        of.setdefault(p, []).append(m)
        side[m, p] = team
    queue, queued, done, saved = deque((p, True) for p in seeds), set(seeds), [], {}
    while queue and len(done) < max_players and len(saved) < max_matches:
        player, is_seed = queue.popleft()
        done.append(player)
        latest = sorted(of.get(player, []), key=lambda m: (-created[m], m))[: seed_matches if is_seed else player_matches]
        for m in latest:
            saved.setdefault(m, player)
        for m in latest:
            for x, _, p, team in rows:
                if x == m and p not in queued and (policy == "all" or (team == side[m, player]) == (policy == "teammates")):
                    queued.add(p)
                    queue.append((p, False))
    return done, saved


def frames(spark, rows, created, seeds):
    return (
        spark.createDataFrame(rows, "match_id long, pos int, player_id long, team int"), spark.createDataFrame(list(created.items()), "match_id long, created long"),
        spark.createDataFrame([(p, "a", k) for k, p in enumerate(seeds)], "player long, tier string, place int"),
    )


@pytest.mark.parametrize(("policy", "limits"), [("all", (1000, 1000)), ("teammates", (12, 1000)), ("opponents", (14, 17))])
def test_crawl_equals_a_queue(spark, tmp_path, policy, limits):
    rows, created = tables(3)
    how = {"policy": policy, "max_players": limits[0], "max_matches": limits[1], "seed_matches": 3, "player_matches": 2}
    players, matches = crawl.crawl(*frames(spark, rows, created, [4, 9]), str(tmp_path), **how)
    done, saved = plain(rows, created, [4, 9], policy, *limits, 3, 2)
    by_place = players.orderBy("place").collect()
    assert [r.player for r in by_place] == done
    place = {r.place: r.player for r in by_place}
    assert {r.match_id: place[r.place] for r in matches.collect()} == saved


def test_crawl_goes_on_and_picks(spark, tmp_path):
    rows, created = tables(5)
    own = frames(spark, rows, created, [1])
    whole = [[tuple(r) for r in df.orderBy(*df.columns).collect()] for df in crawl.crawl(*own, str(tmp_path / "whole"), policy="radial")]
    crawl.crawl(*own, str(tmp_path / "parts"), policy="radial", most_rounds=1)
    parts = [[tuple(r) for r in df.orderBy(*df.columns).collect()] for df in crawl.crawl(*own, str(tmp_path / "parts"), policy="radial")]
    assert whole == parts and len(whole[0]) > 1
    assert crawl.crawl(*own[:2], own[2].limit(0), str(tmp_path / "none"))[0].collect() == []
    with pytest.raises(ValueError):
        crawl.crawl(*own, str(tmp_path / "x"), policy="some")


def test_seeds_by_tier(spark):
    seeds = spark.createDataFrame([(p, t, k) for k, (p, t) in enumerate([(5, "a"), (6, "a"), (7, "b"), (8, "a"), (9, "b"), (5, "b")])], "player long, tier string, place int")
    assert [(r.place, r.player) for r in crawl.seeded(seeds, 2).orderBy("place").collect()] == [(1, 5), (2, 6), (3, 7), (4, 9)]
    assert crawl.seeded(seeds).count() == 5
