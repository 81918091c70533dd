"""Exports: name hashes, shares of maxima, tombstones, wars, and lineages of any depth."""

import math

import pytest
from pyspark.sql import functions as F

from skein.functions import scalars
from skein.operators import components, layout, serving, simulation_log
from skein.sources import sinks


def test_name_hash_wraps_like_64_bit_words(spark):
    def plain(text):
        h = 1469598103934665603
        for b in text.encode():
            h = (h * 1099511628211 + b) % 2**64
        return h

    words = ["", "a", "foobar", "éß漢", "x" * 3000]
    rows = spark.createDataFrame([(w,) for w in words] + [(None,)], "w string")
    placed = layout.hidden_position(rows.withColumn("h", scalars.name_hash64(F.col("w"))), "w").collect()
    assert [None if r.h is None else int(r.h) for r in placed] == [*map(plain, words), None]
    for r, w in zip(placed, words, strict=False):
        h = plain(w)
        angle, radius = math.radians(h % 360), 700 + (h >> 9) % 180
        assert (r.x, r.y) == pytest.approx((radius * math.cos(angle), radius * math.sin(angle)))


def test_points_along_a_path(spark):
    df = spark.createDataFrame([(0, 3), (1, 3), (2, 3), (0, 1)], "i int, n int")
    line = layout.along_path(F.lit(0.0), F.lit(10.0), F.col("i"), F.col("n"))
    arc = layout.along_path(F.lit(0.0), F.lit(10.0), F.col("i"), F.col("n"), 80.0)
    got = df.select(F.round(line, 6), F.round(arc, 6)).collect()
    assert [tuple(r) for r in got] == [(0.0, -40.0), (5.0, 45.0), (10.0, -30.0), (0.0, -40.0)]


def test_shares_of_the_largest_value(spark):
    df = spark.createDataFrame([(1, 4.0, 0.0), (2, 1.0, None), (3, None, -1.0)], "k int, a double, b double")
    got = [tuple(r) for r in serving.share_of_max(df, ["a", "b"]).orderBy("k").collect()]
    assert got == [(1, 1.0, 0.0), (2, 0.25, 0.0), (3, 0.0, pytest.approx(-1e9))]
    assert serving.share_of_max(df.limit(0), ["a", "b"]).count() == 0


def test_cluster_export_of_nulls_and_single_clusters(spark):
    df = spark.createDataFrame([(1, 1, 9.0, 9.0, 0.0, 0.0, 0.5), (2, 2, 4.0, 25.0, 0.1, 0.25, 0.4), (3, 3, None, None, None, None, None)], "comp long, size long, mean_op double, mean_feed double, op_spread double, bridge_ratio double, size_share double")
    got = {r.comp: r for r in serving.cluster_export(df, ["mean_op"]).collect()}
    assert set(got) == {2, 3}
    assert (got[2].cohesion, got[2].internal_edge_ratio, got[2].feed_risk, got[2].a_mean_op) == (0.75, 0.8, 1.0, 1.0)
    assert (got[3].cohesion, got[3].internal_edge_ratio, got[3].feed_risk, got[3].a_mean_op) == (1.0, 1.0, 0.0, 0.0)


def test_tombstones_are_written_once(spark):
    deaths = spark.createDataFrame([(1, 9, "starved", None, ["seed-1", "war", "merge-parent-2"]), (1, 5, "conquered", 7, None), (1, 5, "conquered", 7, None), (2, 3, "odd", None, ["gen-4", None]), (3, 1, "imploded", None, [])], "tribe long, tick long, kind string, other long, lineage array<string>")
    stored = spark.createDataFrame([(3, 8, "starved", ["seed-3"])], "tribe long, tick long, cause string, lineage array<string>")
    got = sorted(tuple(r) for r in simulation_log.tombstones(deaths, stored).collect())
    assert got == [(1, 5, "conquered-by-7", []), (2, 3, "unknown", ["gen-4"]), (3, 8, "starved", ["seed-3"])]
    assert simulation_log.tombstones(deaths.limit(0), stored.limit(0)).count() == 0


def test_active_wars(spark):
    wars = spark.createDataFrame([(1, "active", 40), (2, "over", 1), (3, "active", 70), (4, None, 2)], "war_id long, status string, start_tick long")
    assert sorted((r.war_id, r.duration) for r in simulation_log.active_wars(wars, 50).collect()) == [(1, 10), (3, 0)]


def test_lineage_beyond_any_round_count_and_of_cycles(spark):
    n = 9000
    chain = spark.range(n).select(F.col("id").alias("entity_id"), F.when(F.col("id") == 0, simulation_log.ABSENT).otherwise(F.col("id") - 1).alias("parent_a"))
    got = simulation_log.lineage(chain)
    assert got.filter("seed <> 0 or depth <> entity").isEmpty() and got.count() == n
    with pytest.raises(ValueError, match="cycle"):
        simulation_log.lineage(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "entity_id long, parent_a long")).count()


def test_graph_buffers_refuse_what_is_too_large(spark, tmp_path):
    nodes, edges = spark.range(3).withColumnRenamed("id", "node"), spark.createDataFrame([(0, 1)], "src long, dst long")
    with pytest.raises(ValueError, match="more than the 3"):
        sinks.write_graph(nodes, edges, str(tmp_path / "g"), most=3)
    assert not (tmp_path / "g").exists()


def test_representatives_and_metadata(spark):
    members = spark.createDataFrame([(n, n % 2) for n in range(30)], "node long, comp long")
    got = sorted(tuple(r) for r in components.representatives(members, 2).collect())
    assert got == [(0, 0, 1), (0, 2, 2), (1, 1, 1), (1, 3, 2)]
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")
    row = serving.run_metadata(pairs, spark.range(7), members, "x", "2", None, 3).first()
    assert tuple(row) == ("x", "2", None, 3, 7, 3, 2, 2)
