"""Queries on what is exported: cluster forms, run metadata, tombstones, active wars, and places of paths and hidden nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import scalars
from skein.operators import components, layout, serving, simulation_log
from skein.plans.graph import ORACLE_SQL, PLAYERS, STRONG, SYM, cluster_profiles, kept_pairs, query, strong_members
from skein.sources import tables

EXPORTED = ("mean_op", "mean_feed", "matches")


def _r4(sql: str) -> str:
    return f"floor(({sql}) * 10000.0 + 0.5) / 10000.0"


def _held(sql: str) -> str:
    return f"greatest(0.0, least(1.0, {sql}))"


@query("cluster_export", f"""WITH p AS ({ORACLE_SQL["cluster_profiles"]}), k AS (SELECT * FROM p WHERE size >= 2), t AS (SELECT {", ".join(f"greatest(coalesce(CAST(max({c}) AS DOUBLE), 0.0), 1e-9) AS t_{c}" for c in EXPORTED)} FROM k)
 SELECT comp, size, {_r4("coalesce(size_share, 0.0)")} AS size_ratio, {_r4("coalesce(mean_op, 0.0)")} AS mean_opscore, {_r4("1 - coalesce(bridge_ratio, 0.0)")} AS cohesion,
 {_r4(_held("1 - " + _held("coalesce(op_spread, 0.0) * 2")))} AS internal_edge_ratio, {_r4(_held("coalesce(mean_feed, 0.0) / 10"))} AS feed_risk,
 {", ".join(f"{_r4(f'least(1.0, coalesce(CAST({c} AS DOUBLE), 0.0) / t_{c})')} AS a_{c}" for c in EXPORTED)} FROM k, t""")
def cluster_export(spark, sf):
    return serving.cluster_export(cluster_profiles(spark, sf), list(EXPORTED))


@query("representative_members", f"WITH RECURSIVE {STRONG} SELECT comp, node, CAST(place AS INT) AS place FROM (SELECT comp, node, row_number() OVER (PARTITION BY comp ORDER BY node) AS place FROM member) x WHERE place <= 8")
def representative_members(spark, sf):
    return components.representatives(strong_members(kept_pairs(spark, sf)))


@query("run_metadata", f"""WITH RECURSIVE {STRONG}, {SYM}, {PLAYERS} SELECT 'assortativity' AS analysis_type, '1' AS schema_version, CAST(7 AS BIGINT) AS seed, CAST(50 AS BIGINT) AS run_count, (SELECT count(*) FROM pl) AS filtered_nodes,
 (SELECT count(DISTINCT node) FROM sym) AS runtime_nodes, (SELECT count(*) FROM rel) AS pair_relations, (SELECT count(DISTINCT comp) FROM member) AS runtime_clusters""")
def run_metadata(spark, sf):
    p = kept_pairs(spark, sf)
    return serving.run_metadata(p, tables.players(spark, sf), strong_members(p), "assortativity", "1", 7, 50)


BYTES = "list_transform(range(1, length(p_name) + 1), lambda i: CAST(ord(substring(p_name, i, 1)) AS HUGEINT))"


@query("hidden_positions", f"""WITH h AS (SELECT p_partkey AS id, list_reduce({BYTES}, lambda h, b: (h * {scalars.HASH_FACTOR} + b) % 18446744073709551616, CAST({scalars.HASH_START} AS HUGEINT)) AS h FROM part)
 SELECT id, CAST(h AS VARCHAR) AS hash, round((700.0 + CAST((h // 512) % 180 AS DOUBLE)) * cos(radians(CAST(h % 360 AS DOUBLE))), 6) AS x, round((700.0 + CAST((h // 512) % 180 AS DOUBLE)) * sin(radians(CAST(h % 360 AS DOUBLE))), 6) AS y FROM h""")
def hidden_positions(spark, sf):
    p = layout.hidden_position(tables.table(spark, sf, "part"), "p_name")
    return p.select(F.col("p_partkey").alias("id"), scalars.name_hash64(F.col("p_name")).cast("string").alias("hash"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("path_places", """WITH l AS (SELECT l_orderkey AS path, l_linenumber, l_linenumber - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem), q AS (SELECT *, CAST(i AS DOUBLE) / greatest(n - 1, 1) AS t FROM l)
 SELECT path, l_linenumber, round(10.0 + (650.0 - 10.0) * t, 6) AS x, round(20.0 + (50.0 - 20.0) * t + (sin(t * pi()) - 0.5) * 80.0, 6) AS y FROM q""")
def path_places(spark, sf):
    from pyspark.sql import Window

    li = tables.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("path"), "l_linenumber", F.count("*").over(Window.partitionBy("l_orderkey")).alias("n"))
    i = F.col("l_linenumber") - 1
    x, y = layout.along_path(F.lit(10.0), F.lit(650.0), i, F.col("n")), layout.along_path(F.lit(20.0), F.lit(50.0), i, F.col("n"), 80.0)
    return li.select("path", "l_linenumber", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("tombstones", """WITH d AS (SELECT o_custkey AS tribe, o_orderkey AS tick, o_orderkey % 5 AS k, o_orderkey % 11 AS other, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
 SELECT c_custkey AS tribe, CAST(0 AS BIGINT) AS tick, 'starved' AS cause, '' AS lineage FROM customer WHERE c_custkey % 4 = 0
 UNION ALL SELECT tribe, tick, CASE k WHEN 0 THEN 'starved' WHEN 1 THEN concat('conquered-by-', other) WHEN 2 THEN concat('absorbed-by-', other) WHEN 3 THEN 'imploded' ELSE 'unknown' END, concat('seed-', tribe, ',gen-', tick) FROM d WHERE n = 1 AND tribe NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 = 0)""")
def tombstones(spark, sf):
    kinds = F.array(*[F.lit(x) for x in (*simulation_log.CAUSES, "other")])
    o = tables.table(spark, sf, "orders").select(F.col("o_custkey").alias("tribe"), F.col("o_orderkey").alias("tick"))
    line = F.array(F.concat(F.lit("seed-"), F.col("tribe")), F.lit("war-1"), F.concat(F.lit("gen-"), F.col("tick")))
    deaths = o.select("tribe", "tick", F.element_at(kinds, (F.col("tick") % 5).cast("int") + 1).alias("kind"), (F.col("tick") % 11).alias("other"), line.alias("lineage"))
    stored = tables.table(spark, sf, "customer").filter("c_custkey % 4 = 0").select(F.col("c_custkey").alias("tribe"), F.lit(0).cast("long").alias("tick"), F.lit("starved").alias("cause"), F.array().cast("array<string>").alias("lineage"))
    return simulation_log.tombstones(deaths, stored).withColumn("lineage", F.array_join("lineage", ","))


@query("active_wars", "SELECT o_orderkey AS war_id, o_custkey AS start_tick, greatest(0, 100 - o_custkey) AS duration FROM orders WHERE o_orderstatus = 'O'")
def active_wars(spark, sf):
    wars = tables.table(spark, sf, "orders").select(F.col("o_orderkey").alias("war_id"), F.col("o_custkey").alias("start_tick"), F.when(F.col("o_orderstatus") == "O", "active").otherwise("over").alias("status"))
    return simulation_log.active_wars(wars, 100).select("war_id", "start_tick", "duration")
