"""Further queries: top lists, benchmarks, landmarks, snapshots, names and territory rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import scalars
from skein.functions.ranking import position
from skein.operators import components, serving, simulation_log
from skein.plans.graph import ACROSS, COUNTRY, PLAYERS, STRONG, also, kept_pairs, query, strong_members
from skein.sources import tables

_TOPS = (("best_op", "mean_op", "DESC"), ("worst_op", "mean_op", "ASC"), ("worst_feed", "mean_feed", "DESC"), ("best_feed", "mean_feed", "ASC"))


@query("country_tops", f"WITH {PLAYERS}, {COUNTRY} " + " UNION ALL ".join(f"SELECT * FROM (SELECT '{n}' AS list, CAST(row_number() OVER (ORDER BY {c} {o}, country) AS INT) AS place, country, {c} AS value FROM c) x WHERE place <= 3" for n, c, o in _TOPS))
def country_tops(spark, sf):
    return serving.country_tops(serving.country_stats(tables.players(spark, sf)), 3)


@query("score_benchmarks", f"""WITH {PLAYERS}, p AS (SELECT id, floor(((rank() OVER (ORDER BY opscore) - 1) + 0.5 * count(*) OVER (PARTITION BY opscore)) / count(*) OVER () * 100 * 10.0 + 0.5) / 10.0 AS a,
 floor(((rank() OVER (ORDER BY match_count) - 1) + 0.5 * count(*) OVER (PARTITION BY match_count)) / count(*) OVER () * 100 * 10.0 + 0.5) / 10.0 AS b FROM pl) SELECT id, a AS op_percentile, b AS match_percentile, round((a + b) / 2, 2) AS benchmark FROM p""")
def score_benchmarks(spark, sf):
    out = serving.midrank_percentile(tables.players(spark, sf).select("id", "opscore", "match_count"), "opscore", "op_percentile")
    out = serving.midrank_percentile(out, "match_count", "match_percentile")
    return out.select("id", "op_percentile", "match_percentile", F.round((F.col("op_percentile") + F.col("match_percentile")) / 2, 2).alias("benchmark"))


STRENGTH = "sg AS (SELECT node, CAST(sum(total) AS BIGINT) AS strength FROM (SELECT src AS node, total FROM rel UNION ALL SELECT dst, total FROM rel) z GROUP BY node)"


@query("global_view", f"WITH RECURSIVE {STRONG}, {STRENGTH} SELECT comp, node, strength, CAST(place AS INT) AS place FROM (SELECT comp, m.node, strength, row_number() OVER (PARTITION BY comp ORDER BY strength DESC, m.node) AS place FROM member m JOIN sg ON sg.node = m.node) x WHERE place <= 10")
def global_view(spark, sf):
    p = kept_pairs(spark, sf)
    return components.strongest_members(p, strong_members(p), 10)


@query("landmark_nodes", f"""WITH RECURSIVE {STRONG}, {ACROSS}, e AS (SELECT src AS node, ca AS comp FROM x UNION ALL SELECT dst, cb FROM x), bc AS (SELECT comp, node, row_number() OVER (PARTITION BY comp ORDER BY count(*) DESC, node) AS n FROM e GROUP BY comp, node),
 sg AS (SELECT node, CAST(sum(total) AS BIGINT) AS strength, count(*) AS degree FROM (SELECT src AS node, total FROM rel UNION ALL SELECT dst, total FROM rel) z GROUP BY node),
 o AS (SELECT sg.node, strength, degree, (bc.node IS NOT NULL) AS bridge, (m.node IS NOT NULL) AS clustered FROM sg LEFT JOIN member m ON m.node = sg.node LEFT JOIN bc ON bc.node = sg.node AND bc.n = 1)
 SELECT CAST(row_number() OVER (ORDER BY bridge DESC, clustered DESC, strength DESC, degree DESC, node) AS INT) AS turn, (SELECT min(node) FROM sg) AS comp, node FROM o ORDER BY turn LIMIT 16""")
def landmark_nodes(spark, sf):
    p = kept_pairs(spark, sf)
    m = strong_members(p)
    return components.landmarks(p, m, components.bridges(p, m), 16)


@query("latest_names", "SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN 'Unknown#Unknown' ELSE concat(p_name, '#', p_brand) END AS label FROM part")
def latest_names(spark, sf):
    p = tables.table(spark, sf, "part")
    raw = F.when(F.col("p_size") % 4 == 0, F.lit("[]")).otherwise(F.to_json(F.array(F.lit("old"), F.concat_ws("#", "p_name", "p_brand"))))
    return p.select(F.col("p_partkey").alias("id"), scalars.latest_name(raw).alias("label"))


@query("autocomplete", "SELECT p_partkey AS id, p_name AS label FROM part WHERE lower(p_name) LIKE '%bolt%' ORDER BY lower(p_name), p_name, p_partkey LIMIT 8")
def autocomplete(spark, sf):
    return serving.autocomplete(tables.players(spark, sf), "BOLT")


@query("run_order", "SELECT tribe, CAST(row_number() OVER (ORDER BY alive DESC, CASE WHEN alive THEN territory ELSE age END DESC, tribe) AS INT) AS place FROM (SELECT p_partkey AS tribe, p_size % 3 > 0 AS alive, p_size AS territory, p_partkey % 17 AS age FROM part) t")
def run_order(spark, sf):
    t = tables.table(spark, sf, "part").select(F.col("p_partkey").alias("tribe"), (F.col("p_size") % 3 > 0).alias("alive"), F.col("p_size").alias("territory"), (F.col("p_partkey") % 17).alias("age"))
    standing = t.select("tribe", "alive", F.when(F.col("alive"), F.col("territory")).otherwise(F.col("age")).alias("held"))
    return position(standing, [F.desc("alive"), F.desc("held"), F.asc("tribe")], "place").select("tribe", "place")


@query("claim_costs", "SELECT p_partkey AS tribe, CAST(8 + 3 * (p_size % 9) + 2 * greatest(0, p_partkey % 5 - 1) + p_size % 4 + CASE WHEN p_size % 2 = 0 THEN 8 ELSE 0 END + CASE WHEN p_size > 40 THEN 10 ELSE 0 END AS BIGINT) AS cost FROM part")
def claim_costs(spark, sf):
    p = tables.table(spark, sf, "part")
    cost = simulation_log.claim_cost(F.col("p_size") % 9, F.col("p_partkey") % 5, F.col("p_size") % 4, F.col("p_size") % 2 == 0, F.col("p_size") > 40)
    return p.select(F.col("p_partkey").alias("tribe"), cost.cast("long").alias("cost"))


@query("hex_distances", """WITH t AS (SELECT p_partkey AS id, p_partkey % 20 AS c, p_partkey // 20 AS r, p_size % 20 AS c2, p_size // 4 AS r2 FROM part), q AS (SELECT *, c - (r - r % 2) // 2 AS qa, c2 - (r2 - r2 % 2) // 2 AS qb FROM t)
 SELECT id, CAST((abs(qa - qb) + abs(r - r2) + abs(qa + r - qb - r2)) // 2 AS BIGINT) AS distance FROM q""")
def hex_distances(spark, sf):
    t = tables.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 20).alias("c"), F.floor(F.col("p_partkey") / 20).alias("r"), (F.col("p_size") % 20).alias("c2"), F.floor(F.col("p_size") / 4).alias("r2"))
    return t.select("id", scalars.hex_distance(F.col("c"), F.col("r"), F.col("c2"), F.col("r2")).alias("distance"))


also("hex_distances", "hex_distances_all")


@query("population_metrics", "SELECT p_brand AS behaviour, count(*) AS tribes, round(avg(p_retailprice), 4) AS mean_fitness, max(p_retailprice) AS best_fitness FROM part GROUP BY p_brand")
def population_metrics(spark, sf):
    return tables.table(spark, sf, "part").groupBy(F.col("p_brand").alias("behaviour")).agg(F.count("*").alias("tribes"), F.round(F.avg("p_retailprice"), 4).alias("mean_fitness"), F.max("p_retailprice").alias("best_fitness"))


@query("leading_artifacts", "SELECT CASE WHEN a >= b AND a >= c THEN 'artifact_a' WHEN b >= c THEN 'artifact_b' ELSE 'artifact_c' END AS leading, count(*) AS runs FROM (SELECT p_size % 7 AS a, p_partkey % 7 AS b, p_size % 5 AS c FROM part) t GROUP BY 1")
def leading_artifacts(spark, sf):
    return simulation_log.winners(tables.table(spark, sf, "part").select(F.col("p_partkey").alias("run"), (F.col("p_size") % 7).cast("long").alias("artifact_a"), (F.col("p_partkey") % 7).alias("artifact_b"), (F.col("p_size") % 5).cast("long").alias("artifact_c")))
