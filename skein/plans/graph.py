"""Queries over the co-presence graph of the star-schema tables, each with SQL for the checking engine where SQL can say it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import assortativity as assort
from skein.operators import balance, centrality, components, groups, paths, projection, serving
from skein.plans.relational import VIEWS
from skein.session import cut
from skein.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

PAIRS = f"participants AS ({VIEWS['participants']}), pairs AS ({VIEWS['pairs']})"
REL = f"{PAIRS}, rel AS (SELECT *, CASE WHEN ally >= enemy THEN 'ally' ELSE 'enemy' END AS relation FROM pairs)"
PLAYERS = """pl AS (SELECT p_partkey AS id, p_name AS label, p_brand AS role, p_type AS country, p_retailprice AS opscore, u.feedscore, coalesce(u.n, 0) AS match_count
 FROM part LEFT JOIN (SELECT l_partkey, round(avg(l_discount), 6) AS feedscore, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY l_partkey) u ON l_partkey = p_partkey)"""
SYM = "sym AS (SELECT src AS node, dst AS other, ally, enemy, total, relation FROM rel UNION ALL SELECT dst, src, ally, enemy, total, relation FROM rel)"


def reach(edges: str) -> str:
    """Membership (node, comp) of the ends of `edges` (src, dst), with comp the smallest node reached."""
    return f"""ce AS (SELECT src AS a, dst AS b FROM {edges} UNION SELECT dst, src FROM {edges}),
 reached(node, root) AS (SELECT a, a FROM ce UNION SELECT ce.b, reached.root FROM reached JOIN ce ON ce.a = reached.node),
 member AS (SELECT node, min(root) AS comp FROM reached GROUP BY node)"""


STRONG = f"{REL}, strong AS (SELECT src, dst FROM rel WHERE ally >= 2), {reach('strong')}"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def also(name: str, other: str) -> None:
    """Registers a query under a second name."""
    QUERIES[other], ORACLE_SQL[other] = QUERIES[name], ORACLE_SQL[name]


def pairs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.pair_relations(tables.participants(spark, sf_dir), tables.tasks(spark, sf_dir))


def kept_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs, computed once for queries that read them several times."""
    return cut(pairs_of(spark, sf_dir))


def strong_members(pairs: DataFrame) -> DataFrame:
    return cut(components.connected_components(pairs.filter("ally >= 2").select("src", "dst")))


@query("pair_relations", f"WITH {REL} SELECT src, dst, ally, enemy, total, relation FROM rel")
def pair_relations(spark, sf):
    return pairs_of(spark, sf)


@query("node_metrics", f"""WITH {REL}, {SYM} SELECT node, count(*) AS degree, count(*) FILTER (relation = 'ally') AS ally_degree, count(*) FILTER (relation = 'enemy') AS enemy_degree,
 CAST(sum(total) AS BIGINT) AS support, CAST(sum(ally) AS BIGINT) AS ally_support, CAST(sum(enemy) AS BIGINT) AS enemy_support FROM sym GROUP BY node""")
def node_metrics(spark, sf):
    return projection.node_metrics(pairs_of(spark, sf))


@query("visible_nodes", f"WITH {REL}, {SYM} SELECT DISTINCT node FROM sym WHERE total >= 2")
def visible_nodes(spark, sf):
    return projection.visible_nodes(pairs_of(spark, sf))


@query("connected_subgraph", f"WITH {REL}, {SYM}, v AS (SELECT DISTINCT node FROM sym WHERE total >= 3) SELECT src, dst, ally, enemy, total, relation FROM rel WHERE src IN (SELECT node FROM v) AND dst IN (SELECT node FROM v)")
def connected_subgraph(spark, sf):
    return projection.connected_subgraph(kept_pairs(spark, sf), 3)


@query("mode_support_counts", f"""WITH {REL} SELECT 'social-path' AS mode, count(*) FILTER (ally > 0) AS candidates, count(*) FILTER (ally >= 2) AS supported, CAST(sum(ally) AS BIGINT) AS evidence FROM rel
 UNION ALL SELECT 'battle-path', count(*) FILTER (total > 0), count(*) FILTER (total >= 2), CAST(sum(total) AS BIGINT) FROM rel""")
def mode_support_counts(spark, sf):
    return projection.mode_summary(kept_pairs(spark, sf), 2)


@query("dataset_summary", f"""WITH {REL} SELECT count(*) AS edges, count(*) FILTER (relation = 'ally') AS ally_edges, count(*) FILTER (relation = 'enemy') AS enemy_edges, count(*) FILTER (ally = enemy) AS ties,
 CAST(sum(total) AS BIGINT) AS evidence, max(total) AS strongest, round(CAST(sum(total) AS DOUBLE) / count(*), 6) AS mean_support FROM rel""")
def dataset_summary(spark, sf):
    p = pairs_of(spark, sf)
    ally = F.col("relation") == "ally"
    return p.agg(F.count("*").alias("edges"), F.count_if(ally).alias("ally_edges"), F.count_if(~ally).alias("enemy_edges"), F.count_if(F.col("ally") == F.col("enemy")).alias("ties"), F.sum("total").alias("evidence"), F.max("total").alias("strongest"), F.round(F.sum("total").cast("double") / F.count("*"), 6).alias("mean_support"))


@query("neighbour_lists", f"WITH {REL}, {SYM} SELECT node, string_agg(CAST(other AS VARCHAR), ',' ORDER BY total DESC, other) AS neighbours FROM sym GROUP BY node")
def neighbour_lists(spark, sf):
    return projection.neighbours(pairs_of(spark, sf)).select("node", F.array_join(F.transform("neighbours", lambda x: x.cast("string")), ",").alias("neighbours"))


also("neighbour_lists", "neighbour_lists_all")


@query("traversal_costs", f"WITH {REL} SELECT src, dst, (1000000 + greatest(ally, 1) - 1) // greatest(ally, 1) AS social_cost, (1000000 + greatest(total, 1) - 1) // greatest(total, 1) AS battle_cost FROM rel")
def traversal_costs(spark, sf):
    return pairs_of(spark, sf).select("src", "dst", projection.traversal_cost(F.col("ally")).alias("social_cost"), projection.traversal_cost(F.col("total")).alias("battle_cost"))


@query("min_costs", f"WITH {REL} SELECT min((1000000 + ally - 1) // ally) FILTER (ally > 0) AS social_cost, min((1000000 + total - 1) // total) AS battle_cost FROM rel WHERE ally > 0 OR total > 0".replace("min((1000000 + ally - 1) // ally) FILTER (ally > 0)", "min((1000000 + greatest(ally, 1) - 1) // greatest(ally, 1)) FILTER (ally > 0)"))
def min_costs(spark, sf):
    p = pairs_of(spark, sf)
    return p.agg(F.min(F.when(F.col("ally") > 0, projection.traversal_cost(F.col("ally")))).alias("social_cost"), F.min(projection.traversal_cost(F.col("total"))).alias("battle_cost"))


@query("eligible_match_pairs", f"""WITH {PAIRS}, pl AS (SELECT p_partkey AS id FROM part WHERE p_size >= 25), own AS (SELECT * FROM participants WHERE player_id IN (SELECT id FROM pl)),
 m AS (SELECT match_id FROM own GROUP BY match_id HAVING count(*) >= 2) SELECT count(DISTINCT match_id) AS matches, count(*) AS rows_kept FROM own WHERE match_id IN (SELECT match_id FROM m)""")
def eligible_match_pairs(spark, sf):
    ids = tables.table(spark, sf, "part").filter("p_size >= 25").select(F.col("p_partkey").alias("id"))
    return projection.eligible_participants(tables.participants(spark, sf), ids).agg(F.countDistinct("match_id").alias("matches"), F.count("*").alias("rows_kept"))


# --- components and clusters --------------------------------------------------------------------------------------------

@query("connected_components", f"WITH RECURSIVE {STRONG} SELECT node, comp FROM member")
def connected_components(spark, sf):
    return strong_members(kept_pairs(spark, sf))


@query("copresence_components", f"WITH RECURSIVE {REL}, e2 AS (SELECT src, dst FROM rel WHERE total >= 2), {reach('e2')} SELECT comp, count(*) AS size FROM member GROUP BY comp")
def copresence_components(spark, sf):
    return components.connected_components(pairs_of(spark, sf).filter("total >= 2").select("src", "dst")).groupBy("comp").agg(F.count("*").alias("size"))


@query("cluster_sizes", f"WITH RECURSIVE {STRONG} SELECT comp, count(*) AS size, CAST(row_number() OVER (ORDER BY count(*) DESC, comp) AS INT) AS rank FROM member GROUP BY comp")
def cluster_sizes(spark, sf):
    return components.sizes(strong_members(kept_pairs(spark, sf)))


@query("layout_components", f"WITH RECURSIVE {STRONG}, every AS (SELECT node, comp FROM member UNION ALL SELECT p_partkey, p_partkey FROM part WHERE p_partkey NOT IN (SELECT node FROM member)) SELECT node, comp, CAST(row_number() OVER (PARTITION BY comp ORDER BY node) - 1 AS INT) AS \"offset\" FROM every")
def layout_components(spark, sf):
    nodes = tables.table(spark, sf, "part").select(F.col("p_partkey").alias("node"))
    return components.member_offsets(components.with_singletons(strong_members(kept_pairs(spark, sf)), nodes))


@query("cluster_best_worst", f"""WITH RECURSIVE {STRONG}, {PLAYERS}, own AS (SELECT comp, node, row_number() OVER (PARTITION BY comp ORDER BY opscore DESC NULLS LAST, node) AS o, row_number() OVER (PARTITION BY comp ORDER BY feedscore DESC NULLS LAST, node) AS f FROM member JOIN pl ON pl.id = node)
 SELECT comp, max(CASE WHEN o = 1 THEN node END) AS best_op, max(CASE WHEN f = 1 THEN node END) AS worst_feed FROM own GROUP BY comp""")
def cluster_best_worst(spark, sf):
    return components.best_and_worst(strong_members(kept_pairs(spark, sf)), tables.players(spark, sf))


ACROSS = "x AS (SELECT r.*, a.comp AS ca, b.comp AS cb FROM rel r JOIN member a ON a.node = src JOIN member b ON b.node = dst WHERE a.comp <> b.comp)"


@query("bridge_nodes", f"""WITH RECURSIVE {STRONG}, {ACROSS}, e AS (SELECT src AS node, ca AS comp FROM x UNION ALL SELECT dst, cb FROM x), c AS (SELECT comp, node, count(*) AS external FROM e GROUP BY comp, node)
 SELECT comp, node, external FROM (SELECT *, row_number() OVER (PARTITION BY comp ORDER BY external DESC, node) AS n FROM c) WHERE n = 1""")
def bridge_nodes(spark, sf):
    p = kept_pairs(spark, sf)
    return components.bridges(p, strong_members(p))


@query("cluster_edges", f"""WITH RECURSIVE {STRONG}, y AS (SELECT r.relation, a.comp AS ca, b.comp AS cb FROM rel r LEFT JOIN member a ON a.node = src LEFT JOIN member b ON b.node = dst),
 t AS (SELECT ca AS comp, relation, ca, cb FROM y WHERE ca IS NOT NULL UNION ALL SELECT cb, relation, ca, cb FROM y WHERE cb IS NOT NULL AND ca IS DISTINCT FROM cb)
 SELECT comp, count(*) FILTER (relation = 'ally' AND ca IS NOT DISTINCT FROM cb) AS internal_ally, count(*) FILTER (NOT (relation = 'ally' AND ca IS NOT DISTINCT FROM cb)) AS enemy_or_cross FROM t GROUP BY comp""")
def cluster_edges(spark, sf):
    p = kept_pairs(spark, sf)
    return components.cluster_edges(p, strong_members(p))


@query("cluster_orbits", f"""WITH RECURSIVE {STRONG}, {ACROSS}, z AS (SELECT ca AS comp, cb AS other, ally FROM x WHERE relation = 'ally' UNION ALL SELECT cb, ca, ally FROM x WHERE relation = 'ally'),
 per AS (SELECT comp, CAST(sum(ally) AS BIGINT) AS cross_ally, count(DISTINCT other) AS neighbours FROM z GROUP BY comp), m AS (SELECT comp, count(*) AS members FROM member GROUP BY comp)
 SELECT m.comp, members, coalesce(cross_ally, 0) AS cross_ally, coalesce(neighbours, 0) AS neighbours, round(ln(1 + coalesce(cross_ally, 0)) + 0.6 * ln(1 + coalesce(neighbours, 0)) + 0.25 * ln(1 + members), 6) AS score FROM m LEFT JOIN per USING (comp)""")
def cluster_orbits(spark, sf):
    p = kept_pairs(spark, sf)
    return components.orbits(p, strong_members(p)).withColumn("score", F.round("score", 6))


@query("edge_class_counts", f"""WITH RECURSIVE {STRONG} SELECT CASE WHEN r.relation = 'enemy' THEN 'enemy' WHEN a.comp IS NOT DISTINCT FROM b.comp THEN 'ally-internal' ELSE 'ally-bridge' END AS view, count(*) AS edges
 FROM rel r LEFT JOIN member a ON a.node = src LEFT JOIN member b ON b.node = dst GROUP BY 1""")
def edge_class_counts(spark, sf):
    p = kept_pairs(spark, sf)
    return projection.edge_class(p, strong_members(p)).groupBy("view").agg(F.count("*").alias("edges"))


@query("cluster_hops", f"""WITH RECURSIVE {STRONG}, q AS (SELECT DISTINCT a.comp AS s, b.comp AS d FROM rel JOIN member a ON a.node = src JOIN member b ON b.node = dst WHERE a.comp <> b.comp), l AS (SELECT s, d FROM q UNION SELECT d, s FROM q),
 h(src, dst, hops) USING KEY (src, dst) AS (SELECT DISTINCT s, s, 0 FROM l UNION SELECT h.src, l.d, h.hops + 1 FROM h JOIN l ON l.s = h.dst LEFT JOIN recurring.h AS r ON r.src = h.src AND r.dst = l.d WHERE r.src IS NULL) SELECT src, dst, hops FROM h""")
def cluster_hops(spark, sf):
    p = kept_pairs(spark, sf)
    return components.hops(components.quotient(p, strong_members(p)))


also("cluster_hops", "cluster_hops_all")


def _renamed(sql: str, mark: str) -> str:
    """The expressions of reach() under names of their own."""
    return re.sub(r"\b(ce|reached|member)\b", rf"\g<1>{mark}", sql)


LEGACY_SQL = f"""WITH RECURSIVE {REL}, firm AS (SELECT src, dst FROM rel WHERE total >= 3), {_renamed(reach('firm'), '1')},
 held AS (SELECT comp, count(*) AS n FROM member1 GROUP BY comp), big AS (SELECT node FROM member1 JOIN held USING (comp) WHERE n > 15),
 firmer AS (SELECT src, dst FROM rel WHERE total >= 5 AND src IN (SELECT node FROM big)), {_renamed(reach('firmer'), '2')},
 held2 AS (SELECT comp, count(*) AS n FROM member2 GROUP BY comp HAVING count(*) >= 3), placed AS (SELECT node, comp, n, row_number() OVER (PARTITION BY comp ORDER BY node) - 1 AS k FROM member2 JOIN held2 USING (comp)),
 parts AS (SELECT node, comp, CAST(CASE WHEN n > 20 THEN k // 12 ELSE 0 END AS INT) AS part FROM placed)
 SELECT node, comp, 0 AS part FROM member1 JOIN held USING (comp) WHERE n <= 15
 UNION ALL SELECT node, comp, part FROM parts JOIN (SELECT comp, part FROM parts GROUP BY comp, part HAVING count(*) >= 3) USING (comp, part)"""


@query("legacy_groups", LEGACY_SQL)
def legacy_groups(spark, sf):
    return components.legacy_groups(kept_pairs(spark, sf))


@query("bounded_groups")
def bounded_groups(spark, sf):
    return groups.bounded_groups(kept_pairs(spark, sf), tables.players(spark, sf))


# --- assortativity ------------------------------------------------------------------------------------------------------

def _assort_sql(modes=assort.MODES, metrics=assort.METRICS) -> str:
    parts = []
    for mode in modes:
        for metric in metrics:
            s = "ally" if mode == "social-path" else "total"
            conds = {"global": "used", "within_cluster": "used AND same", "cross_cluster": "used AND NOT same", "strong_ties": "used AND s >= 3", "weak_ties": "used AND s < 3"}
            cols = []
            for k, c in conds.items():
                n, sm, q, p = f"2.0 * count(*) FILTER ({c})", f"coalesce(sum(x + y) FILTER ({c}), 0)", f"coalesce(sum(x * x + y * y) FILTER ({c}), 0)", f"2.0 * coalesce(sum(x * y) FILTER ({c}), 0)"
                cols.append(f"count(*) FILTER ({c}) AS {k}_edges, round(CASE WHEN {n} >= 2 AND ({n}) * ({q}) - ({sm}) * ({sm}) > 2.220446049250313e-16 THEN (({n}) * ({p}) - ({sm}) * ({sm})) / (({n}) * ({q}) - ({sm}) * ({sm})) END, 6) AS {k}_r")
            parts.append(f"""SELECT '{mode}' AS mode, '{metric}' AS metric, count(*) AS candidates, count(*) FILTER (used) AS analyzed, count(*) FILTER (st = 1) AS low_support, count(*) FILTER (st = 2) AS missing_metric, count(*) FILTER (st = 3) AS low_match_count, {', '.join(cols)}
 FROM (SELECT *, st = 0 AS used FROM (SELECT {s} AS s, a.{metric} AS x, b.{metric} AS y, coalesce(ca.comp = cb.comp, false) AS same, CASE WHEN {s} < 2 THEN 1 WHEN a.{metric} IS NULL OR b.{metric} IS NULL THEN 2 WHEN a.match_count < 20 OR b.match_count < 20 THEN 3 ELSE 0 END AS st
 FROM rel LEFT JOIN pl a ON a.id = src LEFT JOIN pl b ON b.id = dst LEFT JOIN member ca ON ca.node = src LEFT JOIN member cb ON cb.node = dst WHERE {s} > 0) i) j""")
    return f"WITH RECURSIVE {STRONG}, {PLAYERS} " + " UNION ALL ".join(parts)


@query("assortativity_global", _assort_sql())
def assortativity_global(spark, sf):
    p = kept_pairs(spark, sf)
    out = assort.assortativity(p, cut(tables.players(spark, sf)), strong_members(p), min_support=2, min_matches=20, strong=3)
    return out.withColumns({f"{s}_r": F.round(f"{s}_r", 6) for s in assort.STRATA})


@query("eligible_node_count", f"WITH {REL}, {SYM}, {PLAYERS} SELECT count(*) AS eligible FROM pl WHERE feedscore IS NOT NULL AND match_count >= 20 AND id IN (SELECT node FROM sym)")
def eligible_node_count(spark, sf):
    return assort.eligible_nodes(pairs_of(spark, sf), tables.players(spark, sf), "feedscore", 20)


@query("permutation_test")
def permutation_test(spark, sf):
    p = pairs_of(spark, sf).filter("total >= 2")
    return assort.permutation_test(p, tables.players(spark, sf).select("id", F.col("opscore").alias("value")), 50, 7)


# --- balance ------------------------------------------------------------------------------------------------------------

def _triads_sql(least: int = 2) -> str:
    return f"""{REL}, se AS (SELECT src, dst, CASE WHEN ally > enemy THEN 1 ELSE -1 END AS sign FROM rel WHERE total >= {least} AND ally <> enemy),
 tr AS (SELECT x.src AS a, x.dst AS b, y.dst AS c, CAST((3 - x.sign - y.sign - z.sign) / 2 AS INT) AS negatives FROM se x JOIN se y ON y.src = x.dst JOIN se z ON z.src = x.src AND z.dst = y.dst)"""


NAMES = "names(negatives, pattern, balanced) AS (VALUES (0, '+++', true), (1, '++-', false), (2, '+--', true), (3, '---', false))"


@query("signed_edges", f"WITH {REL} SELECT src, dst, CASE WHEN ally > enemy THEN 1 ELSE -1 END AS sign FROM rel WHERE total >= 2 AND ally <> enemy")
def signed_edges(spark, sf):
    return balance.signed_edges(pairs_of(spark, sf))


def _found(spark, sf):
    return balance.triads(cut(balance.signed_edges(pairs_of(spark, sf))))


@query("triad_distribution", f"WITH {_triads_sql()}, {NAMES} SELECT pattern, balanced, count(a) AS triads FROM names LEFT JOIN tr USING (negatives) GROUP BY pattern, balanced")
def triad_distribution(spark, sf):
    return balance.distribution(_found(spark, sf))


@query("triad_nodes_topk", f"""WITH {_triads_sql()}, n AS (SELECT a AS node, negatives FROM tr UNION ALL SELECT b, negatives FROM tr UNION ALL SELECT c, negatives FROM tr)
 SELECT node, count(*) AS total, count(*) FILTER (negatives % 2 = 1) AS unbalanced, count(*) FILTER (negatives % 2 = 1) / CAST(count(*) AS DOUBLE) AS instability, p_name AS label FROM n JOIN part ON p_partkey = node GROUP BY node, p_name ORDER BY unbalanced DESC, total DESC, instability DESC, label, node LIMIT 10""")
def triad_nodes_topk(spark, sf):
    labels = tables.table(spark, sf, "part").select(F.col("p_partkey").alias("node"), F.col("p_name").alias("label"))
    return balance.top_unbalanced(_found(spark, sf), labels)


@query("triad_cluster_summary", f"""WITH RECURSIVE {_triads_sql()}, e2 AS (SELECT src, dst FROM rel WHERE total >= 2), {reach('e2')}, k AS (SELECT comp, count(*) AS size FROM member GROUP BY comp),
 l AS (SELECT m1.comp, negatives FROM tr JOIN member m1 ON m1.node = a JOIN member m2 ON m2.node = b AND m2.comp = m1.comp JOIN member m3 ON m3.node = c AND m3.comp = m1.comp)
 SELECT l.comp, size, count(*) AS local_triads, count(*) FILTER (negatives % 2 = 0) AS balanced_count, count(*) FILTER (negatives % 2 = 1) AS unbalanced_count, count(*) FILTER (negatives % 2 = 0) / CAST(count(*) AS DOUBLE) AS balanced_ratio FROM l JOIN k ON k.comp = l.comp GROUP BY l.comp, size""")
def triad_cluster_summary(spark, sf):
    p = kept_pairs(spark, sf)
    members = components.connected_components(p.filter("total >= 2").select("src", "dst"))
    return balance.cluster_summary(balance.triads(cut(balance.signed_edges(p))), cut(members))


@query("triad_examples", f"WITH {_triads_sql()}, {NAMES} SELECT pattern, CAST(n AS INT) AS n, a, b, c FROM (SELECT *, row_number() OVER (PARTITION BY negatives ORDER BY a, b, c) AS n FROM tr) t JOIN names USING (negatives) WHERE n <= 2")
def triad_examples(spark, sf):
    return balance.examples(_found(spark, sf))


def _sweep_sql() -> str:
    parts = []
    for least in (2, 3, 4):
        for policy, tie in (("exclude", "NULL"), ("ally", "1"), ("enemy", "-1")):
            n = f"{least}{policy}"
            parts.append(f"""SELECT {least} AS min_support, '{policy}' AS tie_policy, (SELECT count(*) FROM e{n}) AS edges, count(*) AS triads, count(*) FILTER (s > 0) AS balanced, coalesce(count(*) FILTER (s > 0) / nullif(count(*), 0), 0.0) AS balanced_ratio
 FROM (SELECT x.sign * y.sign * z.sign AS s FROM e{n} x JOIN e{n} y ON y.src = x.dst JOIN e{n} z ON z.src = x.src AND z.dst = y.dst)""")
            parts[-1] = (f"e{n} AS (SELECT * FROM (SELECT src, dst, CASE WHEN ally > enemy THEN 1 WHEN ally < enemy THEN -1 ELSE {tie} END AS sign FROM rel WHERE total >= {least}) WHERE sign IS NOT NULL)", parts[-1])
    return f"WITH {REL}, {', '.join(v for v, _ in parts)} {' UNION ALL '.join(q for _, q in parts)}"


@query("balance_sweep", _sweep_sql())
def balance_sweep(spark, sf):
    return balance.sweep(kept_pairs(spark, sf), [2, 3, 4], ["exclude", "ally", "enemy"])


# --- paths and centrality -----------------------------------------------------------------------------------------------

SOURCE = "s0 AS (SELECT min(src) AS node FROM rel WHERE total >= 2)"


LEVELS_SQL = f"""WITH RECURSIVE {REL}, {SYM}, near(node, level) USING KEY (node) AS (SELECT min(src), 0 FROM rel
 UNION SELECT sym.other, min(near.level) + 1 FROM near JOIN sym ON sym.node = near.node LEFT JOIN recurring.near AS known ON known.node = sym.other WHERE known.node IS NULL GROUP BY sym.other) SELECT node, level FROM near"""


@query("bfs_levels", LEVELS_SQL)
def bfs_levels(spark, sf):
    p = kept_pairs(spark, sf)
    return paths.bfs_levels(projection.symmetric(p), p.agg(F.min("src").alias("node")), both_ways=True)


also("bfs_levels", "bfs_levels_all")


DISTANCE_SQL = f"""WITH RECURSIVE {REL}, {SYM}, priced AS (SELECT node, other, CAST((1000000 + total - 1) // total AS BIGINT) AS cost FROM sym),
 near(node, distance) USING KEY (node) AS (SELECT min(src), CAST(0 AS BIGINT) FROM rel
 UNION SELECT p.other, min(near.distance + p.cost) FROM near JOIN priced p ON p.node = near.node LEFT JOIN recurring.near AS best ON best.node = p.other WHERE best.distance IS NULL OR near.distance + p.cost < best.distance GROUP BY p.other)
 SELECT node, distance FROM near"""


@query("weighted_distance", DISTANCE_SQL)
def weighted_distance(spark, sf):
    p = kept_pairs(spark, sf)
    return paths.distances(paths.allowed(p, "battle-path"), p.agg(F.min("src").alias("node")))


@query("path_comparison")
def path_comparison(spark, sf):
    p = kept_pairs(spark, sf)
    ends = p.agg(F.min("src").alias("a"), F.max("dst").alias("b")).first()
    if ends.a is None:
        return spark.createDataFrame([], paths.RUN)
    m = strong_members(p)
    nodes = projection.symmetric(p).agg(F.countDistinct("node")).first()[0]
    marks = [r.node for r in components.landmarks(p, m, components.bridges(p, m), components.landmark_budget(nodes)).collect()]
    return paths.run(spark, p, ends.a, ends.b, landmarks=marks)


@query("player_focus", f"""WITH RECURSIVE {STRONG}, f AS (SELECT min(node) AS node FROM member), near AS (SELECT dst AS node FROM rel, f WHERE src = f.node UNION SELECT src FROM rel, f WHERE dst = f.node),
 kept AS (SELECT node FROM member WHERE comp = (SELECT comp FROM member m, f WHERE m.node = f.node) UNION SELECT node FROM near) SELECT src, dst, ally, enemy, total, relation FROM rel WHERE src IN (SELECT node FROM kept) AND dst IN (SELECT node FROM kept)""")
def player_focus(spark, sf):
    p = kept_pairs(spark, sf)
    m = strong_members(p)
    return paths.focus(p, m, m.agg(F.min("node")).first()[0])


@query("betweenness")
def betweenness(spark, sf):
    labels = tables.table(spark, sf, "part").select(F.col("p_partkey").alias("node"), F.col("p_name").alias("label"))
    return centrality.betweenness(kept_pairs(spark, sf), labels, "social-path", True, 1)


# --- serving ------------------------------------------------------------------------------------------------------------

@query("percentile_midrank", f"WITH {PLAYERS} SELECT id, opscore, floor(((rank() OVER (ORDER BY opscore) - 1) + 0.5 * count(*) OVER (PARTITION BY opscore)) / count(*) OVER () * 100 * 10.0 + 0.5) / 10.0 AS percentile FROM pl")
def percentile_midrank(spark, sf):
    return serving.midrank_percentile(tables.players(spark, sf).select("id", "opscore"), "opscore", "percentile").select("id", "opscore", "percentile")


@query("leaderboard_page", f"WITH {PLAYERS}, t AS (SELECT count(*) AS total FROM pl WHERE opscore > 0) SELECT CAST(20 + row_number() OVER (ORDER BY opscore DESC, id) AS INT) AS rank, id, label, role, opscore, total, total > 60 AS has_more FROM (SELECT * FROM pl WHERE opscore > 0 ORDER BY opscore DESC, id LIMIT 40 OFFSET 20) x, t")
def leaderboard_page(spark, sf):
    return serving.leaderboard(tables.players(spark, sf), None, 20, 40)


COUNTRY = "c AS (SELECT country, count(*) AS players, round(avg(feedscore), 6) AS mean_feed, round(avg(opscore), 6) AS mean_op, CAST(sum(match_count) AS BIGINT) AS matches FROM pl WHERE trim(country) <> '' AND opscore IS NOT NULL AND feedscore IS NOT NULL GROUP BY country)"


@query("country_stats", f"WITH {PLAYERS}, {COUNTRY} SELECT * FROM c")
def country_stats(spark, sf):
    return serving.country_stats(tables.players(spark, sf))


@query("column_stats", f"WITH {PLAYERS} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 4) AS mean, CAST(min({c}) AS DOUBLE) AS least, CAST(max({c}) AS DOUBLE) AS most FROM pl WHERE match_count > 0" for c in ("opscore", "feedscore", "match_count")))
def column_stats(spark, sf):
    return serving.column_stats(tables.players(spark, sf), ["opscore", "feedscore", "match_count"])


@query("cluster_profiles", f"""WITH RECURSIVE {STRONG}, {PLAYERS}, {ACROSS}, e AS (SELECT src AS node, ca AS comp FROM x UNION ALL SELECT dst, cb FROM x), bc AS (SELECT comp, node, row_number() OVER (PARTITION BY comp ORDER BY count(*) DESC, node) AS n FROM e GROUP BY comp, node)
 SELECT m.comp, count(*) AS size, round(sum(opscore * match_count) / nullif(sum(match_count), 0), 4) AS mean_op, round(sum(feedscore * match_count) / nullif(sum(match_count), 0), 4) AS mean_feed,
 round(sqrt(greatest(0.0, avg(opscore * opscore) - avg(opscore) * avg(opscore))), 4) AS op_spread, round(count(bc.node) / CAST(count(*) AS DOUBLE), 4) AS bridge_ratio, CAST(sum(match_count) AS BIGINT) AS matches,
 string_agg(CAST(m.node AS VARCHAR), ',' ORDER BY CAST(m.node AS VARCHAR)) AS members, round(count(*) / CAST((SELECT count(*) FROM member) AS DOUBLE), 4) AS size_share
 FROM member m LEFT JOIN pl ON pl.id = m.node LEFT JOIN bc ON bc.node = m.node AND bc.n = 1 GROUP BY m.comp""")
def cluster_profiles(spark, sf):
    p = kept_pairs(spark, sf)
    m = strong_members(p)
    return serving.cluster_profiles(m, tables.players(spark, sf), components.bridges(p, m))


@query("browse_page", "SELECT p_partkey, p_name, p_brand FROM part WHERE (lower(CAST(p_partkey AS VARCHAR)) LIKE '%1%' OR lower(p_name) LIKE '%1%' OR lower(p_brand) LIKE '%1%') AND lower(p_brand) LIKE '%2%' ORDER BY p_name DESC, p_partkey LIMIT 25 OFFSET 25")
def browse_page(spark, sf):
    return serving.browse(tables.table(spark, sf, "part").select("p_partkey", "p_name", "p_brand"), "1", {"p_brand": "2"}, "p_name", False, 2, 25, "p_partkey")


@query("kda_by_player", "SELECT l_partkey AS player_id, count(*) AS matches, round(avg((l_quantity + l_discount * 100) / greatest(l_linenumber, 1)), 4) AS mean_kda FROM lineitem GROUP BY l_partkey")
def kda_by_player(spark, sf):
    k = serving.kda(F.col("l_quantity"), F.col("l_linenumber"), F.col("l_discount") * 100)
    return tables.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("player_id")).agg(F.count("*").alias("matches"), F.round(F.avg(k), 4).alias("mean_kda"))
