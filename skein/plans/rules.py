"""Queries on the rules of collecting, of the simulation and of the writers: gates, names, tiers, schedules, numbers, expiry, imports and scale."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import scalars
from skein.operators import balance, components, projection, simulation_log
from skein.plans.graph import ACROSS, ORACLE_SQL, PLAYERS, STRONG, kept_pairs, query, strong_members
from skein.sources import matches, sinks, tables
from skein.streaming import ingest, stateful


@query("graph_scale", f"""WITH RECURSIVE {STRONG}, {ACROSS}, z AS (SELECT ca AS comp, cb AS other FROM x WHERE relation = 'ally' UNION SELECT cb, ca FROM x WHERE relation = 'ally'),
 o AS (SELECT m.comp, m.members, coalesce(n.others, 0) AS others FROM (SELECT comp, count(*) AS members FROM member GROUP BY comp) m LEFT JOIN (SELECT comp, count(DISTINCT other) AS others FROM z GROUP BY comp) n ON n.comp = m.comp),
 e AS (SELECT count(*) AS edges, count(*) FILTER (relation = 'ally') AS allies, CAST(sum(total) AS BIGINT) AS evidence FROM rel)
 SELECT (SELECT count(DISTINCT node) FROM (SELECT src AS node FROM rel UNION ALL SELECT dst FROM rel) u) AS nodes, edges, CAST(allies AS DOUBLE) / edges AS ally_ratio, CAST(edges - allies AS DOUBLE) / edges AS enemy_ratio, CAST(evidence AS DOUBLE) / edges AS mean_support,
 (SELECT count(*) FROM o) AS clusters, (SELECT max(members) FROM o) AS largest_cluster, (SELECT CAST(sum(members) AS DOUBLE) / count(*) FROM o) AS mean_cluster, (SELECT count(*) FROM o WHERE others > 0) AS tied_clusters, (SELECT count(*) FROM o WHERE others = 0) AS outer_clusters FROM e""")
def graph_scale(spark, sf):
    p = kept_pairs(spark, sf)
    return components.scale(p, strong_members(p))


@query("cluster_highlights", f"""WITH RECURSIVE {STRONG}, {PLAYERS}, own AS (SELECT comp, node, row_number() OVER (PARTITION BY comp ORDER BY opscore DESC NULLS LAST, node) AS o, row_number() OVER (PARTITION BY comp ORDER BY feedscore DESC NULLS LAST, node) AS f FROM member JOIN pl ON pl.id = node)
 SELECT m.comp, m.node, coalesce(own.o = 1, false) AS best_op, coalesce(own.f = 1, false) AS worst_feed FROM member m LEFT JOIN own ON own.node = m.node""")
def cluster_highlights(spark, sf):
    return components.highlights(strong_members(kept_pairs(spark, sf)), tables.players(spark, sf))


@query("sweep_summary", f"""WITH s AS ({ORACLE_SQL["balance_sweep"]}) SELECT count(*) AS runs, count(*) FILTER (triads > 0) AS runs_with_triads, count(*) FILTER (triads = 0) AS runs_without_triads,
 coalesce(min(balanced_ratio) FILTER (triads > 0), 0.0) AS min_ratio, coalesce(max(balanced_ratio) FILTER (triads > 0), 0.0) AS max_ratio, round(coalesce(avg(balanced_ratio) FILTER (triads > 0), 0.0), 9) AS mean_ratio FROM s""")
def sweep_summary(spark, sf):
    from skein.plans.graph import balance_sweep

    return balance.sweep_summary(balance_sweep(spark, sf)).withColumn("mean_ratio", F.round("mean_ratio", 9))


@query("eligible_players", "SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN 'Unknown' ELSE p_name END AS label FROM part WHERE p_size % 4 = 3")
def eligible_players(spark, sf):
    part = tables.table(spark, sf, "part")
    label = F.when(F.col("p_size") % 4 == 0, None).when(F.col("p_size") % 4 == 1, "  ").when(F.col("p_size") % 4 == 2, "Unknown").otherwise(F.col("p_name"))
    return projection.eligible(part.select(F.col("p_partkey").alias("id"), label.alias("label"))).select("id", "label")


@query("name_lists", "SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN concat('a', '|', p_name) ELSE p_name END AS names FROM part")
def name_lists(spark, sf):
    raw = F.when(F.col("p_size") % 2 == 0, F.to_json(F.array(F.lit("a"), F.col("p_name")))).otherwise(F.col("p_name"))
    return tables.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array_join(scalars.names_of(raw), "|").alias("names"))


@query("quality_gate", """WITH n AS (SELECT l_orderkey, count(*) AS n, bool_or(l_linenumber = 2 AND l_partkey % 17 = 0) AS holes FROM lineitem GROUP BY l_orderkey)
 SELECT o_orderkey AS match_id, CASE WHEN o_custkey % 9 = 0 OR o_custkey % 4 NOT IN (0, 1, 2) THEN 'queue' WHEN o_orderdate < DATE '1994-01-01' THEN 'too old' WHEN n < 3 THEN 'too few participants' WHEN holes THEN 'incomplete participant' END AS reject_reason
 FROM orders JOIN n ON n.l_orderkey = o_orderkey""")
def quality_gate(spark, sf):
    line, one = tables.table(spark, sf, "lineitem"), F.lit(1)
    holes = F.when((F.col("l_linenumber") == 2) & (F.col("l_partkey") % 17 == 0), None).otherwise(one)
    who = F.struct(F.col("l_partkey").cast("string").alias("puuid"), one.alias("teamId"), holes.alias("kills"), one.alias("deaths"), one.alias("assists"))
    own = line.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(who).alias("participants"))
    queue = F.when(F.col("o_custkey") % 9 == 0, None).otherwise(F.col("o_custkey") % 4)
    created = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86_400_000
    found = tables.table(spark, sf, "orders").join(own, "o_orderkey").select(F.col("o_orderkey").alias("match_id"), queue.alias("queue_id"), created.alias("created"), "participants")
    days_to_1994 = 8766
    return matches.quality_gate(found, (days_to_1994 + 365) * 86_400_000, [0, 1, 2], 365, 3).select("match_id", "reject_reason")


@query("polity_tiers", """SELECT p_partkey AS tribe, CASE WHEN p_size * 3 >= 100 THEN 'Empire' WHEN p_size * 3 >= 50 THEN 'Kingdom' WHEN p_size * 3 >= 25 THEN 'Duchy' WHEN p_size * 3 >= 3 THEN 'City' ELSE 'Tribe' END AS by_members,
 CASE WHEN p_size * 320 >= 15000 THEN 'Empire' WHEN p_size * 320 >= 7000 THEN 'Kingdom' WHEN p_size * 320 >= 3000 THEN 'Duchy' WHEN p_size * 320 >= 1000 THEN 'City' ELSE 'Tribe' END AS by_population,
 CASE WHEN greatest(p_size % 3, p_partkey % 3, p_size % 2) <= 0 THEN 'Generalist' WHEN p_size % 2 >= greatest(p_size % 3, p_partkey % 3) THEN 'Governance' WHEN p_partkey % 3 >= p_size % 3 THEN 'Economy' ELSE 'Military' END AS specialisation FROM part""")
def polity_tiers(spark, sf):
    p, size = tables.table(spark, sf, "part"), F.col("p_size").cast("long")
    own = p.select(F.col("p_partkey").alias("tribe"), size.alias("p_size"), (size % 3).alias("Military"), (F.col("p_partkey") % 3).alias("Economy"), (size % 2).alias("Governance"))
    return own.select(
        "tribe", simulation_log.polity_tier(F.col("p_size") * 3, simulation_log.TIER_MEMBERS).alias("by_members"), simulation_log.polity_tier(F.col("p_size") * 320, simulation_log.TIER_POPULATION).alias("by_population"),
        simulation_log.specialisation(["Military", "Economy", "Governance"]).alias("specialisation"),
    )


@query("output_labels", "SELECT p_partkey AS tribe, CASE WHEN p_size % 5 >= greatest(p_size % 7, p_partkey % 7) THEN 'third' WHEN p_partkey % 7 >= p_size % 7 THEN 'second' ELSE 'first' END AS dominant FROM part")
def output_labels(spark, sf):
    size = F.col("p_size").cast("long")
    own = tables.table(spark, sf, "part").select(F.col("p_partkey").alias("tribe"), (size % 7).alias("first"), (F.col("p_partkey") % 7).alias("second"), (size % 5).alias("third"))
    return own.select("tribe", simulation_log.last_argmax(["first", "second", "third"]).alias("dominant"))


@query("event_numbers", "SELECT l_orderkey AS tick, l_linenumber AS place, row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS event_id FROM lineitem")
def event_numbers(spark, sf):
    rows = tables.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("tick"), F.col("l_linenumber").alias("place"))
    return simulation_log.numbered(rows, ["tick", "place"])


#: After how many ticks each action of the simulation falls due.
SCHEDULE = {"merge": 20, "border": 30, "tension": 10, "trade": 50, "census": 60, "generation": 1000}


@query("due_actions", " UNION ALL ".join(f"SELECT o_orderkey AS tick, '{name}' AS action FROM orders WHERE o_orderkey > 0 AND o_orderkey % {every} = 0" for name, every in SCHEDULE.items()))
def due_actions(spark, sf):
    return ingest.due(tables.table(spark, sf, "orders").select(F.col("o_orderkey").alias("tick")), SCHEDULE)


@query("log_after", "SELECT event_id, event_type FROM events WHERE event_id > (SELECT CAST(floor(max(event_id) / 2) AS BIGINT) FROM events)")
def log_after(spark, sf):
    e = tables.table(spark, sf, "events").select("event_id", "event_type")
    return simulation_log.after(e, int(e.agg(F.max("event_id")).first()[0] or 0) // 2)


@query("unexpired_entries", "SELECT o_orderkey AS entry, o_custkey AS since FROM orders WHERE o_custkey + 80 > 150")
def unexpired_entries(spark, sf):
    return stateful.unexpired(tables.table(spark, sf, "orders").select(F.col("o_orderkey").alias("entry"), F.col("o_custkey").alias("since")), 150)


@query("running_pairs", "SELECT user_id AS src, event_id % 7 AS dst, count(*) AS total FROM events GROUP BY 1, 2")
def running_pairs(spark, sf):
    return stateful.running_pairs(tables.table(spark, sf, "events").select(F.col("user_id").alias("src"), (F.col("event_id") % 7).alias("dst")))


@query("evolved_rows", "SELECT c_custkey AS id, c_name AS name, CAST(0 AS BIGINT) AS matches FROM customer UNION ALL SELECT s_suppkey, NULL, CAST(3 AS BIGINT) FROM supplier")
def evolved_rows(spark, sf):
    old = tables.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    new = tables.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.lit(3).cast("long").alias("matches"))
    return sinks.evolve(old, new, {"matches": 0})


@query("imported_rows", """WITH n AS (SELECT o_custkey AS id, o_orderkey AS seen, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
 SELECT c_custkey AS id, CAST(-1 AS BIGINT) AS seen, c_name AS name FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT id, seen, NULL FROM n WHERE n = 1 AND id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)""")
def imported_rows(spark, sf):
    stored = tables.table(spark, sf, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.lit(-1).cast("long").alias("seen"), F.col("c_name").alias("name"))
    rows = tables.table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seen"), F.lit("x").alias("further"))
    return sinks.insert_or_ignore(stored, rows, ["id"], ["seen"])


@query("replays_with_runs", """WITH t AS (SELECT o_orderkey AS replay_id, o_custkey AS saved_at FROM orders ORDER BY o_custkey DESC, o_orderkey DESC LIMIT 24)
 SELECT t.replay_id, t.saved_at, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) AS runs FROM t LEFT JOIN lineitem ON l_orderkey = t.replay_id GROUP BY 1, 2""")
def replays_with_runs(spark, sf):
    heads = tables.table(spark, sf, "orders").select(F.col("o_orderkey").alias("replay_id"), F.col("o_custkey").alias("saved_at"))
    runs = tables.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("replay_id"), F.col("l_linenumber").alias("run_index"), F.lit("bfs").alias("algorithm"), F.col("l_linenumber").alias("path_length"))
    return sinks.latest_replays(heads, runs).select("replay_id", "saved_at", F.array_join(F.transform("runs", lambda x: x["run_index"].cast("string")), ",").alias("runs"))


@query("last_seen", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def last_seen(spark, sf):
    return matches.last_seen(tables.table(spark, sf, "events").select("user_id", "event_id"), "user_id", "event_id")


@query("findings", """SELECT p_partkey AS id, CASE WHEN p_size / 50.0 > 0.65 THEN 'balanced' WHEN p_size / 50.0 < 0.4 THEN 'unbalanced' ELSE 'mixed' END AS balance,
 CASE WHEN p_size / 25.0 - 1 > 0.2 THEN 'assortative' WHEN p_size / 25.0 - 1 < -0.2 THEN 'disassortative' ELSE 'neutral' END AS assortativity FROM part""")
def findings(spark, sf):
    size = F.col("p_size")
    return tables.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), scalars.balance_finding(size / 50.0).alias("balance"), scalars.assortativity_finding(size / 25.0 - 1).alias("assortativity"))
