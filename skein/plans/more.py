"""Queries for scoring, layout, streaming semantics, ingestion and the simulation log, over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import scalars
from skein.operators import components, layout, scoring, simulation_log
from skein.plans.graph import STRONG, also, kept_pairs, query, strong_members
from skein.sources import matches, sinks, tables
from skein.streaming import stateful

ROLE_LIST = "['top', 'JUNGLE', ' Mid ', 'adc', 'support', 'x']"
LINE_STATS = f"""st AS (SELECT l_orderkey AS match_id, l_partkey AS player_id, l_linenumber, l_linenumber % 2 AS team, 1200 + l_orderkey % 1800 AS duration, {ROLE_LIST}[CAST(l_partkey % 6 AS INT) + 1] AS pos,
 CAST(l_quantity AS DOUBLE) AS kills, CAST(l_linenumber AS DOUBLE) AS deaths, round(l_discount * 100) AS assists, l_extendedprice AS gold, l_extendedprice * 0.9 AS spent, l_tax * 100 AS vision, l_extendedprice / 10 AS dmg,
 CAST(l_linenumber + 2 AS DOUBLE) AS wards, l_extendedprice / 5 AS heal, l_extendedprice / 4 AS mitigated, l_quantity / 2 AS cc, l_extendedprice / 8 AS taken, CAST(l_linenumber % 3 AS DOUBLE) AS turrets, l_extendedprice / 20 AS turret_damage,
 CASE WHEN l_linenumber = 1 THEN 0.5 ELSE 0.0 END AS first_blood, l_quantity + 10 AS minions FROM lineitem)"""
ROLE_SQL = "CASE upper(trim(pos)) WHEN 'TOP' THEN 'TOP' WHEN 'JUNGLE' THEN 'JUNGLE' WHEN 'MID' THEN 'MIDDLE' WHEN 'ADC' THEN 'BOTTOM' WHEN 'SUPPORT' THEN 'UTILITY' ELSE 'UNKNOWN' END"


def line_stats(spark, sf):
    """Participant statistics made of order lines."""
    roles = F.array(*[F.lit(x) for x in ("top", "JUNGLE", " Mid ", "adc", "support", "x")])
    li = tables.table(spark, sf, "lineitem")
    own = li.select(
        F.col("l_orderkey").alias("match_id"), F.col("l_partkey").alias("player_id"), "l_linenumber", (F.col("l_linenumber") % 2).alias("teamId"), (1200 + F.col("l_orderkey") % 1800).alias("duration"),
        F.element_at(roles, (F.col("l_partkey") % 6).cast("int") + 1).alias("teamPosition"), F.col("l_quantity").cast("double").alias("kills"), F.col("l_linenumber").cast("double").alias("deaths"), F.round(F.col("l_discount") * 100).alias("assists"),
        F.col("l_extendedprice").alias("goldEarned"), (F.col("l_extendedprice") * 0.9).alias("goldSpent"), (F.col("l_tax") * 100).alias("visionScore"), (F.col("l_extendedprice") / 10).alias("physicalDamage"),
        (F.col("l_linenumber") + 2).cast("double").alias("wardsPlaced"), (F.col("l_extendedprice") / 5).alias("totalHeal"), (F.col("l_extendedprice") / 4).alias("damageSelfMitigated"), (F.col("l_quantity") / 2).alias("timeCCingOthers"),
        (F.col("l_extendedprice") / 8).alias("totalDamageTaken"), (F.col("l_linenumber") % 3).cast("double").alias("turretTakedowns"), (F.col("l_extendedprice") / 20).alias("damageDealtToTurrets"), (F.col("l_linenumber") == 1).alias("firstBloodKill"),
        (F.col("l_quantity") + 10).alias("laneMinionsFirst10Minutes"),
    )
    return scoring.with_fields(own)


def _case(table: dict) -> str:
    return "CASE role " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items() if k != "UNKNOWN") + f" ELSE {table['UNKNOWN']} END"


def _mult(name: str) -> str:
    return _case({r: m[scoring.ARTIFACTS_V1.index(name)] for r, m in scoring.MULTIPLIERS.items()})


@query("score_v1", f"""WITH {LINE_STATS}, r AS (SELECT *, {ROLE_SQL} AS role, greatest(1.0, duration / 60.0) AS d FROM st)
 SELECT match_id, player_id, l_linenumber, role, round((kills + assists * 0.965 - deaths * 0.25) * {_mult('kda')} + (gold / d / 10 + least(1.0, greatest(0.5, spent / greatest(1.0, gold))) * 0.5) * {_mult('economy')} + (vision * 0.15 + wards * 0.05) * {_mult('map_awareness')} + dmg / 1000 * 0.2 * {_mult('damage')}
 + (heal * 0.001 + mitigated * 0.002 + cc * 0.01) * {_mult('utility')} + taken / d * 0.05 * {_mult('tanking')} + (turrets * 0.25 + turret_damage * 0.001) * {_mult('objectives')} + (first_blood + minions / 50) * {_mult('early_game')}, 4) AS opscore,
 round(deaths * {_case(scoring.DEATH_TOLERANCE)} - (kills + assists) * 0.35, 4) AS feedscore FROM r""")
def score_v1(spark, sf):
    return scoring.score_v1(line_stats(spark, sf)).select("match_id", "player_id", "l_linenumber", "role", F.round("opscore", 4).alias("opscore"), F.round("feedscore", 4).alias("feedscore"))


@query("score_v2")
def score_v2(spark, sf):
    return scoring.score_v2(line_stats(spark, sf)).select("match_id", "player_id", "l_linenumber", "role", "combat_impact", "risk_discipline", "resource_tempo", "map_objective_control", "team_enablement", "opscore", "feed_risk")


@query("score_curve", "WITH x AS (SELECT DISTINCT l_quantity / 20 AS r FROM lineitem) SELECT r, round(least(2.2, r * r / (r * r + 0.3 / 0.7) + 0.5 * ln(greatest(1.0, r))), 6) AS plus, round(least(2.2, 1 / (r * r) / (1 / (r * r) + 0.3 / 0.7) + 0.5 * ln(greatest(1.0, 1 / r))), 6) AS minus FROM x")
def score_curve(spark, sf):
    x = tables.table(spark, sf, "lineitem").select((F.col("l_quantity") / 20).alias("r")).distinct()
    return x.select("r", F.round(scoring.curve(F.col("r")), 6).alias("plus"), F.round(scoring.falling_curve(F.col("r")), 6).alias("minus"))


@query("score_normalised", """WITH a AS (SELECT quantile_cont(p_retailprice, 0.05) AS lo, quantile_cont(p_retailprice, 0.5) AS mid, quantile_cont(p_retailprice, 0.95) AS hi FROM part)
 SELECT p_partkey AS id, round(least(10.0, greatest(0.0, CASE WHEN p_retailprice <= lo THEN 0 WHEN p_retailprice <= mid THEN (p_retailprice - lo) / (mid - lo) * 6.6 WHEN p_retailprice <= hi THEN 6.6 + (p_retailprice - mid) / (hi - mid) * 3.4 ELSE 10 END)), 4) AS score FROM part, a""")
def score_normalised(spark, sf):
    return scoring.normalised(tables.table(spark, sf, "part"), "p_retailprice", "score").select(F.col("p_partkey").alias("id"), F.round("score", 4).alias("score"))


@query("bootstrap_players", f"""WITH {LINE_STATS}, f AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY match_id * 10 + l_linenumber) AS n FROM st WHERE player_id NOT IN (SELECT p_partkey FROM part WHERE p_size < 25))
 SELECT player_id, match_id * 10 + l_linenumber AS seen, floor((deaths - (kills + assists) * 0.35) * 10000 + 0.5) / 10000 AS feedscore, floor((kills + assists * 0.965 + gold / 560 + vision * 0.15) * 10000 + 0.5) / 10000 AS opscore FROM f WHERE n = 1""")
def bootstrap_players(spark, sf):
    known = tables.table(spark, sf, "part").filter("p_size < 25").select(F.col("p_partkey").alias("player_id"))
    s = line_stats(spark, sf).withColumn("seen", F.col("match_id") * 10 + F.col("l_linenumber"))
    return scoring.new_players(s, known).withColumns({c: F.floor(F.col(c) * 10000 + 0.5) / 10000 for c in ("feedscore", "opscore")})


@query("top_feeders", f"""WITH {LINE_STATS}, s AS (SELECT match_id, player_id, round(deaths - (kills + assists) * 0.35, 4) AS feedscore FROM st), k AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY feedscore DESC, player_id) AS n FROM s) SELECT match_id, player_id, feedscore FROM k WHERE n = 1""")
def top_feeders(spark, sf):
    s = line_stats(spark, sf).select("match_id", "player_id", F.round(scoring.zero("deaths") - (scoring.zero("kills") + scoring.zero("assists")) * 0.35, 4).alias("feedscore"))
    return scoring.top_feeder(s)


@query("team_context", f"WITH {LINE_STATS} SELECT match_id, player_id, l_linenumber, sum(kills) OVER (PARTITION BY match_id, team) AS team_kills, count(*) OVER (PARTITION BY match_id, team) AS team_size FROM st")
def team_context(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("match_id", "teamId")
    return line_stats(spark, sf).select("match_id", "player_id", "l_linenumber", F.sum("kills").over(w).alias("team_kills"), F.count("*").over(w).alias("team_size"))


@query("player_profiles", f"""WITH {LINE_STATS}, r AS (SELECT player_id, {ROLE_SQL.replace('pos', "(['top', 'JUNGLE', 'x'])[CAST(match_id % 3 AS INT) + 1]")} AS role, kills, deaths FROM st), b AS (SELECT player_id, count(*) AS matches, CAST(sum(kills) AS BIGINT) AS kills FROM r GROUP BY player_id),
 k AS (SELECT player_id, role, count(*) AS n, row_number() OVER (PARTITION BY player_id ORDER BY count(*) DESC, role) AS o FROM r GROUP BY player_id, role) SELECT player_id, matches, kills, role, round(n / CAST(matches AS DOUBLE), 6) AS role_confidence FROM b JOIN k USING (player_id) WHERE o = 1""")
def player_profiles(spark, sf):
    roles = F.array(*[F.lit(x) for x in ("top", "JUNGLE", "x")])
    s = line_stats(spark, sf).withColumns({"role": scalars.role_of(F.element_at(roles, (F.col("match_id") % 3).cast("int") + 1)), "name": F.lit("n"), "opscore": F.col("kills"), "feedscore": F.col("deaths")})
    kills = s.groupBy("player_id").agg(F.sum("kills").cast("long").alias("kills"))
    return scoring.profiles(s).join(kills, "player_id").select("player_id", "matches", "kills", "role", F.round("role_confidence", 6).alias("role_confidence"))


# --- scalar functions ---------------------------------------------------------------------------------------------------

@query("scalar_rules", """SELECT p_partkey AS id, CAST((p_size * 2 + CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS packed, CASE WHEN p_retailprice / 1000 > 0.95 THEN 'high' ELSE 'low' END AS level,
 regexp_replace(p_name, '[^A-Za-z0-9_-]', '_', 'g') AS slug, least(64, greatest(8, CAST(pow(2, ceil(log2(p_size))) AS BIGINT))) AS budget, least(length(p_name), 4) AS clipped FROM part""")
def scalar_rules(spark, sf):
    p = tables.table(spark, sf, "part")
    return p.select(
        F.col("p_partkey").alias("id"), scalars.pack_edge(F.col("p_size"), F.col("p_size") % 3 == 0).alias("packed"), F.when(F.col("p_retailprice") / 1000 > 0.95, "high").otherwise("low").alias("level"),
        scalars.slug(F.col("p_name")).alias("slug"), scalars.next_power_of_two(F.col("p_size")).alias("budget"), F.least(F.length("p_name").cast("long"), F.lit(4).cast("long")).alias("clipped"),
    )


@query("json_previews", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN length(props) > 8 THEN concat(substring(props, 1, 8), '…') ELSE props END AS preview FROM events")
def json_previews(spark, sf):
    from skein.operators.serving import preview

    e = tables.table(spark, sf, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"), preview("props", 8).alias("preview"))


# --- layout -------------------------------------------------------------------------------------------------------------

@query("sphere_layout")
def sphere_layout(spark, sf):
    m = strong_members(kept_pairs(spark, sf))
    size = components.sizes(m)
    count = size.count()
    anchors = layout.sphere_points(size.withColumn("k", F.col("rank") - 1), "k", count)
    return layout.sphere_members(components.member_offsets(m).join(anchors, "comp")).select("node", "comp", "offset", "px", "py", "pz")


@query("grid_layout", f"""WITH RECURSIVE {STRONG}, s AS (SELECT comp, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, comp) - 1 AS k FROM member GROUP BY comp), c AS (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS cols FROM s)
 SELECT comp, CAST(k % cols * 520.0 - (cols - 1) * 260.0 AS DOUBLE) AS ax, CAST(k // cols * 520.0 - ((n + cols - 1) // cols - 1) * 260.0 AS DOUBLE) AS ay FROM s, c""")
def grid_layout(spark, sf):
    size = components.sizes(strong_members(kept_pairs(spark, sf)))
    x, y = layout.grid_anchor(F.col("rank") - 1, size.count())
    return size.select("comp", x.cast("double").alias("ax"), y.cast("double").alias("ay"))


@query("orbit_layout")
def orbit_layout(spark, sf):
    p = kept_pairs(spark, sf)
    o = components.orbits(p, strong_members(p))
    return layout.orbit_radius(o, o.count())


# --- streaming semantics, as batch --------------------------------------------------------------------------------------

@query("window_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def window_tumbling(spark, sf):
    return stateful.tumbling(tables.table(spark, sf, "events"))


@query("window_sliding", "SELECT w AS window_start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY w")
def window_sliding(spark, sf):
    return stateful.sliding(tables.table(spark, sf, "events"))


@query("window_session", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
 SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def window_session(spark, sf):
    return stateful.sessions(tables.table(spark, sf, "events"))


@query("stream_dedup", "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type")
def stream_dedup(spark, sf):
    e = tables.table(spark, sf, "events")
    return stateful.deduplicated(e.unionAll(e)).groupBy("event_type").agg(F.count("*").alias("n"))


@query("running_means", "SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY user_id")
def running_means(spark, sf):
    return stateful.running_means(tables.table(spark, sf, "events"))


@query("dispute_runs", "WITH t AS (SELECT DISTINCT user_id % 5 AS a, 5 + user_id % 3 AS b, CAST(floor(floor(epoch(ts)) / 600) AS BIGINT) AS tick FROM events), r AS (SELECT *, tick - row_number() OVER (PARTITION BY a, b ORDER BY tick) AS run FROM t) SELECT a, b, min(tick) AS first_tick, max(tick) AS last_tick, max(tick) - min(tick) >= 3 AS ready FROM r GROUP BY a, b, run")
def dispute_runs(spark, sf):
    t = tables.table(spark, sf, "events").select((F.col("user_id") % 5).alias("a"), (5 + F.col("user_id") % 3).alias("b"), F.floor(F.unix_timestamp("ts") / 600).cast("long").alias("tick"), F.lit(True).alias("adjacent"))
    return stateful.disputes(t, 3)


# --- ingestion ----------------------------------------------------------------------------------------------------------

@query("idempotent_append", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0)")
def idempotent_append(spark, sf):
    o = tables.table(spark, sf, "orders").select("o_orderkey")
    return sinks.append_new(o.unionAll(o), o.filter("o_orderkey % 3 = 0"), "o_orderkey")


@query("upsert_by_key", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'new' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def upsert_by_key(spark, sf):
    o = tables.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return sinks.upsert(o, o.filter("o_orderkey % 4 = 0").withColumn("o_orderstatus", F.lit("new")), ["o_orderkey"])


@query("premade_signal", "WITH p AS (SELECT l_orderkey AS m, l_partkey AS id, min(l_linenumber) % 2 AS t FROM lineitem GROUP BY 1, 2), own AS (SELECT m, t FROM p WHERE id = 1) SELECT id AS player_id, count(*) AS together FROM p JOIN own USING (m, t) WHERE id <> 1 GROUP BY id HAVING count(*) >= 2 ORDER BY together DESC, id LIMIT 5")
def premade_signal(spark, sf):
    return matches.premade_signal(tables.participants(spark, sf), 1)


@query("rank_gate", "WITH e AS (SELECT o_orderkey AS id, (['IRON', 'GOLD', 'DIAMOND', 'NONE'])[CAST(o_orderkey % 4 AS INT) + 1] AS tier, o_custkey % 100 AS lp FROM orders) SELECT id FROM e WHERE tier IN ('GOLD', 'DIAMOND') AND lp >= 30")
def rank_gate(spark, sf):
    tier = F.element_at(F.array(*[F.lit(x) for x in ("IRON", "GOLD", "DIAMOND", "NONE")]), (F.col("o_orderkey") % 4).cast("int") + 1)
    e = tables.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), tier.alias("tier"), (F.col("o_custkey") % 100).alias("lp"))
    return matches.rank_gate(e, least="SILVER", least_lp=30).select("id")


# --- simulation log -----------------------------------------------------------------------------------------------------

@query("log_counts", "SELECT event_type, count(*) AS n, min(event_id) AS first_tick, max(event_id) AS last_tick FROM events GROUP BY event_type")
def log_counts(spark, sf):
    return simulation_log.counts_by_type(tables.table(spark, sf, "events").withColumn("tick", F.col("event_id")))


@query("log_recent", "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 20")
def log_recent(spark, sf):
    return simulation_log.recent(tables.table(spark, sf, "events").select("event_id", "event_type"), 20)


@query("war_stats", """WITH w AS (SELECT o_orderkey AS war_id, o_custkey % 50 AS attacker, 50 + o_orderkey % 50 AS defender, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 50 ELSE 50 + o_orderkey % 50 END AS winner, o_orderkey % 7 AS al, o_orderkey % 5 AS dl FROM orders),
 s AS (SELECT winner, attacker AS tribe, al AS losses FROM w UNION ALL SELECT winner, defender, dl FROM w) SELECT tribe, count(*) FILTER (winner = tribe) AS won, count(*) FILTER (winner <> tribe) AS lost, CAST(sum(losses) AS BIGINT) AS casualties FROM s GROUP BY tribe""")
def war_stats(spark, sf):
    o = tables.table(spark, sf, "orders")
    w = o.select(F.col("o_orderkey").alias("war_id"), (F.col("o_custkey") % 50).alias("attacker"), (50 + F.col("o_orderkey") % 50).alias("defender"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey") % 50).otherwise(50 + F.col("o_orderkey") % 50).alias("winner"), (F.col("o_orderkey") % 7).alias("attacker_losses"), (F.col("o_orderkey") % 5).alias("defender_losses"))
    return simulation_log.war_stats(w)


@query("fitness", "SELECT p_partkey AS tribe, round(0.3 * least(1.0, p_size / 40.0) + 0.25 * least(1.0, p_retailprice / 950) + 0.2 * least(1.0, p_partkey % 11 / 8.0) + 0.15 * least(1.0, p_size % 5 / 4.0) + 0.1 * least(1.0, p_size % 3 / 1.5), 6) AS fitness FROM part")
def fitness(spark, sf):
    p = tables.table(spark, sf, "part")
    f = simulation_log.fitness(F.col("p_size") / 40.0, F.col("p_retailprice") / 950, F.col("p_partkey") % 11 / 8.0, F.col("p_size") % 5 / 4.0, F.col("p_size") % 3 / 1.5)
    return p.select(F.col("p_partkey").alias("tribe"), F.round(f, 6).alias("fitness"))


@query("mutation_rates", "SELECT p_partkey AS tribe, round(greatest(0.3 * 0.2, 0.2 * (2 - 1.7 * coalesce((p_retailprice - min(p_retailprice) OVER ()) / nullif(max(p_retailprice) OVER () - min(p_retailprice) OVER (), 0), 0))), 6) AS mutation_rate FROM part")
def mutation_rates(spark, sf):
    p = tables.table(spark, sf, "part").select(F.col("p_partkey").alias("tribe"), F.col("p_retailprice").alias("f"))
    return simulation_log.mutation_rate(p, "f", 0.2).select("tribe", F.round("mutation_rate", 6).alias("mutation_rate"))


HEX = "t AS (SELECT p_partkey AS tile, p_partkey % 20 AS c, p_partkey // 20 AS r, p_size % 6 AS owner FROM part)"
NEAR = """moves AS (SELECT tile, owner, unnest([c - 1, c + 1, c + r % 2 - 1, c + r % 2, c + r % 2 - 1, c + r % 2]) AS c, unnest([r, r, r - 1, r - 1, r + 1, r + 1]) AS r FROM t),
 near AS (SELECT moves.tile, t.tile AS other, moves.owner AS ao, t.owner AS bo FROM moves JOIN t USING (c, r))"""


def _grid(spark, sf):
    """Every part as a tile, and the neighbours on a grid as high as the largest id needs."""
    t = tables.table(spark, sf, "part").select(F.col("p_partkey").alias("tile"), (F.col("p_partkey") % 20).alias("col"), F.floor(F.col("p_partkey") / 20).alias("row"), (F.col("p_size") % 6).alias("owner"))
    return t, simulation_log.hex_neighbours(t, 20, (t.agg(F.max("row")).first()[0] or 0) + 1)


@query("hex_neighbours", f"WITH {HEX}, {NEAR} SELECT tile, other FROM near")
def hex_neighbours(spark, sf):
    return _grid(spark, sf)[1]


@query("border_pairs", f"WITH {HEX}, {NEAR} SELECT DISTINCT ao AS a, bo AS b FROM near WHERE ao < bo")
def border_pairs(spark, sf):
    return simulation_log.adjacent_tribes(*_grid(spark, sf))


also("hex_neighbours", "hex_neighbours_all")
also("border_pairs", "border_pairs_all")


@query("tile_ownership", "WITH t AS (SELECT l_suppkey AS tile, l_partkey % 9 AS tribe, l_orderkey * 10 + l_linenumber AS place FROM lineitem), n AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY place, tribe) AS n, count(*) OVER (PARTITION BY tile) AS held FROM t) SELECT tile, tribe AS owner, held > 1 AS contested FROM n WHERE n = 1")
def tile_ownership(spark, sf):
    t = tables.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("tile"), (F.col("l_partkey") % 9).alias("tribe"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"))
    return simulation_log.ownership(t)


@query("biome_composition", "SELECT p_size % 6 AS tribe, p_type AS biome, count(*) AS tiles FROM part GROUP BY 1, 2")
def biome_composition(spark, sf):
    return simulation_log.composition(tables.table(spark, sf, "part").select((F.col("p_size") % 6).alias("tribe"), F.col("p_type").alias("biome")))


@query("lineage_seeds", "WITH RECURSIVE p AS (SELECT p_partkey AS e, CASE WHEN p_partkey % 13 = 0 OR p_partkey < 3 THEN NULL ELSE p_partkey - p_size % 2 - 1 END AS up FROM part), w(entity, cur, depth) AS (SELECT e, e, 0 FROM p UNION ALL SELECT w.entity, p.up, w.depth + 1 FROM w JOIN p ON p.e = w.cur WHERE p.up IS NOT NULL) SELECT entity, cur AS seed, CAST(depth AS BIGINT) AS depth FROM w JOIN p ON p.e = w.cur WHERE p.up IS NULL")
def lineage_seeds(spark, sf):
    p = tables.table(spark, sf, "part")
    up = F.when((F.col("p_partkey") % 13 == 0) | (F.col("p_partkey") < 3), F.lit(simulation_log.ABSENT)).otherwise(F.col("p_partkey") - F.col("p_size") % 2 - 1)
    return simulation_log.lineage(p.select(F.col("p_partkey").alias("entity_id"), up.alias("parent_a")))
