"""Performance scores of match participants, from column expressions and small role tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions.scalars import minutes, role_of

ROLES = ("TOP", "JUNGLE", "MIDDLE", "BOTTOM", "UTILITY", "UNKNOWN")

# Fixed values of the first scoring generation.
ARTIFACTS_V1 = ("kda", "economy", "map_awareness", "utility", "damage", "tanking", "objectives", "early_game")
MULTIPLIERS = {
    "TOP": (1.1, 1.05, 0.9, 0.6, 1.15, 1.0, 1.2, 1.05),
    "JUNGLE": (1.2, 0.7, 1.4, 0.8, 1.0, 0.8, 1.4, 1.3),
    "MIDDLE": (1.0, 1.1, 1.2, 1.0, 1.05, 0.8, 1.0, 1.1),
    "BOTTOM": (1.2, 1.3, 1.1, 0.7, 1.4, 0.6, 0.9, 1.0),
    "UTILITY": (0.7, 0.4, 1.8, 1.8, 0.5, 1.1, 0.7, 0.8),
    "UNKNOWN": (1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0),
}
DEATH_TOLERANCE = {"TOP": 1.0, "JUNGLE": 1.05, "MIDDLE": 1.0, "BOTTOM": 1.15, "UTILITY": 0.8, "UNKNOWN": 1.0}

# Fixed values of the second.
TARGET, SHARPNESS, LAMBDA, CAP = 0.7, 2.0, 0.5, 2.2
SHORT, FULL, NEUTRAL, CEILING = 12.0, 20.0, 0.7, 4.5
OVERFLOW = {"combat": 0.25, "risk": 0.25, "resource": 0.25, "map": 0.35, "team": 0.2}
#: The weights of both subcategories of each artifact, by role.
ARTIFACT_WEIGHTS = {
    "TOP": {"combat": (0.55, 0.45), "risk": (0.65, 0.35), "resource": (0.55, 0.45), "map": (0.35, 0.65), "team": (0.9, 0.1)},
    "JUNGLE": {"combat": (0.55, 0.45), "risk": (0.65, 0.35), "resource": (0.45, 0.55), "map": (0.3, 0.7), "team": (0.9, 0.1)},
    "MIDDLE": {"combat": (0.55, 0.45), "risk": (0.65, 0.35), "resource": (0.6, 0.4), "map": (0.45, 0.55), "team": (0.85, 0.15)},
    "BOTTOM": {"combat": (0.45, 0.55), "risk": (0.75, 0.25), "resource": (0.7, 0.3), "map": (0.35, 0.65), "team": (0.8, 0.2)},
    "UTILITY": {"combat": (0.7, 0.3), "risk": (0.65, 0.35), "resource": (0.35, 0.65), "map": (0.7, 0.3), "team": (0.55, 0.45)},
    "UNKNOWN": {"combat": (0.5, 0.5), "risk": (0.65, 0.35), "resource": (0.5, 0.5), "map": (0.5, 0.5), "team": (0.75, 0.25)},
}
#: What a player of each role is expected to reach.
EXPECTED = {
    "TOP": {
        "assistWeight": 0.7, "killParticipation": 0.42, "soloKills": 1.2, "pickKills": 7.0, "damagePerMinute": 650.0, "damageShare": 0.22,
        "deathRate": 0.16, "deadTimeShare": 0.105, "livingRatio": 0.32, "clutchSurvival": 2.0, "goldPerMinute": 400.0, "csPerMinute": 7.0,
        "laneCs10": 65.0, "visionPerMinute": 0.65, "wardActivityPerMinute": 0.35, "objectiveDamagePerMinute": 260.0, "epicParticipation": 0.7, "structureConversion": 1.3,
        "ccPerMinute": 1.1, "ccConversion": 3.0, "protectionPerMinute": 45.0, "saves": 0.2,
    },
    "JUNGLE": {
        "assistWeight": 0.85, "killParticipation": 0.55, "soloKills": 1.0, "pickKills": 10.0, "damagePerMinute": 550.0, "damageShare": 0.18,
        "deathRate": 0.15, "deadTimeShare": 0.095, "livingRatio": 0.3, "clutchSurvival": 2.0, "goldPerMinute": 380.0, "csPerMinute": 5.6,
        "laneCs10": 60.0, "visionPerMinute": 0.85, "wardActivityPerMinute": 0.3, "objectiveDamagePerMinute": 520.0, "epicParticipation": 2.3, "structureConversion": 0.8,
        "ccPerMinute": 1.3, "ccConversion": 4.0, "protectionPerMinute": 30.0, "saves": 0.15,
    },
    "MIDDLE": {
        "assistWeight": 0.75, "killParticipation": 0.5, "soloKills": 1.2, "pickKills": 9.0, "damagePerMinute": 700.0, "damageShare": 0.23,
        "deathRate": 0.14, "deadTimeShare": 0.09, "livingRatio": 0.32, "clutchSurvival": 2.0, "goldPerMinute": 420.0, "csPerMinute": 7.3,
        "laneCs10": 68.0, "visionPerMinute": 0.7, "wardActivityPerMinute": 0.32, "objectiveDamagePerMinute": 250.0, "epicParticipation": 0.9, "structureConversion": 1.0,
        "ccPerMinute": 1.2, "ccConversion": 3.5, "protectionPerMinute": 35.0, "saves": 0.15,
    },
    "BOTTOM": {
        "assistWeight": 0.65, "killParticipation": 0.55, "soloKills": 0.6, "pickKills": 8.0, "damagePerMinute": 780.0, "damageShare": 0.27,
        "deathRate": 0.13, "deadTimeShare": 0.085, "livingRatio": 0.34, "clutchSurvival": 1.6, "goldPerMinute": 450.0, "csPerMinute": 7.8,
        "laneCs10": 70.0, "visionPerMinute": 0.55, "wardActivityPerMinute": 0.24, "objectiveDamagePerMinute": 360.0, "epicParticipation": 1.1, "structureConversion": 1.2,
        "ccPerMinute": 0.6, "ccConversion": 2.2, "protectionPerMinute": 25.0, "saves": 0.1,
    },
    "UTILITY": {
        "assistWeight": 1.0, "killParticipation": 0.58, "soloKills": 0.15, "pickKills": 12.0, "damagePerMinute": 330.0, "damageShare": 0.1,
        "deathRate": 0.16, "deadTimeShare": 0.1, "livingRatio": 0.3, "clutchSurvival": 1.5, "goldPerMinute": 280.0, "csPerMinute": 0.8,
        "laneCs10": 5.0, "visionPerMinute": 1.8, "wardActivityPerMinute": 0.75, "objectiveDamagePerMinute": 90.0, "epicParticipation": 1.1, "structureConversion": 0.4,
        "ccPerMinute": 2.0, "ccConversion": 5.0, "protectionPerMinute": 160.0, "saves": 0.7,
    },
    "UNKNOWN": {
        "assistWeight": 0.75, "killParticipation": 0.5, "soloKills": 1.0, "pickKills": 8.0, "damagePerMinute": 600.0, "damageShare": 0.2,
        "deathRate": 0.15, "deadTimeShare": 0.095, "livingRatio": 0.31, "clutchSurvival": 1.8, "goldPerMinute": 380.0, "csPerMinute": 6.0,
        "laneCs10": 55.0, "visionPerMinute": 0.8, "wardActivityPerMinute": 0.35, "objectiveDamagePerMinute": 250.0, "epicParticipation": 1.0, "structureConversion": 1.0,
        "ccPerMinute": 1.1, "ccConversion": 3.0, "protectionPerMinute": 45.0, "saves": 0.2,
    },
}
JUNGLE_CS10, CRABS, BUFFS = 55.0, 1.0, 2.0


def zero(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def or_else(first: str, second: str) -> Column:
    """The first, unless it is absent or zero."""
    return F.when(zero(first) != 0, zero(first)).otherwise(zero(second))


def by_role(table: dict[str, float], role: Column) -> Column:
    out = F.lit(float(table.get("UNKNOWN", table.get("MIDDLE", 0.0))))
    for name, value in table.items():
        out = F.when(role == name, F.lit(float(value))).otherwise(out)
    return out


def score_v1(stats: DataFrame) -> DataFrame:
    """stats with role, the eight artifacts weighted by role, opscore and feedscore.  stats has the flat participant fields and `duration`."""
    d, role = minutes(F.col("duration")), role_of(F.col("teamPosition"))
    efficiency = F.least(F.lit(1.0), F.greatest(F.lit(0.5), zero("goldSpent") / F.greatest(F.lit(1.0), zero("goldEarned"))))
    flag = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(0))
    raw = {
        "kda": zero("kills") + zero("assists") * 0.965 - zero("deaths") * 0.25,
        "economy": zero("goldEarned") / d / 10 + efficiency * 0.5,
        "map_awareness": zero("visionScore") * 0.15 + zero("wardsPlaced") * 0.05 + zero("detectorWardsPlaced") * 0.04 + zero("wardsKilled") * 0.08 + zero("controlWardsPlaced") * 0.06,
        "utility": zero("enemyChampionImmobilizations") * 0.08 + zero("totalDamageShieldedOnTeammates") * 0.001 + zero("totalHeal") * 0.001 + zero("damageSelfMitigated") * 0.002 + zero("timeCCingOthers") * 0.01,
        "damage": (zero("physicalDamage") + zero("magicDamage") + zero("trueDamage")) / 1000 * 0.2,
        "tanking": zero("totalDamageTaken") / d * 0.05,
        "objectives": zero("damageDealtToBuildings") * 0.002 + zero("turretTakedowns") * 0.25 + zero("inhibitorTakedowns") * 0.5 + zero("turretPlatesTaken") * 0.03 + zero("damageDealtToTurrets") * 0.001,
        "early_game": flag("firstBloodKill") * 0.5 + flag("firstBloodAssist") * 0.2 + flag("firstTowerKill") * 0.3 + flag("firstTowerAssist") * 0.1 + zero("laneMinionsFirst10Minutes") / 50,
    }
    out = stats.withColumn("role", role)
    out = out.withColumns({k: v * by_role({r: m[ARTIFACTS_V1.index(k)] for r, m in MULTIPLIERS.items()}, F.col("role")) for k, v in raw.items()})
    total = sum((F.col(k) for k in ARTIFACTS_V1), F.lit(0.0))
    return out.withColumns({"opscore": total, "feedscore": zero("deaths") * by_role(DEATH_TOLERANCE, F.col("role")) - (zero("kills") + zero("assists")) * 0.35})


STAT_FIELDS = (
    "kills", "deaths", "assists", "goldEarned", "goldSpent", "visionScore", "wardsPlaced", "wardsKilled", "detectorWardsPlaced", "controlWardsPlaced", "totalDamageShieldedOnTeammates", "totalHeal",
    "damageSelfMitigated", "timeCCingOthers", "physicalDamage", "magicDamage", "trueDamage", "totalDamageTaken", "damageDealtToBuildings", "damageDealtToTurrets", "turretTakedowns", "inhibitorTakedowns",
    "enemyChampionImmobilizations", "turretPlatesTaken", "laneMinionsFirst10Minutes", "firstBloodKill", "firstBloodAssist", "firstTowerKill", "firstTowerAssist",
)


def curve(r: Column) -> Column:
    """Saturating score of a performance ratio: TARGET at 1, logarithmic overflow above, at most CAP; 0 at 0."""
    m = ((1 - TARGET) / TARGET) ** (1 / SHARPNESS)
    r = F.greatest(r, F.lit(0.0))
    return F.least(F.lit(CAP), F.pow(r, SHARPNESS) / (F.pow(r, SHARPNESS) + F.lit(m**SHARPNESS)) + LAMBDA * F.ln(F.greatest(F.lit(1.0), r)))


def falling_curve(r: Column) -> Column:
    """For metrics where less is better; the cap at 0."""
    return F.when(r <= 0, F.lit(CAP)).otherwise(curve(1 / F.when(r > 0, r)))


def clamp01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def reliability(minutes_played: Column) -> Column:
    return clamp01((minutes_played - SHORT) / (FULL - SHORT))


def adjusted(score: Column, reliable: Column) -> Column:
    """Short games pull volatile rates to the neutral score."""
    return reliable * score + (1 - reliable) * NEUTRAL


def artifact(first: Column, second: Column, weight: Column, kind: str, reliable: Column) -> Column:
    base = 2 * (weight * first + (1 - weight) * second)
    return F.least(F.lit(CEILING), base + OVERFLOW[kind] * (0.5 + 0.5 * reliable) * F.greatest(F.lit(0.0), base - 2))


def expectations(spark: SparkSession) -> DataFrame:
    """One row a role, with every expected value."""
    names = list(EXPECTED["UNKNOWN"])
    rows = [(r, *(own[n] for n in names)) for r, own in EXPECTED.items()]
    return spark.createDataFrame(rows, "role string, " + ", ".join(f"E_{n} double" for n in names))


def score_v2(stats: DataFrame) -> DataFrame:
    """stats with the five artifacts, opscore (at most 10) and feed_risk.  Team totals are windows over (match_id, teamId)."""
    team = Window.partitionBy("match_id", "teamId")
    e = lambda n: F.col(f"E_{n}")
    d = F.greatest(F.lit(1.0), F.when(F.col("duration") > 100000, F.col("duration") / 60000).otherwise(F.col("duration") / 60))
    out = stats.withColumns({"role": role_of(F.col("teamPosition")), "_min": d, "_dmg": zero("physicalDamage") + zero("magicDamage") + zero("trueDamage")})
    out = out.withColumns({"_kills": F.sum(zero("kills")).over(team), "_team_dmg": F.sum("_dmg").over(team)}).join(F.broadcast(expectations(stats.sparkSession)), "role")
    m, s, role = F.col("_min"), F.col("_min") * 60, F.col("role")
    r = reliability(m)
    w = {k: by_role({r: own[k][0] for r, own in ARTIFACT_WEIGHTS.items()}, role) for k in OVERFLOW}
    conversion = (zero("kills") + zero("assists") * e("assistWeight")) / F.greatest(F.lit(1.0), F.col("_kills"))
    playmaking = 0.65 * curve(zero("soloKills") / e("soloKills")) + 0.35 * curve(zero("pickKillWithAlly") / e("pickKills"))
    fight = 0.75 * curve(conversion / e("killParticipation")) + 0.25 * playmaking
    pressure = F.sqrt(adjusted(curve(F.col("_dmg") / m / e("damagePerMinute")), r) * curve(F.col("_dmg") / F.greatest(F.lit(1.0), F.col("_team_dmg")) / e("damageShare")))
    risk = (0.55 * (zero("deaths") / m / e("deathRate")) + 0.45 * (zero("totalTimeSpentDead") / s / e("deadTimeShare"))) / (1 + 0.75 * conversion)
    death_cost = adjusted(falling_curve(risk), r)
    survival = 0.7 * curve(zero("longestTimeSpentLiving") / s / e("livingRatio")) + 0.3 * curve((zero("tookLargeDamageSurvived") + zero("survivedThreeImmobilizesInFight") + zero("survivedSingleDigitHpCount")) / e("clutchSurvival"))
    cs_weight = F.when(role == "UTILITY", 0.05).otherwise(0.25)
    economy = 0.55 * adjusted(curve(zero("goldEarned") / m / e("goldPerMinute")), r) + cs_weight * curve((zero("totalMinionsKilled") + zero("neutralMinionsKilled")) / m / e("csPerMinute")) + (0.45 - cs_weight) * clamp01(zero("goldSpent") / F.greatest(F.lit(1.0), zero("goldEarned")))
    ahead = lambda c: F.when(zero(c) > 0, 0.9).otherwise(0.48)
    lane = 0.45 * curve(zero("laneMinionsFirst10Minutes") / e("laneCs10")) + 0.35 * ahead("earlyLaningPhaseGoldExpAdvantage") + 0.2 * ahead("laningPhaseGoldExpAdvantage")
    jungle = 0.4 * curve(zero("jungleCsBefore10Minutes") / JUNGLE_CS10) + 0.3 * curve(zero("initialCrabCount") / CRABS) + 0.3 * curve(zero("initialBuffCount") / BUFFS)
    tempo = F.when(role == "JUNGLE", jungle).otherwise(lane)
    wards = zero("wardsPlaced") + zero("wardsKilled") + zero("detectorWardsPlaced") + zero("controlWardsPlaced")
    vision = 0.7 * adjusted(curve(zero("visionScore") / m / e("visionPerMinute")), r) + 0.2 * adjusted(curve(wards / m / e("wardActivityPerMinute")), r) + 0.1 * clamp01(zero("controlWardTimeCoverage"))
    epic = zero("dragonTakedowns") + 1.5 * zero("baronTakedowns") + zero("riftHeraldTakedowns") + 2 * zero("objectivesStolen")
    objective = 0.4 * adjusted(curve(zero("damageDealtToObjectives") / m / e("objectiveDamagePerMinute")), r) + 0.35 * curve(epic / e("epicParticipation")) + 0.25 * curve((zero("turretTakedowns") + 1.5 * zero("inhibitorTakedowns")) / e("structureConversion"))
    setup = 0.55 * adjusted(curve((zero("enemyChampionImmobilizations") + 0.25 * zero("timeCCingOthers")) / m / e("ccPerMinute")), r) + 0.45 * curve((zero("immobilizeAndKillWithAlly") + zero("knockEnemyIntoTeamAndKill")) / e("ccConversion"))
    protection = or_else("effectiveHealAndShielding", "_fallback_protection")
    guard = 0.75 * curve(protection / m / e("protectionPerMinute")) + 0.25 * curve(zero("saveAllyFromDeath") / e("saves"))
    out = out.withColumns({"_fallback_protection": zero("totalDamageShieldedOnTeammates") + zero("totalHealsOnTeammates"), "_vision": vision, "_objective": objective})
    w_objective = F.least(F.lit(0.9), 1 - w["map"] + 0.25 * clamp01((F.col("_objective") - F.col("_vision")) / 1.5))
    out = out.withColumns({
        "combat_impact": artifact(fight, pressure, w["combat"], "combat", r), "risk_discipline": artifact(death_cost, survival, w["risk"], "risk", r), "resource_tempo": artifact(economy, tempo, w["resource"], "resource", r),
        "map_objective_control": artifact(F.col("_objective"), F.col("_vision"), w_objective, "map", r), "team_enablement": artifact(setup, guard, w["team"], "team", r),
    })
    names = ("combat_impact", "risk_discipline", "resource_tempo", "map_objective_control", "team_enablement")
    out = out.withColumns({"opscore": F.least(F.lit(10.0), sum((F.col(n) for n in names), F.lit(0.0))), "feed_risk": F.greatest(F.lit(0.0), F.least(F.lit(10.0), 10 - 5 * F.col("risk_discipline")))})
    return out.drop(*(c for c in out.columns if c.startswith(("_", "E_"))))


V2_FIELDS = (
    *STAT_FIELDS, "soloKills", "pickKillWithAlly", "totalTimeSpentDead", "longestTimeSpentLiving", "tookLargeDamageSurvived", "survivedThreeImmobilizesInFight", "survivedSingleDigitHpCount", "totalMinionsKilled", "neutralMinionsKilled",
    "earlyLaningPhaseGoldExpAdvantage", "laningPhaseGoldExpAdvantage", "jungleCsBefore10Minutes", "initialCrabCount", "initialBuffCount", "controlWardTimeCoverage", "dragonTakedowns", "baronTakedowns", "riftHeraldTakedowns", "objectivesStolen",
    "damageDealtToObjectives", "immobilizeAndKillWithAlly", "knockEnemyIntoTeamAndKill", "effectiveHealAndShielding", "totalHealsOnTeammates", "saveAllyFromDeath",
)


def with_fields(stats: DataFrame, names=V2_FIELDS) -> DataFrame:
    """stats with absent fields added as nulls."""
    return stats.withColumns({n: F.lit(None).cast("double") for n in names if n not in stats.columns})


def anchors(stats: DataFrame, column: str) -> DataFrame:
    return stats.agg(*(F.percentile(column, p).alias(n) for n, p in (("floor", 0.05), ("center", 0.5), ("ceiling", 0.95))))


def normalised(stats: DataFrame, column: str, out: str) -> DataFrame:
    """Piecewise between the 5th, 50th and 95th percentile: 0, 6.6 and 10."""
    x, lo, mid, hi = F.col(column), F.col("floor"), F.col("center"), F.col("ceiling")
    y = F.when(x <= lo, 0.0).when(x <= mid, F.try_divide(x - lo, mid - lo) * 6.6).when(x <= hi, 6.6 + F.try_divide(x - mid, hi - mid) * 3.4).otherwise(10.0)
    return stats.crossJoin(F.broadcast(anchors(stats, column))).withColumn(out, F.least(F.lit(10.0), F.greatest(F.lit(0.0), y))).drop("floor", "center", "ceiling")


def new_players(stats: DataFrame, known: DataFrame) -> DataFrame:
    """The first sighting of each player not known yet, with starting scores.  stats: player_id, seen, kills, deaths, assists, goldEarned, visionScore."""
    first = Window.partitionBy("player_id").orderBy("seen")
    own = stats.join(known, "player_id", "left_anti").withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    ka = zero("kills") + zero("assists")
    return own.select("player_id", "seen", (zero("deaths") - ka * 0.35).alias("feedscore"), (zero("kills") + zero("assists") * 0.965 + zero("goldEarned") / 560 + zero("visionScore") * 0.15).alias("opscore"))


def top_feeder(stats: DataFrame) -> DataFrame:
    w = Window.partitionBy("match_id").orderBy(F.desc("feedscore"), "player_id")
    return stats.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def profiles(stats: DataFrame) -> DataFrame:
    """player_id, names (sorted), matches, mean scores, most frequent role and its share."""
    base = stats.groupBy("player_id").agg(F.array_sort(F.collect_set("name")).alias("names"), F.count("*").alias("matches"), F.round(F.avg("opscore"), 2).alias("opscore"), F.round(F.avg("feedscore"), 2).alias("feedscore"))
    roles = stats.groupBy("player_id", "role").agg(F.count("*").alias("n"))
    best = roles.withColumn("_k", F.row_number().over(Window.partitionBy("player_id").orderBy(F.desc("n"), "role"))).filter("_k = 1")
    return base.join(best.select("player_id", "role", "n"), "player_id").withColumn("role_confidence", F.col("n") / F.col("matches")).drop("n")
