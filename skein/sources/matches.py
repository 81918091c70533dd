"""Match documents, player tables, registries and documents."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions.scalars import NO_NAME, latest_name

_P = """puuid string, teamId int, riotIdGameName string, riotIdTagline string, teamPosition string, kills int, deaths int, assists int, goldEarned int, goldSpent int, visionScore int, wardsPlaced int, wardsKilled int,
detectorWardsPlaced int, totalDamageShieldedOnTeammates long, totalHeal long, damageSelfMitigated long, timeCCingOthers int, physicalDamageDealtToChampions long, magicDamageDealtToChampions long, trueDamageDealtToChampions long,
totalDamageTaken long, damageDealtToBuildings long, damageDealtToTurrets long, turretTakedowns int, inhibitorTakedowns int, firstBloodKill boolean, firstBloodAssist boolean, firstTowerKill boolean, firstTowerAssist boolean,
challenges struct<controlWardsPlaced: double, enemyChampionImmobilizations: double, turretPlatesTaken: double, laneMinionsFirst10Minutes: double>"""
MATCH = f"metadata struct<matchId: string, participants: array<string>>, info struct<queueId: int, gameCreation: bigint, gameDuration: bigint, participants: array<struct<{_P}>>>"


def reader(read):
    """A reader or stream reader of match documents; a file that is no such document gives nulls."""
    return read.schema(MATCH + ", _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE")


def shaped(raw: DataFrame, broken: bool = False) -> DataFrame:
    """match_id, queue_id, created, duration, participants, ids, file.  A file that is no match document is skipped, or kept with null participants where broken ones are asked for."""
    name = F.col("_metadata.file_name")
    return raw.filter(F.col("info.participants").isNotNull() | F.lit(broken)).select(
        F.coalesce("metadata.matchId", F.regexp_replace(name, r"\.json$", "")).alias("match_id"), F.col("info.queueId").alias("queue_id"), F.col("info.gameCreation").alias("created"),
        F.col("info.gameDuration").alias("duration"), F.col("info.participants").alias("participants"), F.col("metadata.participants").alias("ids"), name.alias("file"),
    )


def read_matches(spark: SparkSession, path: str, glob: str = "*.json", recursive: bool = False) -> DataFrame:
    """match_id, queue_id, created, duration, participants, ids, file.  A file that is no such document is skipped."""
    return shaped(reader(spark.read).option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).json(path))


def participants(matches: DataFrame) -> DataFrame:
    """match_id, pos, player_id, team, and the participant's record; rows without an id go, an absent team is 0."""
    out = matches.select("match_id", "duration", F.posexplode("participants").alias("pos", "p"))
    return out.filter(F.col("p.puuid").isNotNull()).select("match_id", "pos", F.col("p.puuid").alias("player_id"), F.coalesce("p.teamId", F.lit(0)).alias("team"), "duration", "p")


def stats(matches: DataFrame) -> DataFrame:
    """The flat fields that scoring reads."""
    p = participants(matches)
    own = ("teamPosition", "kills", "deaths", "assists", "goldEarned", "goldSpent", "visionScore", "wardsPlaced", "wardsKilled", "detectorWardsPlaced", "totalDamageShieldedOnTeammates", "totalHeal", "damageSelfMitigated", "timeCCingOthers", "totalDamageTaken", "damageDealtToBuildings", "damageDealtToTurrets", "turretTakedowns", "inhibitorTakedowns", "firstBloodKill", "firstBloodAssist", "firstTowerKill", "firstTowerAssist")
    damage = {"physicalDamage": "physicalDamageDealtToChampions", "magicDamage": "magicDamageDealtToChampions", "trueDamage": "trueDamageDealtToChampions"}
    extra = ("controlWardsPlaced", "enemyChampionImmobilizations", "turretPlatesTaken", "laneMinionsFirst10Minutes")
    name = F.concat_ws("#", "p.riotIdGameName", "p.riotIdTagline")
    return p.select("match_id", "pos", "player_id", F.col("team").alias("teamId"), "duration", name.alias("name"), *(F.col(f"p.{c}").alias(c) for c in own), *(F.col(f"p.{s}").alias(d) for d, s in damage.items()), *(F.col(f"p.challenges.{c}").alias(c) for c in extra))


def matches_with(matches: DataFrame, player_id: str) -> DataFrame:
    return matches.filter(F.array_contains("ids", player_id))


def quality_gate(matches: DataFrame, as_of_ms: int, queues: list[int], days: int = 365, players: int = 10) -> DataFrame:
    """matches with reject_reason, null for a match that passes."""
    fields = F.exists("participants", lambda p: p["puuid"].isNull() | p["teamId"].isNull() | p["kills"].isNull() | p["deaths"].isNull() | p["assists"].isNull())
    reason = (
        F.when(F.col("queue_id").isNull() | ~F.col("queue_id").isin(queues), "queue")
        .when(F.col("created") < as_of_ms - days * 86_400_000, "too old")
        .when(F.size("participants") < players, "too few participants")
        .when(fields, "incomplete participant")
    )
    return matches.withColumn("reject_reason", reason)


#: Rank tiers in rising order.
TIERS = ("IRON", "BRONZE", "SILVER", "GOLD", "PLATINUM", "EMERALD", "DIAMOND", "MASTER", "GRANDMASTER", "CHALLENGER")


def rank_gate(entries: DataFrame, least: str | None = None, most: str | None = None, least_lp: int | None = None, most_lp: int | None = None, allowed: list[str] | None = None) -> DataFrame:
    """Entries (tier, lp) within the bounds; a tier unknown never passes."""
    order = F.create_map(*[x for k, t in enumerate(TIERS) for x in (F.lit(t), F.lit(k))])
    place = F.try_element_at(order, F.upper("tier"))
    ok = place.isNotNull()
    if least:
        ok &= place >= TIERS.index(least)
    if most:
        ok &= place <= TIERS.index(most)
    if least_lp is not None:
        ok &= F.col("lp") >= least_lp
    if most_lp is not None:
        ok &= F.col("lp") <= most_lp
    if allowed:
        ok &= F.upper("tier").isin([a.upper() for a in allowed])
    return entries.filter(ok)


def read_players(spark: SparkSession, path: str | None = None, jdbc: dict | None = None) -> DataFrame:
    """Players with the latest of their names as label, from Parquet or over JDBC."""
    raw = spark.read.format("jdbc").options(**jdbc).load() if jdbc else spark.read.parquet(path)
    return raw.withColumn("label", latest_name(F.col("names")))


def write_players(players: DataFrame, path: str, log: str | None = None) -> None:
    players.write.mode("overwrite").parquet(path)
    if log:
        players.select("puuid", "names", "opscore", "feedscore").write.mode("overwrite").option("sep", ";").option("header", True).csv(log)


def dataset_registry(spark: SparkSession, root: dict[str, str]) -> DataFrame:
    """dataset, path, tables, rows: what each dataset's folder of Parquet tables holds."""
    found = []
    for name, path in sorted(root.items()):
        jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = jvm.getFileSystem(spark._jsc.hadoopConfiguration())
        names = sorted(s.getPath().getName() for s in (fs.listStatus(jvm) if fs.exists(jvm) else []) if s.getPath().getName().endswith(".parquet"))
        found.append((name, path, len(names), sum(spark.read.parquet(os.path.join(path, n)).count() for n in names)))
    return spark.createDataFrame(found, "dataset string, path string, tables int, rows long")


def markdown_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, title, summary (first prose line, at most 220 characters), size, modified."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).load(path)
    lines = F.transform(F.split(F.decode("content", "UTF-8"), "\n"), lambda x: F.trim(x))
    title = F.try_element_at(F.filter(lines, lambda x: x.startswith("# ")), F.lit(1))
    prose = F.try_element_at(F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^(#|[-*>|`]|\d+\.|!\[)")), F.lit(1))
    return raw.select("path", F.coalesce(F.substring(title, 3, 1000), F.regexp_extract("path", r"([^/]+)\.md$", 1)).alias("title"), F.substring(F.coalesce(prose, F.lit("")), 1, 220).alias("summary"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def named_clusters(clusters: DataFrame, players: DataFrame) -> DataFrame:
    """clusters (cluster_id, members) with the members' latest names in order."""
    own = clusters.select("cluster_id", F.posexplode("members").alias("pos", "puuid")).join(players.select("puuid", latest_name(F.col("names")).alias("name")), "puuid", "left")
    return own.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "puuid", F.coalesce("name", F.lit(NO_NAME)).alias("name")))), lambda x: F.struct(x["puuid"].alias("puuid"), x["name"].alias("name"))).alias("members"))


def mock_matches(spark: SparkSession, sizes: tuple[int, ...] = (20, 18, 8, 4, 3, 12, 2, 16, 6, 14, 9), matches: int = 400) -> DataFrame:
    """Deterministic matches of five against five: teams come from one cluster where it is large enough, topped up from the next ones."""
    nodes = [f"c{i}n{j}" for i, n in enumerate(sizes) for j in range(n)]
    start = [sum(sizes[:i]) for i in range(len(sizes))]
    out = []
    for m in range(matches):
        i = m % len(sizes)
        k = (m * 7) % len(sizes)
        blue = [nodes[start[i] + (m + x) % sizes[i]] if x < sizes[i] else nodes[(start[i] + sizes[i] + m + x) % len(nodes)] for x in range(5)]
        red = []
        x = 0
        while len(red) < 5:
            n = nodes[(start[k] + m * 3 + x) % len(nodes)]
            if n not in blue and n not in red:
                red.append(n)
            x += 1
        out += [(f"m{m}", p, n, t) for t, team in ((100, blue), (200, red)) for p, n in enumerate(team, 0 if t == 100 else 5)]
    return spark.createDataFrame(out, "match_id string, pos int, player_id string, team int")


def frontier(known: DataFrame, processed: DataFrame, k: int = 50, seed: int = 1) -> DataFrame:
    """Up to k candidates that were not processed, in a seeded random order."""
    return known.join(processed, "puuid", "left_anti").orderBy(F.xxhash64("puuid", F.lit(seed)), "puuid").limit(k)


def premade_signal(parts: DataFrame, player_id, least: int = 2, k: int = 5) -> DataFrame:
    """Repeated team mates of a player, most frequent first."""
    own = parts.filter(F.col("player_id") == player_id).select("match_id", "team")
    mates = parts.join(own, ["match_id", "team"], "left_semi").filter(F.col("player_id") != player_id)
    return mates.groupBy("player_id").agg(F.count("*").alias("together")).filter(F.col("together") >= least).orderBy(F.desc("together"), "player_id").limit(k)


def last_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
