"""A crawl over stored matches: from seed players along the matches they took part in, in the order of a queue, round by round.

A round takes all players that the last one found, in queue order: each brings his latest matches, and those bring further players.  So players are met as a first-in-first-out queue would meet
them, and both limits cut the queue where it would stop.  Every round is written to the folder before the next one begins; a crawl that was cut short goes on from its last whole round.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions.ranking import position, total_before
from skein.session import united

POLICIES = ("all", "teammates", "opponents", "radial")


def seeded(seeds: DataFrame, per_tier: int | None = None) -> DataFrame:
    """The first per_tier seeds (player, tier, place) of each tier, all where it is None, with their places in the queue; of a repeated player the first place counts."""
    own = seeds.groupBy("player").agg(F.min(F.struct("place", "tier")).alias("s")).select("player", "s.place", "s.tier")
    if per_tier is not None:
        own = own.withColumn("_n", F.row_number().over(Window.partitionBy("tier").orderBy("place", "player"))).filter(F.col("_n") <= per_tier)
    return position(own.select("player", F.col("place").alias("_at")), [F.asc("_at"), F.asc("player")], "place").select(F.col("place").cast("long").alias("place"), "player", F.lit(True).alias("is_seed"))


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _expanded(taken: DataFrame, participants: DataFrame, known: DataFrame, policy: str, picks: int, seed: int) -> DataFrame:
    """player and the place of its first mention: the participants of the taken matches (place, source, team, match_id, n) that the policy lets in and that are not known."""
    other = participants.select("match_id", F.col("player_id").alias("player"), "pos", F.col("team").alias("other_team"))
    met = taken.join(other, "match_id").filter("player <> source").join(known.select("player"), "player", "left_anti")
    if policy in ("teammates", "opponents"):
        met = met.filter(F.col("team").eqNullSafe(F.col("other_team")) == F.lit(policy == "teammates"))
    elif policy == "radial":
        chance = F.row_number().over(Window.partitionBy("place", "match_id").orderBy(F.xxhash64(F.lit(seed), "match_id", "player"), "pos"))
        most = 1 + F.pmod(F.xxhash64(F.lit(seed), "match_id", "source"), F.lit(picks))
        met = met.withColumns({"_n": chance, "_most": most}).filter("_n <= _most")
    return met.groupBy("player").agg(F.min(F.struct("place", "n", "pos")).alias("first"))


def crawl(participants: DataFrame, created: DataFrame, seeds: DataFrame, folder: str, policy: str = "all", max_players: int = 1000, max_matches: int = 1_000_000, seed_matches: int = 20, player_matches: int = 5, per_tier: int | None = None, picks: int = 2, seed: int = 1, most_rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(players, matches): place, player, is_seed, round of the players that were processed, and match_id, place of the matches they brought, place being the first that did.

    participants: match_id, pos, player_id, team; created: match_id, created; seeds: player, tier, place.  A player brings the latest seed_matches or player_matches of his matches, and the queue
    stops before the player at whom max_matches are there.  policy: all participants, those of the player's side or of the others, or radial: up to `picks` of a match by a seeded hash, among players unknown before the round.
    most_rounds ends a call after so many rounds; the next call with the same folder goes on."""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy}")
    spark = participants.sparkSession
    if _stored(spark, f"{folder}/queue/0") is None:
        seeded(seeds, per_tier).write.mode("overwrite").parquet(f"{folder}/queue/0")
    queues = [q for q in [_stored(spark, f"{folder}/queue/0")] if q is not None]
    while (more := _stored(spark, f"{folder}/queue/{len(queues)}")) is not None:
        queues.append(more)
    done = [spark.read.parquet(f"{folder}/done/{k}") for k in range(len(queues) - 1)]
    saved = [spark.read.parquet(f"{folder}/saved/{k}") for k in range(len(queues) - 1)]
    rounds = 0
    while not queues[-1].isEmpty() and (most_rounds is None or rounds < most_rounds):
        turn, rounds = len(queues) - 1, rounds + 1
        front = queues[-1].filter(F.col("place") <= max_players)
        own = front.join(participants.groupBy(F.col("player_id").alias("player"), "match_id").agg(F.min("team").alias("team")), "player").join(created, "match_id")
        n = F.row_number().over(Window.partitionBy("place").orderBy(F.desc("created"), "match_id"))
        most = F.when(F.col("is_seed"), seed_matches).otherwise(player_matches)
        taken = own.withColumn("n", n).filter(F.col("n") <= most).select("place", F.col("player").alias("source"), "team", "match_id", "n")
        new = taken.groupBy("match_id").agg(F.min("place").alias("place"))
        new = new.join(united(saved).select("match_id"), "match_id", "left_anti") if saved else new
        before = united(saved).count() if saved else 0
        brought = front.join(new.groupBy("place").agg(F.count("*").alias("brings")), "place", "left").fillna(0, ["brings"])
        kept = total_before(brought, ["place"], F.col("brings"), "had").filter(F.col("had") + F.lit(before) < max_matches)
        kept.select("place", "player", "is_seed", F.lit(turn).alias("round")).write.mode("overwrite").parquet(f"{folder}/done/{turn}")
        done.append(spark.read.parquet(f"{folder}/done/{turn}"))
        new.join(done[-1].select("place"), "place", "left_semi").select("match_id", "place").write.mode("overwrite").parquet(f"{folder}/saved/{turn}")
        saved.append(spark.read.parquet(f"{folder}/saved/{turn}"))
        found = _expanded(taken.join(done[-1].select("place"), "place", "left_semi"), participants, united(queues), policy, picks, seed)
        last = queues[-1].agg(F.max("place")).first()[0]
        placed = position(found, ["first.place", "first.n", "first.pos", "player"], "at")
        placed.select((F.col("at") + F.lit(last)).cast("long").alias("place"), "player", F.lit(False).alias("is_seed")).write.mode("overwrite").parquet(f"{folder}/queue/{turn + 1}")
        queues.append(spark.read.parquet(f"{folder}/queue/{turn + 1}"))
    empty = lambda schema: spark.createDataFrame([], schema)
    kind = dict(participants.dtypes)
    return (united(done) if done else empty(f"place long, player {kind['player_id']}, is_seed boolean, round int"), united(saved) if saved else empty(f"match_id {kind['match_id']}, place long"))
