"""How the star-schema tables stand for matches and players.

A match is an order, a player a part, the team of a player in a match the parity of its first line; a player's scores are its price and its mean discount.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lines that one task pairs by match, or sums by player.
LINES_A_TASK = 250_000


def tasks(spark: SparkSession, sf_dir: str) -> int:
    """How many tasks the lines are dealt out to: by their number, so that the memory of a task does not grow with the table."""
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, "lineitem").count() // LINES_A_TASK))


def participants(spark: SparkSession, sf_dir: str, player: str = "l_partkey") -> DataFrame:
    """match_id, player_id, pos, team.  Dealt out by match once: the aggregate and the pair join after it need no further exchange."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("match_id"), F.col(player).alias("player_id"), "l_linenumber")
    return lines.repartition(tasks(spark, sf_dir), "match_id").groupBy("match_id", "player_id").agg(F.min("l_linenumber").alias("pos")).withColumn("team", F.col("pos") % 2)


def players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, role, country, opscore, feedscore, match_count.  Lines are dealt out by player once, as many to a task as of matches: no task holds those of more before the exchange."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_discount").repartition(tasks(spark, sf_dir), "l_partkey")
    used = lines.groupBy("l_partkey").agg(F.round(F.avg("l_discount"), 6).alias("feedscore"), F.countDistinct("l_orderkey").alias("match_count"))
    part = table(spark, sf_dir, "part")
    return part.join(used, part.p_partkey == used.l_partkey, "left").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), F.col("p_brand").alias("role"), F.col("p_type").alias("country"),
        F.col("p_retailprice").alias("opscore"), "feedscore", F.coalesce("match_count", F.lit(0)).alias("match_count"),
    )
