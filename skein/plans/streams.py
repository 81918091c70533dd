"""Queries that run as streams over a table of files, with SQL for what they come to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.plans.graph import query
from skein.sources import tables
from skein.streaming import processors


def stream_of(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table's file as a stream of files."""
    return spark.readStream.schema(tables.table(spark, sf, name).schema).parquet(f"{sf}/{name}*.parquet")


def line() -> Column:
    """An event as a line of a collector's job: sign-ups are its status, purchases its progress, all others its log."""
    kind, at = F.col("event_type"), F.col("event_id")
    status = F.to_json(F.struct(F.lit("status").alias("type"), F.concat(F.lit("s"), at).alias("status")))
    progress = F.to_json(F.struct(F.lit("progress").alias("type"), F.concat(F.lit("stage"), at % 3).alias("currentStage"), F.struct(at.alias("matchesSaved")).alias("progress")))
    log = F.to_json(F.struct(F.lit("log").alias("type"), F.concat(kind, at.cast("string")).alias("message")))
    return F.concat(F.lit("@@EVENT@@ "), F.when(kind == "signup", status).when(kind == "purchase", progress).otherwise(log))


@query("stream_job_snapshots", """WITH l AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE event_type NOT IN ('signup', 'purchase')),
 s AS (SELECT user_id, max(event_id) FILTER (event_type = 'signup') AS st, max(event_id) FILTER (event_type = 'purchase') AS pr FROM events GROUP BY user_id), g AS (SELECT user_id, string_agg(event_type || event_id, ',' ORDER BY event_id) AS logs FROM l WHERE n <= 80 GROUP BY user_id)
 SELECT CAST(s.user_id AS VARCHAR) AS job, 's' || st AS status, 'stage' || (pr % 3) AS stage, pr AS saved, coalesce(logs, '') AS logs FROM s LEFT JOIN g ON g.user_id = s.user_id""")
def stream_job_snapshots(spark, sf):
    lines = stream_of(spark, sf, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("at"), line().alias("value"))
    found = processors.drained(processors.job_snapshots(processors.parsed(lines)), "update")
    last = found.withColumn("_n", F.row_number().over(Window.partitionBy("job").orderBy(F.desc("batch")))).filter("_n = 1")
    return last.select("job", "status", "stage", "saved", F.array_join("logs", ",").alias("logs"))


@query("stream_dispute_acts", """WITH t AS (SELECT DISTINCT user_id % 5 AS a, 5 + user_id % 3 AS b, event_id // 40 AS tick FROM events), r AS (SELECT *, tick - row_number() OVER (PARTITION BY a, b ORDER BY tick) AS run FROM t)
 SELECT a, b, min(tick) AS first_tick, min(tick) + 3 AS tick FROM r GROUP BY a, b, run HAVING max(tick) - min(tick) >= 3""")
def stream_dispute_acts(spark, sf):
    ticks = stream_of(spark, sf, "events").select((F.col("user_id") % 5).alias("a"), (5 + F.col("user_id") % 3).alias("b"), F.floor(F.col("event_id") / 40).cast("long").alias("tick"))
    return processors.drained(processors.dispute_acts(ticks, 3)).drop("batch")


@query("stream_expired_entries", "WITH s AS (SELECT user_id AS entry, max(event_id) AS since FROM events GROUP BY user_id) SELECT entry, since, since + 80 AS until FROM s WHERE since + 80 <= (SELECT max(event_id) FROM events) - 10")
def stream_expired_entries(spark, sf):
    entries = stream_of(spark, sf, "events").select(F.col("user_id").alias("entry"), F.col("event_id").alias("tick"))
    return processors.drained(processors.expired_entries(entries)).drop("batch")
