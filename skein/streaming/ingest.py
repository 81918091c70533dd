"""Collecting match documents: a resumable stream of files that keeps the eligible matches and sets the others aside with their reason."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.session import cut
from skein.sources import matches


def stream_matches(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """Match documents as a stream, files that are none with null participants, at most `files` of them a batch: this is the limit on the rate."""
    return matches.shaped(matches.reader(spark.readStream).option("maxFilesPerTrigger", files).json(path), broken=True)


def divide(found: DataFrame, stored: DataFrame | None, as_of_ms: int, queues: list[int], days: int = 365, players: int = 10) -> tuple[DataFrame, DataFrame]:
    """(kept, set_aside): one row of each match id that is not stored yet and passes the gate; the others that fail it, with reject_reason.

    A match id that both passes and fails in one batch is kept; of several files that pass, or fail, the first by name counts. """
    judged = matches.quality_gate(found.filter("match_id is not null and participants is not null"), as_of_ms, queues, days, players)
    order = Window.partitionBy("match_id").orderBy(F.col("reject_reason").isNotNull(), "file", F.xxhash64(F.to_json("participants")))
    first = judged.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
    if stored is not None:
        first = first.join(stored.select("match_id"), "match_id", "left_anti")
    first = cut(first)  # judged once for both
    return first.filter("reject_reason is null").drop("reject_reason"), first.filter("reject_reason is not null").select("match_id", "file", "reject_reason")


def collect(spark: SparkSession, path: str, out: str, as_of_ms: int, queues: list[int], days: int = 365, players: int = 10, files: int = 100) -> dict[str, int]:
    """Reads what has arrived under path since the last call and returns the rows that out/matches and out/quarantine hold now; none of either where nothing ever arrived.
    out/broken names the files that are no match documents.

    The files read are noted in out/checkpoint, so a run that was cut short goes on where it stopped.  Each batch writes a folder of its own and
    overwrites it when it is repeated; it looks for matches of earlier batches only in the folders of those, so a repeat writes the same rows."""

    def earlier(batch: int) -> DataFrame | None:
        return spark.read.parquet(f"{out}/matches").filter(F.col("batch") < batch) if batch else None

    def write(rows: DataFrame, batch: int) -> None:
        rows = cut(rows)  # parsed once
        rows.filter("participants is null").select("file").write.mode("overwrite").parquet(f"{out}/broken/batch={batch}")
        kept, aside = divide(rows, earlier(batch), as_of_ms, queues, days, players)
        kept.write.mode("overwrite").parquet(f"{out}/matches/batch={batch}")
        aside.write.mode("overwrite").parquet(f"{out}/quarantine/batch={batch}")

    def held(name: str) -> int:
        try:
            return spark.read.parquet(f"{out}/{name}").count()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0

    stream = stream_matches(spark, path, files)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return {name: held(name) for name in ("matches", "quarantine")}


def due(ticks: DataFrame, schedule: dict[str, int]) -> DataFrame:
    """tick, action: the actions of the schedule (name: every how many ticks) that fall on each tick; tick 0 starts none."""
    at = F.col("tick")
    named = F.array(*[F.when((at > 0) & (at % every == 0), F.lit(name)) for name, every in schedule.items()])
    return ticks.select("tick", F.explode(F.filter(named, lambda x: x.isNotNull())).alias("action"))
