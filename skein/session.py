"""Sessions and lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(name: str = "skein", cores: str = "*", partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions)).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true").getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Where it is unset, a folder of this machine serves a local master; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or tempfile.mkdtemp(prefix="skein-")


#: Spark's setting that removes the shuffle files of an execution at its end.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """df computed once, with its lineage cut by a reliable checkpoint in the shared folder.  Shuffle files of the computation go when it is written: else they stay until the driver's memory is cleaned."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(spark))
    before = spark.conf.get(CLEANED, None)
    spark.conf.set(CLEANED, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # the setting holds for a plan that is made under it
    finally:
        spark.conf.set(CLEANED, before) if before is not None else spark.conf.unset(CLEANED)


def united(parts: list[DataFrame]) -> DataFrame:
    """The rows of all parts, which were each written once, in no more partitions than a shuffle has."""
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out if len(parts) == 1 else out.coalesce(int(out.sparkSession.conf.get("spark.sql.shuffle.partitions")))


#: Values of a frontier that may go to every task.
SMALL = 500_000


def reaching(front: DataFrame, edges: DataFrame, rows: int) -> DataFrame:
    """The edges (node, ...) that leave the front (node, ...) of so many rows.  A small front is sent to the tasks that read the edges, so that a round does not deal all edges out anew; a larger one is joined by dealing out both."""
    return (F.broadcast(front) if rows * len(front.columns) <= SMALL else front).join(edges, "node")


def few(df: DataFrame) -> DataFrame:
    """df, which was written once, marked to be sent to all tasks where it has few values, so that what it is joined with stays where it is."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() * len(df.columns) <= SMALL else df


def joined(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows of both in no more partitions than a shuffle has, so that loops of many rounds do not pile them up."""
    return a.unionAll(b).coalesce(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")))
