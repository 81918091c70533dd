"""Positions and running totals in a total order over all rows, without bringing the rows to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.session import cut


def total_before(df: DataFrame, order: list[Column | str], value: Column, out: str) -> DataFrame:
    """df with the sum of value over the rows before, in an order without ties.

    Rows are dealt out by ranges of the order; each range sums its own, and only one total a range meets in one task."""
    dealt = cut(df.repartitionByRange(*order).withColumns({"_range": F.spark_partition_id(), "_value": value}))
    sums = dealt.groupBy("_range").agg(F.sum("_value").alias("_sum"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.join(F.broadcast(starts), "_range").withColumn(out, F.col("_start") + F.coalesce(F.sum("_value").over(inside), F.lit(0))).drop("_range", "_value", "_start")


def position(df: DataFrame, order: list[Column | str], out: str = "rank") -> DataFrame:
    """df with the place of each row, from 1, in an order without ties."""
    return total_before(df, order, F.lit(1).cast("long"), out).withColumn(out, (F.col(out) + 1).cast("int"))
