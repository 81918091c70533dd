"""Do connected players score alike?  Pearson correlation over edges, strata, and a seeded permutation test."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.ranking import position
from skein.operators.projection import support
from skein.session import cut

MODES, METRICS = ("social-path", "battle-path"), ("opscore", "feedscore")
TINY = 2.220446049250313e-16
STRATA = ("global", "within_cluster", "cross_cluster", "strong_ties", "weak_ties")


def pearson(when: Column, x: Column, y: Column) -> Column:
    """Correlation over both directions of the rows where `when` holds; null under two samples or without variance."""
    pick = lambda v: F.coalesce(F.sum(F.when(when, v)), F.lit(0.0))
    n, s, q, p = 2.0 * F.count_if(when), pick(x + y), pick(x * x + y * y), 2.0 * pick(x * y)
    spread = n * q - s * s
    return F.when((n >= 2) & (spread > TINY), F.try_divide(n * p - s * s, spread))


def classified(pairs: DataFrame, players: DataFrame, membership: DataFrame, min_support: int, min_matches: int) -> DataFrame:
    """Edges once for each mode that allows them and each metric, with both values and why an edge is skipped: low support, then missing metric, then few matches.

    Scores, matches and cluster are attached to both ends once; the four readings are made of the joined row."""
    nodes = players.select(F.col("id").alias("node"), *(F.col(m).cast("double").alias(m) for m in METRICS), "match_count").join(membership.select("node", "comp"), "node", "full")
    nodes = cut(nodes)  # read for both ends
    own = pairs.select("src", "dst", *(support(m).alias(m) for m in MODES))
    for end in ("src", "dst"):
        own = own.join(nodes.select(F.col("node").alias(end), F.struct("match_count", "comp", *METRICS).alias(f"{end}_own")), end, "left")
    reading = F.explode(F.array(*(F.struct(F.lit(mode).alias("mode"), F.lit(metric).alias("metric"), F.col(mode).alias("support"), F.col(f"src_own.{metric}").alias("x"), F.col(f"dst_own.{metric}").alias("y")) for mode in MODES for metric in METRICS)))
    same = F.coalesce(F.col("src_own.comp") == F.col("dst_own.comp"), F.lit(False)).alias("same_cluster")
    few = ((F.col("src_own.match_count") < min_matches) | (F.col("dst_own.match_count") < min_matches)).alias("few_matches")
    out = own.select(reading.alias("r"), same, few).select("r.*", "same_cluster", "few_matches").filter("support > 0")
    status = F.when(F.col("support") < min_support, "low_support").when(F.col("x").isNull() | F.col("y").isNull(), "missing_metric").when(F.col("few_matches"), "low_match_count").otherwise("analyzed")
    return out.withColumn("status", status)


def assortativity(pairs: DataFrame, players: DataFrame, membership: DataFrame, min_support: int = 2, min_matches: int = 1, strong: int = 3) -> DataFrame:
    """One row for each mode and metric: counters, and n and coefficient of each stratum, by one aggregate over the edges, summed in each task before its four groups are exchanged."""
    e = classified(pairs, players, membership, min_support, min_matches)
    used, within, tie = F.col("status") == "analyzed", F.col("same_cluster"), F.col("support") >= strong
    when = dict(zip(STRATA, (used, used & within, used & ~within, used & tie, used & ~tie), strict=True))
    aggs = [F.count("status").alias("candidates"), *(F.count_if(F.col("status") == s).alias(s) for s in ("analyzed", "low_support", "missing_metric", "low_match_count"))]
    for name, cond in when.items():
        aggs += [F.count_if(cond).alias(f"{name}_edges"), pearson(cond, F.col("x"), F.col("y")).alias(f"{name}_r")]
    every = pairs.sparkSession.createDataFrame([(mode, metric) for mode in MODES for metric in METRICS], "mode string, metric string")
    out = e.groupBy("mode", "metric").agg(*aggs)
    return every.join(out, ["mode", "metric"], "left").fillna(0, [c for c in out.columns if c not in ("mode", "metric") and not c.endswith("_r")])


def eligible_nodes(pairs: DataFrame, players: DataFrame, metric: str, min_matches: int) -> DataFrame:
    ends = pairs.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return ends.join(players.filter(F.col(metric).isNotNull() & (F.col("match_count") >= min_matches)), "id", "left_semi").agg(F.count("*").alias("eligible"))


class Lcg:
    """The seeded generator of the permutation test: fixed multiplier and increment, modulo 2^64; indices by remainder."""

    MULTIPLIER, INCREMENT = 6364136223846793005, 1442695040888963407

    def __init__(self, seed: int):
        self.state = max(1, seed)

    def below(self, n: int) -> int:
        self.state = (self.state * self.MULTIPLIER + self.INCREMENT) % 2**64
        return self.state % n

    def shuffled(self, values: list) -> list:
        out = list(values)
        for i in range(len(out) - 1, 0, -1):
            j = self.below(i + 1)
            out[i], out[j] = out[j], out[i]
        return out

    def ahead(self, steps: int) -> Lcg:
        """The generator as it is after so many steps, by powers of the affine step."""
        a, c, total_a, total_c = self.MULTIPLIER, self.INCREMENT, 1, 0
        while steps:
            if steps & 1:
                total_a, total_c = total_a * a % 2**64, (total_c * a + c) % 2**64
            a, c, steps = a * a % 2**64, (c * a + c) % 2**64, steps >> 1
        out = Lcg(1)
        out.state = (self.state * total_a + total_c) % 2**64
        return out

    def states(self, n: int) -> np.ndarray:
        """The next n states, which the generator then has behind it."""
        powers = np.multiply.accumulate(np.full(n, self.MULTIPLIER, np.uint64)) if n else np.zeros(0, np.uint64)
        sums = np.cumsum(np.concatenate((np.ones(1, np.uint64), powers[:-1])), dtype=np.uint64) * np.uint64(self.INCREMENT) if n else powers
        out = powers * np.uint64(self.state % 2**64) + sums
        if n:
            self.state = int(out[-1])
        return out

    def permutation(self, n: int, block: int = 1 << 20) -> np.ndarray:
        """Where the value at each place comes from after `shuffled`; the states are made block by block."""
        out, top = list(range(n)), n - 1
        while top > 0:
            size = min(block, top)
            picks = self.states(size) % np.arange(top + 1, top + 1 - size, -1).astype(np.uint64)
            for i, j in zip(range(top, top - size, -1), picks.tolist(), strict=True):
                out[i], out[j] = out[j], out[i]
            top -= size
        return np.array(out, np.int64)


def permutations(spark: SparkSession, n: int, runs: int, seed: int) -> DataFrame:
    """run (from 1), place, origin: the value at each place of a run comes from origin.  One generator goes through all runs; each is made in a task of its own, which jumps to the state its run begins at
    and holds n numbers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in batch.column("id").to_pylist():
                origin = Lcg(seed).ahead((run - 1) * max(0, n - 1)).permutation(n)
                for at in range(0, n, 1 << 16):
                    part = origin[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), run, np.int32)), pa.array(np.arange(at, at + len(part))), pa.array(part)], ["run", "place", "origin"])

    return spark.range(1, runs + 1, 1, max(1, runs)).mapInArrow(work, "run int, place long, origin long")


def drawn_values(own: DataFrame, n: int, runs: int, seed: int) -> DataFrame:
    """run, place, value: the n values of own (place, value) as each run shuffles them.  Spark takes the rows that tasks make for as few as their ranges have; so the join is told to merge, for they must not be broadcast."""
    return permutations(own.sparkSession, n, runs, seed).hint("merge").join(own.select(F.col("place").alias("origin"), "value"), "origin").select("run", "place", "value")


def permutation_test(edges: DataFrame, values: DataFrame, n_permutations: int = 100, seed: int = 1) -> DataFrame:
    """observed, null mean, stddev, min, max, p_upper, p_two_sided, z, percentile of the correlation over edges (src, dst) when values (id, value) are shuffled.

    Values stand in id order; the shuffles of one generator are made in tasks and joined to the values by place, so a row is gathered for each node, as long as there are runs."""
    own = position(values.filter("value is not null").select("id", F.col("value").cast("double").alias("value")), [F.asc("id")], "place")
    own = cut(own.withColumn("place", (F.col("place") - 1).cast("long")))
    every = drawn_values(own, own.count(), n_permutations, seed).unionByName(own.select(F.lit(0).alias("run"), "place", "value"))
    held = every.groupBy("place").agg(F.array_sort(F.collect_list(F.struct("run", "value"))).alias("drawn"))
    table = cut(own.select("id", "place").join(held, "place").select("id", F.transform("drawn", lambda x: x["value"]).alias("perm")))
    both = edges.select("src", "dst").join(table.select(F.col("id").alias("src"), F.col("perm").alias("x")), "src").join(table.select(F.col("id").alias("dst"), F.col("perm").alias("y")), "dst")
    long = both.select(F.posexplode(F.arrays_zip("x", "y")).alias("run", "v"))
    per = cut(long.groupBy("run").agg(pearson(F.lit(True), F.col("v.x"), F.col("v.y")).alias("r"), F.count("*").alias("edges")))
    observed = per.filter("run = 0").select(F.col("r").alias("observed"), "edges")
    null = per.filter("run > 0").select(F.col("r").alias("sample"))
    o, s = F.col("observed"), F.col("sample")
    agg = observed.crossJoin(null).groupBy("observed", "edges").agg(
        F.count("sample").alias("valid"), F.count_if(s.isNull()).alias("undefined"), F.avg("sample").alias("null_mean"), F.stddev_pop("sample").alias("null_stddev"), F.min("sample").alias("null_min"), F.max("sample").alias("null_max"),
        F.count_if(s >= o).alias("_ge"), F.count_if(F.abs(s) >= F.abs(o)).alias("_abs"), F.count_if(s <= o).alias("_le"),
    )
    n = F.col("valid")
    return agg.select("observed", "edges", "valid", "undefined", "null_mean", "null_stddev", "null_min", "null_max", ((F.col("_ge") + 1) / (n + 1)).alias("p_upper"), ((F.col("_abs") + 1) / (n + 1)).alias("p_two_sided"), F.try_divide(F.col("_le"), n).alias("percentile"), F.try_divide(o - F.col("null_mean"), F.col("null_stddev")).alias("z"))
