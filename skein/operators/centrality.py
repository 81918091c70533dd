"""Betweenness centrality.

`betweenness` makes one Brandes accumulation for each source node, sources spread over tasks, with the graph broadcast as sorted arrays; a graph above a bounded size goes by joins.
`betweenness_by_joins` keeps the graph in Spark: a batch of sources goes through the graph together, forward over the rows of its shortest-path graphs, counting paths, and
backward, summing dependencies.  Exact with all nodes as sources; with a sample of them an estimate whose error `sampling_error` bounds.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.ranking import position
from skein.operators.paths import bfs_levels
from skein.operators.projection import COST_SCALE, support, symmetric, traversal_cost
from skein.session import cut, reaching, united


#: Edges that a task goes over at a time, about; as many sources go through the graph together as have so many.
AT_ONCE = 100_000


def _edges_of(start: np.ndarray, at: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in at, and places of the edges of the nodes there, about `most` edges at a time."""
    n = start[at + 1] - start[at]
    ends = np.cumsum(n)
    cuts = np.unique(np.searchsorted(ends, np.arange(most, ends[-1], most)) + 1) if len(at) else []
    for part in np.split(np.arange(len(at)), cuts):
        own = np.repeat(part, n[part])
        yield own, np.arange(len(own)) + np.repeat(start[at[part]] - (np.cumsum(n[part]) - n[part]), n[part])


def dependencies(start: np.ndarray, other: np.ndarray, cost: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """What each node contributes to the shortest paths from the sources, summed.  Edges stand in both directions, with costs above 0.

    All sources go through the graph together, by rising distance.  The edges of a node are read once, when its distance is the least left: those from nearer nodes count its paths, the others are relaxed."""
    n, size = len(start) - 1, len(sources) * (len(start) - 1)
    sigma, dist, seen = np.zeros(size), np.full(size, np.iinfo(np.int64).max), np.zeros(size, bool)
    first = np.arange(len(sources)) * n + sources
    sigma[first], dist[first] = 1, 0
    pending, heap, steps = {0: [first]}, [0], []
    while heap:
        d = heapq.heappop(heap)
        level = np.concatenate(pending.pop(d))
        level = level[dist[level] == d]
        for own, k in _edges_of(start, level % n, AT_ONCE):
            at = level[own]
            to, new = at - at % n + other[k], d + cost[k]
            known = dist[to]
            before = np.flatnonzero(known + cost[k] == d) if d else np.zeros(0, np.int64)
            if len(before):
                a, b = at[before], to[before]
                np.add.at(sigma, a, sigma[b])
                steps.append((a, b))
            nearer = np.flatnonzero(new < known)
            if not len(nearer):
                continue
            to, new = to[nearer], new[nearer]
            np.minimum.at(dist, to, new)
            if len(to) > size // 8:
                seen[to] = True
                found = np.flatnonzero(seen)
                seen[found] = False
            else:
                found = np.unique(to)
            held = dist[found]
            for x in np.unique(held).tolist():
                if x not in pending:
                    pending[x] = []
                    heapq.heappush(heap, x)
                pending[x].append(found[held == x])
    out = np.zeros(size)
    while steps:
        a, b = steps.pop()
        np.add.at(out, b, sigma[b] / sigma[a] * (1 + out[a]))
    out[first] = 0
    return out.reshape(len(sources), n).sum(axis=0)


def betweenness(pairs: DataFrame, labels: DataFrame, mode: str = "social-path", weighted: bool = True, min_support: int = 1, most_edges: int = 5_000_000) -> DataFrame:
    """node, label, degree, strength, raw, normalised, rank.  labels: node, label.

    The projected graph is broadcast, so its edges are counted first; above most_edges the same is done by joins."""
    spark = pairs.sparkSession
    edges = pairs.filter((support(mode) > 0) & (support(mode) >= min_support)).select("src", "dst", support(mode).alias("w"))
    if edges.count() > most_edges:
        return betweenness_by_joins(pairs, labels, mode, weighted, min_support)
    rows = edges.toPandas()
    nodes = np.unique(np.concatenate((rows["src"].to_numpy(), rows["dst"].to_numpy()))) if len(rows) else np.zeros(0, np.int64)
    a, b = np.searchsorted(nodes, rows["src"].to_numpy()), np.searchsorted(nodes, rows["dst"].to_numpy())
    w = rows["w"].to_numpy().astype(np.int64)
    cost = (COST_SCALE + np.maximum(w, 1) - 1) // np.maximum(w, 1) if weighted else np.ones(len(w), np.int64)
    ends, others, costs = np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((cost, cost))
    order = np.lexsort((others, ends))
    shared = spark.sparkContext.broadcast((np.searchsorted(ends[order], np.arange(len(nodes) + 1)), others[order], costs[order]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, other, price = shared.value
        total = np.zeros(len(start) - 1)
        many = max(1, AT_ONCE // max(len(other), len(total)))
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for at in range(0, len(ids), many):
                total += dependencies(start, other, price, ids[at : at + many])
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], ["k", "part"])

    tasks = max(1, min(len(nodes), 4 * spark.sparkContext.defaultParallelism))
    part = spark.range(0, len(nodes), 1, tasks).mapInArrow(work, "k long, part double").groupBy("k").agg((F.sum("part") / 2).alias("raw"))
    n = len(nodes)
    kind = dict(pairs.dtypes)["src"]
    index = spark.createDataFrame([(k, v.item() if hasattr(v, "item") else v) for k, v in enumerate(nodes)], f"k long, node {kind}")
    degree = symmetric(edges).groupBy("node").agg(F.count("*").alias("degree"), F.sum("w").alias("strength"))
    scale = (n - 1) * (n - 2) / 2
    out = index.join(part, "k", "left").join(degree, "node").join(labels, "node", "left").select("node", F.coalesce("label", F.col("node").cast("string")).alias("label"), "degree", "strength", F.coalesce("raw", F.lit(0.0)).alias("raw"))
    out = out.withColumn("normalised", F.col("raw") / scale if scale > 0 else F.lit(0.0))
    return position(out, [F.desc("raw"), F.desc("degree"), F.desc("strength"), F.asc("label"), F.asc("node")])


def shortest_edges(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """source, v, w, n_in: the edges (v, w) of the shortest-path graph of each source, and how many of them lead to w.  edges: node, other, cost; sources: source."""
    start = sources.select("source", F.col("source").alias("node"), F.lit(0).cast("long").alias("distance"))
    best = front = cut(start)
    rows = best.count()
    while True:
        reach = reaching(front, edges, rows).groupBy("source", "other").agg(F.min(F.col("distance") + F.col("cost")).alias("new")).withColumnRenamed("other", "node")
        nearer = reach.join(best, ["source", "node"], "left").filter(F.col("distance").isNull() | (F.col("new") < F.col("distance")))
        front = cut(nearer.select("source", "node", F.col("new").alias("distance")))
        rows = front.count()
        if not rows:
            break
        best = cut(united([best.join(front, ["source", "node"], "left_anti"), front]))
    reached = best.select("source", F.col("node").alias("w"), "distance")
    steps = cut(reaching(best, edges, best.count()).select("source", F.col("node").alias("v"), F.col("other").alias("w"), (F.col("distance") + F.col("cost")).alias("distance")).join(reached, ["source", "w", "distance"]).select("source", "v", "w"))
    return cut(steps.join(steps.groupBy("source", "w").agg(F.count("*").alias("n_in")), ["source", "w"]))


def path_counts(steps: DataFrame, sources: DataFrame) -> list[DataFrame]:
    """source, node, sigma: the number of shortest paths, in rounds; a node is in the round after the last of those before it, so its count is whole when it is passed on."""
    rounds = [cut(sources.select("source", F.col("source").alias("node"), F.lit(1.0).alias("sigma")))]
    waiting = None
    while True:
        passed = rounds[-1].withColumnRenamed("node", "v").join(steps, ["source", "v"]).select("source", F.col("w").alias("node"), "sigma", F.lit(1).cast("long").alias("told"), "n_in")
        held = passed if waiting is None else passed.unionByName(waiting)
        held = cut(held.groupBy("source", "node").agg(F.sum("sigma").alias("sigma"), F.sum("told").alias("told"), F.max("n_in").alias("n_in")))
        ready = cut(held.filter(F.col("told") == F.col("n_in")).select("source", "node", "sigma"))
        if ready.isEmpty():
            return rounds
        rounds.append(ready)
        waiting = held.filter(F.col("told") < F.col("n_in"))


def dependencies_by_level(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """dependencies_of where every edge costs the same and stands in both directions: a round for each level forward and one backward, over the edges of that level.  Only levels are written, a row for each source and node."""
    levels = [cut(sources.select("source", F.col("source").alias("node"), F.lit(1.0).alias("sigma")))]
    sizes = [levels[0].count()]
    while sizes[-1]:
        reach = reaching(levels[-1], edges, sizes[-1]).groupBy("source", "other").agg(F.sum("sigma").alias("sigma")).withColumnRenamed("other", "node")
        levels.append(cut(reach.join(united(levels[-2:]).select("source", "node"), ["source", "node"], "left_anti").select("source", "node", "sigma")))
        sizes.append(levels[-1].count())
    found, last = [], levels[-2].withColumn("delta", F.lit(0.0))
    for at in range(len(levels) - 3, 0, -1):  # the last level has no dependencies, and those on the source itself don't count
        told = reaching(last.select("source", "node", ((F.col("delta") + 1) / F.col("sigma")).alias("share")), edges, sizes[at + 1])
        told = told.groupBy("source", "other").agg(F.sum("share").alias("share")).withColumnRenamed("other", "node")
        last = cut(levels[at].join(told, ["source", "node"], "left").select("source", "node", "sigma", (F.col("sigma") * F.coalesce("share", F.lit(0.0))).alias("delta")))
        found.append(last.groupBy("node").agg(F.sum("delta").alias("part")))
    if not found:
        return sources.select(F.col("source").alias("node"), F.lit(0.0).alias("part")).limit(0)
    return united(found).groupBy("node").agg(F.sum("part").alias("part"))


def dependencies_of(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """node, part: the dependencies of the sources on each node, summed.  edges: node, other, each written once, and cost, unless all cost the same."""
    if "cost" not in edges.columns:
        return dependencies_by_level(edges, sources)
    steps = shortest_edges(edges, sources)
    rounds = path_counts(steps, sources)
    number = united([r.select("source", F.col("node").alias("v"), F.lit(k).alias("turn")) for k, r in enumerate(rounds)])
    back = cut(steps.join(number, ["source", "v"]).select("source", "v", F.col("w").alias("node"), "turn"))
    found, waiting = [], None
    for turn in range(len(rounds) - 1, 0, -1):
        own = rounds[turn]
        if waiting is None:
            own = own.withColumn("share", F.lit(0.0))
        else:
            own = own.join(waiting.filter(F.col("turn") == turn).select("source", F.col("v").alias("node"), "share"), ["source", "node"], "left").fillna(0.0, ["share"])
        own = cut(own.withColumn("delta", F.col("sigma") * F.col("share")))
        found.append(own.groupBy("node").agg(F.sum("delta").alias("part")))
        passed = own.join(back, ["source", "node"]).select("source", "v", "turn", ((F.col("delta") + 1) / F.col("sigma")).alias("share"))
        held = passed if waiting is None else passed.unionByName(waiting.filter(F.col("turn") < turn))
        waiting = cut(held.groupBy("source", "v", "turn").agg(F.sum("share").alias("share")))
    if not found:
        return sources.select(F.col("source").alias("node"), F.lit(0.0).alias("part")).limit(0)
    return united(found).groupBy("node").agg(F.sum("part").alias("part"))


def sampling_error(sources: int, nodes: int, confidence: float = 0.95) -> float:
    """What normalised estimates from sampled sources are off by at most, for all nodes together, at this confidence: a source's dependency on a node is at most nodes - 2 (Hoeffding, and a union over the nodes)."""
    return nodes / (nodes - 1) * math.sqrt(math.log(2 * nodes / (1 - confidence)) / (2 * sources)) if nodes > 2 else 0.0


def betweenness_by_joins(pairs: DataFrame, labels: DataFrame, mode: str = "social-path", weighted: bool = True, min_support: int = 1, sources: int | None = None, seed: int = 1, rows_at_once: int = 200_000_000) -> DataFrame:
    """node, label, degree, strength, raw, normalised, rank.  labels: node, label.

    sources: how many nodes to start from, chosen by a seeded hash; all where it is None.  A batch holds as many sources as give about rows_at_once rows of sources times edges, one at least."""
    half = cut(pairs.filter((support(mode) > 0) & (support(mode) >= min_support) & (F.col("src") != F.col("dst"))).select("src", "dst", support(mode).alias("w")))
    edges = symmetric(half)
    own = cut(edges.groupBy("node").agg(F.count("*").alias("degree"), F.sum("w").alias("strength")))
    n = own.count()
    k = n if sources is None else min(n, sources)
    order = cut(position(own.select(F.col("node").alias("source")), [F.xxhash64(F.col("source"), F.lit(seed)), F.asc("source")], "turn").filter(F.col("turn") <= k))
    if k < n:  # edges that no source reaches are on none of its paths
        reached = cut(bfs_levels(edges, order.select(F.col("source").alias("node")), both_ways=True, written=True).select("node"))
        edges = symmetric(half.join(reached.withColumnRenamed("node", "src"), "src", "left_semi"))
    priced = cut(edges.select("node", "other", *([traversal_cost(F.col("w")).alias("cost")] if weighted else [])))
    m = priced.count()
    batch = max(1, rows_at_once // max(1, m))
    parts = [cut(dependencies_of(priced, cut(order.filter((F.col("turn") > at) & (F.col("turn") <= at + batch)).select("source")))) for at in range(0, k, batch)]
    total = united(parts).groupBy("node").agg((F.sum("part") / 2 * n / max(1, k)).alias("raw")) if parts else None
    scale = (n - 1) * (n - 2) / 2
    out = own.join(total, "node", "left") if total is not None else own.withColumn("raw", F.lit(0.0))
    out = out.join(labels, "node", "left").select("node", F.coalesce("label", F.col("node").cast("string")).alias("label"), "degree", "strength", F.coalesce("raw", F.lit(0.0)).alias("raw"))
    out = out.withColumn("normalised", F.col("raw") / scale if scale > 0 else F.lit(0.0))
    return position(out, [F.desc("raw"), F.desc("degree"), F.desc("strength"), F.asc("label"), F.asc("node")])
