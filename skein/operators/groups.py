"""Groups of bounded size: components of ally evidence, the large ones divided greedily, in rounds over all tasks."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.ranking import position
from skein.operators.components import connected_components, with_singletons
from skein.operators.projection import symmetric
from skein.session import cut

MOST = 20


def _free_ties(ties: DataFrame, state: DataFrame) -> DataFrame:
    """node, other, w of the ties between nodes without a group."""
    free = state.filter("head is null").select("node")
    return ties.join(free, "node", "left_semi").join(free.withColumnRenamed("node", "other"), "other", "left_semi")


def _seeded(ties: DataFrame, state: DataFrame, era: int) -> DataFrame:
    """state with a new group for each free node that stands before all of its free neighbours: by the number of these, their support, matches, then id."""
    free = _free_ties(ties, state)
    own = free.groupBy("node").agg(F.count("*").alias("n"), F.sum("w").alias("s"))
    key = F.struct((-F.coalesce("n", F.lit(0))).alias("n"), (-F.coalesce("s", F.lit(0))).alias("s"), (-F.col("matches")).alias("m"), F.col("node").alias("id"))
    keys = cut(state.filter("head is null").select("node", "matches").join(own, "node", "left").select("node", key.alias("key")))
    best = free.join(keys.select(F.col("node").alias("other"), "key"), "other").groupBy("node").agg(F.min("key").alias("near"))
    seeds = keys.join(best, "node", "left").filter(F.col("near").isNull() | (F.col("key") < F.col("near"))).select("node", F.lit(True).alias("_seed"))
    new = F.col("_seed").isNotNull()
    out = state.join(seeds, "node", "left").withColumns({"head": F.when(new, F.col("node")).otherwise(F.col("head")), "era": F.when(new, F.lit(era)).otherwise(F.col("era"))})
    return cut(out.select(*state.columns))


def _grown(ties: DataFrame, state: DataFrame, era: int, most: int) -> DataFrame:
    """state after each open group of this era took the free node with most support to it, then to its seed, then free neighbours, support and smallest id.
    A node that several groups want goes to the one it supports most, then to the smaller seed; the others choose anew in the next step."""
    members = state.filter(F.col("era") == era).select(F.col("node").alias("other"), "head")
    room = members.groupBy("head").agg(F.count("*").alias("size")).filter(F.col("size") < most).select("head")
    near = ties.join(state.filter("head is null").select("node"), "node", "left_semi").join(members, "other").join(room, "head", "left_semi")
    held = near.groupBy("head", "node").agg(F.sum("w").alias("held"), F.sum(F.when(F.col("other") == F.col("head"), F.col("w")).otherwise(0)).alias("to_seed"))
    own = _free_ties(ties, state).groupBy("node").agg(F.count("*").alias("n"), F.sum("w").alias("s"))
    low = lambda c: (-F.coalesce(F.col(c), F.lit(0))).alias(c)
    wanted = held.join(own, "node", "left").groupBy("head").agg(F.min(F.struct(low("held"), low("to_seed"), low("n"), low("s"), "node")).alias("first"))
    given = wanted.select("head", "first.node", "first.held").groupBy("node").agg(F.min(F.struct("held", "head")).alias("taker")).select("node", F.col("taker.head").alias("_to"))
    out = state.join(given, "node", "left").withColumns({"era": F.when(F.col("_to").isNotNull(), F.lit(era)).otherwise(F.col("era")), "head": F.coalesce("head", "_to")})
    return cut(out.select(*state.columns))


def divided(ties: DataFrame, nodes: DataFrame, most: int = MOST) -> DataFrame:
    """node, head: nodes (node, matches) in groups of at most `most`, each called after its seed.  ties: node, other, w in both directions.

    A round starts a group at every node that is best among its free neighbours and lets all these groups grow side by side, one member a step, until none finds another;
    rounds go on until every node has a group.  So groups equal those of growing one group after the other from the best node left wherever groups of a round do not want the same nodes."""
    kind = dict(nodes.dtypes)["node"]
    ties = cut(ties.filter("node <> other"))
    state = cut(nodes.select("node", F.coalesce("matches", F.lit(0)).cast("long").alias("matches"), F.lit(None).cast(kind).alias("head"), F.lit(None).cast("int").alias("era")))
    placed = lambda: state.agg(F.count("head"), F.count("*")).first()
    for era in count(1):
        done, every = placed()
        if done == every:
            return state.select("node", "head")
        state = _seeded(ties, state, era)
        before, _ = placed()
        while True:
            state = _grown(ties, state, era, most)
            now, _ = placed()
            if now == before:
                break
            before = now


def bounded_groups(pairs: DataFrame, players: DataFrame, least: int = 2, most: int = MOST) -> DataFrame:
    """node, group, size: group is numbered by falling size, then smallest member; players without a tie are groups of one.

    Only components above `most` are divided."""
    ties = pairs.filter(F.col("ally") >= least).select("src", "dst", "ally")
    membership = with_singletons(connected_components(ties), players.select(F.col("id").alias("node")))
    membership = cut(membership)
    n = membership.groupBy("comp").agg(F.count("*").alias("members"))
    small = membership.join(n.filter(F.col("members") <= most), "comp").select("node", F.col("comp").alias("head"))
    large = membership.join(n.filter(F.col("members") > most), "comp").select("node", "comp")
    own = large.join(players.select(F.col("id").alias("node"), F.col("match_count").alias("matches")), "node", "left").select("node", "matches")
    inner = symmetric(ties).join(large.select("node"), "node", "left_semi").select("node", "other", F.col("ally").alias("w"))
    heads = cut(divided(inner, own, most))
    named = heads.groupBy("head").agg(F.min("node").alias("least"))
    grouped = heads.join(named, "head").select("node", F.col("least").alias("head"))
    every = cut(small.unionAll(grouped))
    size = every.groupBy("head").agg(F.count("*").alias("size"))
    numbered = position(size, [F.desc("size"), F.asc("head")], "group")
    return every.join(numbered, "head").select("node", "group", "size")
