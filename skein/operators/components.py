"""Connected components and what is built on them."""

from __future__ import annotations

import math
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.ranking import position
from skein.operators.projection import symmetric
from skein.session import cut, few, united


#: Edges of one node that a task joins.  Of `total` edges at most total / max(HUB, total / MOST_HUBS) <= MOST_HUBS nodes have more, so their list may be broadcast.
HUB, MOST_HUBS = 50_000, 100_000


def _with_least(edges: DataFrame, least: DataFrame, total: int, how: str = "inner") -> DataFrame:
    """edges (u, v) with the m of their u.  least has u, m and the number n of its edges; a hub is spread over a salt for every HUB of them."""
    hub = max(HUB, total // MOST_HUBS)
    if total <= hub:
        return edges.join(least.select("u", "m"), "u", how).select("u", "v", "m")
    salts = F.ceil(F.col("n") / hub).cast("int")
    hubs = least.filter(F.col("n") > hub).select(F.col("u").alias("hub"), salts.alias("salts"))
    dealt = edges.join(F.broadcast(hubs), edges["u"] == hubs["hub"], "left").select("u", "v", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("v"), F.col("salts"))).cast("int").alias("salt"))
    every = F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt")
    return dealt.join(least.select("u", "m", every), ["u", "salt"], how).select("u", "v", "m")


#: Of more edges, one in THINNED is contracted first; most of the others then lie in one component, and go by two joins instead of all steps of a round.
MANY, THINNED = 5_000_000, 16


def connected_components(edges: DataFrame, written: bool = False) -> DataFrame:
    """(node, comp) for the ends of edges (src, dst), which are written once, unless they were; comp is the smallest node reached."""
    now = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))  # repeated edges go in the first round
    now = now if written else cut(now)
    loops = now.filter("u = v").select(F.col("u").alias("node")).distinct()
    now = now.filter("u <> v")
    total = now.count()
    if total <= MANY:
        found = _contracted(now, total)
    else:
        some = cut(now.filter(F.pmod(F.xxhash64("u", "v"), F.lit(THINNED)) == 0))
        first = cut(_contracted(some, some.count()))
        held = some.unionAll(some.select("v", "u")).groupBy("u").agg((F.count("*") * THINNED).alias("n"))
        least = cut(first.select(F.col("node").alias("u"), F.col("comp").alias("m")).join(held, "u"))
        rest = now
        for _ in ("u", "v"):  # each end in turn becomes the component that it was found in
            rest = _with_least(rest, least, 2 * total, "left").select(F.col("v").alias("u"), F.coalesce("m", "u").alias("v"))
        rest = cut(rest.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        last = cut(_contracted(rest, rest.count()))
        moved = first.join(last.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
        found = moved.unionAll(last.join(first, "node", "left_anti"))
    alone = loops.join(found, "node", "left_anti").select("node", F.col("node").alias("comp"))
    return found.unionAll(alone)


def _contracted(now: DataFrame, total: int) -> DataFrame:
    """(node, comp) for the ends of so many edges (u, v), written once, u above v.

    Alternating large-star and small-star contractions: each round is two aggregates and two joins over the edges left, the number of rounds grows with the
    logarithm of the longest path, and no step gathers a component."""
    state = None
    while total:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("least"), F.count("*").alias("n")).select("u", F.least("u", "least").alias("m"), "n")
        large = _with_least(both.filter("v > u"), low, 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _with_least(large, low, total).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        now = cut(small.distinct())
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if new == state:
            break
        state, total = new, new[0]
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def sizes(membership: DataFrame, least: int = 2) -> DataFrame:
    """comp, size and rank (by falling size, then smallest member), of components of at least `least` members."""
    out = membership.groupBy("comp").agg(F.count("*").alias("size")).filter(F.col("size") >= least)
    return position(out, [F.desc("size"), F.asc("comp")])


def with_singletons(membership: DataFrame, nodes: DataFrame) -> DataFrame:
    """membership, and each other node as a component of its own."""
    alone = nodes.join(membership, "node", "left_anti").select("node", F.col("node").alias("comp"))
    return membership.select("node", "comp").unionAll(alone)


def member_offsets(membership: DataFrame) -> DataFrame:
    """Place of each member in its component, by id."""
    return membership.withColumn("offset", F.row_number().over(Window.partitionBy("comp").orderBy("node")) - 1)


def legacy_groups(pairs: DataFrame, least: int = 3, large: int = 15, stronger: int = 2, split: int = 20, chunk: int = 12, smallest: int = 3) -> DataFrame:
    """(node, comp, part): components at weight `least`; one of more than `large` members is taken apart at a weight higher by `stronger`,
    parts under `smallest` go, and one of more than `split` members is chunked by id."""
    base = connected_components(pairs.filter(F.col("total") >= least))
    n = base.groupBy("comp").count()
    small = base.join(n.filter(F.col("count") <= large), "comp").select("node", "comp", F.lit(0).alias("part"))
    big = base.join(n.filter(F.col("count") > large), "comp", "left_semi")
    inner = pairs.filter(F.col("total") >= least + stronger).join(big.select(F.col("node").alias("src")), "src", "left_semi")
    again = connected_components(inner.select("src", "dst"))
    m = again.groupBy("comp").agg(F.count("*").alias("members")).filter(F.col("members") >= smallest)
    placed = member_offsets(again.join(m, "comp"))
    part = F.when(F.col("members") > split, F.floor(F.col("offset") / chunk)).otherwise(0).cast("int")
    chunks = placed.withColumn("part", part)
    kept = chunks.withColumn("held", F.count("*").over(Window.partitionBy("comp", "part"))).filter(F.col("held") >= smallest)
    return small.unionAll(kept.select("node", "comp", "part"))


def bridges(pairs: DataFrame, membership: DataFrame) -> DataFrame:
    """comp, node, external: the member with most pairs to other clusters; the smallest id of equals."""
    a, b = (few(membership.select(F.col("node").alias(e), F.col("comp").alias(f"{e}_comp"))) for e in ("src", "dst"))
    across = pairs.join(a, "src").join(b, "dst").filter("src_comp <> dst_comp")
    ends = symmetric(across.select("src", "dst")).groupBy("node").agg(F.count("*").alias("external")).join(membership, "node")
    first = Window.partitionBy("comp").orderBy(F.desc("external"), "node")
    return ends.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("comp", "node", "external")


def best_and_worst(membership: DataFrame, players: DataFrame, largest_id_wins: bool = False) -> DataFrame:
    """comp, best_op, worst_feed: members with the largest opscore and feedscore (high feed is bad)."""
    own = membership.join(players.select(F.col("id").alias("node"), "opscore", "feedscore"), "node")
    low = lambda c: F.min(F.struct(F.col(c).isNull().alias("unknown"), (-F.col(c)).alias("held"), "node"))["node"]
    high = lambda c: F.max(F.struct(F.col(c).isNotNull().alias("known"), F.col(c).alias("held"), "node"))["node"]
    top = high if largest_id_wins else low
    return own.groupBy("comp").agg(top("opscore").alias("best_op"), top("feedscore").alias("worst_feed"))


def quotient(pairs: DataFrame, membership: DataFrame) -> DataFrame:
    """Distinct (src, dst) clusters that some pair joins, both directions."""
    a, b = (membership.select(F.col("node").alias(e), F.col("comp").alias(f"{e}_comp")) for e in ("src", "dst"))
    across = pairs.join(a, "src").join(b, "dst").filter("src_comp <> dst_comp").select(F.least("src_comp", "dst_comp").alias("src"), F.greatest("src_comp", "dst_comp").alias("dst")).distinct()
    return symmetric(across).select(F.col("node").alias("src"), F.col("other").alias("dst"))


#: Rows that a task of one step of hops makes before repeated ones go, by the mean number of links of a cluster.
STEP_ROWS = 2_000_000


def _reached(step: DataFrame, edge: DataFrame, rows: float) -> DataFrame:
    """Distinct src, dst one link beyond a step (src, dst).  A large step is dealt out by the rows it makes, not by the far fewer it has, so that a task's memory does not grow with it."""
    tasks = math.ceil(rows / STEP_ROWS)
    dealt = step.repartition(tasks, "dst") if tasks > step.sparkSession.sparkContext.defaultParallelism else step
    return dealt.join(edge, "dst").select("src", F.col("next").alias("dst")).distinct()


def hops(links: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """src, dst, hops between clusters that links (both directions) connect, from the sources (src), else from all.  Each step is written once, and kept apart from the two before it."""
    edge = cut(links.select(F.col("src").alias("dst"), F.col("dst").alias("next")).distinct())
    start = edge.select(F.col("dst").alias("src")).distinct()
    degree = edge.count() / max(1, start.count())
    if sources is not None:
        start = start.join(sources.select("src").distinct(), "src", "left_semi")
    steps = [cut(start.select("src", F.col("src").alias("dst"), F.lit(0).alias("hops")))]
    rows = steps[0].count()
    for step in count(1):
        front = _reached(steps[-1], edge, rows * degree)
        new = cut(front.join(united(steps[-2:]).select("src", "dst"), ["src", "dst"], "left_anti").withColumn("hops", F.lit(step)))
        rows = new.count()
        if not rows:
            return united(steps)
        steps.append(new)


def cluster_edges(pairs: DataFrame, membership: DataFrame) -> DataFrame:
    """comp, internal_ally and enemy_or_cross: an edge that is enemy or between clusters counts once for each cluster it touches."""
    a, b = (membership.select(F.col("node").alias(e), F.col("comp").alias(f"{e}_comp")) for e in ("src", "dst"))
    both = pairs.join(a, "src", "left").join(b, "dst", "left")
    inside = F.col("src_comp").eqNullSafe(F.col("dst_comp")) & (F.col("relation") == "ally")
    touched = F.explode(F.array_distinct(F.filter(F.array("src_comp", "dst_comp"), lambda c: c.isNotNull())))
    return both.select(touched.alias("comp"), inside.alias("inside")).groupBy("comp").agg(F.count_if("inside").alias("internal_ally"), F.count_if(~F.col("inside")).alias("enemy_or_cross"))


def orbits(pairs: DataFrame, membership: DataFrame) -> DataFrame:
    """comp, members, cross_ally, neighbours, score: how strongly ally-dominant edges tie a cluster to others."""
    a, b = (membership.select(F.col("node").alias(e), F.col("comp").alias(f"{e}_comp")) for e in ("src", "dst"))
    across = pairs.filter("relation = 'ally'").join(a, "src").join(b, "dst").filter("src_comp <> dst_comp").select(F.col("src_comp").alias("src"), F.col("dst_comp").alias("dst"), "ally")
    per = symmetric(across).groupBy("node").agg(F.sum("ally").alias("cross_ally"), F.countDistinct("other").alias("neighbours")).withColumnRenamed("node", "comp")
    out = membership.groupBy("comp").agg(F.count("*").alias("members")).join(per, "comp", "left").fillna(0, ["cross_ally", "neighbours"])
    return out.withColumn("score", F.log1p("cross_ally") + 0.6 * F.log1p("neighbours") + 0.25 * F.log1p("members"))


def landmark_budget(nodes: int, least: int = 8, most: int = 64) -> int:
    """Half the root of the number of nodes, rounded up to a power of two, within bounds; 0 for no nodes."""
    if not nodes:
        return 0
    want = max(1, -(-int(nodes**0.5 * 1000) // 2000))
    return min(most, max(least, 1 << (want - 1).bit_length()))


def landmarks(pairs: DataFrame, membership: DataFrame, bridge_nodes: DataFrame, budget: int) -> DataFrame:
    """turn, comp, node: landmarks taken in turns from the components of the traversal graph: bridges first, then clustered nodes, then by
    strength, degree and id.  Components take turns by falling size.  pairs were written once."""
    parts = cut(connected_components(pairs.select("src", "dst"), written=True))
    strength = cut(symmetric(pairs.select("src", "dst", "total")).groupBy("node").agg(F.sum("total").alias("strength"), F.count("*").alias("degree")))
    own = parts.join(strength, "node").join(membership.select("node", F.lit(True).alias("clustered")), "node", "left").join(bridge_nodes.select("node", F.lit(True).alias("bridge")), "node", "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).desc()
    turn = F.row_number().over(Window.partitionBy("comp").orderBy(flag("bridge"), flag("clustered"), F.desc("strength"), F.desc("degree"), "node"))
    size = parts.groupBy("comp").agg(F.count("*").alias("size"))
    return own.withColumn("turn", turn).filter(F.col("turn") <= budget).join(size, "comp").orderBy("turn", F.desc("size"), "comp").limit(budget).select("turn", "comp", "node")


def strongest_members(pairs: DataFrame, membership: DataFrame, k: int = 10) -> DataFrame:
    """comp, node, strength, place: the k strongest nodes of each cluster."""
    strength = symmetric(pairs).groupBy("node").agg(F.sum("total").alias("strength"))
    place = F.row_number().over(Window.partitionBy("comp").orderBy(F.desc("strength"), "node"))
    return membership.join(strength, "node").withColumn("place", place).filter(F.col("place") <= k).select("comp", "node", "strength", "place")


#: Nodes of a cluster, and visited nodes, that are shown with a path.  Fixed values.
SHOWN_MEMBERS, SHOWN_VISITED = 10, 200


def shown_members(pairs: DataFrame, membership: DataFrame, preferred: DataFrame, bridge_nodes: DataFrame, star_nodes: DataFrame, k: int = SHOWN_MEMBERS) -> DataFrame:
    """comp, node, place: of each cluster that a preferred node is in, its first members: preferred ones, then bridges, stars, the strongest, then by id.  As many as k, or as there are preferred nodes in all."""
    most = max(k, preferred.count())
    flag = lambda df, name: df.select("node").distinct().withColumn(name, F.lit(True))
    touched = membership.join(preferred, "node", "left_semi").select("comp").distinct()
    strength = symmetric(pairs.select("src", "dst", "total")).groupBy("node").agg(F.sum("total").alias("strength"))
    own = membership.join(touched, "comp", "left_semi").join(strength, "node", "left")
    for df, name in ((preferred, "preferred"), (bridge_nodes, "bridge"), (star_nodes, "star")):
        own = own.join(flag(df, name), "node", "left")
    order = [F.coalesce(F.col(c), F.lit(False)).desc() for c in ("preferred", "bridge", "star")] + [F.coalesce("strength", F.lit(0)).desc(), F.asc("node")]
    return own.withColumn("place", F.row_number().over(Window.partitionBy("comp").orderBy(*order))).filter(F.col("place") <= most).select("comp", "node", "place")


def snapshot(pairs: DataFrame, membership: DataFrame, path: DataFrame, visited: DataFrame, bridge_nodes: DataFrame, star_nodes: DataFrame, mode: str = "social-path", ends: tuple = (), k: int = SHOWN_MEMBERS, most_visited: int = SHOWN_VISITED) -> DataFrame:
    """src, dst, relation, weight: the edges shown with a path (place, node).

    Shown nodes are the ends, the path, the first most_visited of the visited (node) by id, and members of every cluster that these are in.  Between them all edges of the mode show while there is no path;
    with one, an edge between clusters shows on the path alone, nodes without a cluster counting as of one.  The path's own edges always show.  Relation and weight are the mode's: ally and its evidence, or the dominant
    relation and all evidence."""
    spark, kind = pairs.sparkSession, dict(pairs.dtypes)["src"]
    named = spark.createDataFrame([(x,) for x in ends], f"node {kind}")
    preferred = cut(named.union(path.select("node")).union(visited.select("node").distinct().orderBy("node").limit(most_visited)).distinct())
    shown = cut(preferred.union(shown_members(pairs, membership, preferred, bridge_nodes, star_nodes, k).select("node")).distinct())
    steps = path.select("place", F.col("node").alias("a")).join(path.select((F.col("place") - 1).alias("place"), F.col("node").alias("b")), "place")
    steps = cut(steps.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct().withColumn("on_path", F.lit(True)))
    found = not steps.isEmpty()
    inside = pairs.join(shown.withColumnRenamed("node", "src"), "src", "left_semi").join(shown.withColumnRenamed("node", "dst"), "dst", "left_semi")
    for end in ("src", "dst"):
        inside = inside.join(membership.select(F.col("node").alias(end), F.col("comp").alias(f"{end}_comp")), end, "left")
    inside = inside.join(steps, ["src", "dst"], "left")
    on_path, same = F.col("on_path").isNotNull(), F.col("src_comp").eqNullSafe(F.col("dst_comp"))
    social = mode == "social-path"
    allowed = F.col("ally") > 0 if social else F.lit(True)
    out = inside.filter(on_path | (allowed & (same | F.lit(not found))))
    return out.select("src", "dst", (F.lit("ally") if social else F.col("relation")).alias("relation"), (F.greatest("ally", F.lit(1)) if social else F.col("total")).alias("weight"))


def representatives(membership: DataFrame, k: int = 8) -> DataFrame:
    """comp, node, place: the first k members of each cluster by id."""
    place = F.row_number().over(Window.partitionBy("comp").orderBy("node"))
    return membership.select("comp", "node", place.alias("place")).filter(F.col("place") <= k)


def highlights(membership: DataFrame, players: DataFrame) -> DataFrame:
    """comp, node, best_op, worst_feed: the members, and whether each has its cluster's largest opscore or feedscore.  A cluster without known scores has neither."""
    top = best_and_worst(membership, players)
    flag = lambda c: F.coalesce(F.col("node") == F.col(c), F.lit(False)).alias(c)
    return membership.select("comp", "node").join(top, "comp", "left").select("comp", "node", flag("best_op"), flag("worst_feed"))


def scale(pairs: DataFrame, membership: DataFrame) -> DataFrame:
    """One row on a graph: nodes, edges, clusters, shares of ally and enemy edges, mean support, largest and mean cluster, and how many clusters ally edges tie to others or leave alone; zeros where there is nothing."""
    zero = lambda c, name: F.coalesce(c, F.lit(0)).alias(name)
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    ally = F.count_if(F.col("relation") == "ally")
    edges = pairs.agg(F.count("*").alias("edges"), share(ally, F.count("*")).alias("ally_ratio"), share(F.count("*") - ally, F.count("*")).alias("enemy_ratio"), share(F.sum("total"), F.count("*")).alias("mean_support"))
    nodes = symmetric(pairs).agg(F.countDistinct("node").alias("nodes"))
    tied = orbits(pairs, membership).agg(
        F.count("*").alias("clusters"), zero(F.max("members"), "largest_cluster"), share(F.sum("members"), F.count("*")).alias("mean_cluster"),
        F.count_if(F.col("neighbours") > 0).alias("tied_clusters"), F.count_if(F.col("neighbours") == 0).alias("outer_clusters"),
    )
    return nodes.crossJoin(edges).crossJoin(tied)
