"""The signed co-presence graph: pairs of participants, and views of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COST_SCALE = 1_000_000


def pair_relations(participants: DataFrame, tasks: int | None = None) -> DataFrame:
    """src, dst, ally, enemy, total, relation: evidence of each unordered pair.  Pairs are made of positions in a match, so a player that stands in it twice pairs with itself.

    With tasks, pairs are dealt out to so many by their ends and summed there, none held before; else they are summed in each task first, and Spark chooses the number."""
    a, b = participants.alias("a"), participants.alias("b")
    ally = (F.col("a.team") == F.col("b.team")).cast("int")
    pairs = a.join(b, (F.col("a.match_id") == F.col("b.match_id")) & (F.col("a.pos") < F.col("b.pos"))).select(
        F.least("a.player_id", "b.player_id").alias("src"), F.greatest("a.player_id", "b.player_id").alias("dst"), ally.alias("ally")
    )
    if tasks:
        pairs = pairs.repartition(tasks, "src", "dst")
    out = pairs.groupBy("src", "dst").agg(F.sum("ally").alias("ally"), F.count("*").alias("total"))
    return out.withColumn("enemy", F.col("total") - F.col("ally")).select("src", "dst", "ally", "enemy", "total", relation("ally", "enemy").alias("relation"))


def relation(ally: str, enemy: str) -> Column:
    """A tie counts as ally."""
    return F.when(F.col(ally) >= F.col(enemy), "ally").otherwise("enemy")


def eligible(players: DataFrame) -> DataFrame:
    """Players with an id and a known label."""
    label = F.trim("label")
    return players.filter(F.col("id").isNotNull() & (F.trim(F.col("id").cast("string")) != "") & (label != "") & ~label.isin("Unknown", "Unknown#Unknown"))


def eligible_participants(participants: DataFrame, ids: DataFrame, least: int = 2) -> DataFrame:
    """Participants among ids, in matches that have at least `least` of them."""
    own = participants.join(ids.select(F.col("id").alias("player_id")).distinct(), "player_id", "left_semi")
    enough = own.groupBy("match_id").count().filter(F.col("count") >= least).select("match_id")
    return own.join(enough, "match_id", "left_semi")


def support(mode: str) -> Column:
    """Evidence of an edge by mode: social-path counts allies, battle-path all."""
    return {"social-path": F.col("ally"), "battle-path": F.col("total")}[mode]


def traversal_cost(weight: Column) -> Column:
    """ceil(scale / max(1, weight)) in integers."""
    w = F.greatest(weight, F.lit(1))
    return F.floor((F.lit(COST_SCALE) + w - 1) / w).cast("long")


def symmetric(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, as node and other."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other"))))
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(ends.alias("e"), *rest).select("e.node", "e.other", *rest)


def node_metrics(pairs: DataFrame) -> DataFrame:
    """Degrees and support of each node."""
    ally = F.col("relation") == "ally"
    return symmetric(pairs).groupBy("node").agg(
        F.count("*").alias("degree"), F.count_if(ally).alias("ally_degree"), F.count_if(~ally).alias("enemy_degree"),
        F.sum("total").alias("support"), F.sum("ally").alias("ally_support"), F.sum("enemy").alias("enemy_support"),
    )


def visible_nodes(pairs: DataFrame, least: int = 2) -> DataFrame:
    return symmetric(pairs.filter(F.col("total") >= least)).select("node").distinct()


def connected_subgraph(pairs: DataFrame, least: int) -> DataFrame:
    """All edges among the nodes that some edge of at least that weight touches: weaker edges between kept nodes stay."""
    kept = visible_nodes(pairs, least)
    return pairs.join(kept.withColumnRenamed("node", "src"), "src", "left_semi").join(kept.withColumnRenamed("node", "dst"), "dst", "left_semi").select(*pairs.columns)


def mode_summary(pairs: DataFrame, least: int) -> DataFrame:
    """Candidate and supported edges of each mode."""
    parts = [pairs.agg(F.lit(m).alias("mode"), F.count_if(support(m) > 0).alias("candidates"), F.count_if(support(m) >= least).alias("supported"), F.coalesce(F.sum(support(m)), F.lit(0)).alias("evidence")) for m in ("social-path", "battle-path")]
    return parts[0].unionAll(parts[1])


def edge_class(pairs: DataFrame, membership: DataFrame) -> DataFrame:
    """pairs with the clusters of both ends and the view class: enemy, ally-internal or ally-bridge.  membership: node, comp."""
    a, b = (membership.select(F.col("node").alias(end), F.col("comp").alias(f"{end}_cluster")) for end in ("src", "dst"))
    out = pairs.join(a, "src", "left").join(b, "dst", "left")
    view = F.when(F.col("relation") == "enemy", "enemy").when(F.col("src_cluster").eqNullSafe(F.col("dst_cluster")), "ally-internal").otherwise("ally-bridge")
    return out.withColumn("view", view)


def neighbours(pairs: DataFrame, k: int | None = None) -> DataFrame:
    """Neighbours of each node, strongest first, ids breaking ties; the first k where k is given, chosen before they are gathered."""
    own = symmetric(pairs).select("node", (-F.col("total")).alias("minus"), "other")
    if k is not None:
        place = F.row_number().over(Window.partitionBy("node").orderBy("minus", "other"))
        own = own.withColumn("_place", place).filter(F.col("_place") <= k)
    ordered = F.array_sort(F.collect_list(F.struct("minus", "other")))
    return own.groupBy("node").agg(F.transform(ordered, lambda x: x["other"]).alias("neighbours"))
