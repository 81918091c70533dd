"""Signed triads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.projection import symmetric

#: Patterns by number of negative edges, and whether they are balanced.
PATTERNS = [("+++", True), ("++-", False), ("+--", True), ("---", False)]


def sign(policy: str = "exclude"):
    """1 where allies prevail, -1 where enemies do; a tie by policy: exclude, ally or enemy."""
    tie = {"exclude": F.lit(None).cast("int"), "ally": F.lit(1), "enemy": F.lit(-1)}[policy]
    return F.when(F.col("ally") > F.col("enemy"), 1).when(F.col("ally") < F.col("enemy"), -1).otherwise(tie)


def signed_edges(pairs: DataFrame, least: int = 2, policy: str = "exclude") -> DataFrame:
    return pairs.filter(F.col("total") >= least).withColumn("sign", sign(policy)).filter("sign is not null").select("src", "dst", "sign")


def closed_wedges(edges: DataFrame) -> DataFrame:
    """x, y, z of each triangle of edges (src, dst, own), and what its three edges carry as own1, own2, own3.
    Each edge points from its end of lower degree to the other, so wedges are few even at hubs."""
    degree = symmetric(edges.select("src", "dst")).groupBy("node").agg(F.count("*").alias("d"))
    both = edges.filter("src <> dst").join(degree.select(F.col("node").alias("src"), F.col("d").alias("ds")), "src").join(degree.select(F.col("node").alias("dst"), F.col("d").alias("dd")), "dst")
    up = F.struct("ds", "src") < F.struct("dd", "dst")
    out = both.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("lo"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("hi"), "own")
    a, b = out.alias("a"), out.alias("b")
    wedges = a.join(b, (F.col("a.lo") == F.col("b.lo")) & (F.col("a.hi") < F.col("b.hi"))).select(F.col("a.lo").alias("x"), F.col("a.hi").alias("y"), F.col("b.hi").alias("z"), F.col("a.own").alias("own1"), F.col("b.own").alias("own2"))
    return wedges.join(edges.select(F.col("src").alias("y"), F.col("dst").alias("z"), F.col("own").alias("own3")), ["y", "z"])


def triads(edges: DataFrame) -> DataFrame:
    """a < b < c with the number of negative edges, and whether the triad is balanced."""
    closed = closed_wedges(edges.select("src", "dst", F.col("sign").alias("own")))
    nodes = F.array_sort(F.array("x", "y", "z"))
    return closed.select(nodes[0].alias("a"), nodes[1].alias("b"), nodes[2].alias("c"), ((3 - F.col("own1") - F.col("own2") - F.col("own3")) / 2).cast("int").alias("negatives")).withColumn("balanced", F.col("negatives") % 2 == 0)


def distribution(found: DataFrame) -> DataFrame:
    """pattern, balanced, triads: all four patterns, with zeros."""
    spark = found.sparkSession
    names = spark.createDataFrame([(k, p, b) for k, (p, b) in enumerate(PATTERNS)], "negatives int, pattern string, balanced boolean")
    return names.join(found.groupBy("negatives").agg(F.count("*").alias("triads")), "negatives", "left").select("pattern", "balanced", F.coalesce("triads", F.lit(0)).alias("triads"))


def ratio(a, b):
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def node_summary(found: DataFrame) -> DataFrame:
    """node, total, unbalanced, instability."""
    per = found.select(F.explode(F.array("a", "b", "c")).alias("node"), "balanced").groupBy("node").agg(F.count("*").alias("total"), F.count_if(~F.col("balanced")).alias("unbalanced"))
    return per.withColumn("instability", ratio(F.col("unbalanced"), F.col("total")))


def top_unbalanced(found: DataFrame, labels: DataFrame, k: int = 10) -> DataFrame:
    """The k nodes with most unbalanced triads.  labels: node, label."""
    out = node_summary(found).join(labels, "node", "left").withColumn("label", F.coalesce("label", F.col("node").cast("string")))
    return out.orderBy(F.desc("unbalanced"), F.desc("total"), F.desc("instability"), "label", "node").limit(k)


def cluster_summary(found: DataFrame, membership: DataFrame) -> DataFrame:
    """comp, size, local_triads, balanced_count, unbalanced_count, balanced_ratio over triads inside one cluster."""
    out = found
    for end in ("a", "b", "c"):
        out = out.join(membership.select(F.col("node").alias(end), F.col("comp").alias(f"k{end}")), end)
    per = out.filter("ka = kb and kb = kc").groupBy(F.col("ka").alias("comp")).agg(F.count("*").alias("local_triads"), F.count_if("balanced").alias("balanced_count"))
    size = membership.groupBy("comp").agg(F.count("*").alias("size"))
    return per.join(size, "comp").select("comp", "size", "local_triads", "balanced_count", (F.col("local_triads") - F.col("balanced_count")).alias("unbalanced_count"), ratio(F.col("balanced_count"), F.col("local_triads")).alias("balanced_ratio"))


def examples(found: DataFrame, k: int = 2) -> DataFrame:
    """The first k triads of each pattern."""
    out = found.withColumn("n", F.row_number().over(Window.partitionBy("negatives").orderBy("a", "b", "c"))).filter(F.col("n") <= k)
    pattern = F.element_at(F.array(*[F.lit(p) for p, _ in PATTERNS]), F.col("negatives") + 1)
    return out.select(pattern.alias("pattern"), "n", "a", "b", "c")


def sweep(pairs: DataFrame, supports: list[int], policies: list[str]) -> DataFrame:
    """min_support, tie_policy, edges, triads, balanced, ratio of each setting.

    Triads are made once, at the least support with all ties; each carries its support, its ties and the sign of its other edges, and one aggregate counts it in every setting that has it."""
    least = sorted({max(1, s) for s in supports})
    settings = [(s, policy) for s in least for policy in policies]
    for policy in policies:
        sign(policy)  # unknown policies are errors
    own = F.struct("total", (F.col("ally") == F.col("enemy")).cast("int").alias("tie"), F.coalesce(sign("ally"), F.lit(1)).alias("sign"))
    edges = pairs.filter(F.col("total") >= least[0]).select("src", "dst", own.alias("own"))
    three = [F.col(f"own{k}") for k in (1, 2, 3)]
    found = closed_wedges(edges).select(F.least(*(o["total"] for o in three)).alias("support"), sum(o["tie"] for o in three).alias("ties"), (three[0]["sign"] * three[1]["sign"] * three[2]["sign"]).alias("sign"))
    here = lambda s, policy, support, ties: (support >= s) & (F.lit(policy != "exclude") | (ties == 0))
    even = lambda policy: F.col("sign") * F.when(F.lit(policy == "enemy") & (F.col("ties") % 2 == 1), -1).otherwise(1) > 0  # noqa: E731  a tie's sign is that of allies
    counts = [c for k, (s, policy) in enumerate(settings) for held in [here(s, policy, F.col("support"), F.col("ties"))] for c in (F.count_if(held).alias(f"triads{k}"), F.count_if(held & even(policy)).alias(f"balanced{k}"))]
    lines = [F.count_if(here(s, policy, F.col("own.total"), F.col("own.tie"))).alias(f"edges{k}") for k, (s, policy) in enumerate(settings)]
    rows = F.explode(F.array(*(F.struct(F.lit(s).alias("min_support"), F.lit(policy).alias("tie_policy"), *(F.col(f"{c}{k}").alias(c) for c in ("edges", "triads", "balanced"))) for k, (s, policy) in enumerate(settings))))
    out = edges.agg(*lines).crossJoin(found.agg(*counts)).select(rows.alias("r")).select("r.*")  # one row beside one row
    return out.withColumn("balanced_ratio", ratio(F.col("balanced"), F.col("triads")))


def sweep_summary(runs: DataFrame) -> DataFrame:
    with_triads = F.when(F.col("triads") > 0, F.col("balanced_ratio"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return runs.agg(F.count("*").alias("runs"), F.count_if(F.col("triads") > 0).alias("runs_with_triads"), F.count_if(F.col("triads") == 0).alias("runs_without_triads"), zero(F.min(with_triads)).alias("min_ratio"), zero(F.max(with_triads)).alias("max_ratio"), zero(F.avg(with_triads)).alias("mean_ratio"))
