"""Request-time queries: percentiles, leaderboards, pages, profiles and browsing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.ranking import total_before


def js_round(x: Column, digits: int = 0) -> Column:
    """Halves round up, negative ones too."""
    scale = 10.0**digits
    return F.floor(x * scale + 0.5) / scale


def midrank_percentile(df: DataFrame, value: str, out: str, descending: bool = False) -> DataFrame:
    """(smaller + half of equals) / n * 100, one decimal.  Values are counted before they are ranked, and ranked by ranges."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_c"))
    ranked = total_before(counts, [F.desc(value) if descending else F.asc(value)], F.col("_c"), "_less")
    n = counts.agg(F.sum("_c").alias("_n"))
    p = ranked.crossJoin(F.broadcast(n)).select(value, js_round((F.col("_less") + 0.5 * F.col("_c")) / F.col("_n") * 100, 1).alias(out))
    return df.join(p, value, "left").withColumn(out, F.coalesce(out, F.lit(0.0)))


def leaderboard(players: DataFrame, role: str | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
    """rank, id, label, role, opscore, total, has_more of one page; limit is held to 1 ... 500, ids break ties."""
    limit, offset = max(1, min(500, limit)), max(0, offset)
    own = players.filter((F.col("opscore") > 0) & (F.lit(True) if role is None else F.col("role") == role))
    total = own.agg(F.count("*").alias("total"))
    page = own.orderBy(F.desc("opscore"), "id").offset(offset).limit(limit)
    ranked = page.withColumn("rank", F.lit(offset) + F.row_number().over(Window.orderBy(F.desc("opscore"), "id")))
    return ranked.crossJoin(total).select("rank", "id", "label", "role", "opscore", "total", (F.col("total") > offset + limit).alias("has_more"))


def country_stats(players: DataFrame) -> DataFrame:
    real = F.trim("country") != ""
    return players.filter(real & F.col("opscore").isNotNull() & F.col("feedscore").isNotNull()).groupBy("country").agg(F.count("*").alias("players"), F.round(F.avg("feedscore"), 6).alias("mean_feed"), F.round(F.avg("opscore"), 6).alias("mean_op"), F.sum("match_count").alias("matches"))


def country_tops(stats: DataFrame, k: int = 10) -> DataFrame:
    """The four lists: best and worst countries by either score."""
    lists = []
    for name, col, down in (("best_op", "mean_op", True), ("worst_op", "mean_op", False), ("worst_feed", "mean_feed", True), ("best_feed", "mean_feed", False)):
        top = stats.orderBy(F.desc(col) if down else F.asc(col), "country").limit(k)
        lists.append(top.select(F.lit(name).alias("list"), F.row_number().over(Window.orderBy(F.desc(col) if down else F.asc(col), "country")).alias("place"), "country", F.col(col).alias("value")))
    return reduce(DataFrame.unionAll, lists)


def kda(kills: Column, deaths: Column, assists: Column) -> Column:
    return (kills + assists) / F.greatest(deaths, F.lit(1))


def cluster_profiles(membership: DataFrame, players: DataFrame, bridge_nodes: DataFrame) -> DataFrame:
    """comp, size, means weighted by matches, spread, bridge ratio, share of all members, and the members' ids."""
    own = membership.join(players.select(F.col("id").alias("node"), "opscore", "feedscore", "match_count"), "node", "left").join(bridge_nodes.select("node", F.lit(1).alias("bridge")), "node", "left")
    weighted = lambda c: F.try_divide(F.sum(F.col(c) * F.col("match_count")), F.nullif(F.sum("match_count"), F.lit(0)))
    per = own.groupBy("comp").agg(
        F.count("*").alias("size"), F.round(weighted("opscore"), 4).alias("mean_op"), F.round(weighted("feedscore"), 4).alias("mean_feed"),
        F.round(F.sqrt(F.greatest(F.lit(0.0), F.avg(F.col("opscore") * F.col("opscore")) - F.avg("opscore") * F.avg("opscore"))), 4).alias("op_spread"),
        F.round(F.sum(F.coalesce("bridge", F.lit(0))) / F.count("*"), 4).alias("bridge_ratio"), F.sum("match_count").alias("matches"), F.array_join(F.array_sort(F.collect_set(F.col("node").cast("string"))), ",").alias("members"),
    )
    total = membership.agg(F.count("*").alias("every"))
    return per.crossJoin(total).select("comp", "size", "mean_op", "mean_feed", "op_spread", "bridge_ratio", "matches", "members", F.round(F.col("size") / F.col("every"), 4).alias("size_share"))


def column_stats(players: DataFrame, columns: list[str]) -> DataFrame:
    """column, n, mean, least, most where matches were played; zeros when there is none."""
    own = players.filter("match_count > 0")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return reduce(DataFrame.unionAll, [own.agg(F.lit(c).alias("column"), F.count(c).alias("n"), zero(F.round(F.avg(c), 4)).alias("mean"), zero(F.min(F.col(c).cast("double"))).alias("least"), zero(F.max(F.col(c).cast("double"))).alias("most")) for c in columns])


def browse(df: DataFrame, search: str = "", filters: dict[str, str] | None = None, sort: str | None = None, ascending: bool = True, page: int = 1, page_size: int = 25, key: str | None = None) -> DataFrame:
    """A page of any table: search in any column, filters in named ones, both as case-blind substrings of the text form."""
    def like(column: str, part: str) -> Column:
        return F.contains(F.lower(F.col(column).cast("string")), F.lit(part.lower()))

    out = df
    if search:
        out = out.filter(reduce(lambda a, b: a | b, [F.coalesce(like(c, search), F.lit(False)) for c in df.columns]))
    for column, part in (filters or {}).items():
        out = out.filter(like(column, part))
    size = page_size if page_size in (25, 50, 100) else 25
    order = [F.asc(sort) if ascending else F.desc(sort)] if sort else []
    return out.orderBy(*order, *(F.asc(c) for c in ([key] if key else df.columns))).offset((max(1, page) - 1) * size).limit(size)


def autocomplete(players: DataFrame, text: str, k: int = 8) -> DataFrame:
    """The first k players whose label holds the text, whatever its case, in the order of dictionaries: accents count after letters, case last."""
    label = F.collate("label", "UNICODE_CI")
    return players.filter(F.contains(label, F.lit(text))).orderBy(label, "label", "id").select("id", "label").limit(k)


def preview(column: str, longest: int = 240) -> Column:
    return F.when(F.length(column) > longest, F.concat(F.substring(column, 1, longest), F.lit("…"))).otherwise(F.col(column))


def share_of_max(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with each column divided by its largest value, or by 1e-9 where that is less, and held to 1 at most; null is 0."""
    top = df.agg(*(F.greatest(F.coalesce(F.max(c).cast("double"), F.lit(0.0)), F.lit(1e-9)).alias(f"_top_{c}") for c in columns))
    shares = {c: F.least(F.lit(1.0), F.coalesce(F.col(c).cast("double"), F.lit(0.0)) / F.col(f"_top_{c}")) for c in columns}
    return df.crossJoin(F.broadcast(top)).withColumns(shares).select(*df.columns)


def cluster_export(profiles: DataFrame, artifacts: list[str]) -> DataFrame:
    """The exported form of cluster_profiles: clusters of two or more, artifacts as shares of their maxima, four decimals; nulls are 0."""
    held = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    own = share_of_max(profiles.filter("size >= 2").withColumns({f"a_{a}": F.col(a) for a in artifacts}), [f"a_{a}" for a in artifacts])
    return own.select(
        "comp", "size", js_round(zero("size_share"), 4).alias("size_ratio"), js_round(zero("mean_op"), 4).alias("mean_opscore"), js_round(1 - zero("bridge_ratio"), 4).alias("cohesion"),
        js_round(held(1 - held(zero("op_spread") * 2)), 4).alias("internal_edge_ratio"), js_round(held(zero("mean_feed") / 10), 4).alias("feed_risk"), *(js_round(F.col(f"a_{a}"), 4).alias(f"a_{a}") for a in artifacts),
    )


def run_metadata(pairs: DataFrame, players: DataFrame, membership: DataFrame, analysis: str, schema_version: str, seed: int | None, runs: int) -> DataFrame:
    """One row on an experiment: what ran, its seed, and the sizes of the players, the graph and the clusters it ran on."""
    nodes = pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct().agg(F.count("*").alias("runtime_nodes"))
    sizes = [players.agg(F.count("*").alias("filtered_nodes")), nodes, pairs.agg(F.count("*").alias("pair_relations")), membership.agg(F.countDistinct("comp").alias("runtime_clusters"))]
    named = [F.lit(analysis).alias("analysis_type"), F.lit(schema_version).alias("schema_version"), F.lit(seed).cast("long").alias("seed"), F.lit(runs).cast("long").alias("run_count")]
    return reduce(DataFrame.crossJoin, sizes).select(*named, "filtered_nodes", "runtime_nodes", "pair_relations", "runtime_clusters")
