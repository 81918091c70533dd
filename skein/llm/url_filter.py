"""URL verdicts from host and path rules and, where no rule fits, from gradient-boosted trees on lexical features.

All of it is DataFrame and SQL functions: features are column expressions, each level of a tree is chosen from one
aggregated histogram, and the finished trees are one expression that whole-stage code generation compiles.

Features: lengths of url, host and path, path depth, parameters, digit ratio, character entropy, host labels, hyphens, and the
smoothed share of blocked urls among the other labelled ones with the same last host label and the same last two.  The trees are
symmetric: one split for each level.  They are fitted on at most `max_train` different labelled urls, chosen by a hash of the url, so the
suffix table has at most that many rows and may be broadcast.

Defined cases: a null url or one without `://` has an empty host and path, fits no rule and is judged by the trees; with no
labelled urls, or of one verdict only, that verdict (else allow) holds for all.  Repeated rows each get a row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import cut

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: (verdict, host, path), fixed by the contract.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), ALPHABET, ALPHABET.lower())
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def lexical(df: DataFrame, url: str = "url") -> DataFrame:
    """df with host, path, the two suffixes and the lexical features x0 ... x8."""
    host, path = host_and_path(F.col(url))
    df = df.withColumns({"host": host, "path": path, "_u": F.coalesce(F.col(url), F.lit(""))})
    size = F.greatest(F.length("_u"), F.lit(1)).cast("double")
    count = lambda c, chars: (F.length(c) - F.length(F.translate(F.col(c), chars, ""))).cast("double")
    chars = F.array_distinct(F.split(F.col("_u"), ""))
    entropy = F.aggregate(F.transform(chars, lambda c: (F.length("_u") - F.length(F.replace(F.col("_u"), c, F.lit("")))) / size), F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    labels = F.split("host", r"\.")
    return df.withColumns({
        "x0": size, "x1": F.length("host").cast("double"), "x2": F.length("path").cast("double"), "x3": count("path", "/"), "x4": F.when(F.instr("_u", "?") > 0, count("_u", "&") + 1).otherwise(0.0),
        "x5": count("_u", "0123456789") / size, "x6": entropy, "x7": F.size(labels).cast("double"), "x8": count("host", "-"),
        "s1": F.coalesce(F.try_element_at(labels, F.lit(-1)), F.lit("")), "s2": F.concat_ws(".", F.slice(F.concat(F.array(F.lit("")), labels), -2, 2)),
    })


N_LEXICAL = 9


@dataclass
class Trees:
    """prior: log odds of block. trees: the (feature, threshold) of each level, and the leaves, the first level as the highest bit."""

    prior: float
    trees: list[tuple[list[tuple[int, float]], list[float]]]
    suffixes: dict[int, DataFrame]

    def with_features(self, df: DataFrame) -> DataFrame:
        for k, rates in self.suffixes.items():
            df = df.join(F.broadcast(rates), f"s{k}", "left").withColumn(f"x{N_LEXICAL - 1 + k}", F.coalesce(F.col(f"rate{k}"), F.lit(0.5)))
        return df

    def margin(self) -> Column:
        return reduce(lambda s, t: s + _leaf_value(*t), self.trees, F.lit(float(self.prior)))


def _leaf(splits: list[tuple[int, float]]) -> Column:
    return reduce(lambda leaf, s: leaf * 2 + (F.col(f"x{s[0]}") > F.lit(s[1])).cast("int"), splits, F.lit(0))


def _leaf_value(splits: list[tuple[int, float]], values: list[float]) -> Column:
    if not splits:
        return F.lit(values[0])
    (f, at), half = splits[0], len(values) // 2
    return F.when(F.col(f"x{f}") > F.lit(at), _leaf_value(splits[1:], values[half:])).otherwise(_leaf_value(splits[1:], values[:half]))


def fit(labelled: DataFrame, max_train: int = 20000, n_trees: int = 10, depth: int = 3, n_bins: int = 12, rate: float = 0.4, l2: float = 1.0) -> Trees:
    """labelled has url and label (1: block). Fits on at most max_train rows."""
    sample = labelled.filter("url is not null and label is not null").groupBy("url").agg(F.max("label").alias("label")).orderBy(F.xxhash64("url"), "url").limit(max_train)
    base = cut(lexical(sample.select("url", F.col("label").cast("double").alias("label"))).drop("_u", "host", "path"))
    n, blocked = base.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if n == 0 or blocked in (0, n):
        return Trees(-1.0 if blocked == 0 else 1.0, [], {})
    sums = {k: cut(base.groupBy(f"s{k}").agg(F.sum("label").alias(f"b{k}"), F.count("*").alias(f"n{k}"))) for k in (1, 2)}
    model = Trees(math.log((blocked + 1) / (n - blocked + 1)), [], {k: v.select(f"s{k}", ((F.col(f"b{k}") + 1) / (F.col(f"n{k}") + 2)).alias(f"rate{k}")) for k, v in sums.items()})
    for k, v in sums.items():  # the trees see shares without the row's own label
        base = base.join(F.broadcast(v), f"s{k}").withColumn(f"x{N_LEXICAL - 1 + k}", (F.col(f"b{k}") - F.col("label") + 1) / (F.col(f"n{k}") + 1))
    data = cut(base.drop("s1", "s2", "b1", "b2", "n1", "n2").coalesce(8))
    names = [f"x{i}" for i in range(N_LEXICAL + 2)]
    quantiles = data.agg(*[F.percentile_approx(c, [i / n_bins for i in range(1, n_bins)], 10000).alias(c) for c in names]).first()
    edges = [sorted(set(quantiles[c])) for c in names]
    bins = F.array(*[reduce(lambda s, e, c=c: s + (F.col(c) > F.lit(e)).cast("int"), at, F.lit(0)) for c, at in zip(names, edges, strict=True)])
    for _ in range(n_trees):
        p = 1 / (1 + F.exp(-model.margin()))
        step = data.withColumns({"g": F.col("label") - p, "h": p * (1 - p), "bins": bins})
        splits: list[tuple[int, float]] = []
        for _ in range(depth + 1):
            found = step.select(_leaf(splits).alias("leaf"), "g", "h", F.posexplode("bins").alias("f", "bin")).groupBy("leaf", "f", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            cells = sorted((r.f, r.leaf, r.bin, r.g, r.h) for r in found)  # at most features x bins x leaves
            if len(splits) == depth:
                leaves = [0.0] * 2**depth
                for leaf in {c[1] for c in cells}:
                    own = [c for c in cells if c[0] == 0 and c[1] == leaf]
                    leaves[leaf] = round(rate * sum(c[3] for c in own) / (sum(c[4] for c in own) + l2), 9)
                model.trees.append((splits, leaves))
                break
            best = (0.0, 0, edges[0][0] if edges[0] else 0.0)
            for f, at in enumerate(edges):
                for cutoff, edge in enumerate(at):
                    gain = 0.0
                    for leaf in range(2 ** len(splits)):
                        own = [c for c in cells if c[0] == f and c[1] == leaf]
                        for side in ([c for c in own if c[2] <= cutoff], [c for c in own if c[2] > cutoff]):
                            gain += sum(c[3] for c in side) ** 2 / (sum(c[4] for c in side) + l2)
                    if gain > best[0] + 1e-9:
                        best = (gain, f, edge)
            splits = [*splits, (best[1], float(best[2]))]
    return model


def judge(pages: DataFrame, model: Trees, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and p_block for each row of pages."""
    df = model.with_features(lexical(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    p = 1 / (1 + F.exp(-model.margin()))
    return df.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(p >= 0.5, "block").otherwise("allow")).alias("verdict"), p.alias("p_block"))


def op6_url_filter(pages: DataFrame) -> DataFrame:
    """The labelled urls are those that a rule decides."""
    urls = pages.select(F.col("url").cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    verdict = rule_columns(host, path)[1]
    labelled = urls.select("url", F.when(verdict == "block", 1).when(verdict == "allow", 0).alias("label"))
    return judge(pages, fit(labelled))
