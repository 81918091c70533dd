"""Writers: clusters by type, artifacts, reports, replays and logs."""

from __future__ import annotations

import json
import os

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def replace_clusters(clusters: DataFrame, path: str, cluster_type: str) -> None:
    """Replaces the clusters of one type and leaves the others."""
    clusters.withColumn("cluster_type", F.lit(cluster_type)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cluster_type").parquet(path)


def evolve(old: DataFrame, new: DataFrame, defaults: dict) -> DataFrame:
    """Rows of both, columns of either; what a side lacks gets its default."""
    return old.unionByName(new, allowMissingColumns=True).fillna(defaults)


def append_new(rows: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """rows whose key is not stored yet, one of each."""
    return rows.dropDuplicates([key]).join(stored, key, "left_anti")


def upsert(stored: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """stored with the rows of equal key replaced."""
    return stored.join(rows, keys, "left_anti").unionByName(rows, allowMissingColumns=True)


def touch(rows: DataFrame, at=None) -> DataFrame:
    """rows with updated_at set to a time, or to now: what each write of a row does."""
    return rows.withColumn("updated_at", F.current_timestamp() if at is None else F.lit(at).cast("timestamp"))


def insert_or_ignore(stored: DataFrame, rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """stored, and of each new key the first row by order; the columns are those of stored, and what rows lack is null.  Rows with a null key go."""
    held = rows.dropna(subset=keys)
    first = held.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
    new = first.join(stored.select(*keys).distinct(), keys, "left_anti")
    return stored.unionByName(new.select(*[c for c in stored.columns if c in new.columns]), allowMissingColumns=True)


def latest_replays(replays: DataFrame, runs: DataFrame, k: int = 24) -> DataFrame:
    """The latest replays with their runs."""
    top = replays.orderBy(F.desc("saved_at"), F.desc("replay_id")).limit(k)
    own = runs.groupBy("replay_id").agg(F.array_sort(F.collect_list(F.struct("run_index", "algorithm", "path_length"))).alias("runs"))
    return top.join(own, "replay_id", "left").orderBy(F.desc("saved_at"), F.desc("replay_id"))


METRICS = ("degree", "ally_degree", "enemy_degree", "support", "ally_support", "enemy_support")


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str, most: int = 5_000_000, places: tuple = ("px", "py"), metrics: tuple = METRICS, about: tuple = (), clusters: DataFrame | None = None) -> dict:
    """Little-endian buffers of a graph that fits the driver: positions (f32 for each of places), metrics (u32 for each), edges (2 x u32), packed weights (u32), and a manifest.

    nodes.json holds the ids, nodes_about.json further columns of the nodes, clusters.json a row for each cluster.
    The folder is the driver's; graphs of more than `most` nodes, edges and clusters are refused before anything is collected."""
    size = nodes.count() + edges.count() + (clusters.count() if clusters is not None else 0)
    if size > most:
        raise ValueError(f"{size} nodes, edges and clusters are more than the {most} that are written through the driver")
    os.makedirs(folder, exist_ok=True)
    n = nodes.select("node", *places, *metrics, *about).orderBy("node").toPandas()
    place = {x: k for k, x in enumerate(n["node"])}
    e = edges.orderBy("src", "dst").toPandas()
    buffers = {
        "positions.f32": n[list(places)].to_numpy("<f4"),
        "metrics.u32": n[list(metrics)].to_numpy("<u4"),
        "edges.u32": np.stack([e["src"].map(place).to_numpy("<u4"), e["dst"].map(place).to_numpy("<u4")], 1) if len(e) else np.zeros((0, 2), "<u4"),
        "props.u32": (e["total"].to_numpy(np.int64) << 1 | (e["relation"] == "enemy").to_numpy(np.int64)).astype("<u4"),
    }
    for name, data in buffers.items():
        data.tofile(os.path.join(folder, name))
    enemies = int((e["relation"] == "enemy").sum())
    manifest = {"nodes": len(n), "edges": len(e), "ally_edges": len(e) - enemies, "enemy_edges": enemies, "buffers": {k: list(v.shape) for k, v in buffers.items()}, "bytes": {k: v.nbytes for k, v in buffers.items()}}
    texts = {"nodes.json": [str(x) for x in n["node"]]}
    if about:
        texts["nodes_about.json"] = {c: [None if x is None else str(x) for x in n[c]] for c in about}
    if clusters is not None:
        rows = [r.asDict(recursive=True) for r in clusters.orderBy(clusters.columns[0]).collect()]
        manifest["clusters"], texts["clusters.json"] = len(rows), rows
    for name, held in (*texts.items(), ("manifest.json", manifest)):
        with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
            json.dump(held, f, sort_keys=True, default=str)
    return manifest


#: What the buffers of the sphere hold: three coordinates and four counts of each node.
SPHERE = {"places": ("px", "py", "pz"), "metrics": METRICS[:4]}


def write_highlights(membership: DataFrame, players: DataFrame, path: str) -> None:
    """JSON lines of comp, node, best_op, worst_feed: each member of a cluster, and whether it is the cluster's best or worst."""
    from skein.operators.components import highlights

    highlights(membership, players).write.mode("overwrite").json(path)


def read_graph(folder: str) -> tuple[list[str], dict[str, np.ndarray]]:
    with open(os.path.join(folder, "manifest.json"), encoding="utf-8") as f:
        manifest = json.load(f)
    with open(os.path.join(folder, "nodes.json"), encoding="utf-8") as f:
        nodes = json.load(f)
    return nodes, {k: np.fromfile(os.path.join(folder, k), "<f4" if k.endswith("f32") else "<u4").reshape(shape) for k, shape in manifest["buffers"].items()}


def summary_markdown(dataset: str, counts: dict, clusters: DataFrame, k: int = 12) -> str:
    """A report: the counts, and the k clusters with the largest orbit score."""
    top = clusters.orderBy(F.desc("score"), F.desc("members"), "comp").limit(k).collect()
    safe = lambda x: str(x).replace("|", "\\|")
    lines = [f"# {safe(dataset)}", "", *(f"- {name}: {value}" for name, value in counts.items()), "", "| cluster | members | cross ally | neighbours | score |", "|-|-|-|-|-|"]
    return "\n".join([*lines, *(f"| {safe(r.comp)} | {r.members} | {r.cross_ally} | {r.neighbours} | {r.score:.4f} |" for r in top)]) + "\n"


def full_report(dataset: str, made_at: str, scale: DataFrame, clusters: DataFrame, folder: str, k: int = 12) -> str:
    """Writes summary.md, and a copy named after made_at; returns the text: one line for each figure of scale (one row), then the table of summary_markdown."""
    figures = {name: (f"{v:.4f}" if isinstance(v, float) else v) for name, v in scale.first().asDict().items()}
    text = summary_markdown(dataset, {"made at": made_at} | figures, clusters, k)
    os.makedirs(folder, exist_ok=True)
    for name in ("summary.md", f"summary-{''.join(c if c.isalnum() else '-' for c in made_at)}.md"):
        with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
            f.write(text)
    return text


def write_log(events: DataFrame, path: str) -> None:
    """Event log as JSON lines."""
    events.write.mode("overwrite").json(path)
