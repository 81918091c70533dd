"""Positions: sphere anchors, members around them, grids and orbits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.scalars import fnv1a32, name_hash64

GOLDEN = 2.3999631
# Fixed values of placement: how far members spread about their group on the sphere, how far they leave its surface, the gap between groups on the plane, and a group's disc there.
SPREAD_MOST, SPREAD_BASE, SPREAD_STEP, SPHERE_JITTER = 0.13, 0.014, 0.006, 0.0028
GRID_GAP, DISC_STEP, DISC_BASE, DISC_JITTER = 520.0, 10.5, 18.0, 0.7
RADIUS = 100.0


def sphere_points(df: DataFrame, index: str, count: int) -> DataFrame:
    """df with x, y, z of point `index` (from 0) of `count` spread over the unit sphere."""
    if count <= 1:
        return df.withColumns({"x": F.lit(0.0), "y": F.lit(1.0), "z": F.lit(0.0)})
    k = F.col(index).cast("double")
    y = 1 - 2 * k / (count - 1.0)
    r = F.sqrt(F.greatest(F.lit(0.0), 1 - y * y))
    return df.withColumns({"x": r * F.cos(k * GOLDEN), "y": y, "z": r * F.sin(k * GOLDEN)})


def _unit(v: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    n = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    return tuple(F.when(n == 0, F.lit(float(d))).otherwise(F.try_divide(c, n)) for c, d in zip(v, (0, 1, 0), strict=True))


def _cross(a, b):
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def sphere_members(df: DataFrame, radius: float = RADIUS) -> DataFrame:
    """df (node, x, y, z of its group's anchor, offset, size) with px, py, pz: members spiral about the anchor on its tangent plane, with a jitter by id."""
    n = _unit((F.col("x"), F.col("y"), F.col("z")))
    df = df.withColumns({"_n0": n[0], "_n1": n[1], "_n2": n[2]})
    n = (F.col("_n0"), F.col("_n1"), F.col("_n2"))
    steep = F.abs(n[1]) < 0.92
    a = _unit(_cross(n, (F.when(steep, 0.0).otherwise(1.0), F.when(steep, 1.0).otherwise(0.0), F.lit(0.0))))
    df = df.withColumns({f"_a{k}": c for k, c in enumerate(a)})
    a = tuple(F.col(f"_a{k}") for k in range(3))
    b = _cross(n, a)
    size, off = F.col("size").cast("double"), F.col("offset").cast("double")
    spread = F.least(F.lit(SPREAD_MOST), SPREAD_BASE + F.sqrt(size) * SPREAD_STEP)
    theta, radial = off * GOLDEN, spread * F.sqrt((off + 1) / size)
    d = _unit(tuple(n[k] + a[k] * F.cos(theta) * radial + b[k] * F.sin(theta) * radial for k in range(3)))
    out = radius * (1 + (fnv1a32(F.col("node").cast("string")) % 7 - 3) * SPHERE_JITTER)
    placed = {f"p{axis}": F.when(F.col("size") <= 1, F.col(axis) * radius).otherwise(d[k] * out).cast("float") for k, axis in enumerate("xyz")}
    return df.withColumns(placed).drop(*(f"_{p}{k}" for p in "na" for k in range(3)))


def grid_anchor(index: Column, count: int, gap: float = GRID_GAP) -> tuple[Column, Column]:
    columns = max(1, math.ceil(math.sqrt(count)))
    lines = -(-count // columns)
    return (index % columns) * gap - (columns - 1) * gap * 0.5, F.floor(index / columns) * gap - max(0, lines - 1) * gap * 0.5


def flat_members(df: DataFrame) -> DataFrame:
    """df (node, ax, ay, offset, size) with px, py on a spiral about the anchor."""
    size, off = F.col("size").cast("double"), F.col("offset").cast("double")
    radius, jitter = (F.sqrt(size) * DISC_STEP + DISC_BASE) * F.sqrt((off + 1) / size), (fnv1a32(F.col("node").cast("string")) % 17 - 8) * DISC_JITTER
    one = F.col("size") <= 1
    return df.withColumns({"px": F.when(one, F.col("ax")).otherwise(F.col("ax") + F.cos(off * GOLDEN) * (radius + jitter)), "py": F.when(one, F.col("ay")).otherwise(F.col("ay") + F.sin(off * GOLDEN) * (radius - jitter))})


def orbit_radius(orbits: DataFrame, count: int) -> DataFrame:
    """orbits (comp, neighbours, score) with radius: well tied clusters lie near the centre, untied ones on an outer ring."""
    outer = max(2400.0, math.sqrt(count) * 240.0)
    top = orbits.agg(F.max("score").alias("top"))
    near = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_divide(F.col("score"), F.col("top")), F.lit(0.0))))
    ring = outer + 360.0 + (fnv1a32(F.col("comp").cast("string")) % 7) * 34.0
    return orbits.crossJoin(top).withColumn("radius", F.when(F.col("neighbours") == 0, ring).otherwise(360.0 + (1 - F.pow(near, 0.72)) * max(1.0, outer - 360.0))).drop("top")


def orbit_angles(orbits: list[dict], links: dict[tuple, int], candidates: int = 56) -> dict:
    """Angle of each cluster, placed one by one by falling score: near the weighted mean of placed neighbours, of `candidates` angles the one that keeps most
    distance for its deviation.  A sequential step over clusters, not over members; it runs on the driver."""
    order = sorted(orbits, key=lambda o: (-o["score"], -o["members"], o["comp"]))
    angle: dict = {}
    where: dict = {}
    for k, o in enumerate(order):
        x = y = 0.0
        for (a, b), w in links.items():
            other = b if a == o["comp"] else a if b == o["comp"] else None
            if other in angle:
                x, y = x + math.cos(angle[other]) * max(1, w), y + math.sin(angle[other]) * max(1, w)
        want = math.atan2(y, x) if abs(x) > 1e-7 or abs(y) > 1e-7 else (k * GOLDEN) % (2 * math.pi)
        best = None
        for step in range(candidates):
            turn = want + (step + 1) // 2 * (1 if step % 2 else -1) * 2 * math.pi / candidates
            at = (math.cos(turn) * o["radius"], math.sin(turn) * o["radius"])
            room = min((math.dist(at, p) for p in where.values()), default=math.inf)
            value = min(room, 900.0) - 120.0 * abs(turn - want)
            if best is None or value > best[0]:
                best = (value, turn, at)
        angle[o["comp"]], where[o["comp"]] = best[1], best[2]
    return angle


def hidden_position(df: DataFrame, name: str) -> DataFrame:
    """df with x, y: a place on an outer ring that depends on the name alone."""
    h = name_hash64(F.col(name))
    angle = F.radians((h % 360).cast("double"))
    radius = 700.0 + (F.floor(h / 512) % 180).cast("double")
    return df.withColumns({"x": radius * F.cos(angle), "y": radius * F.sin(angle)})


def along_path(start: Column, end: Column, index: Column, total: Column, height: float = 0.0) -> Column:
    """The coordinate of point `index` (from 0) of `total` on a line from start to end, lifted by half a sine wave of `height`, centred."""
    progress = index.cast("double") / F.greatest(total - 1, F.lit(1))
    return start + (end - start) * progress + (F.sin(progress * math.pi) - 0.5) * height
