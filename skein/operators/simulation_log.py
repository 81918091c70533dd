"""Analytics over the event log of the territory simulation, its lineage and its tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.ranking import total_before
from skein.functions.scalars import hex_distance
from skein.session import cut

ABSENT = 4294967295
EVENT = "event_id long, tick long, generation int, event_type string, severity string, tribe_id long, other_tribe_id long, tile_id long, war_id long, value_a float, value_b float, flags long"


def with_nulls(events: DataFrame) -> DataFrame:
    """The sentinel of absent ids becomes null."""
    return events.withColumns({c: F.nullif(F.col(c), F.lit(ABSENT)) for c in ("tribe_id", "other_tribe_id", "tile_id", "war_id")})


def counts_by_type(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.min("tick").alias("first_tick"), F.max("tick").alias("last_tick"))


def recent(events: DataFrame, k: int) -> DataFrame:
    return events.orderBy(F.desc("event_id")).limit(k)


def after(events: DataFrame, last_seen: int) -> DataFrame:
    return events.filter(F.col("event_id") > last_seen)


def war_stats(wars: DataFrame) -> DataFrame:
    """tribe, won, lost, casualties.  wars: war_id, attacker, defender, winner, attacker_losses, defender_losses."""
    sides = F.explode(F.array(F.struct(F.col("attacker").alias("tribe"), F.col("attacker_losses").alias("losses")), F.struct(F.col("defender").alias("tribe"), F.col("defender_losses").alias("losses"))))
    own = wars.select("winner", sides.alias("s"))
    return own.groupBy(F.col("s.tribe").alias("tribe")).agg(F.count_if(F.col("winner") == F.col("s.tribe")).alias("won"), F.count_if(F.col("winner") != F.col("s.tribe")).alias("lost"), F.sum("s.losses").alias("casualties"))


def fitness(territory: Column, population: Column, survival: Column, mergers: Column, wars: Column) -> Column:
    one = lambda c: F.least(F.lit(1.0), c)
    return 0.3 * one(territory) + 0.25 * one(population) + 0.2 * one(survival) + 0.15 * one(mergers) + 0.1 * one(wars)


def mutation_rate(df: DataFrame, fitness_col: str, base: float) -> DataFrame:
    """df with mutation_rate: from twice the base at the least fitness down to 0.3 of it at the largest."""
    ends = df.agg(F.min(fitness_col).alias("_low"), F.max(fitness_col).alias("_high"))
    rank = F.coalesce(F.try_divide(F.col(fitness_col) - F.col("_low"), F.col("_high") - F.col("_low")), F.lit(0.0))
    return df.crossJoin(F.broadcast(ends)).withColumn("mutation_rate", F.greatest(F.lit(0.3 * base), base * (2 - 1.7 * rank))).drop("_low", "_high")


def last_argmax(names: list[str]) -> Column:
    """The name of the largest column; the last of equals."""
    top = F.greatest(*[F.col(n) for n in names])
    out = F.lit(None).cast("string")
    for n in names:
        out = F.when(F.col(n) == top, n).otherwise(out)
    return out


#: The least number of constituents, and the least population, of each polity tier.
TIER_MEMBERS = {"Empire": 100, "Kingdom": 50, "Duchy": 25, "City": 3}
TIER_POPULATION = {"Empire": 15_000, "Kingdom": 7_000, "Duchy": 3_000, "City": 1_000}


def polity_tier(size: Column, least: dict[str, int]) -> Column:
    """The highest tier that size reaches; below all of them, or null, it is a Tribe."""
    out = F.lit("Tribe")
    for name, bound in sorted(least.items(), key=lambda x: x[1]):
        out = F.when(size >= bound, name).otherwise(out)
    return out


def specialisation(stats: list[str]) -> Column:
    """last_argmax of the statistics; Generalist where none is above 0 (or all are null)."""
    return F.when(F.greatest(*[F.col(s) for s in stats]) > 0, last_argmax(stats)).otherwise("Generalist")


def numbered(events: DataFrame, order: list[str], start: int = 1) -> DataFrame:
    """events with event_id: sequential 64-bit numbers from start in an order without ties, given out by ranges of the order."""
    return total_before(events, order, F.lit(1).cast("long"), "event_id").withColumn("event_id", F.col("event_id") + start)


def run_order(tribes: DataFrame) -> DataFrame:
    """The living by territory, then the dead by age."""
    return tribes.orderBy(F.desc("alive"), F.when(F.col("alive"), F.col("territory")).otherwise(F.col("age")).desc(), "tribe")


def ownership(tiles: DataFrame) -> DataFrame:
    """tile, owner, contested.  tiles: tile, tribe, place; the first occupant owns."""
    w = Window.partitionBy("tile").orderBy("place", "tribe")
    return tiles.select("tile", "tribe", F.row_number().over(w).alias("n"), F.count("*").over(Window.partitionBy("tile")).alias("held")).filter("n = 1").select("tile", F.col("tribe").alias("owner"), (F.col("held") > 1).alias("contested"))


def composition(tiles: DataFrame) -> DataFrame:
    return tiles.groupBy("tribe", "biome").agg(F.count("*").alias("tiles"))


def hex_neighbours(tiles: DataFrame, width: int, height: int) -> DataFrame:
    """tile, other: neighbours on the grid (col, row), odd rows shifted right; an equi-join on the six shifted places."""
    odd = F.col("row") % 2 == 1
    at = lambda c, r: F.struct(c.alias("col"), r.alias("row"))
    c, r = F.col("col"), F.col("row")
    shifts = F.array(at(c - 1, r), at(c + 1, r), *(at(F.when(odd, c + d).otherwise(c + d - 1), r + dr) for dr in (-1, 1) for d in (0, 1)))
    out = tiles.select("tile", F.explode(shifts).alias("p")).filter((F.col("p.col") >= 0) & (F.col("p.col") < width) & (F.col("p.row") >= 0) & (F.col("p.row") < height))
    other = tiles.select(F.col("tile").alias("other"), F.col("col").alias("ocol"), F.col("row").alias("orow"))
    return out.join(other, (F.col("p.col") == F.col("ocol")) & (F.col("p.row") == F.col("orow"))).select("tile", "other")


def adjacent_tribes(owned: DataFrame, near: DataFrame) -> DataFrame:
    """Pairs of different owners whose tiles touch."""
    a, b = owned.select("tile", F.col("owner").alias("a")), owned.select(F.col("tile").alias("other"), F.col("owner").alias("b"))
    return near.join(a, "tile").join(b, "other").filter("a < b").select("a", "b").distinct()


def claim_cost(tiles: Column, distance: Column, terrain: Column, contested: Column, overextended: Column) -> Column:
    return 8 + 3 * tiles + 2 * F.greatest(F.lit(0), distance - 1) + terrain + F.when(contested, 8).otherwise(0) + F.when(overextended, 10).otherwise(0)


def nearest(df: DataFrame) -> DataFrame:
    """Of each tribe (tribe, col, row, other, ocol, orow), the nearest other; the smallest id of equals."""
    d = hex_distance(F.col("col"), F.col("row"), F.col("ocol"), F.col("orow"))
    return df.withColumn("distance", d).withColumn("_n", F.row_number().over(Window.partitionBy("tribe").orderBy("distance", "other"))).filter("_n = 1").select("tribe", "other", "distance")


def lineage(parents: DataFrame) -> DataFrame:
    """entity, seed, depth along the first parent (entity_id, parent_a), by doubling: each round follows as many steps as all before.

    Chains of any depth are followed to their end; parents that form a cycle are an error."""
    now = cut(parents.select(F.col("entity_id").alias("entity"), F.nullif("parent_a", F.lit(ABSENT)).alias("up")).select("entity", F.coalesce("up", "entity").alias("seed"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("depth")))
    for _ in range(now.count().bit_length() + 1):
        nxt = now.select(F.col("entity").alias("seed"), F.col("seed").alias("further"), F.col("depth").alias("more"))
        new = cut(now.join(nxt, "seed", "left").select("entity", F.coalesce("further", "seed").alias("seed"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), (F.coalesce("more", F.lit(0)) > 0).alias("moved")))
        now = new.select("entity", "seed", "depth")
        if new.filter("moved").isEmpty():
            return now
    raise ValueError("the parents form a cycle")


def winners(summaries: DataFrame) -> DataFrame:
    """How often each winner's leading artifact won.  summaries: run, five artifact columns."""
    names = sorted(c for c in summaries.columns if c.startswith("artifact_"))
    top = F.greatest(*[F.col(n) for n in names])
    first = F.lit(None).cast("string")
    for n in reversed(names):
        first = F.when(F.col(n) == top, n).otherwise(first)
    return summaries.groupBy(first.alias("leading")).agg(F.count("*").alias("runs"))


#: What a compact lineage keeps, and causes of extinction; {} is the other tribe.
KEPT_LINEAGE = ["seed-", "gen-", "merged-", "merge-parent-"]
CAUSES = {"starved": "starved", "conquered": "conquered-by-{}", "absorbed": "absorbed-by-{}", "imploded": "imploded"}


def cause_of(kind: Column, other: Column) -> Column:
    out = F.lit("unknown")
    for name, text in CAUSES.items():
        said = F.concat(F.lit(text.removesuffix("{}")), other.cast("string")) if text.endswith("{}") else F.lit(text)
        out = F.when(kind == name, said).otherwise(out)
    return out


def tombstones(deaths: DataFrame, stored: DataFrame) -> DataFrame:
    """stored (tribe, tick, cause, lineage) with the first death of each tribe that it lacks.  deaths: tribe, tick, kind, other, lineage (names).

    Of deaths in one tick, the least by (kind, other, lineage) stands; an unknown kind is `unknown`, a null lineage is empty."""
    first = deaths.groupBy("tribe").agg(F.min(F.struct("tick", "kind", "other", "lineage")).alias("d"))
    known = lambda x: F.exists(F.array(*[F.lit(k) for k in KEPT_LINEAGE]), lambda k: F.startswith(x, k))
    new = first.select("tribe", "d.tick", cause_of(F.col("d.kind"), F.col("d.other")).alias("cause"), F.filter(F.coalesce("d.lineage", F.array().cast("array<string>")), known).alias("lineage"))
    return stored.select("tribe", "tick", "cause", "lineage").unionByName(new.join(stored, "tribe", "left_anti"))


def active_wars(wars: DataFrame, tick: int) -> DataFrame:
    """The wars that go on, with duration: ticks since start_tick, not below 0."""
    return wars.filter("status = 'active'").withColumn("duration", F.greatest(F.lit(0).cast("long"), F.lit(tick) - F.col("start_tick")))
