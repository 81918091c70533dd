"""Scalar expressions of the analytics surface."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accepted spellings of a role.
ROLES = {"TOP": "TOP", "JUNGLE": "JUNGLE", "MID": "MIDDLE", "MIDDLE": "MIDDLE", "BOT": "BOTTOM", "ADC": "BOTTOM", "BOTTOM": "BOTTOM", "SUPPORT": "UTILITY", "UTILITY": "UTILITY"}
NO_NAME = "Unknown#Unknown"


def names_of(raw: Column) -> Column:
    """A JSON array of names; what is no array is one name."""
    return F.coalesce(F.from_json(raw, "array<string>"), F.array(raw))


def latest_name(raw: Column) -> Column:
    name = F.try_element_at(F.from_json(raw, "array<string>"), F.lit(-1))
    return F.when(F.trim(F.coalesce(name, F.lit(""))) == "", NO_NAME).otherwise(name)


def role_of(raw: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.upper(F.trim(raw))), F.lit("UNKNOWN"))


def minutes(duration: Column) -> Column:
    """Match length in minutes, at least 1; values above 100000 are milliseconds."""
    return F.greatest(F.lit(1.0), F.when(duration > 100000, duration / 60000).otherwise(duration / 60))


def fnv1a32(text: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes, as an expression over their hexadecimal digits."""
    hexed = F.hex(F.encode(text, "UTF-8"))
    data = F.transform(F.sequence(F.lit(0), F.floor(F.length(hexed) / 2).cast("int") - 1), lambda i: F.conv(F.substr(hexed, i * 2 + 1, F.lit(2)), 16, 10).cast("long"))
    folded = F.aggregate(data, F.lit(2166136261).cast("long"), lambda h, b: (h.bitwiseXOR(b) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))
    return F.when(F.length(text) == 0, F.lit(2166136261).cast("long")).otherwise(folded)


#: Fixed values of the 64-bit name hash.
HASH_START, HASH_FACTOR = 1469598103934665603, 1099511628211
_WORD = "decimal(38,0)"


def name_hash64(text: Column) -> Column:
    """64-bit hash of the UTF-8 bytes as decimal(38,0): multiply, then add, wrapping; null for null.  Decimals hold each product whole."""
    hexed = F.hex(F.encode(text, "UTF-8"))
    size = F.floor(F.length(hexed) / 2).cast("int")
    places = F.filter(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: i <= size)
    data = F.transform(places, lambda i: F.conv(F.substr(hexed, i * 2 - 1, F.lit(2)), 16, 10).cast(_WORD))
    factor, wrap = (F.lit(str(x)).cast("decimal(20,0)") for x in (HASH_FACTOR, 2**64))
    folded = F.aggregate(data, F.lit(HASH_START).cast(_WORD), lambda h, b: ((h.cast("decimal(20,0)") * factor.cast("decimal(13,0)") + b.cast("decimal(3,0)")) % wrap).cast(_WORD))
    return F.when(text.isNotNull(), folded)


def pack_edge(weight: Column, is_enemy: Column) -> Column:
    """Bit 0 tells the relation, the rest the weight."""
    return F.shiftleft(weight.cast("long"), 1).bitwiseOR(is_enemy.cast("long"))


def unpack_edge(packed: Column) -> tuple[Column, Column]:
    return F.shiftright(packed, 1), packed.bitwiseAND(F.lit(1).cast("long")) == 1


def next_power_of_two(x: Column, least: int = 8, most: int = 64) -> Column:
    return F.least(F.lit(most), F.greatest(F.lit(least), F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(x, F.lit(1))))).cast("long")))


def hex_distance(c1: Column, r1: Column, c2: Column, r2: Column) -> Column:
    """Distance of tiles on a hexagonal grid whose odd rows are shifted right."""
    q1, q2 = c1 - F.floor((r1 - r1 % 2) / 2), c2 - F.floor((r2 - r2 % 2) / 2)
    return ((F.abs(q1 - q2) + F.abs(r1 - r2) + F.abs(q1 + r1 - q2 - r2)) / 2).cast("long")


def md_escape(text: Column) -> Column:
    return F.replace(text, F.lit("|"), F.lit("\\|"))


def slug(text: Column) -> Column:
    out = F.regexp_replace(text, "[^A-Za-z0-9_-]", "_")
    return F.when(out == "", "unknown").otherwise(out)


def balance_finding(ratio: Column) -> Column:
    return F.when(ratio > 0.65, "balanced").when(ratio < 0.4, "unbalanced").otherwise("mixed")


def assortativity_finding(r: Column) -> Column:
    return F.when(r > 0.2, "assortative").when(r < -0.2, "disassortative").otherwise("neutral")
