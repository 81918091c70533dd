"""Routines that SQL can call: temporary table functions over temporary views, which the planner expands into the query that calls them.

    register(spark, people=..., belongs=..., steps=...)
    spark.sql("SELECT * FROM reach_count(7, 3)")
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Levels that the walks are written out to; a call that asks for more is an error.
MOST_LEVELS = 6


def _levels() -> str:
    """Common table expressions: the nodes of each level up to MOST_LEVELS, each once, and all with their least level in `reached`."""
    parts = ["l0 AS (SELECT start AS node)"]
    parts += [f"l{k} AS (SELECT DISTINCT s.to AS node FROM l{k - 1} JOIN skein_steps s ON s.at = l{k - 1}.node WHERE most >= {k})" for k in range(1, MOST_LEVELS + 1)]
    every = " UNION ALL ".join(f"SELECT node, {k} AS hops FROM l{k}" for k in range(MOST_LEVELS + 1))
    checked = f"CASE WHEN most > {MOST_LEVELS} THEN CAST(raise_error('at most {MOST_LEVELS} levels') AS INT) ELSE min(hops) END"
    return f"WITH {', '.join(parts)}, reached AS (SELECT node, {checked} AS hops FROM ({every}) GROUP BY node)"


FUNCTIONS = {
    "player_summary": ("who BIGINT", "person BIGINT, op DOUBLE, feed DOUBLE, `groups` BIGINT", "SELECT p.person, CAST(p.op AS DOUBLE), CAST(p.feed AS DOUBLE), coalesce(b.n, 0) FROM skein_people p LEFT JOIN (SELECT person, count(*) AS n FROM skein_belongs GROUP BY person) b ON b.person = p.person WHERE p.person = who"),
    "reached_within": ("start BIGINT, most INT", "node BIGINT, hops INT", f"{_levels()} SELECT node, hops FROM reached"),
    "reach_count": ("start BIGINT, most INT", "reached BIGINT", f"{_levels()} SELECT count_if(hops > 0) FROM reached"),
}


def register(spark: SparkSession, people: DataFrame, belongs: DataFrame, steps: DataFrame) -> list[str]:
    """Makes the functions callable in this session; returns their names.  people: person, op, feed; belongs: person; steps: at, to."""
    for name, df in (("people", people), ("belongs", belongs), ("steps", steps)):
        df.createOrReplaceTempView(f"skein_{name}")
    for name, (takes, gives, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS TABLE ({gives}) RETURN {body}")
    return list(FUNCTIONS)
