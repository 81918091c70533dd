"""Routines called from SQL, and labels in dictionary order."""

import pytest

from skein.functions import table_functions
from skein.operators import serving


@pytest.fixture
def functions(spark):
    people = spark.createDataFrame([(k, k + 0.5, 1.0) for k in range(1, 10)], "person long, op double, feed double")
    belongs = spark.createDataFrame([(1,), (1,), (2,)], "person long")
    ties = [(k, k + 1) for k in range(1, 9)] + [(1, 5)]
    steps = spark.createDataFrame(ties + [(b, a) for a, b in ties], "at long, to long")
    return table_functions.register(spark, people, belongs, steps)


def test_functions_in_queries(spark, functions):
    assert set(functions) == {"player_summary", "reached_within", "reach_count"}
    assert tuple(spark.sql("SELECT * FROM player_summary(1)").first()) == (1, 1.5, 1.0, 2)
    assert spark.sql("SELECT * FROM player_summary(77)").collect() == []
    assert {(r.node, r.hops) for r in spark.sql("SELECT * FROM reached_within(1, 2)").collect()} == {(1, 0), (2, 1), (5, 1), (3, 2), (4, 2), (6, 2)}
    assert spark.sql("SELECT reached FROM reach_count(1, 2)").first().reached == 5 and spark.sql("SELECT reached FROM reach_count(1, 0)").first().reached == 0
    rows = spark.sql("SELECT p.person, c.reached FROM skein_people p, LATERAL reach_count(p.person, 1) c WHERE p.person < 3").collect()
    assert {(r.person, r.reached) for r in rows} == {(1, 2), (2, 2)}
    with pytest.raises(Exception, match="at most 6 levels"):
        spark.sql("SELECT * FROM reached_within(1, 7)").collect()


def test_labels_in_dictionary_order(spark):
    players = spark.createDataFrame([(k, x) for k, x in enumerate(["zeta", "Éa", "eb", "Ez", "f", "ea", "EA"])], "id int, label string")
    assert [r.label for r in serving.autocomplete(players, "e").collect()] == ["EA", "ea", "eb", "Ez", "zeta"]
    assert [r.label for r in serving.autocomplete(players, "é").collect()] == ["Éa"]
    assert [r.label for r in serving.autocomplete(players, "A", 3).collect()] == ["EA", "ea", "Éa"]
