"""All registered queries of the graph engine, and the SQL that checks them."""

from __future__ import annotations

from skein.plans import exports, extra, graph, more, relational, rules, searches, streams  # noqa: F401  all but relational add to graph.QUERIES

_relational = relational.catalogue()
QUERIES = {**graph.QUERIES, **_relational[0]}
ORACLE_SQL = {**graph.ORACLE_SQL, **_relational[1]}
