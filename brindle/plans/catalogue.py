"""All core queries and the SQL that they must agree with."""

from __future__ import annotations

from brindle.plans import data_quality, documents, relational, retrieval, shapes, sources, wording

MODULES = [retrieval, relational, documents, sources, data_quality, wording, shapes]
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
