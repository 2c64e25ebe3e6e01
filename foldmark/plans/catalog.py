"""All queries of the core, by name."""

from __future__ import annotations

from foldmark.plans import ingest, overlap, relational, scalars, training

MODULES = (scalars, relational, overlap, ingest, training)

QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: text for m in MODULES for name, text in m.SQL.items()}

#: The query that entry() runs.
FLAGSHIP = "p1_profile"
