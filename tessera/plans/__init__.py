"""Registered queries over the driver's tables and the SQL that must give the same rows."""

from __future__ import annotations

from tessera.catalogue import merged
from tessera.plans import flows, frames, segments, text, vectors

QUERIES: dict = merged(segments.QUERIES, vectors.QUERIES, text.QUERIES, frames.QUERIES, flows.QUERIES)
ORACLE_SQL: dict = merged(segments.ORACLE_SQL, vectors.ORACLE_SQL, text.ORACLE_SQL, frames.ORACLE_SQL, flows.ORACLE_SQL)
