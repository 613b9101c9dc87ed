"""Registered queries of the engine: name -> builder, and name -> SQL."""

from __future__ import annotations

from graphloom.plans import answering, construction, traversal  # noqa: F401  they register their queries
from graphloom.streaming import ingest  # noqa: F401


def queries() -> dict:
    return dict(construction.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(construction.SQL)
