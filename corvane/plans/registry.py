"""Where queries are registered, each with the SQL it is checked against, and what several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.operators import graph
from corvane.sources.adapters import ctes, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The closure as a recursive expression, self included.
CLOSURE = """closed AS (SELECT DISTINCT tag, ancestor FROM (
  SELECT tag_id AS tag, tag_id AS ancestor FROM tags UNION ALL SELECT tag, ancestor FROM up)),
up AS (SELECT child AS tag, parent AS ancestor FROM edges UNION SELECT u.tag, e.parent FROM up u JOIN edges e ON u.ancestor = e.child)"""


def closed_ctes(*more: str) -> str:
    parts = CLOSURE.split("),\nup AS (")
    return f"WITH RECURSIVE {ctes('tags', 'edges', *more)},\nup AS ({parts[1]},\n{parts[0]})"


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def closed(s: SparkSession, d: str) -> DataFrame:
    return graph.closure(view(s, d, "edges"), view(s, d, "tags"))
