"""Queries by name: each a function of (spark, sf_dir), and the SQL that gives the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is there already")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


#: SQL for vectors as rows of (vec_id, label, pos, v), and for a vector with the one of the next id.
LONG = "(SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
PAIRS = (
    "(SELECT p.vec_id, p.label, CAST(p.embedding AS DOUBLE[]) AS pred, CAST(t.embedding AS DOUBLE[]) AS target"
    " FROM embeddings p JOIN embeddings t ON t.vec_id = p.vec_id + 1)"
)
