"""Where query modules enter their queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, whole: bool = False) -> Callable[[Query], Query]:
    """whole: the query, which was once a sample of a larger one, also keeps that one's name,
    name_whole."""

    def enter(f: Query) -> Query:
        for n in (name, f"{name}_whole") if whole else (name,):
            QUERIES[n] = f
            if sql:
                ORACLES[n] = sql
        return f

    return enter
