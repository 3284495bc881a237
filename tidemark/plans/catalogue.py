"""Every query of the core library by name, with the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import documents, pipeline, relational, sentences, series, spikes, streams, texts, vectors

_MODULES = (spikes, texts, relational, series, sentences, vectors, documents, streams, pipeline)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for m in _MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql.strip() for m in _MODULES for name, sql in m.SQL.items()}
