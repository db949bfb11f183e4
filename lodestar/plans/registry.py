"""Every query of the package by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestar.plans import history, learning, more, ranking, records, retrieval, searches, texts

MODULES = (retrieval, ranking, history, texts, more, learning, records, searches)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for m in MODULES for f in m.QUERIES}
SQL: dict[str, str] = {name: sql for m in MODULES for name, sql in m.SQL.items()}
