"""All queries of the engine's own operators, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillrow.plans import domain, markdown, paged, positions, records

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**domain.QUERIES, **markdown.QUERIES, **records.QUERIES, **paged.QUERIES, **positions.QUERIES}
ORACLE_SQL: dict[str, str] = {**domain.ORACLE_SQL, **markdown.ORACLE_SQL, **records.ORACLE_SQL, **paged.ORACLE_SQL, **positions.ORACLE_SQL}
