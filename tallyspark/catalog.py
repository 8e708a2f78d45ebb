"""The queries of the package's own operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyspark.plans import files, history, ingest, lineage, native, proofs, snapshot, telemetry, transport

#: The modules that hold queries: each has QUERIES and SQL.
MODULES = (telemetry, ingest, history, lineage, snapshot, proofs, native, transport, files)
FLAGSHIP = "span_phase_totals"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
