"""All queries outside the training-data subpackage, by name."""

from __future__ import annotations

from folioflow.plans import analytics, artifacts, benchmarking, contracts, documents, intake, jobs, monitoring, operations, records, stores, streams

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (documents, intake, analytics, artifacts, contracts, records, monitoring, jobs, benchmarking, operations, stores, streams):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
