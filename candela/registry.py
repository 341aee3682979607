"""All queries of the library: name -> (spark, folder) -> DataFrame, and their DuckDB SQL."""

from __future__ import annotations

from .plans import indicator_queries, report_queries, scan_queries

ENTRIES = {**scan_queries.QUERIES, **indicator_queries.QUERIES, **report_queries.QUERIES}

QUERIES = {k: f for k, (f, _) in ENTRIES.items()}
ORACLES = {k: s for k, (_, s) in ENTRIES.items() if s}
