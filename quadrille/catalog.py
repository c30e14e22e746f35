"""All registered queries on the four signals, and their reference SQL."""

from __future__ import annotations

from . import catalog_logs, catalog_metrics, catalog_profiles, catalog_streams, catalog_traces

CASES = {**catalog_metrics.CASES, **catalog_logs.CASES, **catalog_traces.CASES, **catalog_profiles.CASES, **catalog_streams.CASES}
QUERIES = {name: run for name, (run, _) in CASES.items()}
SQL = {name: sql for name, (_, sql) in CASES.items() if sql}
