"""Registry of the core's queries and their SQL."""

from __future__ import annotations

from tidewheel.plans import audits, pipelines, recordings, relations, scans, timelines

_REGISTRIES = (scans.query, relations.query, timelines.query, pipelines.query, audits.query)


def queries() -> dict:
    return {k: v for r in _REGISTRIES for k, v in r.queries.items()} | recordings.QUERIES


def oracle_sql() -> dict[str, str]:
    return {k: v for r in _REGISTRIES for k, v in r.sql.items()} | recordings.SQL
