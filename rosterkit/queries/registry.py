"""All registered queries and their oracles."""

from __future__ import annotations

from rosterkit.queries import detection, extraction, files, libraries, reports, scalars, store, streams

_MODULES = [scalars, detection, extraction, reports, libraries, files, store, streams]


def queries() -> dict:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for module in _MODULES for name, text in module.ORACLES.items()}
