"""All queries of the core operators over the project's tables, each with its equal SQL where SQL can express it."""

from __future__ import annotations

from loomline.plans import chat, corpus, deductive, details, manifest, recordings, stores, streams

PARTS = (corpus, chat, manifest, recordings, deductive, streams, stores, details)


def queries() -> dict:
    return {name: run for part in PARTS for name, run in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.SQL.items()}
