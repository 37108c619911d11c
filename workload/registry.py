"""All registered queries: name -> (function of spark and table folder, SQL or None)."""

from __future__ import annotations

from workload import ingestion, learning, maintenance, ranking, text, vectors


def all_queries() -> dict:
    merged: dict = {}
    for module in (text, ranking, vectors, learning, maintenance, ingestion):
        merged.update(module.QUERIES)
    return merged
