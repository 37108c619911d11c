"""Routing to dispatch to learning, end to end on known outcomes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from signpost.operators import dispatch as D
from signpost.plans.route import route


@dataclass(frozen=True)
class Dispatch:
    ranked: DataFrame
    gate: DataFrame
    plan: DataFrame
    resolution: DataFrame
    attempts: DataFrame
    alternatives: DataFrame


def dispatch(ranked: DataFrame, queries: DataFrame, outcomes: DataFrame) -> Dispatch:
    """Gate, candidates, winner, usage records and alternatives for ranked results."""
    plan = D.fallback_plan(ranked)
    resolution = D.resolve_fallback(plan, outcomes)
    return Dispatch(
        ranked,
        D.confidence_gate(queries, ranked),
        plan,
        resolution,
        D.attempt_log(plan, outcomes),
        D.alternatives(ranked, resolution),
    )


def auto(catalog: DataFrame, queries: DataFrame, outcomes: DataFrame, **options) -> Dispatch:
    return dispatch(route(catalog, queries, **options), queries, outcomes)
