"""Dispatch decisions on ranked results, resolved against known outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signpost import schema as S


def confidence_gate(queries: DataFrame, ranked: DataFrame, confidence: float = S.CONFIDENCE) -> DataFrame:
    """Per query: `no_match`, `low_confidence` or `execute`."""
    top = ranked.groupBy("query_id").agg(F.max("score").alias("top_score"))
    gate = (
        F.when(F.col("top_score").isNull(), "no_match")
        .when(F.col("top_score") < confidence, "low_confidence")
        .otherwise("execute")
    )
    return queries.select("query_id").join(top, "query_id", "left").select("query_id", "top_score", gate.alias("gate"))


def fallback_plan(
    ranked: DataFrame, confidence: float = S.CONFIDENCE, max_fallback: int = S.MAX_FALLBACK
) -> DataFrame:
    """Candidates tried in turn: confident results among the first few."""
    return ranked.filter((F.col("score") >= confidence) & (F.col("rank") <= max_fallback)).select(
        "query_id", "rank", "name", "score"
    )


def tried_candidates(plan: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Plan with each candidate's outcome and its query's winner rank, null when all fail; the plan is computed once.

    `outcomes(name, success[, query_id])`; a candidate without an outcome has no handler and fails.
    """
    on = ["query_id", "name"] if "query_id" in outcomes.columns else ["name"]
    known = plan.join(outcomes.select(*on, "success"), on, "left").withColumn(
        "success", F.coalesce("success", F.lit(False))
    )
    # a query's candidates: a plan's few
    per_query = Window.partitionBy("query_id")
    won = F.min(F.when(F.col("success"), F.col("rank"))).over(per_query)
    return known.select("*", won.alias("winner_rank"), F.count("*").over(per_query).alias("candidates"))


def attempt_log(plan: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One usage record per candidate tried, the winner last."""
    tried = tried_candidates(plan, outcomes)
    reached = F.col("winner_rank").isNull() | (F.col("rank") <= F.col("winner_rank"))
    return tried.filter(reached).select("query_id", "rank", "name", "success")


def resolve_fallback(plan: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Per query: winner, its rank, failed attempts before it, and status `success` or `all_failed`."""
    tried = tried_candidates(plan, outcomes)
    is_winner = F.col("rank") == F.col("winner_rank")
    per_query = tried.groupBy("query_id", "winner_rank", "candidates").agg(
        F.max(F.when(is_winner, F.col("name"))).alias("winner")
    )
    status = F.when(F.col("winner_rank").isNull(), "all_failed").otherwise("success")
    failed = F.coalesce(F.col("winner_rank") - 1, F.col("candidates"))
    return per_query.select(
        "query_id", status.alias("status"), "winner", "winner_rank", failed.cast("long").alias("failed_attempts")
    )


def alternatives(ranked: DataFrame, resolution: DataFrame, count: int = S.ALTERNATIVES) -> DataFrame:
    """Results offered beside the outcome: those after the winner, or after the failed candidates."""
    tried = F.col("failed_attempts") + F.when(F.col("status") == "success", 1).otherwise(0)
    after = resolution.select("query_id", tried.alias("tried"))
    offered = ranked.join(after, "query_id").filter(
        (F.col("rank") > F.col("tried")) & (F.col("rank") <= F.col("tried") + count)
    )
    return offered.select("query_id", "rank", "name", "score")
