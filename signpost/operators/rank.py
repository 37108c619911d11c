"""Fusing stage scores with usage, success, recency and source weight; top-k; explorer slot."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signpost import schema as S
from signpost.functions import scoring as X
from signpost.operators.windows import rank_within

STAGES = ("trigger", "keyword", "semantic")


def stage_frame(df: DataFrame, stage: str, score: Column) -> DataFrame:
    """One stage's scores in the common shape, the other stages zero."""
    return df.select(
        "query_id",
        "name",
        *[(score.cast("double") if s == stage else F.lit(0.0)).alias(s) for s in STAGES],
    )


def sum_stages(frames: list[DataFrame]) -> DataFrame:
    """Stage totals per (query, entry). Frames laid out by name are summed where they lie."""
    union = frames[0]
    for frame in frames[1:]:
        union = union.unionByName(frame)
    return union.groupBy("query_id", "name").agg(*[F.sum(s).alias(s) for s in STAGES])


def fuse_scores(
    stages: DataFrame,
    catalog: DataFrame,
    as_of: Column,
    threshold: float = S.THRESHOLD,
    weights: Mapping[str, float] | None = None,
    match: str = "exact",
) -> DataFrame:
    """Final score of each candidate; the unrounded score must reach the threshold.

    Only the five scoring fields of the catalog travel; wide columns are joined after the top-k.
    """
    return final_scores(stages.join(entry_figures(catalog, as_of, weights, match), "name"), threshold)


def entry_figures(
    catalog: DataFrame, as_of: Column, weights: Mapping[str, float] | None = None, match: str = "exact"
) -> DataFrame:
    """`name, usage, success, recency, factor`: what an entry adds to its stages, and the weight of its source."""
    recency = X.recency_factor(F.col("last_used_at"), as_of)
    return catalog.select(
        "name",
        X.usage_bonus(F.col("usage_count"), recency).alias("usage"),
        X.success_bonus(F.col("success_rate")).alias("success"),
        recency.alias("recency"),
        X.source_weight(F.col("source"), weights, match).alias("factor"),
    )


def final_scores(candidates: DataFrame, threshold: float) -> DataFrame:
    """Rounded scores of candidates with stages and figures; the unrounded score must reach the threshold."""
    raw = F.col("trigger") + F.col("keyword") + F.col("semantic") + F.col("usage") + F.col("success")
    scored = candidates.withColumn("final", raw * F.col("factor")).filter(
        (F.col("final") >= F.lit(float(threshold))) & ~F.isnan("final")
    )
    return scored.select(
        "query_id",
        "name",
        X.round_half_up(F.col("final"), 2).alias("score"),
        *STAGES,
        X.round_half_up(F.col("usage"), 2).alias("usage"),
        X.round_half_up(F.col("success"), 2).alias("success"),
        X.round_half_up(F.col("recency"), 3).alias("recency"),
    )


def effective_top_k(top_k: int | None) -> int:
    """0 or None means the default."""
    return top_k or S.TOP_K


def rank_top_k(scored: DataFrame, top_k: int | None = S.TOP_K) -> DataFrame:
    """Best k per query on the rounded score, ties by name."""
    return rank_within(scored, "query_id", [F.desc("score"), F.asc("name")], effective_top_k(top_k))


def explorer_fires(query_id: Column, seed: str, percent: int) -> Column:
    digest = F.md5(F.concat(F.lit(f"{seed}:"), query_id.cast("string")))
    roll = F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(100))
    return roll < percent


def add_explorer(
    ranked: DataFrame,
    catalog: DataFrame,
    top_k: int | None = S.TOP_K,
    seed: str = "0",
    percent: int = S.EXPLORER_PERCENT,
) -> DataFrame:
    """Append the least-used entry missing from a query's results, for a seeded share of the queries.

    k results cannot cover the k + 1 least-used entries, so that many are enough to choose from. The slot is
    added next to the first result in the same pass, so the ranking is not computed a second time.
    """
    size = effective_top_k(top_k) + 1
    usage = F.coalesce("usage_count", F.lit(0)).alias("usage_count")
    least = catalog.select(usage, "name").orderBy("usage_count", "name").limit(size)
    pool = least.agg(F.sort_array(F.collect_list(F.struct("usage_count", "name"))).alias("pool")).scalar()
    per_query = Window.partitionBy("query_id")
    listed = ranked.withColumn("_names", F.collect_list("name").over(per_query)).withColumn("_pool", pool)
    unlisted = F.filter("_pool", lambda e: ~F.array_contains(F.col("_names"), e["name"]))
    pick = F.try_element_at(unlisted, F.lit(1))["name"]
    fires = (
        (F.col("rank") == 1)
        & (F.size("_names") >= S.EXPLORER_MIN_RESULTS)
        & explorer_fires(F.col("query_id"), seed, percent)
        & pick.isNotNull()
    )
    own = F.struct(*[F.col(c) for c in ranked.columns if c != "query_id"], F.lit(False).alias("explorer"))
    slot = F.struct(
        *[
            pick.alias(c) if c == "name"
            else (F.size("_names") + 1).cast("long").alias(c) if c == "rank"
            else F.lit(0.0).alias(c)
            for c in ranked.columns if c != "query_id"
        ],
        F.lit(True).alias("explorer"),
    )
    rows = F.explode(F.when(fires, F.array(own, slot)).otherwise(F.array(own))).alias("row")
    return listed.select("query_id", rows).select("query_id", "row.*")


def attach_details(results: DataFrame, catalog: DataFrame) -> DataFrame:
    """Descriptive catalog columns for the few rows that were ranked."""
    wide = catalog.select("name", "description", "source", "category", "input_schema")
    return results.join(wide, "name")


def no_match_report(queries: DataFrame, results: DataFrame, catalog: DataFrame, categories: bool = False) -> DataFrame:
    """Queries without a result, with the size of the catalog.

    With `categories` also `category_counts`: (category, entries) of each, largest first, then by name.
    """
    total = catalog.agg(F.count("*").alias("n")).scalar()
    missing = queries.join(results.select("query_id").distinct(), "query_id", "left_anti")
    report = missing.select("query_id", "query_text", total.alias("catalog_size"))
    if not categories:
        return report
    counts = catalog.groupBy("category").agg(F.count("*").alias("n"))
    # one row per category of the catalog
    listed = counts.agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("minus"), "category"))).alias("all"))
    pair = lambda c: F.struct(c["category"].alias("category"), (-c["minus"]).alias("entries"))
    return report.withColumn("category_counts", listed.select(F.transform("all", pair).alias("all")).scalar())
