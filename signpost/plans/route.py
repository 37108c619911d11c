"""The whole ranking as one plan: three candidate stages, fusion and top-k within blocks, final top-k."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signpost import schema as S
from signpost.operators import lexical as L
from signpost.operators import rank as R
from signpost.operators import vectors as V
from signpost.operators.blocks import best_of_blocks, cells, stage_scores_of


def stage_scores(
    catalog: DataFrame,
    queries: DataFrame,
    text_index: L.TextIndex | None = None,
    vector_index: V.VectorIndex | None = None,
    vector_k: int = S.VECTOR_TOP_K,
    vector_categories: int = S.VECTOR_CATEGORIES,
) -> DataFrame:
    """Trigger, keyword and semantic score of every candidate: `query_id, name, trigger, keyword, semantic`.

    Stages are put together in the cells of `blocks`, one row per (query, entry). The needed part of the text index is written first.
    """
    terms = L.query_term_counts(queries)
    index, n, avg_len, size = L.index_of_batch(catalog, terms, text_index, by_names=True)
    rows = cells(
        queries.count(), *L.keyword_stage(index, terms, n, avg_len), n, hits=semantic_hits(queries, vector_index, vector_k, vector_categories),
        n_postings=size, **L.trigger_stage(catalog, queries),
    )
    return stage_scores_of(rows, queries.schema["query_id"].dataType.simpleString())


def semantic_hits(queries: DataFrame, vector_index: V.VectorIndex | None, vector_k: int, vector_categories: int) -> list[DataFrame]:
    if vector_index is None:
        return []
    semantic = V.semantic_stage(vector_index, queries, vector_k, vector_categories)
    return [semantic.select("query_id", "name", F.lit(0.0).alias("trigger"), F.col("score").alias("semantic"))]


def best_candidates(
    catalog: DataFrame,
    queries: DataFrame,
    as_of: Column,
    k: int,
    threshold: float,
    weights: Mapping[str, float] | None,
    match: str,
    text_index: L.TextIndex | None,
    vector_index: V.VectorIndex | None,
    vector_k: int,
    vector_categories: int,
) -> DataFrame:
    """Each block's best k of each query, with stage scores and the entry's figures."""
    terms = L.query_term_counts(queries)
    index, n, avg_len, size = L.index_of_batch(catalog, terms, text_index)
    rows = cells(
        queries.count(), *L.keyword_stage(index, terms, n, avg_len), n, R.entry_figures(catalog, as_of, weights, match),
        semantic_hits(queries, vector_index, vector_k, vector_categories), n_postings=size, **L.trigger_stage(catalog, queries),
    )
    return best_of_blocks(rows, queries.schema["query_id"].dataType.simpleString(), k, threshold)


def route(
    catalog: DataFrame,
    queries: DataFrame,
    *,
    top_k: int | None = S.TOP_K,
    threshold: float | None = S.THRESHOLD,
    weights: Mapping[str, float] | None = None,
    match: str = "exact",
    as_of: Column | None = None,
    text_index: L.TextIndex | None = None,
    vector_index: V.VectorIndex | None = None,
    vector_k: int = S.VECTOR_TOP_K,
    vector_categories: int = S.VECTOR_CATEGORIES,
    explorer_seed: str | None = None,
    explorer_percent: int = S.EXPLORER_PERCENT,
) -> DataFrame:
    """Best entries for each query of a batch.

    `queries(query_id, query_text[, embedding])`. Without `vector_index` the other stages answer alone; without
    `text_index` the needed part of it is built in the same plan. The semantic stage scores the
    `vector_k` nearest entries from the `vector_categories` nearest categories; others get 0 from it. Give
    `explorer_seed` for the explorer slot.
    """
    now = F.current_timestamp() if as_of is None else as_of
    least = threshold or S.THRESHOLD
    found = best_candidates(
        catalog, queries, now, R.effective_top_k(top_k), least, weights, match,
        text_index, vector_index, vector_k, vector_categories,
    )
    ranked = R.rank_top_k(R.final_scores(found, least), top_k)
    if explorer_seed is None:
        return ranked.withColumn("explorer", F.lit(False))
    return R.add_explorer(ranked, catalog, top_k, explorer_seed, explorer_percent)
