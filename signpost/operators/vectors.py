"""Vector search over category partitions, as blocked joins.

A search picks the best categories by centroid and then scans those categories exactly. Both steps are the
same operator, `nearest_in_groups`: rows of a group are spread over blocks of bounded size, queries meet each
block of their groups by an equi-join, numpy scores one block at a time and only its best k rows leave the
task. No all-pairs table is built, and a category holding a third of all rows is just more blocks.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signpost import schema as S
from signpost.functions.scoring import round_half_up
from signpost.operators.windows import rank_within
from signpost.session import shared_folder

ROWS_PER_BLOCK = 32_768
QUERIES_PER_BLOCK = 8_192
#: Cosines of a task worked on at once: 8 MB, and as much again for what is derived from them.
CELLS_AT_ONCE = 1_000_000
#: Chosen categories up to which the scan of the vectors is given their list; more are joined to it.
FEW_CATEGORIES = 1_000
COSINE_DIGITS = 12  # scores closer than this tie and fall back to the name


@dataclass(frozen=True)
class VectorIndex:
    """`vectors(name, category, vec)` and `centroids(category, n, centroid)`; `dim` is one-row (dim)."""

    vectors: DataFrame
    centroids: DataFrame
    dim: DataFrame


def common_dimension(catalog: DataFrame) -> DataFrame:
    """Most frequent vector length, the longest among equals; one row."""
    lengths = catalog.filter(F.size("embedding") > 0).groupBy(F.size("embedding").alias("dim"))
    best = lengths.agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1)
    return best.agg(F.max("dim").alias("dim"))


def clean_vector(vec: Column, dim: Column) -> Column:
    """Cut or zero-fill to `dim`; null and NaN components become 0."""
    padding = F.array_repeat(F.lit(0.0).cast("float"), F.greatest(dim - F.size(vec), F.lit(0)))
    whole = F.slice(F.concat(vec, padding), F.lit(1), dim)
    return F.transform(whole, lambda x: F.coalesce(F.nanvl(x, F.lit(0.0).cast("float")), F.lit(0.0).cast("float")))


def build_vector_index(catalog: DataFrame, dim: int | None = None) -> VectorIndex:
    dims = common_dimension(catalog)
    if dim is not None:
        dims = dims.select(F.lit(dim).alias("dim"))
    vectors = (
        catalog.filter(F.size("embedding") > 0)
        .withColumn("dim", dims.scalar())
        .select(
            "name",
            F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit("misc")).alias("category"),
            clean_vector(F.col("embedding"), F.col("dim")).alias("vec"),
        )
    )
    # Summarizer keeps one running mean per category and task: nothing is exploded before the exchange.
    centroids = vectors.groupBy("category").agg(
        F.count("*").alias("n"), Summarizer.mean(array_to_vector(F.col("vec").cast("array<double>"))).alias("mean")
    )
    return VectorIndex(vectors, centroids.select("category", "n", vector_to_array("mean").alias("centroid")), dims)


def _unit_rows(vectors: pd.Series) -> np.ndarray:
    m = np.vstack(vectors.to_numpy()).astype(np.float64)
    norms = np.sqrt(np.einsum("ij,ij->i", m, m))
    norms[norms == 0] = np.inf  # a zero vector scores 0 against everything
    m /= norms[:, None]
    return m


def _block_top_k(k: int):
    def score(key, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or rows.empty:
            return pd.DataFrame({"query_id": queries["query_id"][:0], "name": rows["name"][:0].astype(object), "cosine": []})
        rows = rows.sort_values("name", ignore_index=True)
        unit, names = _unit_rows(rows["vec"]), rows["name"].to_numpy()
        wanted, best = _unit_rows(queries["query_vec"]), min(k, len(rows))
        step = max(1, CELLS_AT_ONCE // len(rows))
        out_query, out_row, out_score = [], [], []
        for start in range(0, len(queries), step):
            cos = wanted[start : start + step] @ unit.T
            np.round(cos, COSINE_DIGITS, out=cos)
            floor = np.partition(cos, len(rows) - best, axis=1)[:, len(rows) - best]
            for i, line in enumerate(cos):
                # everything at or above the k-th score; rows are in name order, so a stable sort breaks ties by name
                keep = np.flatnonzero(line >= floor[i])
                keep = keep[np.argsort(-line[keep], kind="stable")][:best]
                out_query.append(np.full(len(keep), start + i))
                out_row.append(keep)
                out_score.append(line[keep])
        return pd.DataFrame(
            {
                "query_id": queries["query_id"].to_numpy()[np.concatenate(out_query)],
                "name": pd.Series(names[np.concatenate(out_row)], dtype=object),
                "cosine": np.concatenate(out_score),
            }
        )

    return score


def nearest_in_groups(queries: DataFrame, wanted: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Best k rows by cosine per query: `query_id, name, cosine, rank`.

    `wanted(query_id, query_vec, grp, blocks)` asks, for one of the `queries`, for a group split into `blocks`;
    `rows(name, vec, grp, blocks)` belong to one. Large query batches are cut into blocks too, by the number of all
    queries, which no group exceeds, so both inputs of a task stay bounded.
    """
    query_blocks = F.greatest(
        F.ceil(queries.agg(F.count("*").alias("n")).scalar() / F.lit(float(QUERIES_PER_BLOCK))).cast("int"), F.lit(1)
    )
    asked = wanted.select(
        "query_id", "query_vec", "grp",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.pmod(F.xxhash64("query_id"), query_blocks).cast("int").alias("query_block"),
    )
    spread = rows.select(
        "name", "vec", "grp",
        F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), query_blocks - 1)).alias("query_block"),
    )
    id_type = wanted.schema["query_id"].dataType.simpleString()
    keys = ["grp", "block", "query_block"]
    local = asked.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInPandas(
        _block_top_k(k), f"query_id {id_type}, name string, cosine double"
    )
    return rank_within(local, "query_id", [F.desc("cosine"), F.asc("name")], k)


def block_count(n: Column) -> Column:
    return F.greatest(F.ceil(n / F.lit(float(ROWS_PER_BLOCK))).cast("int"), F.lit(1))


def usable_queries(index: VectorIndex, queries: DataFrame) -> DataFrame:
    """Queries whose vector has the dimension of the index; others find nothing by meaning."""
    return queries.filter(F.size("embedding") == index.dim.scalar()).select(
        "query_id", F.col("embedding").alias("query_vec")
    )


def nearest_categories(index: VectorIndex, queries: DataFrame, top_categories: int = S.VECTOR_CATEGORIES) -> DataFrame:
    """Best categories per query: `query_id, category, cosine, rank`."""
    blocks = block_count(index.centroids.agg(F.count("*").alias("n")).scalar())
    wanted = usable_queries(index, queries).select("query_id", "query_vec", F.lit(0).alias("grp"), blocks.alias("blocks"))
    rows = index.centroids.select(
        F.col("category").alias("name"), F.col("centroid").alias("vec"), F.lit(0).alias("grp"), blocks.alias("blocks")
    )
    return nearest_in_groups(queries, wanted, rows, top_categories).withColumnRenamed("name", "category")


def chosen_categories(index: VectorIndex, queries: DataFrame, top_categories: int) -> DataFrame:
    """`query_id, category`, written once to the shared folder: the queries and the scan of the vectors both start from it."""
    path = f"{shared_folder(queries.sparkSession)}/chosen-{uuid.uuid4().hex}"
    nearest_categories(index, queries, top_categories).select("query_id", "category").write.parquet(path)
    return queries.sparkSession.read.parquet(path)


def vectors_of(index: VectorIndex, chosen: DataFrame) -> DataFrame:
    """Vectors of the chosen categories; where they are stored by category, the others are not read."""
    categories = chosen.select("category").distinct()
    few = [r.category for r in categories.limit(FEW_CATEGORIES + 1).collect()]
    if len(few) <= FEW_CATEGORIES:
        return index.vectors.where(F.col("category").isin(few))
    return index.vectors.join(categories, "category", "left_semi")


def centroid_search(
    index: VectorIndex,
    queries: DataFrame,
    top_k: int = S.VECTOR_TOP_K,
    top_categories: int = S.VECTOR_CATEGORIES,
) -> DataFrame:
    """Exact nearest entries within each query's best categories: `query_id, name, cosine, rank`."""
    sizes = index.centroids.select("category", block_count(F.col("n")).alias("blocks"))
    chosen = chosen_categories(index, queries, top_categories)
    wanted = chosen.join(usable_queries(index, queries), "query_id").join(sizes, "category")
    rows = vectors_of(index, chosen).join(sizes, "category")
    return nearest_in_groups(
        queries,
        wanted.select("query_id", "query_vec", F.col("category").alias("grp"), "blocks"),
        rows.select("name", "vec", F.col("category").alias("grp"), "blocks"),
        top_k,
    )


def semantic_stage(
    index: VectorIndex, queries: DataFrame, top_k: int = S.VECTOR_TOP_K, categories: int = S.VECTOR_CATEGORIES
) -> DataFrame:
    """Cosine times the stage weight for the best `top_k` entries of each query's nearest `categories`."""
    found = centroid_search(index, queries, top_k, categories)
    return found.select("query_id", "name", (F.col("cosine") * F.lit(S.SEMANTIC_WEIGHT)).alias("score"))


def vector_index_stats(index: VectorIndex) -> DataFrame:
    """Rows, dimension, categories and matrix size in KB (four bytes a component)."""
    dim = F.coalesce(index.dim.scalar(), F.lit(0))
    totals = index.centroids.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("entries"), F.count("*").alias("categories")
    )
    size = round_half_up(F.col("entries") * dim * F.lit(4) / F.lit(1024.0), 0)
    return totals.select("entries", dim.cast("long").alias("dimension"), "categories", size.cast("long").alias("memory_kb"))
