"""Vector search (P11, R4-R6, G4) and routing with all three stages."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from signpost import functions as X
from signpost.operators import vectors as V
from signpost.plans import route as P
from signpost.plans.indexes import write_vector_index
from signpost.session import shared_folder
from workload import ranking as R
from workload import tables as T


def index_of(spark, sf_dir):
    return V.build_vector_index(T.vector_catalog(spark, sf_dir))


def cosine_similarity(spark, sf_dir):
    index = index_of(spark, sf_dir)
    both = index.vectors.join(index.centroids, "category")
    return both.select("name", T.rounded(X.cosine_similarity(F.col("vec"), F.col("centroid")), 6).alias("cosine"))


def vector_index(spark, sf_dir):
    centroids = index_of(spark, sf_dir).centroids
    rows = centroids.select("category", "n", F.posexplode("centroid").alias("position", "mean"))
    return rows.select("category", "n", F.col("position").cast("long").alias("position"), T.rounded("mean", 6).alias("mean"))


def nearest_categories(spark, sf_dir):
    best = V.nearest_categories(index_of(spark, sf_dir), T.vector_queries(spark, sf_dir))
    return best.select("query_id", "category", T.rounded("cosine", 6).alias("cosine"), "rank")


def centroid_search(spark, sf_dir):
    found = V.centroid_search(index_of(spark, sf_dir), T.vector_queries(spark, sf_dir))
    return found.select("query_id", "name", T.rounded("cosine", 6).alias("cosine"), "rank")


def centroid_search_stored(spark, sf_dir):
    """As `centroid_search`, over an index that was written first."""
    index = write_vector_index(T.vector_catalog(spark, sf_dir), f"{shared_folder(spark)}/vectors-{uuid4().hex}")
    found = V.centroid_search(index, T.vector_queries(spark, sf_dir))
    return found.select("query_id", "name", T.rounded("cosine", 6).alias("cosine"), "rank")


def semantic_stage(spark, sf_dir):
    found = V.semantic_stage(index_of(spark, sf_dir), T.vector_queries(spark, sf_dir))
    return found.select("query_id", "name", T.rounded("score", 6).alias("score"))


def vector_index_stats(spark, sf_dir):
    return V.vector_index_stats(index_of(spark, sf_dir))


def embedded_documents(spark, sf_dir):
    """Documents with the vector of the same number; those without one keep a null.

    Grouped by name the vectors are known to be unique, and readers of other columns skip the join.
    """
    vectors = (
        T.table(spark, sf_dir, "embeddings")
        .groupBy(F.concat(F.lit("doc_"), F.col("vec_id").cast("string")).alias("name"))
        .agg(F.max("embedding").alias("embedding"))
    )
    catalog = T.used_document_catalog(spark, sf_dir)
    return catalog.drop("embedding").join(vectors, "name", "left").select(catalog.columns)


def route_with_vectors(spark, sf_dir):
    catalog = embedded_documents(spark, sf_dir)
    vectors = T.table(spark, sf_dir, "embeddings").groupBy(F.col("vec_id").alias("query_id")).agg(F.max("embedding").alias("embedding"))
    queries = T.benchmark_queries(spark, sf_dir).join(vectors, "query_id", "left")
    ranked = P.route(
        catalog, queries, as_of=T.as_of(), weights=R.WEIGHTS, vector_index=V.build_vector_index(catalog)
    )
    return R.shown(ranked, "rank")


NEAREST = f"""centroid_scores AS (SELECT q.vec_id AS query_id, c.category, {T.cosine_sql("q.v", "c.c")} AS cosine
  FROM query_vectors q, centroids c),
nearest AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 12) DESC, category) AS rank FROM centroid_scores
  QUALIFY rank <= 4),
entry_scores AS (SELECT n.query_id, v.name, {T.cosine_sql("q.v", "v.v")} AS cosine
  FROM nearest n JOIN vectors v USING (category) JOIN query_vectors q ON q.vec_id = n.query_id),
found AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 12) DESC, name) AS rank FROM entry_scores
  QUALIFY rank <= 20)"""
BASE = f"WITH {T.VECTORS}, {T.CENTROIDS}"
SEARCH = f"{BASE}, query_vectors AS (SELECT vec_id, v FROM vectors), {NEAREST}"
DOC_VECTORS = f"""vectors AS (SELECT 'doc_' || vec_id AS name, lang AS category, list_transform(embedding, lambda x: x::DOUBLE) AS v
  FROM embeddings JOIN documents ON doc_id = vec_id), {T.CENTROIDS},
query_vectors AS (SELECT item_id AS vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v
  FROM benchmark JOIN embeddings ON vec_id = item_id), {NEAREST}"""

QUERIES = {
    "cosine_similarity": (
        cosine_similarity,
        f"{BASE} SELECT name, {T.rounded_sql(T.cosine_sql('v', 'c'), 6)} AS cosine FROM vectors JOIN centroids USING (category)",
    ),
    "vector_index": (
        vector_index,
        f"""{BASE}, n AS (SELECT category, count(*) AS n FROM vectors GROUP BY category)
        SELECT category, n, i - 1 AS position, {T.rounded_sql("m", 6)} AS mean FROM parts_of JOIN n USING (category)""",
    ),
    "nearest_categories": (
        nearest_categories,
        f"{SEARCH} SELECT query_id, category, {T.rounded_sql('cosine', 6)} AS cosine, rank FROM nearest",
    ),
    "centroid_search": (
        centroid_search,
        f"{SEARCH} SELECT query_id, name, {T.rounded_sql('cosine', 6)} AS cosine, rank FROM found",
    ),
    "centroid_search_stored": (
        centroid_search_stored,
        f"{SEARCH} SELECT query_id, name, {T.rounded_sql('cosine', 6)} AS cosine, rank FROM found",
    ),
    "semantic_stage": (
        semantic_stage,
        f"{SEARCH} SELECT query_id, name, {T.rounded_sql('cosine * 2e0', 6)} AS score FROM found",
    ),
    "vector_index_stats": (
        vector_index_stats,
        """SELECT count(*) AS entries, 64::BIGINT AS dimension, count(DISTINCT label) AS categories,
        floor(count(*) * 64 * 4 / 1024e0 + 0.5e0)::BIGINT AS memory_kb FROM embeddings""",
    ),
    "route_with_vectors": (
        route_with_vectors,
        f"""WITH RECURSIVE {R.DOC_CAT}, {T.BENCHMARK}, {R.LEXICAL}, {R.KEYWORD}, {R.TRIGGER}, {DOC_VECTORS},
        {R.fused_sql(R.WEIGHT_SQL, "SELECT query_id, name, 0e0, 0e0, cosine * 2e0 FROM found")}
        SELECT {R.SHOWN_SQL}, rank FROM numbered_results WHERE rank <= 5""",
    ),
}
