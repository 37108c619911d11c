"""Derived tables kept beside a catalog version, so a query batch reads postings and vectors instead of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signpost.operators.lexical import NO_TERM, TextIndex, by_name, marked_token_rows
from signpost.operators.vectors import VectorIndex, build_vector_index


def write_text_index(catalog: DataFrame, path: str) -> TextIndex:
    """Postings sorted by term within each file, so a term's row groups are found by their min/max statistics.

    The text is read once: entries without tokens are in the postings too, by their NO_TERM row, so that term and
    corpus figures come from what was written. Texts are exchanged by name, not their terms, which take some times as much.
    """
    spark = catalog.sparkSession
    counted = marked_token_rows(by_name(catalog.select("name", "search_text"))).groupBy("name", "doc_len", "term").agg(F.count("*").alias("tf"))
    counted.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    postings = spark.read.parquet(f"{path}/postings")
    entry = F.col("term") == NO_TERM
    terms = postings.filter(~entry).groupBy("term").agg(F.count("*").alias("df"))
    terms.write.mode("overwrite").parquet(f"{path}/terms")
    corpus = postings.filter(entry).agg(
        F.count("*").alias("n"), F.coalesce(F.avg("doc_len"), F.lit(0.0)).alias("avg_len")
    )
    corpus.write.mode("overwrite").parquet(f"{path}/corpus")
    return read_text_index(spark, path)


def read_text_index(spark: SparkSession, path: str) -> TextIndex:
    tables = [spark.read.parquet(f"{path}/{t}") for t in ("postings", "corpus", "terms")]
    return TextIndex(*tables)


def write_vector_index(catalog: DataFrame, path: str, dim: int | None = None) -> VectorIndex:
    """Vectors partitioned by category, so the categories a batch chose prune the scan."""
    spark = catalog.sparkSession
    index = build_vector_index(catalog, dim)
    index.vectors.write.mode("overwrite").partitionBy("category").parquet(f"{path}/vectors")
    index.centroids.write.mode("overwrite").parquet(f"{path}/centroids")
    index.dim.write.mode("overwrite").parquet(f"{path}/dim")
    return read_vector_index(spark, path)


def read_vector_index(spark: SparkSession, path: str) -> VectorIndex:
    vectors = spark.read.schema("name string, vec array<float>, category string").parquet(f"{path}/vectors")
    return VectorIndex(vectors, spark.read.parquet(f"{path}/centroids"), spark.read.parquet(f"{path}/dim"))
