"""Corpus pipeline: quality, repeated lines, near duplicates, benchmark leaks, source mix.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns the columns of `documents`; the last
returns the training order. Stages are written and read again between each other, so that each starts from a table.
"""

from __future__ import annotations

import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import signpost
from signpost.llm import decontaminate, jaccard_join, line_dedup, mixing, pu_quality
from signpost.llm.common import shared_dir

# Executors need not have the package: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(signpost)

#: Some stages can only be said in Python; the whole is tested against a brute-force version.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, learned from the labels outside its held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    trainable = ~pu_quality.held_out_fold(F.col("doc_id"), 4, 2)
    model = pu_quality.train(docs, labels, trainable)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    accepted = pu_quality.score_documents(whole, model).where(F.col("score") >= pu_quality.THRESHOLD)
    return accepted.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without lines that a smaller doc_id holds."""
    return line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at 0.8; documents without words all stay."""
    return jaccard_join.one_per_component(docs, num=4, den=5, shingle=5)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies in training order."""
    return mixing.mix_documents(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("source mix", source_mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        path = f"{shared_dir(spark)}/stage-{i}-{uuid.uuid4().hex}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
