"""Indexes bound to the catalog version they were built from.

`write_indexes` builds the text and, if there are vectors, the vector index of the current catalog version into a folder of their own
and then writes one small manifest that names the version; a manifest is only there when its indexes are whole. `read_bound` gives catalog and
indexes of one version and refuses a catalog that has moved on, so a ranking never mixes versions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from signpost.operators.lexical import TextIndex
from signpost.operators.vectors import VectorIndex
from signpost.plans.indexes import read_text_index, read_vector_index, write_text_index, write_vector_index
from signpost.sources.snapshot import current_version, read_catalog

BINDING = "version long, text boolean, vectors boolean"


class StaleIndexError(RuntimeError):
    """The catalog has a later version than the indexes, or no indexes at all."""


@dataclass(frozen=True)
class Bound:
    """A catalog and the indexes of the same version."""

    version: int
    catalog: DataFrame
    text_index: TextIndex
    vector_index: VectorIndex | None


def _folder(path: str, version: int) -> str:
    return f"{path}/indexes/{version}"


def write_indexes(spark: SparkSession, path: str, vectors: bool = True, dim: int | None = None) -> Bound:
    """Build the indexes of the catalog at `path`; building them again for one version replaces them."""
    version = current_version(spark, path)
    catalog = read_catalog(spark, path, version)
    folder = _folder(path, version)
    write_text_index(catalog, f"{folder}/text")
    if vectors:
        write_vector_index(catalog, f"{folder}/vectors", dim)
    bound = spark.createDataFrame([(version, True, vectors)], BINDING)
    bound.coalesce(1).write.mode("overwrite").parquet(f"{folder}/bound")
    return read_bound(spark, path)


def read_bound(spark: SparkSession, path: str) -> Bound:
    """Catalog and indexes of its current version; StaleIndexError where that has none."""
    version = current_version(spark, path)
    folder = _folder(path, version)
    try:
        bound = spark.read.schema(BINDING).parquet(f"{folder}/bound").first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        bound = None
    if bound is None or bound.version != version:
        raise StaleIndexError(f"catalog version {version} at {path} has no indexes")
    vectors = read_vector_index(spark, f"{folder}/vectors") if bound.vectors else None
    return Bound(version, read_catalog(spark, path, version), read_text_index(spark, f"{folder}/text"), vectors)
