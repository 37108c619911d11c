"""Catalog maintenance. Every function takes DataFrames and returns the next catalog as a DataFrame.

A small batch leaves the catalog unshuffled: untouched rows pass an anti join and only the old values of the
touched names are fetched, by a semi join; both sides are broadcast by Spark when the batch is small.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from signpost import schema as S
from signpost.functions.text import blank_to_null
from signpost.operators import quality as Q
from signpost.operators.entries import catalog_search_text, normalize_entries, with_fields
from signpost.operators.windows import keep_last

NAMES = S.CATALOG.names


def _orderable(kind: DataType) -> bool:
    if isinstance(kind, ArrayType):
        return _orderable(kind.elementType)
    if isinstance(kind, StructType):
        return all(_orderable(f.dataType) for f in kind.fields)
    return not isinstance(kind, MapType | VariantType)


def _whole_row(df: DataFrame) -> Column:
    """A total order over rows that hold no order of their own: by their columns from left to right, nulls first.

    Columns are compared as they are, and only where all before them tie; those without an order count by their JSON.
    """
    parts = []
    for i, f in enumerate(df.schema.fields):
        column = F.col(f"`{f.name}`")
        told = column if _orderable(f.dataType) else F.when(column.isNotNull(), F.to_json(F.struct(column)))
        parts.append(told.alias(f"_{i}"))
    return F.struct(*parts)


def dedupe_batch(batch: DataFrame) -> DataFrame:
    """One row per name: the last by `seq`, among equal ones or without it the last in the order of the rows' columns."""
    order = [F.desc("seq")] if "seq" in batch.columns else []
    return keep_last(batch, "name", [*order, F.desc(_whole_row(batch))])


def upsert_catalog(
    catalog: DataFrame, batch: DataFrame, as_of: Column | None = None, preserve_all: bool = False
) -> DataFrame:
    """Insert or replace by name; of rows that repeat a name one stands, as `dedupe_batch` says.

    A replaced entry keeps its use count unless zero, its success rate, its registration time, and its vector
    unless a new one is given; its last use and failure count start afresh. `preserve_all` keeps those too.
    """
    batch = batch.withColumn("name", F.coalesce("name", F.lit("")))
    entries = normalize_entries(dedupe_batch(batch), as_of).select(*NAMES)
    touched = batch.select("name").distinct()
    untouched = catalog.select(*NAMES).join(touched, "name", "left_anti")
    kept = ["usage_count", "success_rate", "embedding", "registered_at", "last_used_at", "consecutive_failures"]
    old = catalog.select("name", *[F.col(c).alias(f"_{c}") for c in kept]).join(touched, "name", "left_semi")
    merged = {
        "usage_count": F.coalesce(F.nullif(F.col("_usage_count"), F.lit(0)), F.col("usage_count")),
        "success_rate": F.coalesce("_success_rate", "success_rate"),
        "embedding": F.coalesce("embedding", "_embedding"),
        "registered_at": F.coalesce("_registered_at", "registered_at"),
    }
    if preserve_all:
        merged["last_used_at"] = F.coalesce("last_used_at", "_last_used_at")
        merged["consecutive_failures"] = F.coalesce("_consecutive_failures", "consecutive_failures")
    both = entries.join(old, "name", "left")
    replaced = both.select(*[merged[c].alias(c) if c in merged else F.col(c) for c in NAMES])
    return untouched.unionByName(replaced)


def purge_source(catalog: DataFrame, source: str) -> DataFrame:
    return catalog.filter(~F.col("source").eqNullSafe(F.lit(source)))


def last_unit_per_source(batch: DataFrame, unit: str) -> DataFrame:
    """Rows of the last unit (file path, say) of each source: every unit purges the ones before it."""
    last = batch.groupBy("source").agg(F.max(unit).alias(unit))
    return batch.join(last, ["source", unit], "left_semi")


def replace_source(
    catalog: DataFrame, batch: DataFrame, as_of: Column | None = None, preserve_all: bool = False
) -> DataFrame:
    """Replace every source named in the batch by the batch's rows; loading twice equals loading once.

    Learned statistics of a replaced source are lost, as its rows are purged first (`preserve_all` keeps those of
    the names that come back); a name held by another source is taken over with its statistics.
    """
    sources = batch.select("source").distinct()
    if preserve_all:
        gone = catalog.join(sources, "source", "left_semi").join(batch.select("name"), "name", "left_anti")
        return upsert_catalog(catalog.join(gone.select("name"), "name", "left_anti"), batch, as_of, True)
    return upsert_catalog(catalog.join(sources, "source", "left_anti"), batch, as_of)


def delete_names(catalog: DataFrame, names: DataFrame) -> DataFrame:
    return catalog.join(names.select("name").distinct(), "name", "left_anti")


def missing_names(catalog: DataFrame, names: DataFrame) -> DataFrame:
    return names.select("name").distinct().join(catalog.select("name"), "name", "left_anti")


def delete_provider(catalog: DataFrame, provider: str) -> DataFrame:
    return catalog.filter(~F.col("provider").eqNullSafe(F.lit(provider)))


def deletion_report(catalog: DataFrame, column: str, value: str) -> DataFrame:
    """One row for `purge_source` (column source) or `delete_provider` (column provider): value, deleted, found.

    `found` is false where no entry has the value, and nothing is deleted.
    """
    gone = catalog.filter(F.col(column).eqNullSafe(F.lit(value))).agg(F.count("*").alias("deleted"))
    return gone.select(F.lit(value).alias("value"), "deleted", (F.col("deleted") > 0).alias("found"))


def create_entries(catalog: DataFrame, batch: DataFrame, as_of: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Validated insert: the next catalog and the judged batch. Triggers are derived, boost keywords not taken."""
    judged = Q.validate_new(batch, catalog)
    fresh = judged.filter("valid").select(
        "name", "description", F.coalesce(blank_to_null(F.col("source")), F.lit("local")).alias("source"),
        "category", "provider", "input_schema", "tags", "examples", "endpoint",
    )
    return upsert_catalog(catalog, fresh, as_of), judged


UPDATABLE_TEXT = ("description", "source", "category", "provider", "input_schema", "endpoint")
UPDATABLE_LISTS = ("tags", "examples")


def update_entries(
    catalog: DataFrame, updates: DataFrame, as_of: Column | None = None, preserve_all: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Validated change of known entries: the next catalog and the judged updates.

    Given fields replace, others stay; several updates of a name apply in `seq` order, without
    one in the order of the rows' columns. Custom triggers and boost
    keywords are lost, since the entry is built anew, unless `preserve_all`.
    """
    judged = Q.validate_update(updates, catalog)
    order = F.col("seq")
    if "seq" not in judged.columns:
        order, judged = _whole_row(judged), judged.withColumn("seq", F.lit(0))
    text = [F.max_by(c, F.when(Q.given(F.col(c)), order)).alias(f"_{c}") for c in UPDATABLE_TEXT]
    lists = [F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(f"_{c}") for c in UPDATABLE_LISTS]
    changes = judged.filter("valid").groupBy(F.col("entry").alias("name")).agg(*text, *lists)
    kept = [c for c in ("triggers", "boost_keywords", "last_used_at") if preserve_all]
    current = catalog.select("name", *UPDATABLE_TEXT, *UPDATABLE_LISTS, *kept).join(changes, "name")
    rows = current.select(
        "name", *[F.coalesce(f"_{c}", c).alias(c) for c in (*UPDATABLE_TEXT, *UPDATABLE_LISTS)], *kept
    )
    return upsert_catalog(catalog, rows, as_of, preserve_all), judged


def missing_updates(catalog: DataFrame, updates: DataFrame) -> DataFrame:
    """Named entries the catalog does not hold."""
    return missing_names(catalog, updates.select(Q.updated_entry(updates).alias("name")))


Embedder = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def embed_missing(catalog: DataFrame, embed: Embedder) -> DataFrame:
    """`name, embedding` of the entries lacking a vector, as the user's function gives them.

    `embed` maps batches of (name, search_text) to (name, embedding); entries with a vector never reach Python.
    The embedder is given the whole search text; how much of it a model takes in is the function's affair.
    """
    lacking = catalog.filter(F.col("embedding").isNull())
    text = F.coalesce(blank_to_null(F.col("search_text")), catalog_search_text())
    inputs = lacking.select("name", text.alias("search_text"))
    return inputs.mapInPandas(embed, "name string, embedding array<float>")


def fill_embeddings(catalog: DataFrame, embed: Embedder) -> DataFrame:
    """Catalog with missing vectors filled; an empty vector counts as failed and stays missing."""
    new = embed_missing(catalog, embed).filter(F.size("embedding") > 0)
    lacking = catalog.filter(F.col("embedding").isNull()).drop("embedding").join(new, "name", "left")
    return catalog.filter(F.col("embedding").isNotNull()).unionByName(lacking)


def fill_embeddings_observed(catalog: DataFrame, embed: Embedder) -> tuple[DataFrame, Observation]:
    """The catalog of `fill_embeddings` and what an action on it counts: embedded, failed and skipped entries.

    Counts are taken as the rows pass, so each text is embedded once for both; `get` waits for the first action.
    """
    seen = Observation("embedding")
    vector = F.col("_new")
    new = embed_missing(catalog, embed).withColumnRenamed("embedding", "_new")
    joined = catalog.join(new, "name", "left").observe(
        seen,
        F.count_if(F.col("embedding").isNull() & (F.size(vector) > 0)).alias("embedded"),
        F.count_if(F.col("embedding").isNotNull()).alias("skipped"),
        F.count_if(F.col("embedding").isNull() & ~F.coalesce(F.size(vector) > 0, F.lit(False))).alias("failed"),
    )
    filled = F.coalesce("embedding", F.when(F.size(vector) > 0, vector)).alias("embedding")
    return joined.select(*[filled if c == "embedding" else F.col(c) for c in catalog.columns]), seen


def embedding_report(catalog: DataFrame, embed: Embedder) -> DataFrame:
    """One row: entries embedded, skipped (had a vector) and failed."""
    done = embed_missing(catalog, embed).agg(F.count_if(F.size("embedding") > 0).alias("n")).scalar()
    counted = catalog.agg(
        F.count("embedding").alias("skipped"), F.count_if(F.col("embedding").isNull()).alias("lacking")
    )
    return counted.select(done.alias("embedded"), "skipped", (F.col("lacking") - done).alias("failed"))


def with_catalog_fields(df: DataFrame) -> DataFrame:
    return with_fields(df, S.CATALOG).select(*NAMES)
