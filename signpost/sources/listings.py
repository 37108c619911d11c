"""Entries listed by servers, and bulk rows handed over by a caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signpost import schema as S
from signpost.functions.text import blank_to_null, boost_keywords, infer_category
from signpost.operators.catalog import replace_source, upsert_catalog
from signpost.operators.entries import with_fields


def listing_entries(listings: DataFrame) -> DataFrame:
    """`listings(server, tool_name, description, input_schema[, seq])` -> raw entries."""
    tool, server = F.col("tool_name"), F.col("server")
    description = F.coalesce("description", F.lit(""))
    keep = [c for c in ("seq",) if c in listings.columns]
    return listings.select(
        F.concat(F.lit("mcp__"), server, F.lit("__"), tool).alias("name"),
        description.alias("description"),
        F.concat(F.lit("mcp:"), server).alias("source"),
        infer_category(tool, "mcp").alias("category"),
        server.alias("provider"),
        "input_schema",
        F.array(F.lit("mcp"), server, tool).alias("tags"),
        boost_keywords(tool, description).alias("boost_keywords"),
        *keep,
    )


def ingest_listings(catalog: DataFrame, listings: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Catalog with each listed server's entries replaced; a server that lists nothing keeps its old ones."""
    return replace_source(catalog, listing_entries(listings), as_of)


def bulk_entries(rows: DataFrame, source: str | None = None, provider: str | None = None) -> DataFrame:
    """Raw entries of named rows; source and provider fall back to the call's, triggers and boost words are dropped."""
    df = with_fields(rows, S.RAW_ENTRY)
    none = F.array().cast(S.STRINGS)
    keep = [c for c in ("seq",) if c in rows.columns]
    return df.filter(blank_to_null(F.col("name")).isNotNull()).select(
        "name",
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce(blank_to_null(F.col("source")), F.lit(source or "local")).alias("source"),
        blank_to_null(F.col("category")).alias("category"),
        F.coalesce(blank_to_null(F.col("provider")), F.lit(provider or "")).alias("provider"),
        "input_schema",
        F.coalesce("tags", none).alias("tags"),
        F.coalesce("examples", none).alias("examples"),
        F.coalesce("endpoint", F.lit("")).alias("endpoint"),
        *keep,
    )


def ingest_bulk(
    catalog: DataFrame,
    rows: DataFrame,
    source: str | None = None,
    provider: str | None = None,
    as_of: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Catalog with the rows upserted, and a one-row count of registered and skipped rows."""
    named = blank_to_null(F.col("name")).isNotNull()
    counts = rows.agg(F.count_if(named).alias("registered"), F.count_if(~named).alias("skipped"))
    return upsert_catalog(catalog, bulk_entries(rows, source, provider), as_of), counts
