"""From raw entries to catalog rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signpost import schema as S
from signpost.functions import text as X


def with_fields(df: DataFrame, struct) -> DataFrame:
    """Add the fields of `struct` that `df` lacks, as nulls; other columns stay."""
    have = set(df.columns)
    missing = {f.name: F.lit(None).cast(f.dataType) for f in struct.fields if f.name not in have}
    return df.withColumns(missing) if missing else df


def catalog_search_text() -> Column:
    c = F.col
    return X.search_text(
        c("name"), c("description"), c("category"), c("provider"),
        c("boost_keywords"), c("triggers"), c("tags"), c("examples"),
    )


def normalize_entries(raw: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Fill the defaults of every field and derive triggers and search text.

    An empty string counts as missing; an explicit empty trigger list stays empty. Columns outside the
    record (a sequence number, a file path) are carried along.
    """
    now = F.current_timestamp() if as_of is None else as_of
    df = with_fields(raw, S.RAW_ENTRY)
    extra = [c for c in df.columns if c not in set(S.RAW_ENTRY.names) | set(S.CATALOG.names)]
    none = F.array().cast(S.STRINGS)

    def text(name: str, default: str = "") -> Column:
        return F.coalesce(X.blank_to_null(F.col(name)), F.lit(default))

    filled = df.select(
        text("name").alias("name"),
        text("description").alias("description"),
        text("source", "unknown").alias("source"),
        text("category", "misc").alias("category"),
        F.coalesce(
            X.blank_to_null(F.col("provider")), X.blank_to_null(F.col("plugin_name")), text("name")
        ).alias("provider"),
        X.blank_to_null(F.col("input_schema")).alias("input_schema"),
        F.coalesce(
            F.col("triggers"), X.extract_triggers(text("name"), F.col("description"), F.col("tags"))
        ).alias("triggers"),
        F.coalesce(F.col("tags"), none).alias("tags"),
        F.coalesce(F.col("examples"), none).alias("examples"),
        text("endpoint").alias("endpoint"),
        text("boost_keywords").alias("boost_keywords"),
        F.coalesce(F.col("usage_count"), F.lit(0)).cast("long").alias("usage_count"),
        F.coalesce(F.col("success_rate"), F.lit(1.0)).alias("success_rate"),
        F.lit(0).cast("long").alias("consecutive_failures"),
        F.col("last_used_at"),
        F.col("embedding"),
        F.coalesce(F.col("registered_at"), now).alias("registered_at"),
        now.alias("updated_at"),
        *extra,
    )
    return filled.withColumn("search_text", catalog_search_text()).select(*S.CATALOG.names, *extra)
