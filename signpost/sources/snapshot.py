"""The catalog on disk: versioned parquet snapshots, older column sets, JSON-text rows."""

from __future__ import annotations

from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signpost import schema as S
from signpost.functions.jsons import parse_json_or_default, strict_json
from signpost.functions.text import blank_to_null


def _commits(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        reader = spark.read.schema("version long, note string, folder string").option("recursiveFileLookup", "true")
        return reader.parquet(f"{path}/commits")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def current_version(spark: SparkSession, path: str) -> int:
    """Last committed version, 0 before the first."""
    commits = _commits(spark, path)
    version = None if commits is None else commits.agg(F.max("version")).first()[0]
    return version or 0


def is_committed(spark: SparkSession, path: str, note: str) -> bool:
    """Whether a version with this note exists, so a repeated streaming batch can be skipped."""
    commits = _commits(spark, path)
    return commits is not None and not commits.filter(F.col("note") == note).isEmpty()


def write_snapshot(df: DataFrame, path: str, note: str | None = None) -> int:
    """Write a table as a new version, then commit it; readers see either the old or the new one.

    A version's files lie in a folder of their own name, so nothing that was written is ever overwritten, and a job may
    write what it derives from the current version. Of two writers that begin from the same version the second fails
    when it commits, and its files stay unread. Only where both commit in the same moment may both fail; readers
    then keep to the smaller folder name.
    """
    spark = df.sparkSession
    version = current_version(spark, path) + 1
    folder = f"{version:012d}-{uuid4().hex}"
    df.write.parquet(f"{path}/versions/{folder}")
    commit = spark.range(1).select(
        F.lit(version).cast("long").alias("version"), F.lit(note).cast("string").alias("note"), F.lit(folder).alias("folder")
    )
    commit.coalesce(1).write.mode("errorifexists").parquet(f"{path}/commits/{version:012d}")
    if _commits(spark, path).filter(F.col("version") == version).count() > 1:
        raise RuntimeError(f"another writer committed version {version} of {path}")
    return version


def read_snapshot(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """A committed version, the current one unless asked otherwise; None before the first commit."""
    commits = _commits(spark, path)
    if commits is None:
        return None
    wanted = commits if version is None else commits.filter(F.col("version") == version)
    found = wanted.groupBy("version").agg(F.min("folder").alias("folder")).orderBy(F.desc("version")).first()
    return None if found is None else spark.read.parquet(f"{path}/versions/{found.folder}")


def write_catalog(catalog: DataFrame, path: str, note: str | None = None) -> int:
    return write_snapshot(catalog.select(*S.CATALOG.names), path, note)


def read_catalog(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The catalog of a committed version, the current one unless asked otherwise; empty before the first commit."""
    snapshot = read_snapshot(spark, path, version)
    return spark.createDataFrame([], S.CATALOG) if snapshot is None else evolve_schema(snapshot)


DEFAULTS = {
    "description": "",
    "source": "unknown",
    "category": "misc",
    "endpoint": "",
    "search_text": "",
    "boost_keywords": "",
    "usage_count": 0,
    "success_rate": 1.0,
    "consecutive_failures": 0,
}


def evolve_schema(df: DataFrame) -> DataFrame:
    """Add columns an older snapshot lacks, with their defaults, and fill provider from a legacy plugin_name."""
    have = set(df.columns)
    legacy = blank_to_null(F.col("plugin_name")) if "plugin_name" in have else F.lit(None).cast("string")
    provider = blank_to_null(F.col("provider")) if "provider" in have else F.lit(None).cast("string")
    columns = []
    for field in S.CATALOG.fields:
        if field.name == "provider":
            column = F.coalesce(provider, legacy, F.lit(""))
        elif field.name in have:
            column = F.col(field.name)
        elif field.dataType == S.STRINGS:
            column = F.array()
        else:
            column = F.lit(DEFAULTS.get(field.name))
        columns.append(column.cast(field.dataType).alias(field.name))
    return df.select(*columns)


def decode_rows(rows: DataFrame) -> DataFrame:
    """Catalog from rows that keep lists, vectors and times as text, as a SQL store does.

    Broken or missing JSON, and text that is no number, fall back to the field's default.
    """
    df = evolve_text(rows)
    none = F.array().cast(S.STRINGS)
    schema = F.col("input_schema")

    def text(name: str) -> F.Column:
        return F.coalesce(blank_to_null(F.col(name)), F.lit(DEFAULTS[name])).alias(name)

    valid_schema = F.when(strict_json(schema).isNotNull() & ~F.is_variant_null(strict_json(schema)), schema)
    vector = parse_json_or_default(F.col("embedding"), "array<float>", F.lit(None).cast(S.VECTOR))
    return df.select(
        F.coalesce("name", F.lit("")).alias("name"),
        text("description"), text("source"), text("category"),
        F.coalesce(
            blank_to_null(F.col("provider")), blank_to_null(F.col("plugin_name")), F.lit("")
        ).alias("provider"),
        valid_schema.alias("input_schema"),
        *[parse_json_or_default(F.col(c), "array<string>", none).alias(c) for c in ("triggers", "tags", "examples")],
        text("endpoint"), text("search_text"), text("boost_keywords"),
        F.coalesce(F.col("usage_count").try_cast("long"), F.lit(0)).cast("long").alias("usage_count"),
        F.coalesce(F.col("success_rate").try_cast("double"), F.lit(1.0)).cast("double").alias("success_rate"),
        F.coalesce(F.col("consecutive_failures").try_cast("long"), F.lit(0)).cast("long").alias("consecutive_failures"),
        F.try_to_timestamp("last_used_at").alias("last_used_at"),
        vector.alias("embedding"),
        F.try_to_timestamp("registered_at").alias("registered_at"),
        F.try_to_timestamp("updated_at").alias("updated_at"),
    )


def evolve_text(rows: DataFrame) -> DataFrame:
    """Add the text columns a row set lacks, as nulls."""
    have = set(rows.columns)
    missing = [c for c in (*S.CATALOG.names, "plugin_name") if c not in have]
    return rows.withColumns({c: F.lit(None).cast("string") for c in missing}) if missing else rows
