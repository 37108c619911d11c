"""JSON manifests: scan a directory, classify each file, one row per declared entry."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signpost import schema as S
from signpost.functions.jsons import strict_json
from signpost.functions.text import blank_to_null, infer_category
from signpost.operators.catalog import last_unit_per_source, replace_source

LOADED, SKIPPED, FAILED = "loaded", "skipped", "failed"
FILES = "path string, content string"


def scan_manifests(spark: SparkSession, directory: str) -> DataFrame:
    """`path, content` of every .json file; a missing or empty directory gives no rows."""
    reader = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json")
    try:
        files = reader.text(directory)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], FILES)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _truthy_text(v: Column, path: str) -> Column:
    """Text of a member, null when it is absent, an empty string, the number zero or false."""
    text, kind = _text(v, path), F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.when(F.when(kind == "STRING", text != "").otherwise(~text.isin("", "0", "-0", "0.0", "false")), text)


def _tools(v: Column) -> Column:
    """The tools array, null when tools is anything but an array."""
    return F.try_variant_get(v, "$.tools", "array<variant>")


def parsed(files: DataFrame) -> DataFrame:
    """Files with `manifest`, null for broken JSON. Repeated keys in one object count as broken."""
    return files.withColumn("manifest", strict_json(F.col("content")))


def _usable(tool: Column) -> Column:
    return _truthy_text(tool, "$.name").isNotNull() & _truthy_text(tool, "$.description").isNotNull()


def triage_manifests(files: DataFrame) -> DataFrame:
    """Status per file: `path, status, reason, provider, entries`. A bad file never stops the others.

    failed: broken JSON, a null document, or a null entry; skipped: no provider, tools missing or no array, or no
    entry with both name and description.
    """
    df = parsed(files)
    manifest = F.col("manifest")
    provider = _truthy_text(manifest, "$.provider")
    checked = df.select(
        "path",
        manifest.isNull().alias("broken"),
        F.is_variant_null(manifest).alias("null_top"),
        provider.alias("provider"),
        _tools(manifest).alias("tools"),
    ).select(
        "path", "broken", "null_top", "provider", F.col("tools").isNotNull().alias("listed"),
        F.exists("tools", lambda t: t.isNull() | F.is_variant_null(t)).alias("null_tool"),
        F.size(F.filter("tools", _usable)).cast("long").alias("usable"),
    )
    reason = (
        F.when(F.col("broken"), "broken_json")
        .when(F.col("null_top"), "null_document")
        .when(F.col("provider").isNull() | ~F.col("listed"), "invalid_manifest")
        .when(F.col("null_tool"), "null_entry")
        .when(F.col("usable") == 0, "no_valid_entries")
    )
    status = (
        F.when(F.col("reason").isNull(), LOADED)
        .when(F.col("reason").isin("broken_json", "null_document", "null_entry"), FAILED)
        .otherwise(SKIPPED)
    )
    told = checked.withColumn("reason", reason).withColumn("status", status)
    return told.select(
        "path",
        "status",
        "reason",
        F.when(F.col("status") == LOADED, F.col("provider")).alias("provider"),
        F.when(F.col("status") == LOADED, F.col("usable")).otherwise(F.lit(0)).cast("long").alias("entries"),
    )


def _list(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "array<string>")


def explode_manifests(files: DataFrame) -> DataFrame:
    """Raw entries of loadable manifests with `path` and `position`; entries lacking name or description drop out.

    An unloadable manifest gives a null list to the outer explode instead of being filtered away: the optimizer would
    move such a filter below the parser and parse every document again for it.
    """
    df = parsed(files).select(
        "path",
        _truthy_text(F.col("manifest"), "$.provider").alias("provider"),
        _tools(F.col("manifest")).alias("tools"),
    )
    sound = F.col("provider").isNotNull() & ~F.exists("tools", lambda t: t.isNull() | F.is_variant_null(t))
    rows = df.select("path", "provider", F.posexplode_outer(F.when(sound, F.col("tools"))).alias("position", "t"))
    t = F.col("t")
    name = _truthy_text(t, "$.name")
    none = F.array().cast(S.STRINGS)
    schema = F.try_variant_get(t, "$.inputSchema", "variant")
    return rows.filter(_usable(t)).select(
        "path",
        "position",
        name.alias("name"),
        _text(t, "$.description").alias("description"),
        F.concat(F.lit("provider:"), F.col("provider")).alias("source"),
        F.coalesce(blank_to_null(_text(t, "$.category")), infer_category(name, "provider")).alias("category"),
        "provider",
        F.when(~F.is_variant_null(schema), F.to_json(schema)).alias("input_schema"),
        _list(t, "$.triggers").alias("triggers"),
        F.coalesce(_list(t, "$.tags"), none).alias("tags"),
        F.coalesce(_list(t, "$.examples"), none).alias("examples"),
        F.coalesce(_text(t, "$.endpoint"), F.lit("")).alias("endpoint"),
        F.coalesce(_text(t, "$.boostKeywords"), F.lit("")).alias("boost_keywords"),
    )


def stage_entries(files: DataFrame, folder: str) -> DataFrame:
    """Parse once into a table under `folder`, for the several joins a load makes.

    Read back, the entries also have a known size, by which Spark chooses how to join them. They are dealt out anew by
    their size before: a task of a few small manifests would else leave a file of its own, and every join open them all.
    """
    explode_manifests(files).hint("rebalance").write.mode("overwrite").parquet(folder)
    return files.sparkSession.read.parquet(folder)


def load_manifests(
    catalog: DataFrame,
    files: DataFrame,
    as_of: Column | None = None,
    preserve_all: bool = False,
    staging: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Catalog with every loadable manifest's source replaced, and the status per file.

    Files apply in path order, so of two manifests of one provider the later one stands; within a file the last
    entry of a name, and across files the later path, wins. With `staging`, a folder all executors share, the parsed
    entries are written there first.
    """
    entries = explode_manifests(files) if staging is None else stage_entries(files, staging)
    rows = last_unit_per_source(entries, "path")
    ordered = rows.withColumn("seq", F.struct("path", "position")).drop("path", "position")
    return replace_source(catalog, ordered, as_of, preserve_all), triage_manifests(files)
