"""Statistics over the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signpost.functions.scoring import round_half_up
from signpost.operators.windows import rank_within


def _counts(catalog: DataFrame, column: str) -> DataFrame:
    return catalog.groupBy(column).agg(F.count("*").alias("entries")).orderBy(F.desc("entries"), F.asc(column))


def counts_by_source(catalog: DataFrame) -> DataFrame:
    return _counts(catalog, "source")


def counts_by_category(catalog: DataFrame) -> DataFrame:
    return _counts(catalog, "category")


def _percent(part: Column, whole: Column) -> Column:
    return round_half_up(part / whole * F.lit(100.0), 0).cast("long")


def embedding_coverage(catalog: DataFrame) -> DataFrame:
    """Entries, those with a vector (an empty one counts) and the rounded percentage."""
    counted = catalog.agg(F.count("*").alias("total"), F.count("embedding").alias("with_embedding"))
    share = F.when(F.col("total") > 0, _percent(F.col("with_embedding"), F.col("total"))).otherwise(F.lit(0).cast("long"))
    return counted.withColumn("percent", share)


def top_used(catalog: DataFrame, limit: int = 10) -> DataFrame:
    used = catalog.filter(F.col("usage_count") > 0)
    percent = _percent(F.coalesce("success_rate", F.lit(1.0)), F.lit(1.0)).alias("success_percent")
    return used.select("name", "usage_count", percent).orderBy(F.desc("usage_count"), "name").limit(limit)


def recently_used(catalog: DataFrame, limit: int = 5) -> DataFrame:
    used = catalog.filter(F.col("last_used_at").isNotNull())
    return used.select("name", "last_used_at").orderBy(F.desc("last_used_at"), "name").limit(limit)


def unstable_entries(catalog: DataFrame, at_least: int = 2, limit: int = 5) -> DataFrame:
    failing = catalog.filter(F.col("consecutive_failures") >= at_least)
    return (
        failing.select("name", "consecutive_failures").orderBy(F.desc("consecutive_failures"), "name").limit(limit)
    )


def ingest_summary(status: DataFrame) -> DataFrame:
    """Files or servers per status with the entries they gave: `status, units, entries`."""
    return status.groupBy("status").agg(F.count("*").alias("units"), F.sum("entries").alias("entries"))


def name_digest(rows: DataFrame, unit: str, order: str = "name", shown: int = 10) -> DataFrame:
    """Per unit: how many names, and the first few as text with "+n more".

    Only the shown names are gathered; a unit of any size is counted by aggregation.
    """
    counted = rows.groupBy(unit).agg(F.count("*").alias("entries"))
    first = rank_within(rows.select(unit, order, "name"), unit, [F.asc(order), F.asc("name")], shown)
    listed = first.groupBy(unit).agg(F.sort_array(F.collect_list(F.struct("rank", "name"))).alias("named"))
    text = F.array_join(F.transform("named", lambda e: e["name"]), ", ")
    more = F.when(
        F.col("entries") > shown, F.concat(F.lit(" ... +"), (F.col("entries") - shown).cast("string"), F.lit(" more"))
    ).otherwise("")
    return counted.join(listed, unit).select(unit, "entries", F.concat(text, more).alias("names"))
