"""Validation of new and changed entries: every rule adds an issue, errors reject, warnings pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signpost import schema as S
from signpost.functions.text import trim_space
from signpost.operators.entries import with_fields

ERROR, WARNING = "error", "warning"


def issue(when: Column, field: str, code: str, severity: str = ERROR) -> Column:
    return F.when(when, F.struct(F.lit(field).alias("field"), F.lit(code).alias("code"), F.lit(severity).alias("severity")))


def blank(c: Column) -> Column:
    return F.coalesce(trim_space(c), F.lit("")) == ""


def given(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def check_name(name: Column) -> Column:
    bad = ~blank(name) & ~name.rlike(S.NAME_PATTERN)
    return F.coalesce(issue(blank(name), "name", "name_required"), issue(bad, "name", "name_format"))


def check_description(description: Column) -> Column:
    short = ~blank(description) & (F.length(trim_space(description)) < S.MIN_DESCRIPTION)
    return F.coalesce(
        issue(blank(description), "description", "description_required"),
        issue(short, "description", "description_short"),
    )


def check_category(category: Column) -> Column:
    return issue(given(category) & ~category.isin(*S.CATEGORIES), "category", "category_unknown")


def warn_no_tags(tags: Column) -> Column:
    return issue(F.coalesce(F.size(tags), F.lit(0)) <= 0, "tags", "tags_missing", WARNING)


def gather(*issues: Column) -> Column:
    return F.filter(F.array(*issues), lambda i: i.isNotNull())


def no_errors(issues: Column) -> Column:
    return ~F.exists(issues, lambda i: i["severity"] == ERROR)


def flag_duplicates(batch: DataFrame, catalog: DataFrame, acceptable: Column) -> DataFrame:
    """Adds `duplicate`: the name is in the catalog, or an earlier acceptable row of the batch takes it.

    `batch` has a `seq` column. The first row per name comes from an aggregation, not a window over all
    rows of a name.
    """
    taken = catalog.select("name").distinct().withColumn("_taken", F.lit(True))
    first = batch.groupBy("name").agg(F.min(F.when(acceptable, F.col("seq"))).alias("_first"))
    joined = batch.join(first, "name", "left").join(taken, "name", "left")
    duplicate = given(F.col("name")) & (
        F.coalesce("_taken", F.lit(False)) | F.coalesce(F.col("_first") < F.col("seq"), F.lit(False))
    )
    return joined.withColumn("duplicate", duplicate).select(*batch.columns, "duplicate")


def validate_new(batch: DataFrame, catalog: DataFrame) -> DataFrame:
    """Batch with `issues` and `valid`; rows are judged in `seq` order."""
    df = with_fields(batch, S.RAW_ENTRY)
    own = [check_name(F.col("name")), check_description(F.col("description")), check_category(F.col("category"))]
    flagged = flag_duplicates(df, catalog, no_errors(gather(*own)))
    issues = gather(*own, issue(F.col("duplicate"), "name", "name_taken"), warn_no_tags(F.col("tags")))
    return flagged.withColumn("issues", issues).withColumn("valid", no_errors(F.col("issues"))).drop("duplicate")


def updated_entry(updates: DataFrame) -> Column:
    if "tool" in updates.columns and "name" in updates.columns:
        return F.coalesce(F.nullif(F.col("tool"), F.lit("")), F.col("name"))
    return F.col("tool" if "tool" in updates.columns else "name")


def validate_update(updates: DataFrame, catalog: DataFrame) -> DataFrame:
    """Updates of known entries with `entry`, `issues` and `valid`; only given fields are judged.

    `tool` names the entry, or `name` where there is no `tool`; the name rule applies to a given `name` alone, so an
    entry with a name of another form is changed through `tool`. A description of under half the current length
    is a warning.
    """
    df = with_fields(updates, S.RAW_ENTRY).withColumn("entry", updated_entry(updates))
    current = catalog.select(F.col("name").alias("entry"), F.col("description").alias("_current"))
    joined = df.join(current, "entry")
    name, description, category = F.col("name"), F.col("description"), F.col("category")
    length = F.length(trim_space(description))
    shrunk = given(description) & given(F.col("_current")) & (length < F.length(trim_space(F.col("_current"))) * 0.5)
    issues = gather(
        issue(given(name) & ~name.rlike(S.NAME_PATTERN), "name", "name_format"),
        issue(given(description) & (length < S.MIN_DESCRIPTION), "description", "description_short"),
        issue(shrunk, "description", "description_shrunk", WARNING),
        check_category(category),
    )
    return joined.withColumn("issues", issues).withColumn("valid", no_errors(F.col("issues"))).drop("_current")


def issue_report(validated: DataFrame) -> DataFrame:
    """How often each issue occurs."""
    each = validated.select(F.explode("issues").alias("i")).select("i.*")
    return each.groupBy("field", "code", "severity").agg(F.count("*").alias("rows"))
