"""What several operators share: words, the shared folder, tables written there."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signpost.session import write_parquet

#: A word is a longest run of characters other than the six ASCII white space ones.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def words(text: Column) -> Column:
    """Words of a text in order; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or the warehouse where that is unset.

    Tables go to a subfolder named by the application, which its owner may delete when the application has ended.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/shared"
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: computed once, and there whatever executor is lost."""
    return write_parquet(df, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}", **options)
