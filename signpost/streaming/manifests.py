"""New manifest files reload their provider as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from signpost.sources.manifests import load_manifests
from signpost.sources.snapshot import is_committed, read_catalog, write_catalog


def stream_manifests(
    spark: SparkSession,
    directory: str,
    catalog_path: str,
    checkpoint: str,
    on_reload: Callable[[DataFrame, int], None] | None = None,
    interval: str | None = "500 milliseconds",
) -> StreamingQuery:
    """Load new .json files of a directory into the catalog at `catalog_path`.

    A burst within one interval becomes one reload; broken files are reported by status, not raised. A batch that
    is run again after a lost driver is recognised by its note and not applied twice. `interval=None` reads what is
    there and stops. Files are told apart by path: an edited manifest needs a new name.
    """
    files = (
        spark.readStream.format("text")
        .option("wholetext", True)
        .option("pathGlobFilter", "*.json")
        .load(directory)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    )

    def reload(batch: DataFrame, epoch: int) -> None:
        note = f"manifests-{epoch}"
        if is_committed(spark, catalog_path, note):
            return
        staging = f"{catalog_path}/staging/{note}"
        catalog, status = load_manifests(read_catalog(spark, catalog_path), batch, staging=staging)
        write_catalog(catalog, catalog_path, note)
        if on_reload is not None:
            on_reload(status, epoch)

    writer = files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(reload)
    return (writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)).start()
