"""Routing a stream of queries against a catalog."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from signpost.plans.route import route
from signpost.plans.versions import Bound


def stream_route(
    queries: DataFrame,
    catalog: Callable[[], DataFrame | Bound],
    output: str,
    checkpoint: str,
    interval: str | None = "1 second",
    **options,
) -> StreamingQuery:
    """Route each micro-batch of `(query_id, query_text[, embedding])` and write its results under `output`.

    `catalog` is called per batch, so a new catalog version is picked up. Where it gives a `Bound` (see
    `plans.versions.read_bound`), catalog and indexes are of one version, no text is split in a batch, and a version
    without indexes stops the stream. A batch has its own folder, overwritten if the batch is run again, so results
    appear once. `options` go to `route`.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        now = catalog()
        if isinstance(now, Bound):
            vectors = now.vector_index if "embedding" in batch.columns else None
            ranked = route(now.catalog, batch, text_index=now.text_index, vector_index=vectors, **options)
        else:
            ranked = route(now, batch, **options)
        ranked.write.mode("overwrite").parquet(f"{output}/batch={epoch}")

    writer = queries.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)
    return (writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)).start()
