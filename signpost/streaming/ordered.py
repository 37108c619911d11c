"""Keyed state for logs that arrive out of order.

A key keeps what its settled attempts add up to, and a buffer of the attempts that are not settled yet. Its watermark trails its
latest attempt by `delay`: attempts before the watermark are settled in the order of (ts, attempt_id), later ones wait, so those that
arrive early or in any order take their place. An attempt that arrives when later ones are settled already cannot take it: it
is left out and counted as late. Without a delay nothing is ever settled and nothing late.

State is kept in RocksDB, one row per key; keys are dealt to a fixed number of buckets, and what a micro-batch brings for a bucket is
settled at once for all keys it touches. It reads and writes the state of those keys only. A touched key tells what it knows,
unsettled attempts included; the rows go to a folder per micro-batch, which is overwritten if the batch is run again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
MICROS = 1_000_000
#: Buckets of keys. A checkpoint keeps the number it began with.
BUCKETS = 1_024


class OrderedFold(StatefulProcessor):
    """Settles each key's attempts in order, for all touched keys of a bucket at once.

    `settle(states, attempts, starts)` gives the keys' states after their attempts (columns name, attempt_id, t in microseconds, success;
    key by key from row `starts` on, in order) and rows about them, or None; `tell(names, late, states, parts)` the frame to put out, with
    `parts` the rows about attempts, whose they are (`key`, a number of a name) and whether they are settled. A state is a
    tuple of `state_type`; the first is `start`.
    """

    def __init__(self, delay: int | None, name_type: str, id_type: str, state_type: str, start: tuple, settle: Callable, tell: Callable):
        self.delay, self.name_type, self.id_type, self.state_type = delay, name_type, id_type, state_type
        self.start, self.settle, self.tell = start, settle, tell

    def init(self, handle: StatefulProcessorHandle) -> None:
        waiting = f"ids array<{self.id_type}>, times array<long>, successes array<boolean>"
        self.keys = handle.getMapState("keys", f"name {self.name_type}", f"{self.state_type}, upto long, late long, {waiting}")

    def settled(self, states: list[tuple], rows: pd.DataFrame) -> tuple[list[tuple], pd.DataFrame | None, np.ndarray]:
        """States after `rows`, which are in order, what is told about them, and their keys."""
        key = rows["key"].to_numpy()
        if not len(rows):
            return states, None, key
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        touched = key[starts].tolist()
        after, told = self.settle([states[i] for i in touched], rows[["name", "attempt_id", "t", "success"]].reset_index(drop=True), starts)
        states = list(states)
        for i, state in zip(touched, after, strict=True):
            states[i] = state
        return states, told, key

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)[["name", "attempt_id", "t", "success"]]
        new["key"], names = pd.factorize(new["name"], use_na_sentinel=False)
        names = [None if pd.isna(x) else x for x in names.tolist()]
        known = [self.keys.getValue((x,)) or (*self.start, None, 0, [], [], []) for x in names]
        states = [tuple(x[:-5]) for x in known]
        upto, late = [x[-5] for x in known], np.array([x[-4] for x in known])
        settled_to = np.array([np.iinfo(np.int64).min if x is None else x for x in upto])
        too_late = new["t"].to_numpy() < settled_to[new["key"].to_numpy()]
        late += np.bincount(new["key"].to_numpy()[too_late], minlength=len(names))
        waiting = [[v for x in known for v in x[i]] for i in (-3, -2, -1)]
        before = pd.DataFrame({"attempt_id": pd.Series(waiting[0], dtype=new["attempt_id"].dtype), "t": pd.Series(waiting[1], dtype="int64"), "success": pd.Series(waiting[2], dtype=bool)})
        before["key"] = np.repeat(np.arange(len(names)), [len(x[-3]) for x in known])
        every = pd.concat([before, new[~too_late].drop(columns="name")], ignore_index=True) if len(before) else new[~too_late].drop(columns="name")
        every = every.sort_values(["key", "t", "attempt_id"], kind="stable", ignore_index=True)
        every["name"] = np.array(names, dtype=object)[every["key"].to_numpy()]
        old = np.zeros(len(every), bool)
        if self.delay is not None and len(every):
            of, t = every["key"].to_numpy(), every["t"].to_numpy()
            last = np.flatnonzero(np.append(of[1:] != of[:-1], True))
            bound = np.zeros(len(names), np.int64)
            bound[of[last]] = t[last] - self.delay
            old = t < bound[of]
            for i in of[last].tolist():
                upto[i] = int(bound[i]) if upto[i] is None else max(upto[i], int(bound[i]))
        states, told, whose = self.settled(states, every[old])
        rest = every[~old]
        after, pending, theirs = self.settled(states, rest)
        cuts = np.searchsorted(theirs, np.arange(len(names) + 1)).tolist()
        ids, times, successes = (rest[c].tolist() for c in ("attempt_id", "t", "success"))
        for i, name in enumerate(names):
            own = slice(cuts[i], cuts[i + 1])
            self.keys.updateValue((name,), (*states[i], upto[i], int(late[i]), ids[own], times[own], successes[own]))
        yield self.tell(names, late, after, [(told, whose, True), (pending, theirs, False)])

    def close(self) -> None:
        pass


def fold_in_order(
    attempts: DataFrame,
    path: str,
    checkpoint: str,
    interval: str | None,
    delay_seconds: float | None,
    state_type: str,
    start: tuple,
    settle: Callable,
    tell: Callable,
    output: str,
) -> StreamingQuery:
    """Run an OrderedFold over a stream (attempt_id, name, ts, success); what touched keys tell goes to `path`, by batch."""
    spark = attempts.sparkSession
    spark.conf.set(PROVIDER, ROCKS)
    delay = None if delay_seconds is None else round(delay_seconds * MICROS)
    id_type = attempts.schema["attempt_id"].dataType.simpleString()
    rows = attempts.select("attempt_id", "name", F.unix_micros("ts").alias("t"), "success").where(
        "attempt_id is not null and t is not null and success is not null"
    )
    name_type = attempts.schema["name"].dataType.simpleString()
    # rows without a name are a key too, in a bucket of their own
    bucket = F.when(F.col("name").isNull(), -1).otherwise(F.pmod(F.xxhash64("name"), F.lit(BUCKETS))).cast("int")
    told = rows.withColumn("bucket", bucket).groupBy("bucket").transformWithStateInPandas(
        OrderedFold(delay, name_type, id_type, state_type, start, settle, tell), output, "Update", "None"
    )

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    writer = told.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)).start()


def read_told(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All that was told, with the number of its micro-batch in `batch`."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(f"{schema}, batch long").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{schema}, batch long")
