"""Usage folds kept up to date from a stream of attempts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from signpost import schema as S
from signpost.operators.usage import KEEP
from signpost.operators.windows import rank_within
from signpost.streaming.ordered import fold_in_order, read_told

FOLD = "name string, uses long, gain double, last_used_at timestamp, failures_since_success long, late long"
TOLD = "name {name}, uses long, gain double, last_t long, failures_since_success long, late long"
STATE = "uses long, gain double, last_t long, failures_since_success long"
START = (0, 0.0, None, None)


def settle(states: list[tuple], attempts: pd.DataFrame, starts: np.ndarray) -> tuple[list[tuple], None]:
    """The folds with later attempts added."""
    success, t = attempts["success"].to_numpy(bool), attempts["t"].to_numpy()
    ends = np.append(starts[1:], len(t))
    n = ends - starts
    place = np.arange(len(t))
    added = S.EMA_ALPHA * np.add.reduceat(np.where(success, KEEP ** (np.repeat(ends, n) - 1.0 - place), 0.0), starts)
    last_ok = np.maximum.reduceat(np.where(success, place, -1), starts)
    after = []
    for (uses, gain, _, since), new, more, ok, end in zip(states, n.tolist(), added.tolist(), last_ok.tolist(), ends.tolist(), strict=True):
        since = end - 1 - ok if ok >= 0 else None if since is None else since + new
        after.append((uses + new, gain * KEEP**new + more, int(t[end - 1]), since))
    return after, None


def tell(names: list, late: np.ndarray, states: list[tuple], _parts: list) -> pd.DataFrame:
    uses, gain, last, since = zip(*states, strict=True)
    rows = {"name": pd.Series(names, dtype=object), "uses": uses, "gain": gain, "last_t": last, "failures_since_success": since, "late": late}
    return pd.DataFrame(rows).astype({"last_t": "Int64", "failures_since_success": "Int64"})


def read_usage(spark: SparkSession, path: str, name_type: str = "string") -> DataFrame:
    """Current folds, in the shape `apply_usage` takes, with the number of late attempts left out per name."""
    told = read_told(spark, path, TOLD.format(name=name_type))
    newest = rank_within(told, "name", [F.desc("batch")], 1)
    return newest.select(
        "name", "uses", "gain", F.timestamp_micros("last_t").alias("last_used_at"), "failures_since_success", "late"
    )


def stream_usage(
    attempts: DataFrame, path: str, checkpoint: str, interval: str | None = "10 seconds", delay_seconds: float | None = 86_400.0
) -> StreamingQuery:
    """Fold a stream `(attempt_id, name, ts, success)`; what each touched name adds up to is kept under `path`.

    Attempts may arrive in any order within `delay_seconds` of their name's latest one (None: of any age); older ones are
    counted as late. A micro-batch works on, and writes, the names it touches only.
    """
    output = TOLD.format(name=attempts.schema["name"].dataType.simpleString())
    return fold_in_order(attempts, path, checkpoint, interval, delay_seconds, STATE, START, settle, tell, output)
