"""Circuit breaker kept up to date from a stream of attempts."""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from signpost import schema as S
from signpost.operators import circuit as C
from signpost.operators.windows import rank_within
from signpost.streaming.ordered import MICROS, fold_in_order, read_told

DECISION = "attempt_id {id}, name {name}, t long, success boolean, decision string, opened_at long, failures long"
TOLD = DECISION + ", final boolean, late long"
STATE = "opened_at long, failures long"
START = (C.CLOSED, 0)


def settle(states: list[tuple], attempts: pd.DataFrame, starts: np.ndarray, threshold: int, recovery: int) -> tuple[list[tuple], pd.DataFrame]:
    """States after the keys' attempts, and the decisions on them."""
    t, success = attempts["t"].to_numpy(np.int64), attempts["success"].to_numpy(bool)
    cut = C.Slices(t, success, starts, threshold, recovery)
    opened, before = (np.array(x, np.int64) for x in zip(*states, strict=True))
    decision, last, failures = cut.replay(opened, before)
    ends = cut.ends - 1
    return list(zip(last[ends].tolist(), failures[ends].tolist(), strict=True)), C.told(attempts, decision, last, failures)


def tell(_names: list, late: np.ndarray, _states: list[tuple], parts: list) -> pd.DataFrame:
    told = [rows.assign(final=final, late=late[key]) for rows, key, final in parts if rows is not None]
    return pd.concat(told, ignore_index=True)


def _told(spark: SparkSession, path: str, name_type: str, id_type: str) -> DataFrame:
    """Final decisions, and those on waiting attempts as last told of their key."""
    rows = read_told(spark, path, TOLD.format(name=name_type, id=id_type))
    newest = rows.groupBy("name").agg(F.max("batch").alias("newest"))
    return rows.join(newest, "name").where(F.col("final") | (F.col("batch") == F.col("newest")))


def read_circuits(spark: SparkSession, path: str, name_type: str = "string", id_type: str = "long") -> DataFrame:
    """State per key after all its attempts so far, the time of the last one and the number of its late attempts."""
    told = _told(spark, path, name_type, id_type)
    last = rank_within(told, "name", [F.desc("t"), F.desc("attempt_id")], 1)
    late = told.groupBy("name").agg(F.max("late").alias("late"))
    return C.shown_trace(last).select("name", "state", "failures", "last_failure", F.col("ts").alias("last_ts")).join(late, "name")


def read_decisions(spark: SparkSession, path: str, name_type: str = "string", id_type: str = "long") -> DataFrame:
    """Decisions in the columns of `circuit_trace`, and `final`: whether no attempt on time can change them."""
    told = _told(spark, path, name_type, id_type)
    finals = told.select("name", "attempt_id", "final")
    return C.shown_trace(told).join(finals, ["name", "attempt_id"])


def stream_circuit(
    attempts: DataFrame,
    path: str,
    checkpoint: str,
    interval: str | None = "10 seconds",
    threshold: int = S.FAILURE_THRESHOLD,
    recovery_seconds: float = S.RECOVERY_SECONDS,
    delay_seconds: float | None = 86_400.0,
) -> StreamingQuery:
    """Decide a stream `(attempt_id, name, ts, success)`; decisions are kept under `path`.

    Attempts may arrive in any order within `delay_seconds` of their key's latest one (None: of any age); a decision is
    final once no earlier attempt on time can arrive. Older ones are counted as late. A micro-batch works on, and
    writes, the keys it touches only.
    """
    output = TOLD.format(name=attempts.schema["name"].dataType.simpleString(), id=attempts.schema["attempt_id"].dataType.simpleString())
    decide = partial(settle, threshold=threshold, recovery=round(recovery_seconds * MICROS))
    return fold_in_order(attempts, path, checkpoint, interval, delay_seconds, STATE, START, decide, tell, output)
