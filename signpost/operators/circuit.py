"""Circuit breaker over an ordered attempt log.

A breaker is sequential per key, so the log is cut into slices and folded in three steps:

1. each slice, in parallel, works out what it does to every state it could be entered with;
2. the slices of a key, a row each, are chained in order to find each slice's true entry state;
3. each slice, in parallel again, is replayed from that state and tells a decision per attempt.

Slices are ranges of (name, time, attempt) with about as many rows each, so a key that holds a third of the log, or a burst
within one second, is as many slices as its rows make. Within a slice nothing is stepped through attempt by attempt: a failure that
opens the circuit points to the next one that does, by two binary searches (the attempt at which the gate lets a trial
through, the end of the next run of failures that trips a closed circuit), and following the pointers, by doubling, gives the exit
for every entry at once.

A state is (last_failure, failures): last_failure is None while closed, else the time of the failure that
opened the circuit, in microseconds.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signpost import schema as S
from signpost.operators.windows import rank_within
from signpost.session import shared_folder, shuffle_partitions

OK, FAILED, REJECTED = "ok", "failed", "rejected"
MICROS = 1_000_000
#: Attempts of a slice, about.
SLICE_ROWS = 250_000
#: Stands for "closed" among times.
CLOSED = -(2**63)


class Slices:
    """Attempts of one or more keys, each key's in order, and where a circuit opened at one of them opens next.

    `starts` are the first rows of the keys. For row j, were it a failure that opens the circuit: `gate` is the first row whose attempt is let
    through (the key's end if none is), `after` the next row that opens it (-1: none), and `tripped` whether it was closed in
    between.
    """

    def __init__(self, t: np.ndarray, success: np.ndarray, starts: np.ndarray, threshold: int, recovery: int):
        n = len(t)
        self.t, self.success, self.starts = t, success, starts
        self.threshold, self.recovery = threshold, recovery
        self.ends = np.append(starts[1:], n)
        self.key = np.repeat(np.arange(len(starts)), self.ends - starts)
        self.end = self.ends[self.key]
        place = np.arange(n)
        last_ok = np.maximum.accumulate(np.where(success, place, -1))
        #: failures in a row up to each row
        self.run = place - np.maximum(last_ok, starts[self.key] - 1)
        self.trips = np.flatnonzero(self.run >= threshold)
        # times of all keys on one line, keys further apart than any wait
        low = t.min() if n else 0
        self.apart = (t.max() - low if n else 0) + recovery + 1
        self.line = t - low + self.key * self.apart
        self.low = low
        self.gate = np.clip(np.searchsorted(self.line, self.line + recovery), place + 1, self.end)
        reopened = (self.gate < self.end) & ~success[np.minimum(self.gate, n - 1)]
        tripped = np.where(self.gate < self.end, self.next_trip(np.minimum(self.gate + 1, n), self.end), -1)
        self.after = np.where(reopened, self.gate, tripped)
        self.tripped = ~reopened

    def next_trip(self, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Row at which a circuit closed without failures before row `at` opens, or -1."""
        found = np.append(self.trips, len(self.t))[np.searchsorted(self.trips, at + self.threshold - 1)]
        return np.where(found < end, found, -1)

    def tail(self, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Failures of a circuit at its key's end that is closed from row `at` on."""
        return np.minimum(self.run[end - 1], end - at)

    def trip_from(self, failures: np.ndarray) -> np.ndarray:
        """First row of each key that opens a circuit entered closed with `failures`, or -1."""
        need = self.threshold - failures
        # the first success of each key, or its end
        ok = np.append(np.flatnonzero(self.success), len(self.t))
        lead = np.minimum(ok[np.searchsorted(ok, self.starts)], self.ends) - self.starts
        return np.where(lead >= need, self.starts + need - 1, self.next_trip(self.starts, self.ends))

    def gate_from(self, last: np.ndarray) -> np.ndarray:
        """First row of each key that a circuit opened at `last`, before the key's rows, lets through."""
        wait = np.clip(last + self.recovery - self.low, -1, self.apart - 1)
        return np.clip(np.searchsorted(self.line, wait + np.arange(len(self.starts)) * self.apart), self.starts, self.ends)

    def exits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row, were it to open the circuit: the last row that does, whether it was closed in between, and the
        openings since then."""
        n = len(self.t)
        jump = np.where(self.after < 0, np.arange(n), self.after)
        tripped = (self.after >= 0) & self.tripped
        steps = ((self.after >= 0) & ~self.tripped).astype(np.int64)
        while True:
            further = jump[jump]
            if (further == jump).all():
                return jump, tripped, steps
            steps = np.where(tripped[jump], steps[jump], steps + steps[jump])
            tripped |= tripped[jump]
            jump = further

    def effects(self) -> list[dict]:
        """Per key: exit state by number of failures if entered closed, and if entered open by lines, each valid for circuits
        opened at `upto` at the latest (and after the line before)."""
        final, tripped, steps = self.exits()
        ends_open = self.gate[final] >= self.end[final]
        left_closed = np.minimum(self.gate[final] + 1, self.end[final])

        def leave(row: np.ndarray, failures: np.ndarray):
            """Exit of circuits opened at `row` with `failures`: last failure or CLOSED, failures."""
            last = np.where(ends_open[row], self.t[final[row]], CLOSED)
            opened = np.where(tripped[row], self.threshold, failures) + steps[row]
            end = self.end[row]
            return last, np.where(ends_open[row], opened, self.tail(left_closed[row], end))

        closed = []
        for f in range(self.threshold):
            row = self.trip_from(np.full(len(self.starts), f))
            last, failures = leave(np.maximum(row, 0), np.full(len(row), self.threshold))
            length = self.ends - self.starts
            whole = self.run[self.ends - 1] == length
            kept = np.where(whole, f + length, self.run[self.ends - 1])
            closed.append((np.where(row < 0, CLOSED, last), np.where(row < 0, kept, failures)))
        # rows that may be the first let through: of each time, while the wait began before the key's rows
        n = len(self.t)
        first = self.starts[self.key]
        earlier = self.t[np.maximum(np.arange(n) - 1, 0)]
        rows = np.flatnonzero((np.arange(n) == first) | ((earlier < self.t) & (earlier - self.recovery < self.t[first])))
        trip = self.next_trip(np.minimum(rows + 1, n), self.end[rows])
        row = np.where(self.success[rows], trip, rows)
        last, failures = leave(np.maximum(row, 0), np.where(self.success[rows], self.threshold, 1))
        shut = row < 0
        last = np.where(shut, CLOSED, last)
        failures = np.where(shut, self.tail(np.minimum(rows + 1, self.end[rows]), self.end[rows]), failures)
        carried = ~self.success[rows] & ~tripped[np.maximum(row, 0)] & (last != CLOSED)
        upto, key = self.t[rows] - self.recovery, self.key[rows]
        # neighbours with one outcome become one line
        same = (last[1:] == last[:-1]) & (failures[1:] == failures[:-1]) & (carried[1:] == carried[:-1]) & (key[1:] == key[:-1])
        kept = np.append(~same, np.ones(min(len(rows), 1), bool))
        upto, last, failures, carried, key = (x[kept] for x in (upto, last, failures, carried, key))
        cuts = np.searchsorted(key, np.arange(len(self.starts) + 1))
        return [
            {
                "closed_last": [int(c[0][i]) for c in closed],
                "closed_failures": [int(c[1][i]) for c in closed],
                "upto": upto[cuts[i] : cuts[i + 1]],
                "open_last": last[cuts[i] : cuts[i + 1]],
                "open_failures": failures[cuts[i] : cuts[i + 1]],
                "carried": carried[cuts[i] : cuts[i + 1]],
            }
            for i in range(len(self.starts))
        ]

    def replay(self, last: np.ndarray, failures: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Decision, last failure (CLOSED while closed) and failures after each attempt; keys are entered with `last` and
        `failures`."""
        n = len(self.t)
        place = np.arange(n)
        shut = last == CLOSED
        let = np.where(shut, self.starts, self.gate_from(np.where(shut, 0, last)))
        trial = np.minimum(let, max(n - 1, 0))
        inside = let < self.ends
        first = np.where(self.success[trial], self.next_trip(np.minimum(let + 1, n), self.ends), trial)
        opens = np.where(shut, self.trip_from(np.where(shut, failures, 0)), np.where(inside, first, -1))
        counts = np.where(shut | self.success[trial], self.threshold, failures + 1)
        rows, told = [], []
        after, tripped = self.after.tolist(), self.tripped.tolist()
        for row, count in zip(opens.tolist(), counts.tolist(), strict=True):
            while row >= 0:
                rows.append(row)
                told.append(count)
                count = self.threshold if tripped[row] else count + 1
                row = after[row]
        rows, told = np.array(rows, np.int64), np.array(told, np.int64)
        held = np.searchsorted(rows, place, side="right") - 1
        known = np.maximum(held, 0)
        is_open = (held >= 0) & (place < self.gate[rows[known]]) if len(rows) else np.zeros(n, bool)
        waits = ~shut[self.key] & (place < let[self.key])
        added = np.where(shut[self.key] & (self.run == place - self.starts[self.key] + 1), failures[self.key], 0)
        out_last, out_failures = np.full(n, CLOSED), self.run + added
        if len(rows):
            out_last = np.where(is_open, self.t[rows[known]], out_last)
            out_failures = np.where(is_open, told[known], out_failures)
        out_last = np.where(waits, last[self.key], out_last)
        out_failures = np.where(waits, failures[self.key], out_failures)
        opening = np.zeros(n, bool)
        opening[rows] = True
        rejected = waits | (is_open & ~opening)
        decision = np.where(rejected, REJECTED, np.where(self.success, OK, FAILED))
        return decision, out_last, out_failures


def pass_through(state: tuple, effect: dict) -> tuple:
    """State after a slice entered in `state`; last_failure is CLOSED while closed."""
    last, failures = state
    if last == CLOSED:
        return effect["closed_last"][failures], effect["closed_failures"][failures]
    line = int(np.searchsorted(effect["upto"], last))
    if line == len(effect["upto"]):
        return state
    return effect["open_last"][line], effect["open_failures"][line] + (failures if effect["carried"][line] else 0)


def key_starts(names: pd.Series) -> np.ndarray:
    """First rows of the runs of equal names."""
    codes = pd.factorize(names, use_na_sentinel=False)[0]
    return np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)


EFFECT = (
    "name {name}, slice long, closed_last array<long>, closed_failures array<long>, "
    "upto array<long>, open_last array<long>, open_failures array<long>, carried array<boolean>"
)
ROWS = "attempt_id {id}, name {name}, t long, success boolean, slice long"


def cut_slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The attempts with the number of their range, which grows along the order."""
    number = TaskContext.get().partitionId()
    for b in batches:
        yield b.assign(slice=number)


def gathered(batches: Iterator[pd.DataFrame], by: str) -> Iterator[pd.DataFrame]:
    """Whole slices of a stream sorted by slice."""
    held: list[pd.DataFrame] = []
    for b in batches:
        cuts = np.append(np.flatnonzero(np.diff(b[by].to_numpy())) + 1, len(b))
        at = 0
        for cut in cuts:
            part = b.iloc[at:cut]
            if held and len(part) and held[0][by].iloc[0] != part[by].iloc[0]:
                yield pd.concat(held, ignore_index=True)
                held = []
            if len(part):
                held.append(part)
            at = cut
    if held:
        yield pd.concat(held, ignore_index=True)


def slice_effects(threshold: int, recovery: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in gathered(batches, "slice"):
            starts = key_starts(rows["name"])
            cut = Slices(rows["t"].to_numpy(), rows["success"].to_numpy(bool), starts, threshold, recovery)
            yield pd.DataFrame(cut.effects()).assign(name=rows["name"].iloc[starts].array, slice=rows["slice"].iloc[0])

    return run


def chain_slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    name, state = None, (CLOSED, 0)
    for batch in batches:
        rows = []
        for row in batch.to_dict("records"):
            if not rows and name is None or row["name"] != name:
                name, state = row["name"], (row["start_last"], row["start_failures"])
            rows.append((row["name"], row["slice"], *state))
            state = pass_through(state, row)
        yield pd.DataFrame(rows, columns=["name", "slice", "entry_last", "entry_failures"])


def replay_slices(threshold: int, recovery: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in gathered(batches, "slice"):
            # a key's entry stands before its attempts
            entry = rows["entry_last"].notna().to_numpy()
            entries, log = rows[entry], rows[~entry].reset_index(drop=True)
            starts = key_starts(log["name"])
            cut = Slices(log["t"].to_numpy(np.int64), log["success"].to_numpy(bool), starts, threshold, recovery)
            last, failures = (entries[c].to_numpy(np.int64) for c in ("entry_last", "entry_failures"))
            yield told(log, *cut.replay(last, failures))

    return run


def told(log: pd.DataFrame, decision: np.ndarray, last: np.ndarray, failures: np.ndarray) -> pd.DataFrame:
    out = log[["attempt_id", "name", "t", "success"]].assign(decision=decision, failures=failures)
    out["opened_at"] = pd.array(last, "Int64")
    out.loc[last == CLOSED, "opened_at"] = pd.NA
    return out[["attempt_id", "name", "t", "success", "decision", "opened_at", "failures"]]


def circuit_trace(
    attempts: DataFrame,
    threshold: int = S.FAILURE_THRESHOLD,
    recovery_seconds: float = S.RECOVERY_SECONDS,
    initial: DataFrame | None = None,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Decision per attempt: `attempt_id, name, ts, success, decision, state, failures, last_failure`.

    `success` is what the call would return if let through. `state` is the stored one, closed or open;
    `last_failure` is given while open. Order is (ts, attempt_id). `initial`, in the shape of `stored_circuits`, is
    where keys stand before the log; others start closed. The ordered log is written once, to the shared folder.
    """
    recovery = round(recovery_seconds * MICROS)
    spark = attempts.sparkSession
    name_type = attempts.schema["name"].dataType.simpleString()
    id_type = attempts.schema["attempt_id"].dataType.simpleString()
    path = f"{shared_folder(spark)}/circuit-{uuid.uuid4().hex}"
    order = ["name", "t", "attempt_id"]
    rows = attempts.select("attempt_id", "name", F.unix_micros("ts").alias("t"), F.coalesce("success", F.lit(False)).alias("success"))
    n = shuffle_partitions(attempts)
    ranges = max(n, -(-attempts.count() // slice_rows))
    schema = ROWS.format(id=id_type, name=name_type)
    ranged = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    ranged.mapInPandas(cut_slices, schema).write.parquet(path)
    log = spark.read.schema(schema).parquet(path)
    # a slice is about as many rows as any other, whichever keys it holds
    effects = (
        log.repartition(n, "slice").sortWithinPartitions("slice", *order)
        .mapInPandas(slice_effects(threshold, recovery), EFFECT.format(name=name_type))
    )
    closed = F.lit(CLOSED)
    if initial is None:
        started = effects.withColumns({"start_last": closed, "start_failures": F.lit(0).cast("long")})
    else:
        start = initial.select(
            "name",
            F.coalesce(F.unix_micros("last_failure"), closed).alias("start_last"),
            F.col("failures").alias("start_failures"),
        )
        started = effects.join(start, "name", "left").withColumns(
            {"start_last": F.coalesce("start_last", closed), "start_failures": F.coalesce("start_failures", F.lit(0))}
        )
    entries = (
        started.repartition("name")
        .sortWithinPartitions("name", "slice")
        .mapInPandas(chain_slices, f"name {name_type}, slice long, entry_last long, entry_failures long")
    )
    both = log.unionByName(entries, allowMissingColumns=True).repartition(n, "slice")
    told = both.sortWithinPartitions("slice", "name", F.asc_nulls_last("entry_last"), "t", "attempt_id").mapInPandas(
        replay_slices(threshold, recovery),
        f"attempt_id {id_type}, name {name_type}, t long, success boolean, "
        "decision string, opened_at long, failures long",
    )
    return shown_trace(told)


def shown_trace(told: DataFrame) -> DataFrame:
    return told.select(
        "attempt_id",
        "name",
        F.timestamp_micros("t").alias("ts"),
        "success",
        "decision",
        F.when(F.col("opened_at").isNull(), "closed").otherwise("open").alias("state"),
        "failures",
        F.timestamp_micros("opened_at").alias("last_failure"),
    )


def recorded_attempts(trace: DataFrame) -> DataFrame:
    """What the usage fold learns from: a rejected attempt counts as a failure."""
    return trace.select("attempt_id", "name", "ts", (F.col("decision") == OK).alias("success"))


def stored_circuits(trace: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Last stored state per key."""
    seen = trace if as_of is None else trace.filter(F.col("ts") <= as_of)
    last = rank_within(seen, "name", [F.desc("ts"), F.desc("attempt_id")], 1)
    return last.select("name", "state", "failures", "last_failure")


def circuit_state_at(
    trace: DataFrame,
    as_of: Column,
    recovery_seconds: float = S.RECOVERY_SECONDS,
    names: DataFrame | None = None,
) -> DataFrame:
    """State as a caller sees it at `as_of`; keys of `names` without attempts are closed."""
    stored = stored_circuits(trace, as_of)
    waited = F.unix_micros(as_of) - F.unix_micros("last_failure") >= F.lit(round(recovery_seconds * MICROS))
    state = F.when((F.col("state") == "open") & waited, "half-open").otherwise(F.col("state"))
    now = stored.select("name", state.alias("state"), "failures")
    if names is None:
        return now
    return names.select("name").join(now, "name", "left").select(
        "name",
        F.coalesce("state", F.lit("closed")).alias("state"),
        F.coalesce("failures", F.lit(0)).alias("failures"),
    )


def tripped_circuits(trace: DataFrame, as_of: Column | None = None) -> DataFrame:
    return stored_circuits(trace, as_of).filter(F.col("state") != "closed").select("name", "failures", "state")


def reset_circuits(attempts: DataFrame, resets: DataFrame) -> DataFrame:
    """Attempts that still count after `resets(name, reset_at)`: those later than the key's last reset."""
    last = resets.groupBy("name").agg(F.max("reset_at").alias("reset_at"))
    kept = attempts.join(last, "name", "left")
    return kept.filter(F.col("reset_at").isNull() | (F.col("ts") > F.col("reset_at"))).select(*attempts.columns)
