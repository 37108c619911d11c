import random
import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from fixtures import AS_OF, entries
from pyspark.sql import functions as F

from signpost.operators import circuit as C
from signpost.operators import usage as U

START = datetime(2024, 1, 1)


def attempts(spark, rows):
    """rows of (name, second, success)"""
    data = [(i, n, START + timedelta(seconds=t), bool(s)) for i, (n, t, s) in enumerate(rows)]
    return spark.createDataFrame(data, "attempt_id long, name string, ts timestamp, success boolean")


def folded(df):
    return {r["name"]: r for r in df.collect()}


@pytest.mark.parametrize("width", [1, 3, 1024])
def test_moving_average(spark, width):
    log = attempts(spark, [("a", i, s) for i, s in enumerate((1, 0, 0, 1, 0))])
    row = folded(U.fold_usage(log, width))["a"]
    assert (row.uses, row.failures_since_success) == (5, 1)
    assert 0.9**5 + row.gain == pytest.approx(0.7461, abs=5e-5)


def random_log(seed, keys=7, n=1500, step=40):
    rng, t, rows = random.Random(seed), 0, []
    for _ in range(n):
        t += rng.randrange(step)  # equal times occur: the id decides
        rows.append((f"k{min(rng.randrange(keys * 2), keys)}", t, rng.random() < 0.45))
    return rows


@pytest.mark.parametrize("width", [1, 60, 1024])
def test_fold_equals_loop(spark, width):
    rows = random_log(1)
    state = {}
    for name, t, success in rows:
        rate, uses, run, _ = state.get(name, (1.0, 0, 0, None))
        state[name] = (rate * 0.9 + 0.1 * success, uses + 1, 0 if success else run + 1, t)
    catalog = entries(spark, [{"name": n} for n in state] + [{"name": "unused"}])
    applied = folded(U.apply_usage(catalog, U.fold_usage(attempts(spark, rows), width), AS_OF))
    for name, (rate, uses, run, t) in state.items():
        row = applied[name]
        assert row.success_rate == pytest.approx(rate, abs=1e-12)
        assert (row.usage_count, row.consecutive_failures) == (uses, run)
        assert row.last_used_at == START + timedelta(seconds=t)
    idle = applied["unused"]
    assert (idle.usage_count, idle.success_rate, idle.last_used_at) == (0, 1.0, None)


def test_one_busy_second_is_spread_by_rows(spark):
    """The log is dealt out by ranges, so all attempts of one key at one time are still many tasks and blocks."""
    log = spark.range(20_000).selectExpr("id AS attempt_id", "concat('a', id % 1) AS name", "timestamp'2024-01-01' AS ts", "id % 3 = 0 AS success")
    plan = U.fold_usage(log)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(name" in plan
    row = U.fold_usage(log).first()
    assert (row.uses, row.failures_since_success) == (20_000, 1)
    assert row.gain == pytest.approx(sum(0.1 * 0.9**k for k in range(1, 400, 3)), abs=1e-12)


def test_folds_merge(spark):
    rows = random_log(2, n=400)
    log = attempts(spark, rows).cache()
    whole = folded(U.fold_usage(log))
    old, new = (U.fold_usage(log.filter(c)) for c in ("attempt_id < 150", "attempt_id >= 150"))
    merged = folded(U.merge_folds(old, new))
    assert whole.keys() == merged.keys()
    for name, row in whole.items():
        assert merged[name].gain == pytest.approx(row.gain, abs=1e-12)
        assert merged[name][1::2] == row[1::2] and merged[name].failures_since_success == row.failures_since_success


def test_unknown_names_are_ignored(spark):
    catalog = entries(spark, [{"name": "a"}])
    log = attempts(spark, [("b", 1, True)])
    assert [r["name"] for r in U.apply_usage(catalog, U.fold_usage(log), AS_OF).collect()] == ["a"]


TRACE = [(0, 0), (10, 0), (20, 0), (30, 1), (90, 0), (100, 1), (160, 1)]


@pytest.mark.parametrize("width", [1, 3, 250_000])
def test_circuit_golden(spark, width):
    trace = C.circuit_trace(attempts(spark, [("a", t, s) for t, s in TRACE]), slice_rows=width).cache()
    got = [(r.decision, r.state, r.failures) for r in trace.orderBy("attempt_id").collect()]
    assert got == [
        ("failed", "closed", 1), ("failed", "closed", 2), ("failed", "open", 3), ("rejected", "open", 3),
        ("failed", "open", 4), ("rejected", "open", 4), ("ok", "closed", 0),
    ]
    at = {s: C.circuit_state_at(trace, F.lit(START + timedelta(seconds=s))).first() for s in (79, 80)}
    assert [(r.state, r.failures) for r in at.values()] == [("open", 3), ("half-open", 3)]
    fold = folded(U.fold_usage(C.recorded_attempts(trace)))["a"]
    assert 0.9**7 + fold.gain == pytest.approx(0.5782969, abs=1e-7)
    assert C.tripped_circuits(trace).count() == 0
    tripped = C.tripped_circuits(trace, F.lit(START + timedelta(seconds=100))).first()
    assert (tripped["name"], tripped.failures, tripped.state) == ("a", 4, "open")


def loop_trace(rows, threshold, recovery):
    state, told = {}, []
    for name, t, success in rows:
        s = state.setdefault(name, {"open": False, "failures": 0, "last": 0})
        if s["open"] and t - s["last"] < recovery:
            told.append(("rejected", s["open"], s["failures"]))
            continue
        if success:
            s.update(open=False, failures=0)
        else:
            s["failures"] += 1
            s["last"] = t
            s["open"] = s["open"] or s["failures"] >= threshold
        told.append(("ok" if success else "failed", s["open"], s["failures"]))
    return told


@pytest.mark.parametrize("seed, threshold, recovery, width", [(1, 3, 60, 100), (2, 3, 600, 250_000), (3, 1, 90, 40), (4, 5, 61, 25), (5, 2, 3000, 15), (6, 3, 0, 30)])
def test_sliced_circuit_equals_loop(spark, seed, threshold, recovery, width):
    rows = random_log(seed)
    trace = C.circuit_trace(attempts(spark, rows), threshold, recovery, slice_rows=width)
    got = [(r.decision, r.state == "open", r.failures) for r in trace.orderBy("attempt_id").collect()]
    assert got == loop_trace(rows, threshold, recovery)


def states_of(rows, threshold, recovery, state):
    """Loop over one key's (t, success) from `state`; the state after."""
    last, failures = state
    for t, success in rows:
        if last != C.CLOSED and t - last < recovery:
            continue
        if success:
            last, failures = C.CLOSED, 0
        else:
            last, failures = t if last != C.CLOSED or failures + 1 >= threshold else C.CLOSED, failures + 1
    return last, failures


@pytest.mark.parametrize("seed", range(40))
def test_slice_effects_hold_for_every_entry(seed):
    rng = random.Random(seed)
    threshold, recovery = rng.randrange(1, 5), rng.choice([0, 1, 5, 30, 200])
    logs, t = [], 100
    for _ in range(rng.randrange(1, 5)):
        log = []
        t = rng.randrange(100, 200)
        for _ in range(rng.randrange(1, 40)):
            log.append((t, rng.random() < rng.choice([0.1, 0.5])))
            t += rng.choice([0, 1, 1, 3, 20])
        logs.append(log)
    flat = [x for log in logs for x in log]
    starts = np.cumsum([0] + [len(log) for log in logs[:-1]])
    cut = C.Slices(np.array([x[0] for x in flat]), np.array([x[1] for x in flat]), starts, threshold, recovery)
    for log, effect in zip(logs, cut.effects(), strict=True):
        for state in [(C.CLOSED, f) for f in range(threshold)] + [(log[0][0] - back, 7) for back in range(0, 260)]:
            assert C.pass_through(state, effect) == states_of(log, threshold, recovery, state), (log, state)
    for entry in [(C.CLOSED, 0), (C.CLOSED, threshold - 1), (95, 9), (60, 2)]:
        k = len(logs)
        decisions, last, failures = cut.replay(np.full(k, entry[0]), np.full(k, entry[1]))
        for i, log in enumerate(logs):
            for j in range(len(log)):
                row = starts[i] + j
                before, after = (states_of(log[:m], threshold, recovery, entry) for m in (j, j + 1))
                assert (last[row], failures[row]) == after
                rejected = before[0] != C.CLOSED and log[j][0] - before[0] < recovery
                assert decisions[row] == ("rejected" if rejected else "ok" if log[j][1] else "failed")


@pytest.mark.parametrize("step, recovery", [(1, 10), (1, 2_000_000), (0, 5)])
def test_a_million_failures_of_one_key(step, recovery):
    n = 1_000_000
    began = time.perf_counter()
    cut = C.Slices(np.arange(n) * step, np.zeros(n, bool), np.array([0]), 3, recovery)
    effect = cut.effects()[0]
    decisions, last, failures = cut.replay(np.array([C.CLOSED]), np.array([0]))
    assert time.perf_counter() - began < 20
    assert C.pass_through((C.CLOSED, 0), effect) == (last[-1], failures[-1])
    assert (decisions[:3] == "failed").all() and (decisions[3] == "rejected") == (recovery > step)


def test_a_hot_key_is_many_slices(spark):
    """A third of the log, all in one second, is spread over ranges of about the asked size."""
    rows = [("hot", 5, i % 3 == 0) for i in range(600)] + random_log(9, n=1200)
    ids = attempts(spark, rows)
    trace = C.circuit_trace(ids, slice_rows=100)
    assert trace.count() == 1800
    got = [(r.decision, r.state == "open", r.failures) for r in trace.orderBy("attempt_id").collect()]
    assert got == loop_trace(rows, 3, 60)


def test_unknown_key_is_closed_and_reset_forgets(spark):
    log = attempts(spark, [("a", t, s) for t, s in TRACE[:3]])
    names = spark.createDataFrame([("a",), ("b",)], "name string")
    now = F.lit(START + timedelta(seconds=30))
    state = {r["name"]: (r.state, r.failures) for r in C.circuit_state_at(C.circuit_trace(log), now, names=names).collect()}
    assert state == {"a": ("open", 3), "b": ("closed", 0)}
    resets = spark.createDataFrame([("a", START + timedelta(seconds=10))], "name string, reset_at timestamp")
    left = C.circuit_trace(C.reset_circuits(log, resets)).collect()
    assert [(r.state, r.failures) for r in left] == [("closed", 1)]
