import json
from datetime import timedelta

import pytest
from fixtures import AS_OF, FIVE, ask, entries
from test_usage import START, attempts, random_log

from signpost.operators import circuit as C
from signpost.operators import usage as U
from signpost.plans.route import route
from signpost.sources.snapshot import read_catalog
from signpost.streaming import (
    read_circuits,
    read_decisions,
    read_usage,
    stream_circuit,
    stream_manifests,
    stream_route,
    stream_usage,
)

ATTEMPT = "attempt_id long, name string, ts timestamp, success boolean"


def chunks(log, folder, bounds):
    """Write a log as one file per batch, oldest first."""
    for low, high in zip(bounds, bounds[1:], strict=False):
        log.filter(f"attempt_id >= {low} and attempt_id < {high}").coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def shuffled(log, folder, n, seed):
    """Write a log as n files whose rows are in no order of time."""
    for i in range(n):
        log.filter(f"abs(hash(attempt_id, {seed})) % {n} = {i}").coalesce(1).write.mode("append").parquet(folder)


def usage_of(rows):
    return {r["name"]: (r.uses, round(r.gain, 12), r.last_used_at, r.failures_since_success) for r in rows.collect()}


@pytest.mark.parametrize("delay", [None, 10_000_000])
def test_usage_stream_equals_batch_in_any_order(spark, tmp_path, delay):
    log = attempts(spark, random_log(11, n=300))
    shuffled(log, f"{tmp_path}/log", 5, 1)
    source = stream(spark, f"{tmp_path}/log", ATTEMPT)
    stream_usage(source, f"{tmp_path}/usage", f"{tmp_path}/cp", None, delay).awaitTermination()
    got = read_usage(spark, f"{tmp_path}/usage")
    assert usage_of(got) == usage_of(U.fold_usage(log)) and {r.late for r in got.collect()} == {0}


def test_usage_stream_settles_and_counts_late(spark, tmp_path):
    """In order, with a short delay, most is settled; what comes after it was settled is left out and counted."""
    log = attempts(spark, random_log(12, n=300))
    chunks(log, f"{tmp_path}/log", [0, 100, 200, 300])
    run = lambda: stream_usage(stream(spark, f"{tmp_path}/log", ATTEMPT), f"{tmp_path}/usage", f"{tmp_path}/cp", None, 50)
    run().awaitTermination()
    assert usage_of(read_usage(spark, f"{tmp_path}/usage")) == usage_of(U.fold_usage(log))
    late = attempts(spark, [("k0", 0, False), ("k0", 1, False), ("new", 3, True)]).selectExpr("attempt_id + 1000 AS attempt_id", "name", "ts", "success")
    late.coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    run().awaitTermination()
    got = read_usage(spark, f"{tmp_path}/usage")
    after = usage_of(got)
    assert after.pop("new")[:1] == (1,) and after == usage_of(U.fold_usage(log))
    assert {r["name"]: r.late for r in got.collect() if r.late} == {"k0": 2}


def test_a_batch_writes_touched_names_only(spark, tmp_path):
    chunks(attempts(spark, [("a", 1, True), ("b", 2, True), ("c", 3, False), ("b", 4, False)]), f"{tmp_path}/log", [0, 3, 4])
    stream_usage(stream(spark, f"{tmp_path}/log", ATTEMPT), f"{tmp_path}/usage", f"{tmp_path}/cp", None).awaitTermination()
    written = [{r["name"] for r in spark.read.parquet(f"{tmp_path}/usage/batch={i}").collect()} for i in (0, 1)]
    assert written == [{"a", "b", "c"}, {"b"}]
    assert read_usage(spark, f"{tmp_path}/nothing").count() == 0


COLUMNS = ["attempt_id", "decision", "state", "failures", "last_failure"]


def decisions(df):
    return sorted(map(tuple, df.select(COLUMNS).collect()), key=str)


@pytest.mark.parametrize("delay, threshold, recovery", [(None, 3, 60.0), (10_000_000, 2, 600.0)])
def test_circuit_stream_equals_batch_in_any_order(spark, tmp_path, delay, threshold, recovery):
    log = attempts(spark, random_log(13, n=300))
    shuffled(log, f"{tmp_path}/log", 4, 2)
    options = {"threshold": threshold, "recovery_seconds": recovery}
    source = stream(spark, f"{tmp_path}/log", ATTEMPT)
    stream_circuit(source, f"{tmp_path}/out", f"{tmp_path}/cp", None, delay_seconds=delay, **options).awaitTermination()
    trace = C.circuit_trace(log, **options)
    assert decisions(read_decisions(spark, f"{tmp_path}/out")) == decisions(trace)
    states = read_circuits(spark, f"{tmp_path}/out").drop("last_ts", "late")
    assert sorted(map(str, states.collect())) == sorted(map(str, C.stored_circuits(trace).select(states.columns).collect()))


def test_circuit_stream_settles_and_counts_late(spark, tmp_path):
    log = attempts(spark, random_log(14, n=300))
    chunks(log, f"{tmp_path}/log", [0, 90, 210, 300])
    run = lambda: stream_circuit(stream(spark, f"{tmp_path}/log", ATTEMPT), f"{tmp_path}/out", f"{tmp_path}/cp", None, delay_seconds=100)
    run().awaitTermination()
    trace = decisions(C.circuit_trace(log))
    got = read_decisions(spark, f"{tmp_path}/out")
    assert decisions(got) == trace and 200 < got.filter("final").count() < 300
    # one that waits takes its place before those that came earlier; one too old is counted
    latest = log.filter("name = 'k1'").agg({"ts": "max"}).first()[0]
    more = [(1000, "k1", latest - timedelta(seconds=50), False), (1001, "k1", START, False)]
    spark.createDataFrame(more, ATTEMPT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    run().awaitTermination()
    full = log.unionByName(spark.createDataFrame(more[:1], ATTEMPT))
    assert decisions(read_decisions(spark, f"{tmp_path}/out")) == decisions(C.circuit_trace(full))
    assert {r["name"]: r.late for r in read_circuits(spark, f"{tmp_path}/out").collect() if r.late} == {"k1": 1}


def test_route_stream_equals_batch(spark, tmp_path):
    queries = ask(spark, "prune roses", "soil acidity survey", "plot tray")
    queries.write.parquet(f"{tmp_path}/queries")
    catalog = entries(spark, FIVE)
    source = spark.readStream.schema(queries.schema).parquet(f"{tmp_path}/queries")
    stream_route(source, lambda: catalog, f"{tmp_path}/out", f"{tmp_path}/cp", None, as_of=AS_OF).awaitTermination()
    columns = ["query_id", "rank", "name", "score"]
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select(columns).collect()))
    assert got == sorted(map(tuple, route(catalog, queries, as_of=AS_OF).select(columns).collect()))


def test_manifest_stream(spark, tmp_path):
    folder, catalog, reloads = tmp_path / "in", f"{tmp_path}/catalog", []
    folder.mkdir()

    def put(name, content):
        (folder / name).write_text(content)

    def run():
        def told(status, epoch):
            reloads.append(sorted(r.status for r in status.collect()))

        stream_manifests(spark, str(folder), catalog, f"{tmp_path}/cp", told, None).awaitTermination()
        return sorted(r["name"] for r in read_catalog(spark, catalog).collect())

    def manifest(*names):
        return json.dumps({"provider": "p", "tools": [{"name": n, "description": "Some text"} for n in names]})

    put("a.json", manifest("one_a", "two_a"))
    put("bad.json", "{ nope")
    put("note.txt", manifest("ignored_one"))
    assert run() == ["one_a", "two_a"]
    put("b.json", manifest("two_a", "three_a"))
    assert run() == ["three_a", "two_a"]
    assert run() == ["three_a", "two_a"]
    assert reloads == [["failed", "loaded"], ["loaded"]]


def test_many_names_of_one_bucket(spark, tmp_path, monkeypatch):
    """What a micro-batch brings for a bucket is settled at once, each name for itself; rows without a name are one too."""
    from signpost.streaming import ordered

    monkeypatch.setattr(ordered, "BUCKETS", 1)
    log = attempts(spark, [(f"k{i % 7}" if i % 9 else None, i, i % 4 > 0) for i in range(60)])
    shuffled(log, f"{tmp_path}/log", 2, 3)
    stream_usage(stream(spark, f"{tmp_path}/log", ATTEMPT), f"{tmp_path}/usage", f"{tmp_path}/cp", None, None).awaitTermination()
    assert usage_of(read_usage(spark, f"{tmp_path}/usage")) == usage_of(U.fold_usage(log))
