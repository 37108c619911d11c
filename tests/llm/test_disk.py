"""What is exchanged and written: whole sets of likely pairs only, and nothing left of an exchange whose rows are written."""

import time

import numpy as np
from pyspark.sql import functions as F

from signpost.llm import common, jaccard_join
from signpost.session import CLEANUP


def shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = manager.getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_written_rows_leave_no_exchange(spark):
    before = shuffle_files(spark)
    rows = common.written(spark.range(10_000).groupBy(F.col("id") % 100).agg(F.sum("id").alias("s")), "sums")
    assert rows.count() == 100
    until = time.time() + 20
    while time.time() < until and any(f.endswith(".data") for f in shuffle_files(spark) - before):
        time.sleep(0.2)
    # the count is an execution of its own and may keep its one row
    assert len({f.split("_")[1] for f in shuffle_files(spark) - before}) <= 1
    assert spark.conf.get(CLEANUP, "false") == "false"


def test_sketches_are_lower_bounds():
    rng = np.random.default_rng(5)
    rejected = 0
    for n in (1, 2, 3, 31, 32, 33, 200, 1500):
        for m in (n, n + 1, n + n // 4, 2 * n + 1):
            for kept in (0, n // 2, n):
                a = rng.integers(0, 2**63, n).astype(np.uint64)
                b = np.concatenate([a[:kept], rng.integers(0, 2**63, max(m - kept, 0)).astype(np.uint64)])
                apart = len(np.setxor1d(a, b))
                bound = jaccard_join.least_difference(jaccard_join.sketch(a), jaccard_join.sketch(b))
                assert bound <= apart
                assert kept < n or m > n or bound == 0
                rejected += not kept and n > 30 and bound * 9 > n + m
    assert rejected == 20
    assert len(jaccard_join.sketch(a[:0])) == 8


def test_unrelated_texts_are_not_read_whole(spark, monkeypatch):
    """Texts of which many share a segment, made of a few common words: hardly one of their sets is read whole."""
    texts = [" ".join([*(f"c{i % 8}x{j}" for j in range(3)), *(f"w{i}x{j}" for j in range(6))]) for i in range(100)]
    near = [f"n{i}" for i in range(40)]
    texts += [" ".join(near), " ".join([*near, "more"])]
    rows = {}

    def kept(df, name, **options):
        out = common.written(df, name, **options)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard_join, "written", kept)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs, 4, 5, 1).collect()}
    assert got == {i: i for i in range(100)} | {100: 100, 101: 100}
    assert rows["classes"] > 40 and rows["candidates"] > 40
    assert rows["class-tokens"] < rows["classes"] / 2 and rows["likely-candidates"] < rows["candidates"] / 4


def test_rows_are_exchanged_once(spark, request):
    """Whole rows are dealt out once, for the choice of one and for the join with it."""
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.autoBroadcastJoinThreshold"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (None, "c")], "doc_id long, text string")
    kept = jaccard_join.one_per_component(docs, 4, 5, 5)
    assert sorted(r.text for r in kept.collect()) == ["a b", "c"]
    plan = kept._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning(no_id") == 2
