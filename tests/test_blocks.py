"""Ranking by blocks gives what scoring everything gives."""

import random

import numpy as np
import pyarrow as pa
import pytest
from fixtures import AS_OF, ask, entries
from pyspark.sql import functions as F

from signpost.operators import blocks as B
from signpost.operators import lexical as L
from signpost.operators import rank as R
from signpost.plans.route import route, stage_scores


def random_catalog(spark, seed, n=300):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(120)]
    pick = lambda k: " ".join(words[min(int(rng.expovariate(0.05)), 119)] for _ in range(k))
    rows = [{"name": f"entry_{i}", "description": pick(rng.randrange(1, 40)), "source": rng.choice("abc"), "triggers": pick(2).split()} for i in range(n)]
    catalog = entries(spark, rows).withColumns(
        {"usage_count": F.abs(F.hash("name")) % 9, "success_rate": F.lit(0.5) + (F.abs(F.hash("name")) % 5) / 10.0}
    )
    return catalog, ask(spark, *[pick(rng.randrange(1, 12)) for _ in range(25)], "nothing_of_this", "")


COLUMNS = ["query_id", "rank", "name", "score", "trigger", "usage", "success", "recency"]


@pytest.mark.parametrize("seed, few, finish", [(1, 100_000, 8), (2, 5, 0), (3, 100_000, 10**9)])
def test_blocks_equal_scoring_everything(spark, monkeypatch, seed, few, finish):
    """With terms travelling or joined, and losers left unfinished always or never."""
    monkeypatch.setattr(B, "ENTRIES_PER_BLOCK", 40)
    monkeypatch.setattr(B, "QUERIES_PER_BATCH", 7)
    monkeypatch.setattr(B, "CELLS_AT_ONCE", 150)
    monkeypatch.setattr(B, "FINISH_COST", finish)
    monkeypatch.setattr(L, "FEW_TERMS", few)
    catalog, queries = random_catalog(spark, seed)
    weights = {"a": 1.5, "b": 0.0}
    for k in (1, 5):
        got = route(catalog, queries, top_k=k, weights=weights, as_of=AS_OF)
        full = R.rank_top_k(R.fuse_scores(stage_scores(catalog, queries), catalog, AS_OF, weights=weights), k)
        assert sorted(map(tuple, got.select(COLUMNS).collect())) == sorted(map(tuple, full.select(COLUMNS).collect()))
    index = L.build_text_index(catalog)
    parts = L.bm25_parts(index, L.query_term_counts(queries)).groupBy("query_id", "name").agg(F.sum("part").alias("score"))
    expected = {(r.query_id, r.name): r.score for r in parts.collect()}
    scored = {(r.query_id, r.name): r.score for r in L.bm25(catalog, queries).collect()}
    assert scored.keys() == expected.keys() and all(abs(scored[x] - expected[x]) < 1e-9 for x in expected)


def cell_rows(terms, postings, entries):
    rows = [(0, 0, B.TERM, q, None, t, w, None, None, None) for q, t, w in terms]
    rows += [(0, 0, B.POSTING, None, n, t, p, None, None, None) for n, t, p in postings]
    rows += [(0, 0, B.ENTRY, None, n, None, 0.0, 1.0, 1.0, 1.0) for n in entries]
    names = ["block", "batch", "kind", "query_id", "name", "term", "x", "y", "z", "w"]
    types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string(), *[pa.float64()] * 4]
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def test_losers_are_not_finished():
    """A common word of little weight is read for the few entries that can still win, not for all that hold it."""
    names = [f"n{i:04d}" for i in range(2000)]
    postings = [(n, "common", 1.0) for n in names] + [(n, "rare", 1.0 + i / 100) for i, n in enumerate(names[:8])]
    cell = B.Cell(cell_rows([(7, "rare", 9.0), (7, "common", 0.1)], postings, names))
    finished = []
    whole = B.Cell.finish
    cell.finish = lambda scores, q, e, low, rows: (finished.append(len(e)), whole(cell, scores, q, e, low, rows))
    (q, e, trigger, keyword, semantic), = cell.best(3, 0.1)
    assert [names[i] for i in e] == ["n0007", "n0006", "n0005"] and finished and finished[0] < 10
    assert np.allclose(keyword, [9 * (1 + i / 100) + 0.1 for i in (7, 6, 5)])


def test_the_catalog_is_never_broadcast(spark, capsys):
    """However small its files are: exploded to triggers or postings it may be any size."""
    catalog, queries = random_catalog(spark, 4)
    L.trigger_words(catalog, L.query_word_counts(queries).select("word").distinct()).explain("simple")
    shown = capsys.readouterr().out
    assert "SortMergeJoin" in shown and shown.count("BroadcastHashJoin") == 1


def test_stages_meet_in_the_cells(spark):
    """Trigger words, repeated ones too, terms and hits of one cell give one row per query and entry."""
    terms = spark.createDataFrame([(1, "t", 2.0)], "query_id long, term string, weight double")
    postings = spark.createDataFrame([("a", "t", 0.5), ("b", "u", 1.0)], "name string, term string, part double")
    words = spark.createDataFrame([(1, "w", 6.0), (2, "w", 3.0), (2, "v", 3.0), (3, "none", 3.0)], "query_id long, word string, weight double")
    found = spark.createDataFrame([("a", "w"), ("a", "v"), ("c", "v")], "name string, word string")
    hits = spark.createDataFrame([(2, "d", 0.0, 4.0)], "query_id long, name string, trigger double, semantic double")
    rows = B.cells(3, terms, postings, 4, hits=[hits], words=words, found=found)
    got = sorted(map(tuple, B.stage_scores_of(rows, "bigint").collect()))
    assert got == [(1, "a", 6.0, 1.0, 0.0), (2, "a", 6.0, 0.0, 0.0), (2, "c", 3.0, 0.0, 0.0), (2, "d", 0.0, 0.0, 4.0)]


def test_cells_follow_the_postings(spark, monkeypatch):
    """More postings make more blocks, and every cell may have a task of its own."""
    monkeypatch.setattr(B, "POSTINGS_PER_BLOCK", 100)
    terms = spark.createDataFrame([(1, "t", 2.0)], "query_id long, term string, weight double")
    postings = spark.createDataFrame([("a", "t", 0.5)], "name string, term string, part double")
    rows = B.cells(1, terms, postings, 1, n_postings=2_000)
    assert rows.select("block").distinct().count() == 20 and rows.rdd.getNumPartitions() == 20


def test_vector_blocks_hold_few_cosines():
    """500 queries against 20,000 rows of a block: the cosines worked on at once stay at some megabytes."""
    import tracemalloc

    import pandas as pd

    from signpost.operators.vectors import _block_top_k

    rng = np.random.default_rng(5)
    rows = pd.DataFrame({"name": [f"n{i:05d}" for i in range(20_000)], "vec": list(rng.normal(size=(20_000, 4)))})
    queries = pd.DataFrame({"query_id": np.arange(500), "query_vec": list(rng.normal(size=(500, 4)))})
    tracemalloc.start()
    found = _block_top_k(3)(None, queries, rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 1500 and peak < 60e6


def test_blocks_are_fewer_where_batches_give_cells(spark, monkeypatch):
    monkeypatch.setattr(B, "QUERIES_PER_BATCH", 5)
    terms = spark.createDataFrame([(i, "t", 1.0) for i in range(20)], "query_id long, term string, weight double")
    postings = spark.createDataFrame([(f"n{i}", "t", 1.0) for i in range(9)], "name string, term string, part double")
    rows = B.cells(20, terms, postings, 9)
    # 4 batches are 4 cells for the 4 shuffle partitions: one block does, so no term is copied
    assert rows.filter(F.col("kind") == B.TERM).count() == 20
    got = {(r.query_id, r["name"]): r.score for r in B.keyword_scores(rows, "bigint").collect()}
    assert got == {(q, f"n{e}"): 1.0 for q in range(20) for e in range(9)}


def test_a_large_vocabulary_is_not_broadcast(spark, monkeypatch):
    catalog = entries(spark, [{"name": f"e{i}", "description": "one two two", "triggers": []} for i in range(6)] + [{"name": None, "description": "", "triggers": []}])
    words = spark.range(2).select(F.when(F.col("id") == 0, "two").otherwise("three").alias("term"))
    index = L.narrow_text_index(catalog, words)
    plan = index.postings._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    rows = {(r["name"], r.term, r.tf) for r in index.postings.collect() if r["name"]}
    assert rows == {(f"e{i}", t, n) for i in range(6) for t, n in (("two", 2), (L.NO_TERM, 1))}
    assert index.corpus.first().n == 7
