"""Rows of blocks and batches are exchanged once, however many of the others they meet."""

from fixtures import AS_OF, ask, entries
from pyspark.sql import functions as F

from signpost.operators import blocks as B
from signpost.operators import lexical as L
from signpost.operators import rank as R
from signpost.plans.route import route

ID = "query_id long, term string, weight double"


def exchanged(plan):
    """Rows that the plan's own exchanges wrote."""
    plan = plan.finalPhysicalPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan.plan() if "QueryStage" in plan.nodeName() else plan
    own = plan.metrics().get("shuffleRecordsWritten").get().value() if plan.nodeName() == "Exchange" else 0
    children = plan.children()
    return own + sum(exchanged(children.apply(i)) for i in range(children.size()))


def many(spark, n_queries=60, n_entries=90):
    terms = spark.createDataFrame([(i, "t", 1.0) for i in range(n_queries)], ID)
    postings = spark.createDataFrame([(f"n{i}", "t", 1.0) for i in range(n_entries)], "name string, term string, part double")
    return terms, postings


def test_no_copies_are_exchanged(spark, monkeypatch):
    monkeypatch.setattr(B, "QUERIES_PER_BATCH", 5)
    monkeypatch.setattr(B, "ENTRIES_PER_BLOCK", 10)
    terms, postings = many(spark)
    scores = B.keyword_scores(B.cells(60, terms, postings, 90), "bigint")
    assert {(r.query_id, r["name"], r.score) for r in scores.collect()} == {(q, f"n{e}", 1.0) for q in range(60) for e in range(90)}
    # terms, postings and a mark of each block once; then blocks, and batches for each lane. Copies were 60 x 9 and 90 x 12 rows
    assert exchanged(scores._jdf.queryExecution().executedPlan()) <= 60 + 90 + 9 + 9 + 12 * 9


def test_hits_of_a_block_without_other_rows(spark, monkeypatch):
    """Hits meet in the cell of their entry's block, which may hold nothing else; null and repeated names stay."""
    monkeypatch.setattr(B, "QUERIES_PER_BATCH", 2)
    monkeypatch.setattr(B, "ENTRIES_PER_BLOCK", 1)
    terms = spark.createDataFrame([(i, "t", 2.0) for i in range(5)], ID)
    postings = spark.createDataFrame([("a", "t", 0.5), ("a", "u", 0.5)], "name string, term string, part double")
    hits = spark.createDataFrame([(i, f"h{i}", 0.0, 4.0) for i in range(5)] + [(3, "a", 0.0, 1.0)], "query_id long, name string, trigger double, semantic double")
    got = sorted(map(tuple, B.stage_scores_of(B.cells(5, terms, postings, 8, hits=[hits]), "bigint").collect()))
    assert got == sorted([(i, "a", 0.0, 1.0, float(i == 3)) for i in range(5)] + [(i, f"h{i}", 0.0, 0.0, 4.0) for i in range(5)])


def test_parts_of_a_cell_in_any_order(spark, monkeypatch):
    """Several blocks and batches give what one cell gives."""
    rows = [{"name": f"e{i}", "description": f"word{i % 7} word{i % 5} thing", "triggers": [f"word{i % 3}", "thing"]} for i in range(40)]
    catalog = entries(spark, rows)
    queries = ask(spark, *[f"word{i % 8} thing{i % 4} word{i % 3}" for i in range(30)], "", "none")

    def ranked():
        found = route(catalog, queries, top_k=4, as_of=AS_OF).select("query_id", "rank", "name", "score", "trigger", "keyword")
        matched = L.trigger_match(catalog, queries)
        report = R.no_match_report(queries, route(catalog, queries, as_of=AS_OF, threshold=5.0), catalog)
        return [sorted(map(str, x.collect())) for x in (found, matched, report)]

    whole = ranked()
    monkeypatch.setattr(B, "QUERIES_PER_BATCH", 4)
    monkeypatch.setattr(B, "ENTRIES_PER_BLOCK", 6)
    monkeypatch.setattr(B, "POSTINGS_PER_BLOCK", 20)
    assert ranked() == whole and all(whole)


def test_triggers_are_not_exchanged_beside_the_cells(spark):
    """What entries' triggers hold is written first, so that its exchanges are gone when the cells are dealt out."""
    catalog = entries(spark, [{"name": f"e{i}", "description": "one", "triggers": [f"trigger{i}"]} for i in range(9)])
    queries = ask(spark, "trigger1 trigger2")
    found = L.trigger_stage(catalog, queries)["found"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Scan parquet" in plan and found.filter(F.col("word") == "trigger1").count() == 1
