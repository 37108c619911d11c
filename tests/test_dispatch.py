from signpost.operators import dispatch as D

RANKED = [(1, r, n, s) for r, n, s in ((1, "a", 9.0), (2, "b", 5.0), (3, "c", 2.0), (4, "d", 1.9), (5, "e", 1.0))]
RANKED += [(2, 1, "x", 1.5), (3, 1, "a", 4.0), (3, 2, "e", 1.0), (3, 3, "f", 0.5)]


def frames(spark, outcomes):
    ranked = spark.createDataFrame(RANKED, "query_id long, rank long, name string, score double")
    queries = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "query_id long")
    plan = D.fallback_plan(ranked)
    known = spark.createDataFrame(outcomes, "name string, success boolean")
    return ranked, queries, plan, known


def test_gate_and_plan(spark):
    ranked, queries, plan, _ = frames(spark, [("a", True)])
    gate = {r.query_id: r.gate for r in D.confidence_gate(queries, ranked).collect()}
    assert gate == {1: "execute", 2: "low_confidence", 3: "execute", 4: "no_match"}
    assert sorted((r.query_id, r["name"]) for r in plan.collect()) == [(1, "a"), (1, "b"), (1, "c"), (3, "a")]


def test_fallback(spark):
    ranked, _, plan, known = frames(spark, [("a", False), ("b", True), ("c", True)])
    resolution = D.resolve_fallback(plan, known)
    got = {r.query_id: (r.status, r.winner, r.winner_rank, r.failed_attempts) for r in resolution.collect()}
    assert got == {1: ("success", "b", 2, 1), 3: ("all_failed", None, None, 1)}
    log = sorted((r.query_id, r["name"], r.success) for r in D.attempt_log(plan, known).collect())
    assert log == [(1, "a", False), (1, "b", True), (3, "a", False)]
    other = sorted((r.query_id, r["name"]) for r in D.alternatives(ranked, resolution).collect())
    assert other == [(1, "c"), (1, "d"), (1, "e"), (3, "e"), (3, "f")]


def test_outcomes_per_query(spark):
    _, _, plan, _ = frames(spark, [("a", True)])
    outcomes = spark.createDataFrame([(3, "a", True), (1, "c", True)], "query_id long, name string, success boolean")
    got = {r.query_id: (r.winner, r.failed_attempts) for r in D.resolve_fallback(plan, outcomes).collect()}
    assert got == {1: ("c", 2), 3: ("a", 0)}
