"""Properties of physical plans that results cannot show."""

import pytest

import __spark_entry__ as entry
from workload import registry

# These run their stream while the query is built.
STREAMS = {"stream_manifests", "stream_usage", "stream_circuit", "stream_route"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["query_id", "name", "score"] and df.count() > 0


CORE = registry.all_queries()


def test_every_query_has_sql():
    assert set(CORE) <= set(entry.oracle_sql()) and set(CORE) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(CORE) - STREAMS))
def test_no_all_pairs_join(spark, sf_dir, name):
    plan = plan_of(entry.queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["route", "rank_top_k", "dedupe_batch", "name_digest", "centroid_search"])
def test_top_k_is_cut_before_the_exchange(spark, sf_dir, name):
    plan = plan_of(entry.queries()[name](spark, sf_dir))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_stage_scores_are_summed_where_they_lie(spark, sf_dir):
    """Between the layout by name and the final top-k nothing of the large side is exchanged again."""
    plan = plan_of(entry.queries()["fuse_scores"](spark, sf_dir))
    above_union = plan.split("Union")[0]
    assert "Union" in plan and "Exchange hashpartitioning(query_id" not in above_union


def test_no_join_is_forced(spark):
    import pathlib

    files = pathlib.Path(entry.__file__).parent.joinpath("signpost").rglob("*.py")
    source = "".join(p.read_text() for p in files if "llm" not in p.parts)
    assert "broadcast(" not in source and "crossJoin" not in source and "localCheckpoint" not in source
