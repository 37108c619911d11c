"""Limits that callers set, names that repeat, and text that is no number."""

from pyspark.sql import functions as F

from signpost.operators import catalog as C
from signpost.operators import rank as R
from signpost.sources import manifests as M
from signpost.sources.snapshot import decode_rows


def empty_catalog(spark):
    return C.with_catalog_fields(spark.range(0).select(F.lit("x").alias("name")))


def test_more_than_twenty_results(spark):
    scored = spark.range(50).select(F.lit("q").alias("query_id"), F.format_string("n%02d", "id").alias("name"), F.col("id").cast("double").alias("score"))
    assert R.rank_top_k(scored, 50).count() == 50


def test_whole_text_reaches_the_embedder(spark):
    rows = spark.createDataFrame([("a_b", "word " * 1000)], "name string, search_text string")
    catalog = C.with_catalog_fields(rows)

    def lengths(batches):
        for b in batches:
            b["embedding"] = [[float(len(t))] for t in b["search_text"]]
            yield b[["name", "embedding"]]

    assert C.embed_missing(catalog, lengths).first().embedding[0] > 4000


def test_repeated_names_without_order(spark):
    old = spark.createDataFrame([("a_b", "old")], "name string, description string")
    catalog = C.upsert_catalog(empty_catalog(spark), old)
    batch = spark.createDataFrame([("a_b", "one"), ("a_b", "two"), ("c_d", "one"), ("c_d", "one"), (None, "x")], "name string, description string")
    rows = {r.name: r.description for r in C.upsert_catalog(catalog, batch).collect()}
    assert C.upsert_catalog(catalog, batch).count() == len(rows) == 3
    # the last in the order of the rows' JSON
    assert rows["a_b"] == "two"


def test_text_that_is_no_number(spark):
    rows = spark.createDataFrame([("a", "", "x", "7")], "name string, usage_count string, success_rate string, consecutive_failures string")
    r = decode_rows(rows).first()
    assert (r.usage_count, r.success_rate, r.consecutive_failures) == (0, 1.0, 7)


def test_truthy_members(spark):
    provider = ['"false"', '"0"', "0", "false", '""', "null", "5"]
    files = [(f"/{i}", f'{{"provider": {p}, "tools": [{{"name": "n", "description": "d"}}]}}') for i, p in enumerate(provider)]
    status = {r.path: r.status for r in M.triage_manifests(spark.createDataFrame(files, "path string, content string")).collect()}
    assert [status[f"/{i}"] for i in range(7)] == ["loaded", "loaded", "skipped", "skipped", "skipped", "skipped", "loaded"]
