"""Indexes bound to catalog versions, and vectors filled and counted in one pass."""

import pandas as pd
import pytest
from fixtures import AS_OF, FIVE, SIXTH, ask, entries, raw

from signpost.operators.catalog import embedding_report, fill_embeddings, fill_embeddings_observed, upsert_catalog
from signpost.plans.route import route
from signpost.plans.versions import StaleIndexError, read_bound, write_indexes
from signpost.sources.snapshot import read_catalog, write_catalog
from signpost.streaming import stream_route

COLUMNS = ["query_id", "rank", "name", "score"]


def rows(df):
    return sorted(map(tuple, df.select(COLUMNS).collect()))


def test_a_stale_index_is_refused(spark, tmp_path):
    path, queries = f"{tmp_path}/catalog", ask(spark, "prune roses", "moonlight chamomile")
    write_catalog(entries(spark, FIVE), path)
    with pytest.raises(StaleIndexError):
        read_bound(spark, path)
    bound = write_indexes(spark, path, vectors=False)
    expected = rows(route(entries(spark, FIVE), queries, as_of=AS_OF))
    assert rows(route(bound.catalog, queries, text_index=bound.text_index, as_of=AS_OF)) == expected
    write_catalog(upsert_catalog(read_catalog(spark, path), raw(spark, [SIXTH]), AS_OF), path)
    with pytest.raises(StaleIndexError):
        read_bound(spark, path)
    after = write_indexes(spark, path, vectors=False)
    assert after.version > bound.version
    got = rows(route(after.catalog, queries, text_index=after.text_index, as_of=AS_OF))
    assert ("brew_night_tea" in {r[2] for r in got}) and len(got) > len(expected)


def test_a_stream_routes_by_bound_indexes(spark, tmp_path):
    path, queries = f"{tmp_path}/catalog", ask(spark, "prune roses", "soil acidity survey")
    write_catalog(entries(spark, FIVE), path)
    write_indexes(spark, path, vectors=False)
    queries.write.parquet(f"{tmp_path}/queries")
    source = spark.readStream.schema(queries.schema).parquet(f"{tmp_path}/queries")
    stream_route(source, lambda: read_bound(spark, path), f"{tmp_path}/out", f"{tmp_path}/cp", None, as_of=AS_OF).awaitTermination()
    assert rows(spark.read.parquet(f"{tmp_path}/out")) == rows(route(entries(spark, FIVE), queries, as_of=AS_OF))


def test_each_text_is_embedded_once_for_data_and_report(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def embed(batches):
        for b in batches:
            calls.add(len(b))
            yield pd.DataFrame({"name": b["name"], "embedding": [[1.0, 2.0] if len(n) % 2 else [] for n in b["name"]]})

    catalog = entries(spark, FIVE)
    filled, seen = fill_embeddings_observed(catalog, embed)
    filled.write.parquet(f"{tmp_path}/filled")
    assert calls.value == len(FIVE)
    report = embedding_report(catalog, embed).first().asDict()
    assert seen.get == report and report["embedded"] + report["failed"] == len(FIVE)
    same = lambda df: sorted((r["name"], r.embedding) for r in df.collect() if r.embedding)
    assert same(spark.read.parquet(f"{tmp_path}/filled")) == same(fill_embeddings(catalog, embed))
