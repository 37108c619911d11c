from collections import Counter

import pytest
from fixtures import AS_OF, FIVE, SIXTH, ask, entries, raw
from pyspark.sql import functions as F

from signpost.operators import lexical as L
from signpost.operators import rank as R
from signpost.operators import vectors as V
from signpost.operators.catalog import upsert_catalog
from signpost.plans.indexes import write_text_index, write_vector_index
from signpost.plans.route import route

QUERIES = ["prune roses", "soil acidity survey", "plot tray", "water raised beds", "xyzzy foobar", "moonlight chamomile"]


def results(df):
    return [
        (r.query_id, r["name"], r.score, r.trigger, round(r.keyword, 6))
        for r in df.orderBy("query_id", "rank").collect()
    ]


def test_five_entries(spark):
    catalog = entries(spark, FIVE)
    assert results(route(catalog, ask(spark, *QUERIES), as_of=AS_OF)) == [
        (0, "prune_roses", 8.15, 3.0, 4.145095),
        (1, "soil_survey", 11.77, 6.0, 4.772085),
        (1, "sow_seeds", 1.86, 0.0, 0.861511),
        (2, "soil_survey", 2.68, 0.0, 1.677292),
        (2, "sow_seeds", 2.36, 0.0, 1.364192),
        (3, "water_beds", 6.65, 0.0, 5.647846),
    ]


def test_corpus_figures_follow_the_catalog(spark):
    catalog = entries(spark, FIVE)
    stats = L.text_index_stats(L.build_text_index(catalog)).first()
    assert (stats.terms, stats.avg_doc_len) == (69, 20.2)
    more = upsert_catalog(catalog, raw(spark, [SIXTH]), AS_OF)
    stats = L.text_index_stats(L.build_text_index(more)).first()
    assert (stats.terms, stats.avg_doc_len) == (81, 20.8)
    assert results(route(more, ask(spark, "moonlight chamomile", "sow at night"), as_of=AS_OF)) == [
        (0, "brew_night_tea", 3.9, 0.0, 2.90053),
        (1, "brew_night_tea", 6.54, 3.0, 2.540083),
        (1, "sow_seeds", 6.42, 3.0, 2.416557),
        (1, "water_beds", 4.0, 3.0, 0.0),
    ]


def test_stored_index_gives_the_same(spark, tmp_path):
    catalog, queries = entries(spark, FIVE), ask(spark, *QUERIES)
    index = write_text_index(catalog, str(tmp_path / "text"))
    assert results(route(catalog, queries, as_of=AS_OF, text_index=index)) == results(route(catalog, queries, as_of=AS_OF))


def test_empty_catalog(spark):
    catalog = entries(spark, FIVE).limit(0)
    assert route(catalog, ask(spark, *QUERIES), as_of=AS_OF).count() == 0
    stats = L.text_index_stats(L.build_text_index(catalog)).first()
    assert (stats.terms, stats.avg_doc_len) == (0, 0.0)


def test_score_with_usage(spark):
    entry = {"name": "x_y", "source": "s", "usage_count": 7, "success_rate": 0.9}
    catalog = entries(spark, [entry]).withColumn("last_used_at", AS_OF - F.expr("interval 30 days"))
    stages = spark.createDataFrame([(1, "x_y", 3.0, 1.0, 0.0)], "query_id int, name string, trigger double, keyword double, semantic double")
    row = R.fuse_scores(stages, catalog, AS_OF, weights={"s": 1.2}).first()
    assert (row.score, row.usage, row.success, row.recency) == (6.54, 0.55, 0.9, 0.368)


def test_threshold_uses_the_unrounded_score(spark):
    catalog = entries(spark, [{"name": "a", "success_rate": 0.0}])
    frame = "query_id int, name string, trigger double, keyword double, semantic double"
    low = spark.createDataFrame([(1, "a", 0.0, 0.0999, 0.0)], frame)
    assert R.fuse_scores(low, catalog, AS_OF).count() == 0
    assert R.fuse_scores(low, catalog, AS_OF, threshold=0.05).first().score == 0.1


def test_repeated_query_words_count(spark):
    catalog = entries(spark, FIVE)
    once = L.trigger_match(catalog, ask(spark, "bees")).first()
    twice = L.trigger_match(catalog, ask(spark, "bees bees")).first()
    assert (once.score, twice.score) == (3.0, 6.0)


def test_trigger_blocking_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    catalog = docs.select(
        F.concat(F.lit("d_"), "doc_id").alias("name"), F.slice(F.split(F.col("text"), r"\s+"), 1, 12).alias("triggers")
    )
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    queries = bench.select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    got = {(r.query_id, r["name"]): r.hits for r in L.trigger_match(catalog, queries).collect()}
    expected = {}
    for q in queries.collect():
        asked = [w for w in q.query_text.lower().split() if len(w) > 1]
        for c in catalog.collect():
            hits = sum(any(w in t for t in c.triggers) for w in asked)
            if hits:
                expected[q.query_id, c["name"]] = hits
    assert got == expected


def test_grams_follow_distinct_triggers(spark):
    one = entries(spark, [{"name": "a", "triggers": ["prune", "soil bed"]}])
    many = one.select("triggers").crossJoin(spark.range(50)).select(F.concat(F.lit("e"), "id").alias("name"), "triggers")
    grams = [L.trigger_grams(L.trigger_owners(c)).count() for c in (one, many)]
    assert grams[0] == grams[1] > 0
    assert L.trigger_match(many, ask(spark, "prune soil")).filter("hits = 2").count() == 50


def test_top_k_is_a_prefix_of_the_next(spark):
    catalog, queries = entries(spark, FIVE), ask(spark, "soil garden", "garden")
    one, two = [
        {(r.query_id, r["rank"]): r["name"] for r in route(catalog, queries, top_k=k, as_of=AS_OF).collect()} for k in (1, 2)
    ]
    assert one.items() <= two.items() and len(two) > len(one)


def test_top_k_defaults_and_cap():
    assert [R.effective_top_k(k) for k in (0, None, 3, 50)] == [5, 5, 3, 50]


def test_explorer_never_displaces(spark):
    catalog = entries(spark, FIVE + [{"name": "idle_one", "description": "zzz"}])
    catalog = catalog.withColumn("usage_count", F.when(F.col("name") == "idle_one", 0).otherwise(3).cast("long"))
    queries = ask(spark, "soil garden", "irrigate")
    plain = route(catalog, queries, as_of=AS_OF)
    with_slot = route(catalog, queries, as_of=AS_OF, explorer_seed="s", explorer_percent=100)
    assert results(with_slot.filter("not explorer")) == results(plain)
    slots = with_slot.filter("explorer").collect()
    assert [(r.query_id, r["name"], r.score, r["rank"]) for r in slots] == [(0, "idle_one", 0.0, 6)]
    assert route(catalog, queries, as_of=AS_OF, explorer_seed="s", explorer_percent=0).filter("explorer").count() == 0


def test_no_match_report(spark):
    catalog, queries = entries(spark, FIVE), ask(spark, *QUERIES)
    missing = R.no_match_report(queries, route(catalog, queries, as_of=AS_OF), catalog).collect()
    assert sorted((r.query_id, r.catalog_size) for r in missing) == [(4, 5), (5, 5)]
    counted = R.no_match_report(queries, route(catalog, queries, as_of=AS_OF), catalog, categories=True).collect()
    of = Counter(r["category"] for r in catalog.collect())
    expected = sorted(of.items(), key=lambda x: (-x[1], x[0]))
    assert [[tuple(c) for c in r.category_counts] for r in counted] == [expected, expected]


VECTORS = [("a1", "A", [1.0, 0.0]), ("a2", "A", [0.8, 0.6]), ("b1", "B", [0.0, 1.0])]


def vector_catalog(spark, rows=VECTORS):
    return spark.createDataFrame(rows, "name string, category string, embedding array<float>")


def vector_query(spark, *vectors):
    return spark.createDataFrame(list(enumerate(vectors)), "query_id long, embedding array<float>")


def found(df):
    return [(r["name"], round(r.cosine, 6)) for r in df.orderBy("query_id", "rank").collect()]


def test_centroid_search(spark):
    index = V.build_vector_index(vector_catalog(spark))
    query = vector_query(spark, [1.0, 0.0])
    centroids = {r.category: [round(x, 6) for x in r.centroid] for r in index.centroids.collect()}
    assert centroids == {"A": [0.9, 0.3], "B": [0.0, 1.0]}
    best = {r.category: round(r.cosine, 6) for r in V.nearest_categories(index, query).collect()}
    assert best == {"A": 0.948683, "B": 0.0}
    assert found(V.centroid_search(index, query)) == [("a1", 1.0), ("a2", 0.8), ("b1", 0.0)]
    assert found(V.centroid_search(index, query, top_categories=1)) == [("a1", 1.0), ("a2", 0.8)]
    stage = {r["name"]: round(r.score, 6) for r in V.semantic_stage(index, query).collect()}
    assert stage == {"a1": 2.0, "a2": 1.6, "b1": 0.0}


def test_vector_index_cleans_its_input(spark):
    rows = VECTORS + [("c1", "", [1.0]), ("c2", None, [1.0, float("nan"), 5.0]), ("c3", "C", []), ("c4", "C", None)]
    index = V.build_vector_index(vector_catalog(spark, rows))
    vectors = {r["name"]: (r.category, list(r.vec)) for r in index.vectors.collect()}
    assert vectors["c1"] == ("misc", [1.0, 0.0]) and vectors["c2"] == ("misc", [1.0, 0.0]) and len(vectors) == 5
    stats = V.vector_index_stats(index).first()
    assert (stats.entries, stats.dimension, stats.categories, stats.memory_kb) == (5, 2, 3, 0)


def test_vector_search_without_a_match(spark):
    index = V.build_vector_index(vector_catalog(spark))
    assert V.centroid_search(index, vector_query(spark, [1.0])).count() == 0
    empty = V.build_vector_index(vector_catalog(spark).limit(0))
    assert V.centroid_search(empty, vector_query(spark, [1.0, 0.0])).count() == 0
    stats = V.vector_index_stats(empty).first()
    assert (stats.entries, stats.dimension, stats.categories) == (0, 0, 0)


def test_blocked_search_equals_exact(spark, sf_dir, monkeypatch, tmp_path):
    monkeypatch.setattr(V, "ROWS_PER_BLOCK", 40)
    monkeypatch.setattr(V, "QUERIES_PER_BLOCK", 200)
    monkeypatch.setattr(V, "CELLS_AT_ONCE", 2000)
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    catalog = rows.select(
        F.col("vec_id").cast("string").alias("name"), (F.col("label") % 4).cast("string").alias("category"), "embedding"
    )
    queries = rows.select(F.col("vec_id").alias("query_id"), "embedding")
    index = write_vector_index(catalog, str(tmp_path / "vectors"))
    got = V.centroid_search(index, queries, top_k=5).toPandas().sort_values(["query_id", "rank"])
    import numpy as np

    pdf = rows.toPandas().sort_values("vec_id")
    m = np.vstack(pdf.embedding).astype(float)
    m /= np.linalg.norm(m, axis=1)[:, None]
    cos = np.round(m @ m.T, 12)
    names = pdf.vec_id.astype(str).to_numpy()
    for i, query in enumerate(pdf.vec_id):
        order = np.lexsort((names, -cos[i]))[:5]
        assert list(got[got.query_id == query]["name"]) == list(names[order])


@pytest.mark.parametrize("few", [1000, 0])
def test_chosen_categories_prune_the_stored_vectors(spark, monkeypatch, tmp_path, few):
    monkeypatch.setattr(V, "FEW_CATEGORIES", few)
    index = write_vector_index(vector_catalog(spark), str(tmp_path / "vectors"))
    query = vector_query(spark, [1.0, 0.0])
    chosen = V.chosen_categories(index, query, 1)
    read = V.vectors_of(index, chosen)
    assert {r["name"] for r in read.collect()} == {"a1", "a2"}
    if few:
        assert "(category#" in read._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert found(V.centroid_search(index, query, top_categories=1)) == [("a1", 1.0), ("a2", 0.8)]


def test_route_with_vectors(spark):
    catalog = entries(spark, [{"name": n, "category": c, "embedding": v} for n, c, v in VECTORS])
    queries = spark.createDataFrame(
        [(0, "nothing here", [1.0, 0.0]), (1, "nothing here", None)], "query_id long, query_text string, embedding array<float>"
    )
    ranked = route(catalog, queries, as_of=AS_OF, vector_index=V.build_vector_index(catalog))
    got = [(r.query_id, r["name"], r.score, round(r.semantic, 6)) for r in ranked.orderBy("query_id", "rank").collect()]
    assert got == [(0, "a1", 3.0, 2.0), (0, "a2", 2.6, 1.6), (0, "b1", 1.0, 0.0)]


def test_source_weights_scale_the_score(spark):
    catalog = entries(spark, [{**e, "source": "local"} for e in FIVE])
    plain = route(catalog, ask(spark, "prune roses"), as_of=AS_OF).first().score
    scaled = route(catalog, ask(spark, "prune roses"), as_of=AS_OF, weights={"local": 0.8}).first().score
    assert scaled == pytest.approx(plain * 0.8, abs=0.011)


def test_stored_postings_of_a_name_lie_together(spark, tmp_path):
    rows = [{"name": f"n{i % 20}", "description": "one two two three", "triggers": []} for i in range(40)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = write_text_index(entries(spark, rows), str(tmp_path / "together"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = index.postings.select("name", F.input_file_name().alias("file")).distinct()
    assert files.count() == 20
    assert {r.tf for r in index.postings.filter("term = 'two'").collect()} == {4}
    assert index.terms.filter("term = 'two'").first().df == 20
