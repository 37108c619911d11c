import pandas as pd
import pytest
from fixtures import AS_OF, entries, raw
from pyspark.sql import functions as F

from signpost.operators import catalog as C
from signpost.operators import quality as Q
from signpost.operators import reports as G

LONG = "A description that is long enough"


def codes(spark, judged, key="name"):
    return {r[key]: [i.code for i in r.issues] for r in judged.collect()}


@pytest.mark.parametrize(
    "name, expected",
    [
        ("read_pdf", []), ("readPdf", ["name_format"]), ("pdf", ["name_format"]), ("read_pdf\n", ["name_format"]),
        ("", ["name_required"]), (None, ["name_required"]), (" \t", ["name_required"]), ("a_b0_c", []), ("a_0b", ["name_format"]),
    ],
)
def test_check_name(spark, name, expected):
    got = spark.range(1).select(Q.gather(Q.check_name(F.lit(name).cast("string"))).alias("i")).first().i
    assert [i.code for i in got] == expected


def test_validate_new(spark):
    catalog = entries(spark, [{"name": "old_one"}])
    batch = raw(spark, [
        {"seq": 1, "name": "good_one", "description": LONG, "tags": ["t"], "category": "web"},
        {"seq": 2, "name": "good_two", "description": LONG},
        {"seq": 3, "name": "old_one", "description": LONG, "tags": ["t"]},
        {"seq": 4, "name": "Bad", "description": " short \n", "category": "nope", "tags": []},
        {"seq": 5, "name": "late_one", "description": "x", "tags": ["t"]},
        {"seq": 6, "name": "late_one", "description": LONG, "tags": ["t"]},
        {"seq": 7, "name": "late_one", "description": LONG, "tags": ["t"]},
    ])
    judged = Q.validate_new(batch, catalog).cache()
    assert codes(spark, judged, "seq") == {
        1: [], 2: ["tags_missing"], 3: ["name_taken"],
        4: ["name_format", "description_short", "category_unknown", "tags_missing"],
        5: ["description_short"], 6: [], 7: ["name_taken"],
    }
    assert {r.seq for r in judged.filter("valid").collect()} == {1, 2, 6}
    report = {(r.code, r.severity): r.rows for r in Q.issue_report(judged).collect()}
    assert report["name_taken", "error"] == 2 and report["tags_missing", "warning"] == 2
    made, _ = C.create_entries(catalog, batch, AS_OF)
    got = {r["name"]: (r.source, r.triggers) for r in made.collect()}
    assert got["good_two"] == ("local", ["good_two", "good", "two"]) and len(got) == 4


def test_update(spark):
    start = raw(spark, [
        {"name": "read_it", "description": LONG, "source": "s", "triggers": ["custom"], "boost_keywords": "kw", "usage_count": 5},
        {"name": "mcp__x__y", "description": LONG},
    ])
    from signpost.operators.entries import normalize_entries

    catalog = normalize_entries(start, AS_OF)
    updates = raw(spark, [
        {"seq": 1, "name": "read_it", "description": "Twelve chars"},
        {"seq": 2, "name": "read_it", "category": "web"},
        {"seq": 3, "name": "read_it", "description": "tiny"},
        {"seq": 4, "tool": "mcp__x__y", "tags": ["tag"]},
        {"seq": 5, "name": "no_such"},
        {"seq": 6, "name": "mcp__x__y", "category": "data"},
    ])
    after, judged = C.update_entries(catalog, updates, AS_OF)
    assert codes(spark, judged, "seq") == {
        1: ["description_shrunk"], 2: [], 3: ["description_short", "description_shrunk"], 4: [], 6: ["name_format"]}
    got = {r["name"]: r for r in after.collect()}
    row = got["read_it"]
    assert (row.description, row.category, row.source, row.usage_count) == ("Twelve chars", "web", "s", 5)
    assert row.triggers == ["read_it", "read", "it", "twelve"] and row.boost_keywords == ""
    assert got["mcp__x__y"].tags == ["tag"] and got["mcp__x__y"].category == "misc"
    assert [r["name"] for r in C.missing_updates(catalog, updates).collect()] == ["no_such"]
    kept, _ = C.update_entries(catalog, updates, AS_OF, preserve_all=True)
    row = kept.filter("name = 'read_it'").first()
    assert (row.triggers, row.boost_keywords) == (["custom"], "kw")


def test_upsert_keeps_what_was_learned(spark):
    catalog = entries(spark, [
        {"name": "a", "usage_count": 7, "success_rate": 0.25, "embedding": [1.0, 2.0]},
        {"name": "b", "usage_count": 0, "success_rate": 0.5},
        {"name": "untouched"},
    ]).withColumns({
        "consecutive_failures": F.lit(3).cast("long"), "last_used_at": AS_OF, "registered_at": F.lit("2020-01-01").cast("timestamp"),
    })
    batch = raw(spark, [
        {"seq": 1, "name": "a", "description": "first"}, {"seq": 2, "name": "a", "description": "second", "success_rate": 0.9},
        {"seq": 3, "name": "b", "usage_count": 4, "embedding": [3.0]}, {"seq": 4, "name": "new"},
    ])
    got = {r["name"]: r for r in C.upsert_catalog(catalog, batch, AS_OF).collect()}
    a, b = got["a"], got["b"]
    assert (a.description, a.usage_count, a.success_rate, list(a.embedding)) == ("second", 7, 0.25, [1.0, 2.0])
    assert (a.consecutive_failures, a.last_used_at, a.registered_at.year) == (0, None, 2020)
    assert (b.usage_count, b.success_rate, list(b.embedding)) == (4, 0.5, [3.0])
    assert got["untouched"].consecutive_failures == 3 and got["new"].registered_at.year == 2024
    kept = {r["name"]: r for r in C.upsert_catalog(catalog, batch, AS_OF, preserve_all=True).collect()}
    assert (kept["a"].consecutive_failures, kept["a"].last_used_at is None) == (3, False)
    once = C.upsert_catalog(catalog, batch, AS_OF)
    twice = C.upsert_catalog(once, batch, AS_OF)
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))


def test_rows_that_repeat_a_name(spark):
    rows = [("a", 9, {"k": 1}, ["x"]), ("a", 10, None, ["x"]), ("a", 10, {"k": 2}, ["x"]), ("b", None, None, None), ("b", None, None, [])]
    batch = spark.createDataFrame(rows, "name string, size int, extra map<string,int>, tags array<string>")
    for given in (batch, batch.orderBy(F.desc("size"), F.desc("tags")), batch.unionAll(batch)):
        kept = {r["name"]: (r["size"], r.extra, r.tags) for r in C.dedupe_batch(given).collect()}
        assert kept == {"a": (10, {"k": 2}, ["x"]), "b": (None, None, [])}
    first = batch.withColumn("seq", F.when(F.col("size") == 9, 2).otherwise(1))
    assert {r["size"] for r in C.dedupe_batch(first).where("name = 'a'").collect()} == {9}


def test_deletes(spark):
    catalog = entries(spark, [{"name": n, "source": s, "provider": p} for n, s, p in (("a", "s", "p"), ("b", "s", "q"), ("c", "t", "p"))])

    def left(df):
        return sorted(r["name"] for r in df.collect())

    assert left(C.purge_source(catalog, "s")) == ["c"]
    assert C.deletion_report(catalog, "source", "s").first()["deleted"] == catalog.count() - 1
    assert tuple(C.deletion_report(catalog, "source", "nowhere").first()) == ("nowhere", 0, False)
    assert left(C.delete_provider(catalog, "p")) == ["b"]
    names = spark.createDataFrame([("a",), ("zz",), ("zz",)], "name string")
    assert left(C.delete_names(catalog, names)) == ["b", "c"]
    assert left(C.missing_names(catalog, names)) == ["zz"]
    replaced = C.replace_source(catalog, raw(spark, [{"name": "d", "source": "s"}]), AS_OF)
    assert left(replaced) == ["c", "d"]


def test_fill_embeddings(spark):
    def embed(batches):
        for batch in batches:
            vectors = [[] if "fail" in t else [float(len(t))] for t in batch["search_text"]]
            yield pd.DataFrame({"name": batch["name"], "embedding": vectors})

    catalog = entries(spark, [{"name": "has", "embedding": [9.0]}, {"name": "lacks"}, {"name": "will_fail"}])
    got = {r["name"]: r.embedding for r in C.fill_embeddings(catalog, embed).collect()}
    size = len(catalog.filter("name = 'lacks'").first().search_text)
    assert got == {"has": [9.0], "lacks": [float(size)], "will_fail": None}
    assert C.embedding_report(catalog, embed).first().asDict() == {"embedded": 1, "skipped": 1, "failed": 1}


def test_reports(spark):
    catalog = entries(spark, [
        {"name": f"n{i:02d}", "source": "s" if i % 3 else "t", "category": "web", "usage_count": i, "success_rate": 0.505,
         "embedding": [] if i == 0 else None} for i in range(12)])
    assert [(r.source, r.entries) for r in G.counts_by_source(catalog).collect()] == [("s", 8), ("t", 4)]
    assert G.embedding_coverage(catalog).first().asDict() == {"total": 12, "with_embedding": 1, "percent": 8}
    assert G.embedding_coverage(catalog.limit(0)).first().percent == 0
    top = G.top_used(catalog).collect()
    assert len(top) == 10 and (top[0]["name"], top[0].usage_count, top[0].success_percent) == ("n11", 11, 51)
    assert G.recently_used(catalog).count() == 0 and G.unstable_entries(catalog).count() == 0
