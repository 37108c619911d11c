import json

import pytest
from fixtures import AS_OF, MANIFEST, ask, entries, raw
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from signpost.functions.jsons import strict_json
from signpost.operators.catalog import replace_source
from signpost.operators.reports import ingest_summary, name_digest
from signpost.plans.auto import auto
from signpost.plans.route import route
from signpost.sources import listings as LI
from signpost.sources import manifests as M
from signpost.sources import snapshot as SN


@pytest.mark.parametrize(
    "text, value",
    [
        ('{"a": 1}', '{"a":1}'), ("null", "null"), (" [1] ", "[1]"), ("5", "5"), ("", None), ('{"a":1}}', None),
        ("1] [2", None), ('1} {"x":2', None), ("1, 2", None), ('1,"b":2', None), ("{ invalid json }}}", None),
        ('{"a":1,"a":2}', None), (None, None),
    ],
)
def test_strict_json(spark, text, value):
    v = strict_json(F.lit(text).cast("string"))
    got = spark.range(1).select(F.when(F.is_variant_null(v), "null").otherwise(F.to_json(v))).first()[0]
    assert got == value


def files(spark, *documents):
    rows = [(f"/m/{i:02d}.json", d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(documents)]
    return spark.createDataFrame(rows, "path string, content string")


def tool(name="good_tool", description="A good tool", **more):
    return {"name": name, "description": description, **more}


def test_triage(spark):
    documents = [
        {"provider": "p", "tools": [tool(), tool("two")]},
        "{ invalid json }}}",
        "null",
        {"provider": "p", "tools": [tool(), None]},
        {"tools": []},
        {"provider": "x"},
        {"provider": "", "tools": [tool()]},
        {"provider": "p", "tools": {}},
        {"provider": "p", "tools": None},
        {"provider": "p", "tools": []},
        {"provider": "p", "tools": [{"name": "no_description"}, {"description": "no name"}, 5, "x"]},
        {"provider": "p", "tools": [tool(), {"name": "no_description"}, {"description": "no name"}]},
        "[]", "7",
    ]
    got = [(r.status, r.reason, r.entries) for r in M.triage_manifests(files(spark, *documents)).orderBy("path").collect()]
    assert got == [
        ("loaded", None, 2), ("failed", "broken_json", 0), ("failed", "null_document", 0), ("failed", "null_entry", 0),
        ("skipped", "invalid_manifest", 0), ("skipped", "invalid_manifest", 0), ("skipped", "invalid_manifest", 0),
        ("skipped", "invalid_manifest", 0), ("skipped", "invalid_manifest", 0), ("skipped", "no_valid_entries", 0),
        ("skipped", "no_valid_entries", 0), ("loaded", None, 1), ("skipped", "invalid_manifest", 0),
        ("skipped", "invalid_manifest", 0),
    ]


def test_directory_cases(spark, tmp_path):
    empty = entries(spark, []).limit(0)
    assert M.scan_manifests(spark, str(tmp_path / "missing")).count() == 0
    (tmp_path / "readme.md").write_text("no")
    assert M.scan_manifests(spark, str(tmp_path)).count() == 0
    valid = {"provider": "test-provider", "tools": [
        tool("test_tool_1"), tool("test_tool_2", category="web"), tool("test_tool_3", category="data")]}
    (tmp_path / "a.json").write_text(json.dumps(valid))
    (tmp_path / "b.json").write_text("{ invalid json }}}")
    (tmp_path / "c.json").write_text(json.dumps({"tools": []}))
    scanned = M.scan_manifests(spark, str(tmp_path))
    catalog, status = M.load_manifests(empty, scanned, AS_OF)
    assert {r.status: (r.units, r.entries) for r in ingest_summary(status).collect()} == {
        "loaded": (1, 3), "failed": (1, 0), "skipped": (1, 0)}
    again, _ = M.load_manifests(catalog, scanned, AS_OF)
    first, second = ([sorted(map(str, c.collect())) for c in (catalog, again)])
    assert first == second and len(first) == 3
    assert {(r.source, r.category) for r in catalog.collect()} == {
        ("provider:test-provider", c) for c in ("misc", "web", "data")}


def test_manifest_golden_ranking(spark):
    catalog, _ = M.load_manifests(entries(spark, []).limit(0), files(spark, MANIFEST), AS_OF)
    queries = ask(spark, "berth for a vessel", "tide and water", "storm wind", "pontoon slip", "diesel tank")
    outcomes = spark.createDataFrame([("moor_boat", True)], "name string, success boolean")
    done = auto(catalog, queries, outcomes, as_of=AS_OF)
    top = done.ranked.filter("rank = 1").orderBy("query_id").collect()
    assert [(r["name"], r.score, r.trigger, round(r.keyword, 6)) for r in top] == [
        ("moor_boat", 7.32, 3.0, 3.321917), ("tide_table", 7.91, 3.0, 3.906531), ("weather_brief", 9.42, 6.0, 2.419591),
        ("moor_boat", 4.32, 0.0, 3.321917), ("fuel_order", 7.37, 3.0, 3.366623)]
    assert {r.gate for r in done.gate.collect()} == {"execute"}
    status = {r.query_id: r.status for r in done.resolution.collect()}
    assert (status[0], status[1]) == ("success", "all_failed")
    row = catalog.filter("name = 'moor_boat'").first()
    assert row.category == "communication" and list(json.loads(row.input_schema)["properties"]) == ["arrival", "length", "vessel"]


def test_last_manifest_of_a_provider_wins_and_names_are_taken_over(spark):
    held = entries(spark, [{"name": "shared_one", "source": "local", "usage_count": 4}, {"name": "old_one", "source": "provider:p", "usage_count": 9}])
    two = files(spark, {"provider": "p", "tools": [tool("first_one"), tool("shared_one")]},
                {"provider": "p", "tools": [tool("shared_one"), tool("old_one"), tool("old_one", "Later text")]})
    catalog, _ = M.load_manifests(held, two, AS_OF)
    got = {r["name"]: (r.source, r.usage_count, r.description) for r in catalog.collect()}
    assert got == {"shared_one": ("provider:p", 4, "A good tool"), "old_one": ("provider:p", 0, "Later text")}
    kept, _ = M.load_manifests(held, two, AS_OF, preserve_all=True)
    assert {r["name"]: r.usage_count for r in kept.collect()} == {"shared_one": 4, "old_one": 9}


def test_explicit_triggers(spark):
    manifest = {"provider": "p", "tools": [tool("a_b", triggers=[]), tool("c_d", triggers=["x", "yy"]), tool("e_f")]}
    catalog, _ = M.load_manifests(entries(spark, []).limit(0), files(spark, manifest), AS_OF)
    assert {r["name"]: r.triggers for r in catalog.collect()} == {
        "a_b": [], "c_d": ["x", "yy"], "e_f": ["e_f"]}


def test_listings(spark):
    rows = [("gh", "create_issue", "Create an issue", None), ("gh", "readFile", None, '{"path":{}}')]
    listings = spark.createDataFrame(rows, "server string, tool_name string, description string, input_schema string")
    before = entries(spark, [{"name": "mcp__gh__gone", "source": "mcp:gh"}, {"name": "mcp__other__x", "source": "mcp:other"}])
    after = {r["name"]: r for r in LI.ingest_listings(before, listings, AS_OF).collect()}
    assert sorted(after) == ["mcp__gh__create_issue", "mcp__gh__readFile", "mcp__other__x"]
    row = after["mcp__gh__create_issue"]
    assert (row.category, row.provider, row.tags) == ("mcp", "gh", ["mcp", "gh", "create_issue"])
    assert row.boost_keywords == "create issue"
    assert row.triggers == ["mcp__gh__create_issue", "mcp", "gh", "create", "issue", "create_issue"]
    assert after["mcp__gh__readFile"].boost_keywords == "read file"


def test_bulk(spark):
    rows = raw(spark, [
        {"name": "a_b", "source": "s", "triggers": ["zz"], "boost_keywords": "kw", "description": "First words"},
        {"name": ""}, {}, {"name": "c_d", "provider": "own"}])
    catalog, counts = LI.ingest_bulk(entries(spark, []).limit(0), rows, provider="given", as_of=AS_OF)
    assert counts.first().asDict() == {"registered": 2, "skipped": 2}
    got = {r["name"]: (r.source, r.provider, r.triggers, r.boost_keywords) for r in catalog.collect()}
    assert got == {"a_b": ("s", "given", ["a_b", "first"], ""), "c_d": ("local", "own", ["c_d"], "")}


def test_second_writer_of_a_version_fails(spark, tmp_path):
    path = str(tmp_path / "table")
    SN.write_snapshot(spark.range(3), path)
    stale = SN.current_version(spark, path)
    SN.write_snapshot(spark.range(5), path)
    with pytest.MonkeyPatch.context() as m, pytest.raises(AnalysisException):
        m.setattr(SN, "current_version", lambda *_: stale)
        SN.write_snapshot(spark.range(7), path)
    assert SN.read_snapshot(spark, path).count() == 5
    assert SN.read_snapshot(spark, path, 1).count() == 3


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "catalog")
    assert SN.read_catalog(spark, path).count() == 0 and SN.current_version(spark, path) == 0
    one = entries(spark, [{"name": "a"}, {"name": "b", "source": "s"}])
    assert SN.write_catalog(one, path, "first") == 1
    current = SN.read_catalog(spark, path)
    assert SN.write_catalog(replace_source(current, raw(spark, [{"name": "c", "source": "s"}]), AS_OF), path) == 2
    assert sorted(r["name"] for r in SN.read_catalog(spark, path).collect()) == ["a", "c"]
    assert sorted(r["name"] for r in SN.read_catalog(spark, path, 1).collect()) == ["a", "b"]
    assert SN.is_committed(spark, path, "first") and not SN.is_committed(spark, path, "second")


def test_evolve_and_decode(spark):
    old = spark.createDataFrame([("a", "", "legacy"), ("b", "p", "legacy")], "name string, provider string, plugin_name string")
    got = {r["name"]: r for r in SN.evolve_schema(old).collect()}
    assert (got["a"].provider, got["b"].provider) == ("legacy", "p")
    assert (got["a"].usage_count, got["a"].success_rate, got["a"].tags, got["a"].source) == (0, 1.0, [], "unknown")
    text = spark.createDataFrame(
        [("a", '["x"]', "{bad", '{"k":1}', "[0.5,1]", "2024-01-01T00:00:00Z"), ("b", None, "", "nope", "[]", None)],
        "name string, tags string, triggers string, input_schema string, embedding string, last_used_at string",
    )
    got = {r["name"]: r for r in SN.decode_rows(text).collect()}
    assert (got["a"].tags, got["a"].triggers, got["a"].input_schema, got["a"].embedding) == (["x"], [], '{"k":1}', [0.5, 1.0])
    assert got["a"].last_used_at.year == 2024
    assert (got["b"].tags, got["b"].input_schema, got["b"].embedding, got["b"].category) == ([], None, [], "misc")


def test_name_digest(spark):
    rows = spark.createDataFrame([("s", f"t{i:02d}") for i in range(12)] + [("q", "only")], "server string, name string")
    got = {r.server: (r.entries, r.names) for r in name_digest(rows, "server").collect()}
    assert got["q"] == (1, "only")
    assert got["s"] == (12, ", ".join(f"t{i:02d}" for i in range(10)) + " ... +2 more")


def test_route_after_reload_is_the_same(spark):
    empty = entries(spark, []).limit(0)
    once, _ = M.load_manifests(empty, files(spark, MANIFEST), AS_OF)
    twice, _ = M.load_manifests(once, files(spark, MANIFEST), AS_OF)
    ranks = [
        [(r["name"], r.score) for r in route(c, ask(spark, "tide and water"), as_of=AS_OF).orderBy("rank").collect()]
        for c in (once, twice)
    ]
    assert ranks[0] == ranks[1]


def test_manifest_folder_is_written_by_many_tasks(spark, tmp_path):
    from pathlib import Path

    from workload.ingestion import supplier_directory

    suppliers = spark.range(50).selectExpr("id AS s_suppkey", "concat('maker ', id) AS s_name")
    suppliers.coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    folder = supplier_directory(spark, str(tmp_path)).removeprefix("file:")
    files = [f.name for f in Path(folder).glob("*.json")]
    assert len(files) == 50 and len({f.split("-")[1] for f in files}) > 1


def test_staged_entries_are_few_files(spark, tmp_path):
    text = '{"provider": "p%d", "tools": [{"name": "n%d", "description": "d"}]}'
    rows = [(f"/{i:03d}", text % (i, i)) for i in range(60)]
    files = spark.createDataFrame(rows, M.FILES).repartition(30)
    staged = M.stage_entries(files, str(tmp_path / "staged"))
    assert {r.name for r in staged.collect()} == {f"n{i}" for i in range(60)}
    assert len(staged.inputFiles()) <= 4
