import math

import pytest
from pyspark.sql import functions as F

from signpost import functions as X
from signpost.functions.text import grams


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def s(v):
    return F.lit(v)


def words(*v):
    return F.array(*[F.lit(x) for x in v])


@pytest.mark.parametrize(
    "name, description, tags, expected",
    [
        ("mcp__github__create_issue", "Create an issue", ["mcp", "github", "create_issue"],
         ["mcp__github__create_issue", "mcp", "github", "create", "issue", "create_issue"]),
        ("new_unique_tool", "A completely unique tool", ["unique"], ["new_unique_tool", "new", "unique", "tool"]),
        ("Read.It", "  Opens it", ["io", "Disk"], ["Read.It", "Read", "It", "opens", "Disk"]),
    ],
)
def test_extract_triggers(spark, name, description, tags, expected):
    assert one(spark, X.extract_triggers(s(name), s(description), words(*tags))) == expected


def test_extract_triggers_of_missing_parts(spark):
    null = F.lit(None).cast("string")
    assert one(spark, X.extract_triggers(s("solo"), null, F.lit(None).cast("array<string>"))) == ["solo"]
    assert one(spark, X.extract_triggers(s(""), s(""), F.lit(None).cast("array<string>"))) == []


@pytest.mark.parametrize(
    "name, category",
    [
        ("take_screenshot", "capture"), ("extract_table_data", "web"), ("send_email", "ai"), ("read_file", "file"),
        ("compile_code", "dev"), ("web_search", "ai"), ("navigate_url", "web"), ("scrape_site", "data"),
        ("git_commit", "misc"),
    ],
)
def test_infer_category(spark, name, category):
    assert one(spark, X.infer_category(s(name))) == category


def test_infer_category_of_a_listing(spark):
    assert one(spark, X.infer_category(s("git_commit"), "mcp")) == "mcp"


def test_boost_keywords(spark):
    got = one(spark, X.boost_keywords(s("createIssue_v2"), s("Creates a new issue in a repository. Needs auth!")))
    assert got == "create issue creates repository"
    assert one(spark, X.boost_keywords(s("get-file.contents"), s(""))) == "get file contents"


def test_tokens(spark):
    text = s("To the File-System, a/b x_yz.. go")
    assert one(spark, X.doc_tokens(text)) == ["to", "the", "file", "system,", "yz", "go"]
    assert one(spark, X.query_terms(text)) == ["the", "file", "system,"]
    assert one(spark, X.query_words(text)) == ["to", "the", "file-system,", "a/b", "x_yz..", "go"]


def test_schema_arg_keys(spark):
    full = '{"type":"object","properties":{"to":{},"subject":{},"body":{}}}'
    assert one(spark, X.schema_arg_keys(s(full))) == ["to", "subject", "body"]
    assert one(spark, X.schema_arg_keys(s('{"a":1,"b":2}'))) == ["a", "b"]
    assert one(spark, X.schema_arg_keys(F.lit(None).cast("string"))) is None


def test_truncate(spark):
    assert one(spark, X.truncate_text(s("abcdef"), 4, "..")) == "abcd.."
    assert one(spark, X.truncate_text(s("abcd"), 4, "..")) == "abcd"


def test_round_half_up(spark):
    assert one(spark, X.round_half_up(s(-0.125), 2)) == -0.12
    assert one(spark, X.round_half_up(s(0.125), 2)) == 0.13


def test_cosine(spark):
    def v(*x):
        return F.array(*[F.lit(float(i)) for i in x])

    assert one(spark, X.cosine_similarity(v(1, 0), v(0.9, 0.3))) == pytest.approx(0.948683, abs=1e-6)
    assert one(spark, X.cosine_similarity(v(0, 0), v(1, 1))) == 0.0
    assert one(spark, X.cosine_similarity(v(1), v(1, 1))) == 0.0
    assert one(spark, X.cosine_similarity(F.lit(None).cast("array<double>"), v(1))) == 0.0


def test_recency_and_bonus(spark):
    now = s("2024-01-31").cast("timestamp")
    recency = X.recency_factor(s("2024-01-01").cast("timestamp"), now)
    assert one(spark, recency) == pytest.approx(math.exp(-1))
    assert one(spark, X.recency_factor(F.lit(None).cast("timestamp"), now)) == 1.0
    assert one(spark, X.usage_bonus(s(7), recency)) == pytest.approx(1.5 * math.exp(-1))


def test_source_weight(spark):
    weights = {"mcp": 1.2, "off": 0.0}
    assert one(spark, X.source_weight(s("mcp"), weights)) == 1.2
    assert one(spark, X.source_weight(s("mcp:x"), weights)) == 1.0
    assert one(spark, X.source_weight(s("mcp:x"), weights, "prefix")) == 1.2
    assert one(spark, X.source_weight(s("off"), weights)) == 0.0


def test_parse_json_or_default(spark):
    none = F.array().cast("array<string>")
    for text, expected in (('["a","b"]', ["a", "b"]), ("", []), ("{", []), (None, []), ("null", [])):
        assert one(spark, X.parse_json_or_default(s(text).cast("string"), "array<string>", none)) == expected


def test_grams(spark):
    assert one(spark, grams(s("banana"), 2)) == ["ba", "an", "na"]
    assert one(spark, grams(s("ab"), 3)) == []


def test_search_text(spark):
    none = F.array().cast("array<string>")
    got = one(spark, X.search_text(s("A"), s(""), s("misc"), s("P"), s("Boo"), words("T", "U"), none, words("ex")))
    assert got == "a misc p boo boo t u ex"
