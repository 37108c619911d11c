"""Scalar functions over the text tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from signpost import functions as X
from workload import tables as T


def normalize_entries(spark, sf_dir):
    raw = T.table(spark, sf_dir, "part").select(
        F.concat(F.translate("p_name", " ", "_"), F.lit("_"), F.col("p_partkey").cast("string")).alias("name"),
        F.when(F.col("p_size") > 10, F.col("p_type")).otherwise("").alias("description"),
        F.when(F.col("p_size") > 20, F.col("p_brand")).alias("provider"),
        F.when(F.col("p_size") > 40, "").when(F.col("p_size") > 30, F.col("p_type")).alias("category"),
    )
    from signpost.operators.entries import normalize_entries as normalize

    return normalize(raw, T.as_of()).select(
        "name", "description", "source", "category", "provider", "endpoint", "usage_count", "success_rate",
        F.array_join("triggers", "|").alias("triggers"), F.size("tags").cast("long").alias("n_tags"),
        F.unix_micros("registered_at").alias("registered_us"),
    )


NORMALIZE = r"""
WITH raw AS (SELECT replace(p_name, ' ', '_') || '_' || p_partkey AS name,
  CASE WHEN p_size > 10 THEN p_type ELSE '' END AS description,
  CASE WHEN p_size > 20 THEN p_brand END AS provider,
  CASE WHEN p_size > 40 THEN '' WHEN p_size > 30 THEN p_type END AS category FROM part),
l AS (SELECT *, list_concat([name], string_split(name, '_'),
  CASE WHEN length(description) > 2 THEN [lower(description)] ELSE [] END) AS t FROM raw)
SELECT name, description, 'unknown' AS source, coalesce(nullif(category, ''), 'misc') AS category,
  coalesce(provider, name) AS provider, '' AS endpoint, 0::BIGINT AS usage_count, 1.0::DOUBLE AS success_rate,
  array_to_string(list_filter(t, lambda x, i: length(x) > 1 AND list_position(t, x) = i), '|') AS triggers,
  0::BIGINT AS n_tags, epoch_us(TIMESTAMP '2024-01-31') AS registered_us FROM l"""


def search_text(spark, sf_dir):
    return T.document_catalog(spark, sf_dir).select("name", "search_text")


def extract_triggers(spark, sf_dir):
    return T.document_catalog(spark, sf_dir).select("name", F.array_join("triggers", "|").alias("triggers"))


def infer_category(spark, sf_dir):
    pages = T.table(spark, sf_dir, "pages")
    return pages.select(
        "page_id",
        X.infer_category(F.col("url")).alias("url_category"),
        X.infer_category(F.col("html"), "mcp").alias("html_category"),
    )


def category_sql(text: str, last: str) -> str:
    def rule(category, *fragments):
        return "WHEN " + " OR ".join(f"contains(lower({text}), '{f}')" for f in fragments) + f" THEN '{category}'"

    return f"""CASE {rule("capture", "screenshot", "capture", "record")}
      {rule("web", "scroll", "tab", "read_page", "navigate")} {rule("data", "extract", "scrape", "parse")}
      {rule("ai", "search", "ai", "query")} {rule("file", "file", "write", "read")}
      {rule("dev", "code", "compile", "lint")} ELSE '{last}' END"""


def boost_keywords(spark, sf_dir):
    docs = T.spread(T.table(spark, sf_dir, "documents"), "doc_id")
    name = F.concat(F.lit("readDoc_"), F.col("source"), F.lit("."), F.col("lang"))
    return docs.select("doc_id", X.boost_keywords(name, F.col("text")).alias("keywords"))


BOOST = r"""
WITH w AS (SELECT doc_id,
  list_filter(string_split_regex(lower(regexp_replace(regexp_replace('readDoc_' || source || '.' || lang,
    '([a-z])([A-Z])', '\1 \2', 'g'), '[_\-.]', ' ', 'g')), '\s+'), lambda x: length(x) > 2) AS a,
  list_filter(string_split_regex(lower(string_split_regex(text, '[.!?]')[1]), '\s+'), lambda x: length(x) > 3)[1:5] AS b
  FROM documents),
c AS (SELECT doc_id, list_concat(a, b) AS l FROM w)
SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:10], ' ') AS keywords FROM c"""


def doc_tokens(spark, sf_dir):
    catalog = T.document_catalog(spark, sf_dir)
    tokens = catalog.select("name", X.doc_tokens(F.col("search_text")).alias("t"))
    return tokens.select("name", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


def query_terms(spark, sf_dir):
    from signpost.operators.lexical import query_term_counts

    return query_term_counts(T.turn_queries(spark, sf_dir))


def query_words(spark, sf_dir):
    from signpost.operators.lexical import query_word_counts

    return query_word_counts(T.turn_queries(spark, sf_dir))


def schema_arg_keys(spark, sf_dir):
    props = F.col("props")
    nested = F.when(F.col("event_type") == "view", F.concat(F.lit('{"type":"object","properties":'), props, F.lit("}")))
    keys = F.coalesce(nested, F.when(F.col("event_type") != "error", props))
    return T.table(spark, sf_dir, "events").select("event_id", F.array_join(X.schema_arg_keys(keys), ",").alias("keys"))


def truncate_text(spark, sf_dir):
    docs = T.table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id",
        X.truncate_text(F.col("text")).alias("result"),
        X.truncate_text(F.col("text"), 50, "").alias("error"),
    )


def round_half_up(spark, sf_dir):
    events = T.table(spark, sf_dir, "events")
    return events.select("event_id", X.round_half_up((F.col("value") - F.lit(50.0)) / F.lit(8.0), 2).alias("rounded"))


def parse_json_or_default(spark, sf_dir):
    text = (
        F.when(F.col("event_type") == "error", F.concat(F.col("props"), F.lit("}")))
        .when(F.col("event_type") == "view", "")
        .otherwise(F.col("props"))
    )
    parsed = X.parse_json_or_default(text, "struct<k:bigint>", F.struct(F.lit(-1).cast("long").alias("k")))
    return T.table(spark, sf_dir, "events").select("event_id", parsed["k"].alias("k"))


QUERIES = {
    "normalize_entries": (normalize_entries, NORMALIZE),
    "search_text": (search_text, f"WITH {T.DOCUMENTS} SELECT name, search_text FROM doc_catalog"),
    "extract_triggers": (
        extract_triggers,
        f"WITH {T.DOCUMENTS} SELECT name, array_to_string(triggers, '|') AS triggers FROM doc_catalog",
    ),
    "infer_category": (
        infer_category,
        f"SELECT page_id, {category_sql('url', 'misc')} AS url_category, {category_sql('html', 'mcp')} AS html_category FROM pages",
    ),
    "boost_keywords": (boost_keywords, BOOST),
    "doc_tokens": (
        doc_tokens,
        f"""WITH {T.DOCUMENTS}, t AS (SELECT name, {T.tokens_sql("search_text", 2)} AS t FROM doc_catalog)
        SELECT name, len(t)::BIGINT AS n, md5(array_to_string(t, ' ')) AS digest FROM t""",
    ),
    "query_terms": (
        query_terms,
        f"""WITH {T.TURNS}, t AS (SELECT query_id, unnest({T.tokens_sql("query_text", 3)}) AS term FROM queries)
        SELECT query_id, term, count(*) AS qtf FROM t GROUP BY ALL""",
    ),
    "query_words": (
        query_words,
        f"""WITH {T.TURNS}, t AS (SELECT query_id, unnest({T.words_sql("query_text")}) AS word FROM queries)
        SELECT query_id, word, count(*) AS times FROM t GROUP BY ALL""",
    ),
    "schema_arg_keys": (
        schema_arg_keys,
        """SELECT event_id, CASE WHEN event_type <> 'error' THEN array_to_string(json_keys(props), ',') END AS keys FROM events""",
    ),
    "truncate_text": (
        truncate_text,
        """SELECT doc_id, CASE WHEN length(text) > 4000 THEN substring(text, 1, 4000) || chr(10) || '... (truncated)'
        ELSE text END AS result, substring(text, 1, 50) AS error FROM documents""",
    ),
    "round_half_up": (
        round_half_up,
        """SELECT event_id, floor((value - 50.0::DOUBLE) / 8.0::DOUBLE * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS rounded
        FROM events""",
    ),
    "parse_json_or_default": (
        parse_json_or_default,
        """SELECT event_id, CASE WHEN event_type IN ('error', 'view') THEN -1 ELSE (props->>'k')::BIGINT END AS k FROM events""",
    ),
}
