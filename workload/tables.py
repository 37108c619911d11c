"""The driver's tables in the roles the operators need, as DataFrames and as SQL with the same meaning.

Every builder reads its table whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signpost.functions.text import query_words  # noqa: F401  (re-exported for the query modules)
from signpost.operators.entries import normalize_entries
from signpost.operators.usage import apply_usage, fold_usage
from signpost.session import shuffle_partitions

AS_OF_TEXT = "2024-01-31 00:00:00"


def as_of():
    return F.lit(AS_OF_TEXT).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread a table by its key: the test tables are one row group each, which one task would tokenise alone."""
    return df.repartition(shuffle_partitions(df), key)


# ---- documents as a text catalog ----


def raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"), "doc_id")
    return docs.select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("name"),
        F.col("text").alias("description"),
        "source",
        F.col("lang").alias("category"),
        F.col("source").alias("provider"),
        F.array("lang", "source").alias("tags"),
    )


def document_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_entries(raw_documents(spark, sf_dir), as_of())


def used_document_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document catalog with what was learned from the events of the user with the same number."""
    return apply_usage(document_catalog(spark, sf_dir), fold_usage(document_attempts(spark, sf_dir)), as_of())


TRIGGER_LIST = r"""list_concat([name],
      CASE WHEN len(string_split_regex(name, '[_\-.]')) > 1 THEN string_split_regex(name, '[_\-.]') ELSE [] END,
      CASE WHEN length(regexp_extract(description, '(\S+)', 1)) > 2
           THEN [lower(regexp_extract(description, '(\S+)', 1))] ELSE [] END,
      list_filter(tags, lambda t: length(t) > 2))"""

SEARCH_TEXT = """lower(concat_ws(' ', nullif(name, ''), nullif(description, ''), nullif(category, ''),
      nullif(provider, ''), {boost} nullif(array_to_string(triggers, ' '), ''), nullif(array_to_string(tags, ' '), '')))"""


def entry_ctes(source_sql: str, prefix: str, triggers: str = "NULL", boost: str = "") -> str:
    """CTEs `<prefix>_catalog` with derived triggers and search text over `name, description, source, ...`.

    `triggers` and `boost` name columns of the source that give explicit triggers and boost keywords.
    """
    twice = f"nullif({boost}, ''), nullif({boost}, '')," if boost else ""
    return rf"""{prefix}_raw AS ({source_sql}),
{prefix}_listed AS (SELECT *, {TRIGGER_LIST} AS l FROM {prefix}_raw),
{prefix}_triggered AS (
  SELECT * EXCLUDE (l), coalesce({triggers}, list_filter(l, lambda x, i: length(x) > 1 AND list_position(l, x) = i)) AS triggers
  FROM {prefix}_listed),
{prefix}_catalog AS (SELECT *, {SEARCH_TEXT.format(boost=twice)} AS search_text FROM {prefix}_triggered)"""


DOCUMENTS = entry_ctes(
    """SELECT 'doc_' || doc_id AS name, text AS description, source, lang AS category, source AS provider,
       [lang, source] AS tags FROM documents""",
    "doc",
)


def tokens_sql(text: str, at_least: int) -> str:
    return rf"list_filter(string_split_regex(lower({text}), '[\s_\-./]+'), lambda t: length(t) >= {at_least})"


def words_sql(text: str) -> str:
    return rf"list_filter(string_split_regex(lower({text}), '\s+'), lambda t: length(t) > 1)"


# ---- queries ----


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


def turn_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns of the conversations."""
    turns = table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    return turns.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"),
        F.col("text").alias("query_text"),
    )


BENCHMARK = "queries AS (SELECT item_id AS query_id, text AS query_text FROM benchmark)"
TURNS = """queries AS (SELECT conv_id || '-' || turn AS query_id, text AS query_text
  FROM conversations WHERE role = 'user')"""


# ---- parts as a structured catalog ----


def raw_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spread(table(spark, sf_dir, "part"), "p_partkey")
    return part.select(
        F.concat(F.translate("p_name", " ", "_"), F.lit("_"), F.col("p_partkey").cast("string")).alias("name"),
        F.concat(F.initcap("p_name"), F.lit(" of type "), F.lower("p_type"), F.lit(" by "), F.col("p_brand")).alias("description"),
        F.concat(F.lit("provider:"), F.col("p_brand")).alias("source"),
        F.lower("p_type").alias("category"),
        F.col("p_brand").alias("provider"),
        F.split("p_name", " ").alias("tags"),
        F.col("p_partkey").alias("part_key"),
        F.col("p_size").cast("long").alias("part_size"),
    )


def part_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with use counts taken from their size and a success rate where it is even."""
    raw = raw_parts(spark, sf_dir)
    stats = raw.withColumns(
        {
            "usage_count": F.col("part_size") % 7,
            "success_rate": F.when(F.col("part_size") % 2 == 0, F.col("part_size") / F.lit(64.0)),
            "last_used_at": F.when(F.col("part_size") % 7 > 0, F.timestamp_micros(F.col("part_key") * 1_000_003)),
        }
    )
    entries = normalize_entries(stats, as_of())
    return entries.withColumn("consecutive_failures", F.col("part_size") % 5).drop("part_key", "part_size")


PARTS = entry_ctes(
    """SELECT replace(p_name, ' ', '_') || '_' || p_partkey AS name,
       upper(p_name[1]) || substring(split_part(p_name, ' ', 1), 2) || ' ' ||
         upper(split_part(p_name, ' ', 2)[1]) || substring(split_part(p_name, ' ', 2), 2) ||
         ' of type ' || lower(p_type) || ' by ' || p_brand AS description,
       'provider:' || p_brand AS source, lower(p_type) AS category, p_brand AS provider,
       string_split(p_name, ' ') AS tags, p_partkey AS part_key,
       (p_size % 7)::BIGINT AS usage_count,
       CASE WHEN p_size % 2 = 0 THEN p_size / 64.0::DOUBLE ELSE 1.0::DOUBLE END AS success_rate,
       CASE WHEN p_size % 7 > 0 THEN p_partkey * 1000003 END AS last_used_us,
       (p_size % 5)::BIGINT AS consecutive_failures FROM part""",
    "part",
)


# ---- vectors ----


def vector_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(
        F.concat(F.lit("vec_"), F.col("vec_id").cast("string")).alias("name"),
        F.concat(F.lit("label_"), F.col("label").cast("string")).alias("category"),
        "embedding",
    )


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector asks for its neighbours."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")


VECTORS = """vectors AS (SELECT 'vec_' || vec_id AS name, 'label_' || label AS category, vec_id,
  list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"""
CENTROIDS = """parts_of AS (SELECT category, i, avg(v[i]) AS m FROM vectors, range(1, 65) r(i) GROUP BY category, i),
centroids AS (SELECT category, list(m ORDER BY i) AS c FROM parts_of GROUP BY category)"""


def cosine_sql(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"


# ---- events as attempts ----


def document_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event is an attempt on the document with the user's number; an error event is a failure."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("attempt_id"),
        F.concat(F.lit("doc_"), F.col("user_id").cast("string")).alias("name"),
        F.col("ts").cast("timestamp").alias("ts"),
        (F.col("event_type") != "error").alias("success"),
    )


def circuit_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As `document_attempts`, with low values failing too, so that circuits trip."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("attempt_id"),
        F.concat(F.lit("doc_"), F.col("user_id").cast("string")).alias("name"),
        F.col("ts").cast("timestamp").alias("ts"),
        (~((F.col("event_type") == "error") | (F.col("value") < 20))).alias("success"),
    )


CIRCUIT_RECOVERY = 43_200.0

ATTEMPTS = """attempts AS (SELECT event_id AS attempt_id, 'doc_' || user_id AS name, ts,
  event_type <> 'error' AS success FROM events)"""

FOLD = """numbered AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ts DESC, attempt_id DESC) - 1 AS k FROM attempts),
fold AS (SELECT name, count(*) AS uses,
  sum(CASE WHEN success THEN 0.1::DOUBLE * pow(0.9::DOUBLE, k) ELSE 0 END) AS gain,
  max(ts) AS last_used_at, min(CASE WHEN success THEN k END) AS since FROM numbered GROUP BY name)"""

CIRCUIT = """ev AS (SELECT event_id AS attempt_id, 'doc_' || user_id AS name, epoch_us(ts) AS t,
  NOT (event_type = 'error' OR value < 20) AS success,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
trace AS (
  SELECT attempt_id, name, t, success, rn, CASE WHEN success THEN 'ok' ELSE 'failed' END AS decision,
    NULL::BIGINT AS opened_at, CASE WHEN success THEN 0 ELSE 1 END::BIGINT AS failures FROM ev WHERE rn = 1
  UNION ALL
  SELECT e.attempt_id, e.name, e.t, e.success, e.rn,
    CASE WHEN p.opened_at IS NOT NULL AND e.t - p.opened_at < 43200000000 THEN 'rejected'
         WHEN e.success THEN 'ok' ELSE 'failed' END,
    CASE WHEN p.opened_at IS NOT NULL AND e.t - p.opened_at < 43200000000 THEN p.opened_at
         WHEN e.success THEN NULL WHEN p.opened_at IS NOT NULL OR p.failures + 1 >= 3 THEN e.t END,
    CASE WHEN p.opened_at IS NOT NULL AND e.t - p.opened_at < 43200000000 THEN p.failures
         WHEN e.success THEN 0 ELSE p.failures + 1 END
  FROM trace p JOIN ev e ON e.name = p.name AND e.rn = p.rn + 1)"""


def rounded(c, places: int = 4):
    from signpost.functions.scoring import round_half_up

    return round_half_up(F.col(c) if isinstance(c, str) else c, places)


def rounded_sql(x: str, places: int = 4) -> str:
    scale = f"{10**places}::DOUBLE"
    return f"floor(({x}) * {scale} + 0.5::DOUBLE) / {scale}"
