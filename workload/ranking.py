"""Retrieval, ranking and dispatch."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from signpost import functions as X
from signpost.operators import dispatch as D
from signpost.operators import lexical as L
from signpost.operators import rank as R
from signpost.plans import route as P
from signpost.plans.indexes import write_text_index
from signpost.session import shared_folder
from signpost.sources import snapshot as SN
from workload import tables as T

WEIGHTS = {"src1": 1.2, "src2": 0.8, "src3": 0.0}
WEIGHT_SQL = "CASE source WHEN 'src1' THEN 1.2e0 WHEN 'src2' THEN 0.8e0 WHEN 'src3' THEN 0e0 ELSE 1e0 END"

LEXICAL = rf"""tokens AS (SELECT name, {T.tokens_sql("search_text", 2)} AS t FROM cat),
lens AS (SELECT name, len(t) AS dl FROM tokens),
tf AS (SELECT name, term, count(*) AS tf FROM (SELECT name, unnest(t) AS term FROM tokens) GROUP BY ALL),
corpus AS (SELECT count(*) AS n, avg(dl) AS a FROM lens),
idf AS (SELECT term, df, ln((n - df + 0.5e0) / (df + 0.5e0) + 1e0) AS idf
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), corpus)"""

KEYWORD = rf"""qtf AS (SELECT query_id, term, count(*) AS qtf
  FROM (SELECT query_id, unnest({T.tokens_sql("query_text", 3)}) AS term FROM queries) GROUP BY ALL),
bm AS (SELECT query_id, name, sum(qtf * idf * (tf * 2.2e0) / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / a))) AS s
  FROM qtf JOIN idf USING (term) JOIN tf USING (term) JOIN lens USING (name), corpus GROUP BY query_id, name)"""

TRIGGER = rf"""qw AS (SELECT query_id, unnest({T.words_sql("query_text")}) AS word FROM queries),
trig AS (SELECT DISTINCT name, unnest(triggers) AS g FROM cat),
pairs AS (SELECT word, g FROM (SELECT DISTINCT word FROM qw) JOIN (SELECT DISTINCT g FROM trig) ON contains(g, word)),
tm AS (SELECT query_id, name, count(*) AS hits
  FROM (SELECT DISTINCT name, word FROM trig JOIN pairs USING (g)) JOIN qw USING (word) GROUP BY ALL)"""

# Documents with what the events taught
DOC_CAT = f"""{T.DOCUMENTS}, {T.ATTEMPTS}, {T.FOLD},
cat AS (SELECT d.*, coalesce(uses, 0) AS usage_count, coalesce(pow(0.9e0, uses) + gain, 1e0) AS success_rate,
  last_used_at FROM doc_catalog d LEFT JOIN fold USING (name))"""
PART_CAT = f"""{T.PARTS}, cat AS (SELECT *, make_timestamp(last_used_us) AS last_used_at FROM part_catalog)"""


def fused_sql(weight: str = "1e0", semantic: str | None = None, threshold: str = "0.1e0") -> str:
    union = """SELECT query_id, name, s AS s2, 0e0 AS s1, 0e0 AS s3 FROM bm
    UNION ALL SELECT query_id, name, 0e0, hits * 3e0, 0e0 FROM tm"""
    if semantic:
        union += f" UNION ALL {semantic}"
    return f"""stages AS (SELECT query_id, name, sum(s1) AS trigger, sum(s2) AS keyword, sum(s3) AS semantic
      FROM ({union}) GROUP BY query_id, name),
    factors AS (SELECT query_id, name, trigger, keyword, semantic, success_rate AS success,
      coalesce(exp(-((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(last_used_at)) / 86400000000e0) / 30e0), 1e0) AS recency,
      usage_count, {weight} AS weight FROM stages JOIN cat USING (name)),
    finals AS (SELECT *, log2(usage_count + 1) * 0.5e0 * recency AS usage,
      (trigger + keyword + semantic + log2(usage_count + 1) * 0.5e0 * recency + success) * weight AS final FROM factors),
    scored AS (SELECT query_id, name, {T.rounded_sql("final", 2)} AS score, trigger, keyword, semantic,
      {T.rounded_sql("usage", 2)} AS usage, {T.rounded_sql("success", 2)} AS success,
      {T.rounded_sql("recency", 3)} AS recency FROM finals WHERE final >= {threshold}),
    numbered_results AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name) AS rank FROM scored)"""


FULL = f"WITH RECURSIVE {DOC_CAT}, {T.BENCHMARK}, {LEXICAL}, {KEYWORD}, {TRIGGER}, {fused_sql(WEIGHT_SQL)}"
FULL_PARTS = f"WITH {PART_CAT}, {T.TURNS}, {LEXICAL}, {KEYWORD}, {TRIGGER}"


def index_of_documents(spark, sf_dir):
    return L.build_text_index(T.document_catalog(spark, sf_dir))


def corpus_stats(spark, sf_dir):
    stats = L.corpus_stats(index_of_documents(spark, sf_dir))
    return stats.select("term", "df", T.rounded("idf", 6).alias("idf"))


def text_index_stats(spark, sf_dir):
    return L.text_index_stats(index_of_documents(spark, sf_dir))


def bm25(spark, sf_dir):
    scores = L.bm25(T.document_catalog(spark, sf_dir), T.benchmark_queries(spark, sf_dir))
    return scores.select("query_id", "name", T.rounded("score").alias("score"))


def trigger_match(spark, sf_dir):
    return L.trigger_match(T.document_catalog(spark, sf_dir), T.benchmark_queries(spark, sf_dir))


def trigger_match_parts(spark, sf_dir):
    return L.trigger_match(T.part_catalog(spark, sf_dir), T.turn_queries(spark, sf_dir)).select("query_id", "name", "hits")


def scored_documents(spark, sf_dir):
    catalog, queries = T.used_document_catalog(spark, sf_dir), T.benchmark_queries(spark, sf_dir)
    return R.fuse_scores(P.stage_scores(catalog, queries), catalog, T.as_of(), weights=WEIGHTS)


SHOWN = ["query_id", "name", "score", "usage", "success", "recency"]


def shown(df, *more):
    stages = [T.rounded(s).alias(s) for s in R.STAGES]
    return df.select(*SHOWN, *stages, *more)


SHOWN_SQL = f"""query_id, name, score, usage, success, recency, {T.rounded_sql("trigger")} AS trigger,
  {T.rounded_sql("keyword")} AS keyword, {T.rounded_sql("semantic")} AS semantic"""


def fuse_scores(spark, sf_dir):
    return shown(scored_documents(spark, sf_dir))


def routed(spark, sf_dir, **options):
    options = {"as_of": T.as_of(), "weights": WEIGHTS, **options}
    return P.route(T.used_document_catalog(spark, sf_dir), T.benchmark_queries(spark, sf_dir), **options)


def route(spark, sf_dir):
    return shown(routed(spark, sf_dir), "rank")


def route_stored_index(spark, sf_dir):
    """As `route`, over a catalog and a text index that were written first."""
    folder = f"{shared_folder(spark)}/index-{uuid4().hex}"
    SN.write_catalog(T.used_document_catalog(spark, sf_dir), f"{folder}/catalog")
    catalog = SN.read_catalog(spark, f"{folder}/catalog")
    index = write_text_index(catalog, f"{folder}/text")
    ranked = P.route(catalog, T.benchmark_queries(spark, sf_dir), as_of=T.as_of(), weights=WEIGHTS, text_index=index)
    return shown(ranked, "rank")


def rank_top_k(spark, sf_dir):
    return R.rank_top_k(scored_documents(spark, sf_dir), 20).select("query_id", "name", "score", "rank")


def route_parts(spark, sf_dir):
    catalog, queries = T.part_catalog(spark, sf_dir), T.turn_queries(spark, sf_dir)
    ranked = P.route(catalog, queries, as_of=T.as_of(), top_k=3, weights={"provider": 1.5}, match="prefix")
    return shown(ranked, "rank")


def explorer_slot(spark, sf_dir):
    ranked = routed(spark, sf_dir, explorer_seed="7", explorer_percent=30)
    return ranked.filter("explorer").select("query_id", "name", "score", F.col("rank").cast("long").alias("rank"))


EXPLORER = f"""{FULL},
top AS (SELECT query_id, name FROM numbered_results WHERE rank <= 5),
sizes AS (SELECT query_id, count(*) AS n FROM top GROUP BY query_id HAVING count(*) >= 2
  AND CAST('0x' || substr(md5('7:' || query_id), 1, 8) AS BIGINT) % 100 < 30),
least AS (SELECT name, row_number() OVER (ORDER BY usage_count, name) AS r FROM cat),
free AS (SELECT query_id, n, min(r) AS r FROM sizes, least
  WHERE NOT EXISTS (SELECT 1 FROM top WHERE top.query_id = sizes.query_id AND top.name = least.name) GROUP BY ALL)
SELECT query_id, name, 0e0 AS score, n + 1 AS rank FROM free JOIN least USING (r)"""


def no_match_report(spark, sf_dir):
    catalog, queries = T.part_catalog(spark, sf_dir), T.turn_queries(spark, sf_dir)
    ranked = P.route(catalog, queries, as_of=T.as_of(), threshold=20.0)
    return R.no_match_report(queries, ranked, catalog)


def no_match_categories(spark, sf_dir):
    catalog, queries = T.part_catalog(spark, sf_dir), T.turn_queries(spark, sf_dir)
    ranked = P.route(catalog, queries, as_of=T.as_of(), threshold=20.0)
    report = R.no_match_report(queries, ranked, catalog, categories=True)
    pair = lambda c: F.concat(F.coalesce(c["category"], F.lit("")), F.lit(":"), c["entries"].cast("string"))
    return report.withColumn("category_counts", F.array_join(F.transform("category_counts", pair), ","))


def result_details(spark, sf_dir):
    ranked = routed(spark, sf_dir).select("query_id", "rank", "name")
    return R.attach_details(ranked, T.document_catalog(spark, sf_dir))


def used_bonus(spark, sf_dir):
    catalog = T.used_document_catalog(spark, sf_dir)
    recency = X.recency_factor(F.col("last_used_at"), T.as_of())
    return catalog.select(
        "name",
        T.rounded(recency, 6).alias("recency"),
        T.rounded(X.usage_bonus(F.col("usage_count"), recency), 6).alias("usage"),
        T.rounded(X.success_bonus(F.col("success_rate")), 6).alias("success"),
    )


def source_weight(spark, sf_dir):
    docs = T.table(spark, sf_dir, "documents")
    tagged = F.concat("source", F.lit(":"), "lang")
    return docs.select(
        "doc_id",
        X.source_weight(F.col("source"), WEIGHTS).alias("exact"),
        X.source_weight(tagged, WEIGHTS).alias("tagged"),
        X.source_weight(tagged, WEIGHTS, "prefix").alias("prefix"),
    )


# ---- dispatch: a document's label says whether its attempt succeeds ----


def outcomes(spark, sf_dir):
    labels = T.table(spark, sf_dir, "labels")
    return labels.select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("name"), (F.col("quality") == 1).alias("success")
    )


def gated(spark, sf_dir):
    return routed(spark, sf_dir, top_k=8, threshold=22.0)


RANKED8 = f"""WITH RECURSIVE {DOC_CAT}, {T.BENCHMARK}, {LEXICAL}, {KEYWORD}, {TRIGGER}, {fused_sql(WEIGHT_SQL, threshold="22e0")},
ranked AS (SELECT query_id, rank, name, score FROM numbered_results WHERE rank <= 8)"""
CONFIDENT = 25.0
PLAN = f"""{RANKED8},
plan AS (SELECT * FROM ranked WHERE score >= 25 AND rank <= 3),
tried AS (SELECT p.*, coalesce(quality = 1, false) AS success FROM plan p LEFT JOIN labels ON name = 'doc_' || doc_id),
won AS (SELECT query_id, min(CASE WHEN success THEN rank END) AS winner_rank, count(*) AS candidates FROM tried GROUP BY query_id),
resolution AS (SELECT query_id, CASE WHEN winner_rank IS NULL THEN 'all_failed' ELSE 'success' END AS status,
  t.name AS winner, winner_rank, coalesce(winner_rank - 1, candidates) AS failed_attempts
  FROM won LEFT JOIN (SELECT query_id, rank AS winner_rank, name FROM tried) t USING (query_id, winner_rank))"""


def confidence_gate(spark, sf_dir):
    return D.confidence_gate(T.benchmark_queries(spark, sf_dir), gated(spark, sf_dir), CONFIDENT)


def fallback_plan(spark, sf_dir):
    return D.fallback_plan(gated(spark, sf_dir), CONFIDENT)


def resolve_fallback(spark, sf_dir):
    return D.resolve_fallback(fallback_plan(spark, sf_dir), outcomes(spark, sf_dir))


def alternatives(spark, sf_dir):
    """From one ranking, written first: the plan and the offer both read it."""
    path = f"{shared_folder(spark)}/ranked-{uuid4().hex}"
    gated(spark, sf_dir).write.parquet(path)
    ranked = spark.read.parquet(path)
    return D.alternatives(ranked, D.resolve_fallback(D.fallback_plan(ranked, CONFIDENT), outcomes(spark, sf_dir)))


def attempt_log(spark, sf_dir):
    return D.attempt_log(fallback_plan(spark, sf_dir), outcomes(spark, sf_dir))


QUERIES = {
    "route": (route, f"{FULL} SELECT {SHOWN_SQL}, rank FROM numbered_results WHERE rank <= 5"),
    "route_stored_index": (
        route_stored_index,
        f"{FULL} SELECT {SHOWN_SQL}, rank FROM numbered_results WHERE rank <= 5",
    ),
    "corpus_stats": (
        corpus_stats,
        f"WITH {T.DOCUMENTS}, cat AS (FROM doc_catalog), {LEXICAL} SELECT term, df, {T.rounded_sql('idf', 6)} AS idf FROM idf",
    ),
    "text_index_stats": (
        text_index_stats,
        f"""WITH {T.DOCUMENTS}, cat AS (FROM doc_catalog), {LEXICAL}
        SELECT (SELECT count(*) FROM idf) AS terms, floor(a * 10 + 0.5e0) / 10e0 AS avg_doc_len, 1.2e0 AS k1, 0.75e0 AS b FROM corpus""",
    ),
    "bm25": (
        bm25,
        f"""WITH {T.DOCUMENTS}, cat AS (FROM doc_catalog), {T.BENCHMARK}, {LEXICAL}, {KEYWORD}
        SELECT query_id, name, {T.rounded_sql("s")} AS score FROM bm""",
    ),
    "trigger_match": (
        trigger_match,
        f"""WITH {T.DOCUMENTS}, cat AS (FROM doc_catalog), {T.BENCHMARK}, {TRIGGER}
        SELECT query_id, name, hits, hits * 3e0 AS score FROM tm""",
    ),
    "trigger_match_parts": (
        trigger_match_parts,
        f"WITH {PART_CAT}, {T.TURNS}, {TRIGGER} SELECT query_id, name, hits FROM tm",
    ),
    "fuse_scores": (fuse_scores, f"{FULL} SELECT {SHOWN_SQL} FROM scored"),
    "rank_top_k": (rank_top_k, f"{FULL} SELECT query_id, name, score, rank FROM numbered_results WHERE rank <= 20"),
    "route_parts": (
        route_parts,
        f"{FULL_PARTS}, {fused_sql('1.5e0')} SELECT {SHOWN_SQL}, rank FROM numbered_results WHERE rank <= 3",
    ),
    "explorer_slot": (explorer_slot, EXPLORER),
    "no_match_report": (
        no_match_report,
        f"""{FULL_PARTS}, {fused_sql(threshold="20e0")}
        SELECT query_id, query_text, (SELECT count(*) FROM cat) AS catalog_size FROM queries
        WHERE query_id NOT IN (SELECT query_id FROM scored)""",
    ),
    "no_match_categories": (
        no_match_categories,
        f"""{FULL_PARTS}, {fused_sql(threshold="20e0")},
        per_category AS (SELECT category, count(*) AS n FROM part_catalog GROUP BY category)
        SELECT query_id, query_text, (SELECT count(*) FROM cat) AS catalog_size,
          (SELECT string_agg(category || ':' || n, ',' ORDER BY n DESC, category) FROM per_category) AS category_counts
        FROM queries WHERE query_id NOT IN (SELECT query_id FROM scored)""",
    ),
    "result_details": (
        result_details,
        f"""{FULL} SELECT query_id, rank, name, description, source, category, NULL::VARCHAR AS input_schema
        FROM numbered_results JOIN doc_catalog USING (name) WHERE rank <= 5""",
    ),
    "usage_bonus": (
        used_bonus,
        f"""WITH {DOC_CAT}, r AS (SELECT *, coalesce(exp(-((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(last_used_at))
          / 86400000000e0) / 30e0), 1e0) AS recency FROM cat)
        SELECT name, {T.rounded_sql("recency", 6)} AS recency,
          {T.rounded_sql("log2(usage_count + 1) * 0.5e0 * recency", 6)} AS usage,
          {T.rounded_sql("success_rate", 6)} AS success FROM r""",
    ),
    "source_weight": (
        source_weight,
        f"SELECT doc_id, {WEIGHT_SQL} AS exact, 1e0 AS tagged, {WEIGHT_SQL} AS prefix FROM documents",
    ),
    "confidence_gate": (
        confidence_gate,
        f"""{RANKED8}, t AS (SELECT query_id, max(score) AS top_score FROM ranked GROUP BY query_id)
        SELECT query_id, top_score, CASE WHEN top_score IS NULL THEN 'no_match' WHEN top_score < 25 THEN 'low_confidence'
          ELSE 'execute' END AS gate FROM queries LEFT JOIN t USING (query_id)""",
    ),
    "fallback_plan": (fallback_plan, f"{PLAN} SELECT query_id, rank, name, score FROM plan"),
    "resolve_fallback": (resolve_fallback, f"{PLAN} SELECT * FROM resolution"),
    "alternatives": (
        alternatives,
        f"""{PLAN} SELECT query_id, rank, name, score FROM ranked
        JOIN (SELECT query_id, failed_attempts + (status = 'success')::INT AS tried FROM resolution) USING (query_id)
        WHERE rank > tried AND rank <= tried + 3""",
    ),
    "attempt_log": (
        attempt_log,
        f"""{PLAN} SELECT query_id, rank, name, success FROM tried JOIN won USING (query_id)
        WHERE winner_rank IS NULL OR rank <= winner_rank""",
    ),
}
