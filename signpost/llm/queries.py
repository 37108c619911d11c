"""The operators and the pipeline over the given tables: name -> (query, SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signpost.llm import (
    centroid_clusters,
    chat_collapse,
    collocations,
    crf_langid,
    decontaminate,
    html_extract,
    jaccard_join,
    line_dedup,
    line_rules,
    mixing,
    nra_search,
    pii,
    pu_quality,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"))
    return plan.select(
        F.col("key").alias("doc_id"),
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("copies")).cast("long").alias("taken"),
        F.round(F.get("positions", F.lit(0)), 6).alias("first_position"),
    ).orderBy("first_position", "doc_id")


OP1_SQL = r"""
WITH d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), h AS (
    SELECT *, md5(concat_ws(':', doc_id::VARCHAR, size::VARCHAR)) AS order_hash FROM d
), s AS (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r
    FROM d GROUP BY source
), w AS (
    SELECT source, source_size, r, [3.0, 1.0, 2.0][(r % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap,
        (SELECT sum(size) FROM d) * 1.5::DOUBLE AS total
    FROM s
), l AS (
    SELECT *, (total - coalesce(sum(cap) OVER p, 0)) / sum(weight) OVER f AS level
    FROM w
    WINDOW p AS (ORDER BY cap / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
        f AS (ORDER BY cap / weight, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), t AS (
    SELECT *, least(cap, weight * coalesce((SELECT arg_min(level, cap / weight) FROM l WHERE level * weight < cap), 'infinity'::DOUBLE)) AS target FROM l
), o AS (
    SELECT h.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY order_hash, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off
    FROM h
), c AS (
    SELECT o.doc_id, o.size, t.source_size, t.target, t.r, t.weight, off,
        CASE WHEN o.size > 0 THEN greatest(0, ceil((target - (off + o.size / 2.0::DOUBLE)) / t.source_size)) ELSE 0 END AS copies
    FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source
), p AS (
    SELECT *, (off + size / 2.0::DOUBLE) / target * weight AS goal,
        weight * CASE WHEN r % 2 = 0 THEN 1.5 ELSE 0.5 END::DOUBLE AS w0, weight * CASE WHEN r % 2 = 0 THEN 0.5 ELSE 1.5 END::DOUBLE AS w1
    FROM c
)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken,
    CASE WHEN copies > 0 THEN round(2 * goal / (w0 + sqrt(greatest(0.0, w0 * w0 + 2 * (w1 - w0) * goal))), 6) END AS first_position
FROM p
"""


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs), digest=True)


OP3_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM d),
k AS (
    SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM l
),
f AS (SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) <> max(doc_id)),
m AS (SELECT k.*, first_doc IS NOT NULL AND first_doc <> doc_id AS dropped FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(dropped::INT)::BIGINT AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"), "word_start", "n_words")


OP4_SQL = r"""
WITH t AS (
    SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark
), w AS (
    SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS words
    FROM t
), s AS (
    SELECT kind, id, len(words) - 4 AS total, unnest(range(0, len(words) - 4)) AS pos, words FROM w WHERE len(words) >= 5
), g AS (
    SELECT kind, id, total, pos, array_to_string(words[pos + 1 : pos + 5], ' ') AS h FROM s
), i AS (
    SELECT id AS item_id, total AS n, h, count(*) AS c FROM g WHERE kind = 'i' GROUP BY ALL
), starts AS (
    SELECT DISTINCT d.id AS doc_id, item_id, n, d.total, greatest(0, least(d.pos, d.total - n)) AS start
    FROM g d JOIN i ON d.h = i.h WHERE d.kind = 'd'
), held AS (
    SELECT doc_id, item_id, n, start, least(n, x.total) AS size, g.h, count(*) AS c
    FROM starts x JOIN g ON g.kind = 'd' AND g.id = doc_id AND g.pos >= start AND g.pos < start + n
    GROUP BY ALL
), v AS (
    SELECT doc_id, item_id, start, size, sum(least(held.c, i.c)) / (size + held.n - sum(least(held.c, i.c)))::DOUBLE AS similarity
    FROM held JOIN i USING (item_id, h) GROUP BY doc_id, item_id, start, size, held.n
), best AS (
    SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS r FROM v WHERE similarity >= 0.8
)
SELECT doc_id, item_id, round(similarity, 6) AS similarity, start::BIGINT AS word_start, (size + 4)::BIGINT AS n_words
FROM best WHERE r = 1
"""


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    base = F.concat(*[pii.span_text(k, F.col(k)) for k in pii.KINDS])
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(base, pii.span_text("term", F.col("terms"))), ",").alias("spans"),
    )


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = pu_quality.held_out_fold(F.col("doc_id"), 4, 2)
    scored = pu_quality.score_documents(docs.select("doc_id", "text"), pu_quality.train(docs, labels, ~held_out))
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= pu_quality.THRESHOLD).cast("int").alias("predicted")
    )


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.judge_documents(table(spark, sf_dir, "documents"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = pu_quality.held_out_fold(F.col("doc_id"), 3, 1)
    found = crf_langid.label_documents(docs, crf_langid.train(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_collapse.collapse_conversations(table(spark, sf_dir, "conversations"))


OP10_SQL = r"""
WITH t AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place,
        floor(turn / 256) AS block
    FROM conversations
), c AS (
    SELECT conv_id, list({'r': role, 't': text} ORDER BY place) AS turns, count(*)::BIGINT AS n FROM t GROUP BY conv_id
), one AS (
    SELECT turns, min(conv_id) AS conv_id, n FROM c GROUP BY turns, n
), inner_prefixes AS (
    SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, n)) AS k FROM c)
), kept AS (
    SELECT conv_id, n FROM one WHERE NOT EXISTS (SELECT 1 FROM inner_prefixes p WHERE p.turns = one.turns)
)
SELECT t.conv_id, (row_number() OVER (PARTITION BY t.conv_id ORDER BY block) - 1)::INT AS part, n AS n_turns,
    count(*)::BIGINT AS n_part_turns,
    string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY place) AS rendered
FROM t JOIN kept ON t.conv_id = kept.conv_id
GROUP BY t.conv_id, block, n
"""


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters.with_figures(centroid_clusters.cluster_vectors(table(spark, sf_dir, "embeddings")))


def _rounds_sql(rounds: int, k: int) -> str:
    """A CTE per round: assignments a<i> to the centroids m<i>, which the next ones follow from."""
    distance = "list_sum([(w[i] - m[i]) * (w[i] - m[i]) FOR i IN range(1, 65)])"
    assigned = """a{i} AS MATERIALIZED (SELECT rid, arg_min(c, d * {k} + c) AS c, min(d) AS d FROM (
    SELECT rid, c, {distance}::BIGINT AS d FROM v, m{i}) GROUP BY rid)"""
    moved = """m{j} AS MATERIALIZED (SELECT m{i}.c, coalesce(n.m, m{i}.m) AS m FROM m{i} LEFT JOIN (
    SELECT c, list(x ORDER BY i) AS m FROM (
        SELECT c, i, ((sum(w[i]) - ((sum(w[i]) % count(*) + count(*)) % count(*))) // count(*))::BIGINT AS x
        FROM v JOIN a{i} USING (rid), range(1, 65) r(i) GROUP BY c, i) GROUP BY c) n USING (c))"""
    out = []
    for i in range(rounds + 1):
        out.append(assigned.format(i=i, k=k, distance=distance))
        if i < rounds:
            out.append(moved.format(i=i, j=i + 1))
    return ",\n".join(out)


OP11_SQL = f"""
WITH v AS MATERIALIZED (
    SELECT row_number() OVER () AS rid, vec_id, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS w FROM embeddings
    WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = 64
), m0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, w AS m FROM v ORDER BY sha256('3:' || vec_id) LIMIT 8
), {_rounds_sql(10, 8)}
SELECT vec_id, a10.c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a10.c))::BIGINT AS cluster_inertia,
    (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a10 JOIN v USING (rid) JOIN m10 ON m10.c = a10.c
"""


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nra_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


OP12_SQL = """
WITH v AS MATERIALIZED (
    SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS w FROM embeddings
    WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)
), s AS (
    SELECT q.vec_id AS query_id, v.vec_id,
        coalesce(list_sum([q.w[i] * v.w[i] FOR i IN range(1, least(len(q.w), len(v.w)) + 1)]), 0)::BIGINT AS score
    FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id
), r AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH p AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), w AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), g AS (
    SELECT lang, k, unnest([array_to_string(w[i : i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS phrase FROM w, range(1, 6) t(k)
), f AS MATERIALIZED (
    SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL
), n AS (
    SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang
), c AS MATERIALIZED (
    SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE k > 1 AND f >= 100
), inside AS (
    SELECT DISTINCT x.lang, array_to_string(x.w[i : i + m - 1], ' ') AS phrase, m, x.a
    FROM c x, range(2, 5) s(m), range(1, 5) t(i) WHERE m < x.k AND i + m - 1 <= x.k
), kept AS (
    SELECT c.* FROM c WHERE NOT EXISTS (
        SELECT 1 FROM inside i WHERE i.lang = c.lang AND i.phrase = c.phrase AND 100 * i.a >= 100 * c.a)
), cut AS (
    SELECT kept.*, j, array_to_string(w[1 : j], ' ') AS first_part, array_to_string(w[j + 1 : ], ' ') AS rest
    FROM kept, range(1, 5) t(j) WHERE j < k
), scored AS (
    SELECT cut.lang, cut.phrase, a, j, x.f AS l, y.f AS r, n, (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score
    FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = first_part JOIN f y ON y.lang = cut.lang AND y.phrase = rest
        JOIN n ON n.lang = cut.lang
), lowest AS (
    SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS c FROM scored
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest WHERE c = 1
)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_source_mix": (op1, OP1_SQL),
    "op2_main_text": (op2, None),
    "op3_line_dedup": (op3, OP3_SQL),
    "op4_decontaminate": (op4, OP4_SQL),
    "op5_jaccard_join": (op5, None),
    "op6_personal_data": (op6, None),
    "op7_quality_score": (op7, None),
    "op8_line_rules": (op8, None),
    "op9_language": (op9, None),
    "op10_chat_collapse": (op10, OP10_SQL),
    "op11_centroid_clusters": (op11, OP11_SQL),
    "op12_top_k_search": (op12, OP12_SQL),
    "op13_collocations": (op13, OP13_SQL),
    "pipeline": (pipeline, None),
}
