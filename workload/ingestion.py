"""Manifests, listings, bulk rows (I1-I5, G8) and the streaming jobs."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from signpost.operators import reports as G
from signpost.session import shared_folder
from signpost.sources import listings as LI
from signpost.sources import manifests as M
from signpost.sources import snapshot as SN
from signpost.streaming import read_decisions, read_usage, stream_circuit, stream_manifests, stream_route, stream_usage
from workload import learning as L
from workload import maintenance as MA
from workload import ranking as R
from workload import tables as T


def new_folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid4().hex}"


# ---- manifests: one per part, good and bad in every way triage tells apart ----


def manifest_files(spark, sf_dir):
    p = T.spread(T.table(spark, sf_dir, "part"), "p_partkey")
    base, key, size = F.translate("p_name", " ", "_"), F.col("p_partkey"), F.col("p_size")
    own = F.struct(
        F.concat(base, F.lit("_"), key.cast("string")).alias("name"),
        F.concat("p_type", F.lit(" "), "p_name").alias("description"),
        F.when(F.col("p_type") != "PROMO", F.lower("p_type")).alias("category"),
        F.split("p_name", " ").alias("tags"),
        F.concat(F.lit("boost "), "p_name").alias("boostKeywords"),
        F.struct(F.struct(size.alias("size")).alias("properties")).alias("inputSchema"),
    )
    shared = F.struct(
        F.concat(F.lit("shared_"), base).alias("name"),
        F.concat(F.lit("Shared by "), "p_brand").alias("description"),
        F.array(F.lit("x"), F.lit("yy")).alias("triggers"),
    )
    tools = F.concat_ws(",", F.to_json(own), F.to_json(shared), F.lit('{"name":"no_description"}'))
    provider = F.concat("p_brand", F.lit("-"), (key % 50).cast("string"))

    def document(provider, tools):
        return F.concat(F.lit('{"provider":"'), provider, F.lit('","version":"1","tools":'), tools, F.lit("}"))

    listed = F.concat(F.lit("["), tools, F.lit("]"))
    content = (
        F.when(size % 10 == 0, F.concat(document(provider, listed), F.lit("}")))
        .when(size % 20 == 1, "null")
        .when(size % 20 == 11, document(provider, F.concat(F.lit("[null,"), tools, F.lit("]"))))
        .when(size % 20 == 2, document(F.lit(""), listed))
        .when(size % 20 == 12, document(provider, tools))
        .when(size % 20 == 3, document(provider, F.lit('[{"name":"no_description"},{"description":"no name"},5]')))
        .when(size % 20 == 13, document(provider, F.lit("{}")))
        .otherwise(document(provider, listed))
    )
    return p.select(F.format_string("/manifests/%012d.json", key).alias("path"), content.alias("content"))


# size % 20 == 12 puts several bare values after "tools": broken JSON
REASON = """CASE WHEN p_size % 10 = 0 OR p_size % 20 = 12 THEN 'broken_json' WHEN p_size % 20 = 1 THEN 'null_document'
  WHEN p_size % 20 = 11 THEN 'null_entry' WHEN p_size % 20 IN (2, 13) THEN 'invalid_manifest'
  WHEN p_size % 20 = 3 THEN 'no_valid_entries' END"""
TRIAGE = f"""judged AS (SELECT *, '/manifests/' || lpad(p_partkey::VARCHAR, 12, '0') || '.json' AS path, {REASON} AS reason,
  p_brand || '-' || p_partkey % 50 AS maker, replace(p_name, ' ', '_') AS base FROM part),
triaged AS (SELECT path, CASE WHEN reason IS NULL THEN 'loaded' WHEN reason IN ('invalid_manifest', 'no_valid_entries') THEN 'skipped'
  ELSE 'failed' END AS status, reason, CASE WHEN reason IS NULL THEN maker END AS provider,
  CASE WHEN reason IS NULL THEN 2 ELSE 0 END::BIGINT AS entries FROM judged)"""
EXPLODED = f"""{TRIAGE}, exploded AS (
  SELECT path, 0 AS position, base || '_' || p_partkey AS name, p_type || ' ' || p_name AS description, 'provider:' || maker AS source,
    CASE WHEN p_type = 'PROMO' THEN 'misc' ELSE lower(p_type) END AS category, maker AS provider,
    json_object('properties', json_object('size', p_size))::VARCHAR AS input_schema, NULL::VARCHAR[] AS given_triggers,
    string_split(p_name, ' ') AS tags, 'boost ' || p_name AS boost_keywords FROM judged WHERE reason IS NULL
  UNION ALL SELECT path, 1, 'shared_' || base, 'Shared by ' || p_brand, 'provider:' || maker, 'misc', maker, NULL, ['x', 'yy'], [], ''
  FROM judged WHERE reason IS NULL)"""


def triage_manifests(spark, sf_dir):
    return M.triage_manifests(manifest_files(spark, sf_dir))


def explode_manifests(spark, sf_dir):
    rows = M.explode_manifests(manifest_files(spark, sf_dir))
    return rows.select(
        "path", "position", "name", "description", "source", "category", "provider", "input_schema", "boost_keywords",
        F.array_join("triggers", "|").alias("triggers"), F.array_join("tags", "|").alias("tags"),
    )


def load_manifests(spark, sf_dir):
    catalog, _ = M.load_manifests(
        T.part_catalog(spark, sf_dir), manifest_files(spark, sf_dir), T.as_of(), staging=new_folder(spark, "staging")
    )
    return MA.shown(catalog)


LOADED = f"""{T.PARTS}, {EXPLODED},
standing AS (SELECT e.* FROM exploded e JOIN (SELECT source, max(path) AS path FROM exploded GROUP BY source) USING (source, path)
  QUALIFY row_number() OVER (PARTITION BY name ORDER BY path DESC, position DESC) = 1),
{T.entry_ctes("SELECT * FROM standing", "made", "given_triggers", "boost_keywords")},
loaded AS (SELECT name, description, source, category, provider, usage_count, consecutive_failures, success_rate,
    last_used_us, triggers, tags, search_text FROM part_catalog WHERE name NOT IN (SELECT name FROM made_catalog)
  UNION ALL SELECT m.name, m.description, m.source, m.category, m.provider, coalesce(o.usage_count, 0), 0, coalesce(o.success_rate, 1e0),
    NULL, m.triggers, m.tags, m.search_text FROM made_catalog m LEFT JOIN part_catalog o USING (name))"""


def ingest_summary(spark, sf_dir):
    return G.ingest_summary(M.triage_manifests(manifest_files(spark, sf_dir)))


def supplier_directory(spark, sf_dir) -> str:
    """A folder with one manifest file per supplier, written by many tasks, each of which commits its own files."""
    s = T.spread(T.table(spark, sf_dir, "supplier"), "s_suppkey")
    number = F.col("s_suppkey").cast("string")
    entry = F.struct(F.concat(F.lit("order_from_"), number).alias("name"), F.concat(F.lit("Order from "), "s_name").alias("description"))
    folder = new_folder(spark, "manifests")
    manifests = s.select("s_name", F.array(entry).alias("tools")).withColumnRenamed("s_name", "provider")
    # the folder is new, and read only once it is whole; else the driver alone would move all files at the end
    each = {"maxRecordsPerFile": 1, "mapreduce.fileoutputcommitter.algorithm.version": 2}
    manifests.write.options(**each).json(folder)
    return folder


def scan_manifests(spark, sf_dir):
    return M.triage_manifests(M.scan_manifests(spark, supplier_directory(spark, sf_dir))).drop("path")


SUPPLIERS = T.entry_ctes(
    """SELECT 'order_from_' || s_suppkey AS name, 'Order from ' || s_name AS description, 'provider:' || s_name AS source,
    'misc' AS category, s_name AS provider, []::VARCHAR[] AS tags, 0 AS usage_count, 0 AS consecutive_failures, 1e0 AS success_rate,
    NULL::BIGINT AS last_used_us FROM supplier""",
    "new",
)


# ---- listings and bulk rows ----


def listings(spark, sf_dir):
    p = T.table(spark, sf_dir, "part")
    return p.select(
        F.col("p_brand").alias("server"),
        F.concat(F.translate("p_name", " ", "-"), F.lit("ToolSize"), F.col("p_size").cast("string")).alias("tool_name"),
        F.when(F.col("p_size") > 5, F.concat("p_type", F.lit(" goods. Size "), F.col("p_size").cast("string"))).alias("description"),
        F.to_json(F.struct(F.col("p_size").alias("size"))).alias("input_schema"),
        F.col("p_partkey").alias("seq"),
    )


LISTINGS = rf"""tools AS (SELECT p_brand AS server, replace(p_name, ' ', '-') || 'ToolSize' || p_size AS tool,
    CASE WHEN p_size > 5 THEN p_type || ' goods. Size ' || p_size ELSE '' END AS description FROM part
    QUALIFY row_number() OVER (PARTITION BY server, tool ORDER BY p_partkey DESC) = 1),
worded AS (SELECT *, list_concat(
    list_filter(string_split_regex(lower(regexp_replace(regexp_replace(tool, '([a-z])([A-Z])', '\1 \2', 'g'), '[_\-.]', ' ', 'g')), '\s+'),
      lambda x: length(x) > 2),
    list_filter(string_split_regex(lower(string_split_regex(description, '[.!?]')[1]), '\s+'), lambda x: length(x) > 3)[1:5]) AS w FROM tools),
{T.entry_ctes(f'''SELECT 'mcp__' || server || '__' || tool AS name, description, 'mcp:' || server AS source,
    {'{cat}'} AS category, server AS provider, ['mcp', server, tool] AS tags,
    array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i)[1:10], ' ') AS boost FROM worded''', "new", boost="boost")}"""


def listing_sql() -> str:
    from workload.text import category_sql

    return LISTINGS.replace("{cat}", category_sql("tool", "mcp"))


def ingest_listings(spark, sf_dir):
    return MA.shown(LI.ingest_listings(T.part_catalog(spark, sf_dir), listings(spark, sf_dir), T.as_of()))


def name_digest(spark, sf_dir):
    rows = LI.listing_entries(listings(spark, sf_dir)).select(F.col("provider").alias("server"), "seq", "name")
    return G.name_digest(rows, "server", "seq")


def bulk_rows(spark, sf_dir):
    c = T.table(spark, sf_dir, "customer")
    return c.select(
        F.when(F.col("c_acctbal") < 0, None)
        .when(F.col("c_mktsegment") == "MACHINERY", "")
        .otherwise(F.concat(F.lower("c_mktsegment"), F.lit("_"), F.col("c_custkey").cast("string")))
        .alias("name"),
        F.col("c_name").alias("description"),
        F.when(F.col("c_acctbal") > 5000, F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string"))).alias("source"),
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", "own").alias("provider"),
        F.array(F.lit("ignored")).alias("triggers"),
        F.lit("ignored words").alias("boost_keywords"),
    )


def ingest_bulk(spark, sf_dir):
    catalog, _ = LI.ingest_bulk(T.part_catalog(spark, sf_dir), bulk_rows(spark, sf_dir), "bulk", "given", T.as_of())
    return MA.shown(catalog)


def bulk_counts(spark, sf_dir):
    _, counts = LI.ingest_bulk(T.part_catalog(spark, sf_dir), bulk_rows(spark, sf_dir), as_of=T.as_of())
    return counts


BULK = T.entry_ctes(
    """SELECT lower(c_mktsegment) || '_' || c_custkey AS name, c_name AS description,
    CASE WHEN c_acctbal > 5000 THEN 'nation:' || c_nationkey ELSE 'bulk' END AS source, 'misc' AS category,
    CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'own' ELSE 'given' END AS provider, []::VARCHAR[] AS tags
    FROM customer WHERE c_acctbal >= 0 AND c_mktsegment <> 'MACHINERY'""",
    "new",
)
NEW_ROWS = """SELECT name, description, source, category, provider, usage_count, consecutive_failures, success_rate, last_used_us,
    triggers, tags, search_text FROM part_catalog
  UNION ALL SELECT name, description, source, category, provider, 0, 0, 1e0, NULL, triggers, tags, search_text FROM new_catalog"""


# ---- streaming: each job reads its table as a stream, runs to its end and shows what it left ----


def stream_of(spark, sf_dir, name):
    """A table as a stream, be it one file or a folder of files; only as a pattern may the path be either."""
    schema = T.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def finish(query):
    query.awaitTermination()


def streamed_manifests(spark, sf_dir):
    folder, path = supplier_directory(spark, sf_dir), new_folder(spark, "catalog")
    SN.write_catalog(T.part_catalog(spark, sf_dir), path)
    finish(stream_manifests(spark, folder, path, new_folder(spark, "checkpoint"), interval=None))
    return MA.shown(SN.read_catalog(spark, path))


def scattered_attempts(spark, attempts):
    """A log as files that each span its whole time, read one per micro-batch."""
    folder = new_folder(spark, "attempts")
    attempts.repartition(5, F.xxhash64("attempt_id")).write.parquet(folder)
    return spark.readStream.schema(attempts.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def streamed_usage(spark, sf_dir):
    path = new_folder(spark, "usage")
    source = scattered_attempts(spark, T.document_attempts(spark, sf_dir))
    finish(stream_usage(source, path, new_folder(spark, "checkpoint"), interval=None, delay_seconds=None))
    return read_usage(spark, path).select(
        "name", "uses", T.rounded("gain", 6).alias("gain"), F.unix_micros("last_used_at").alias("last_used_us"),
        "failures_since_success",
    )


def streamed_circuit(spark, sf_dir):
    path = new_folder(spark, "circuit")
    source = scattered_attempts(spark, T.circuit_attempts(spark, sf_dir))
    options = {"recovery_seconds": T.CIRCUIT_RECOVERY, "delay_seconds": None}
    finish(stream_circuit(source, path, new_folder(spark, "checkpoint"), None, **options))
    return read_decisions(spark, path).select("attempt_id", "name", "decision", "state", "failures")


def streamed_route(spark, sf_dir):
    queries = stream_of(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    path = new_folder(spark, "routes")
    options = {"as_of": T.as_of(), "weights": R.WEIGHTS}
    finish(
        stream_route(
            queries, lambda: T.used_document_catalog(spark, sf_dir), path, new_folder(spark, "checkpoint"), interval=None, **options
        )
    )
    return R.shown(spark.read.parquet(path), "rank")


QUERIES = {
    "triage_manifests": (triage_manifests, f"WITH {TRIAGE} SELECT * FROM triaged"),
    "explode_manifests": (
        explode_manifests,
        f"""WITH {EXPLODED} SELECT path, position, name, description, source, category, provider, input_schema, boost_keywords,
        array_to_string(given_triggers, '|') AS triggers, array_to_string(tags, '|') AS tags FROM exploded""",
    ),
    "load_manifests": (load_manifests, f"WITH {LOADED} SELECT {MA.SHOWN_SQL} FROM loaded"),
    "ingest_summary": (
        ingest_summary,
        f"WITH {TRIAGE} SELECT status, count(*) AS units, sum(entries)::BIGINT AS entries FROM triaged GROUP BY status",
    ),
    "scan_manifests": (
        scan_manifests,
        "SELECT 'loaded' AS status, NULL::VARCHAR AS reason, s_name AS provider, 1::BIGINT AS entries FROM supplier",
    ),
    "ingest_listings": (
        ingest_listings,
        f"WITH {T.PARTS}, {listing_sql()}, every AS ({NEW_ROWS}) SELECT {MA.SHOWN_SQL} FROM every",
    ),
    "name_digest": (
        name_digest,
        """WITH l AS (SELECT p_brand AS server, 'mcp__' || p_brand || '__' || replace(p_name, ' ', '-') || 'ToolSize' || p_size AS name,
          row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part)
        SELECT server, count(*) AS entries, string_agg(CASE WHEN r <= 10 THEN name END, ', ' ORDER BY r)
          || CASE WHEN count(*) > 10 THEN ' ... +' || (count(*) - 10) || ' more' ELSE '' END AS names FROM l GROUP BY server""",
    ),
    "ingest_bulk": (ingest_bulk, f"WITH {T.PARTS}, {BULK}, every AS ({NEW_ROWS}) SELECT {MA.SHOWN_SQL} FROM every"),
    "bulk_counts": (
        bulk_counts,
        """SELECT count(*) FILTER (c_acctbal >= 0 AND c_mktsegment <> 'MACHINERY') AS registered,
        count(*) FILTER (c_acctbal < 0 OR c_mktsegment = 'MACHINERY') AS skipped FROM customer""",
    ),
    "stream_manifests": (
        streamed_manifests,
        f"WITH {T.PARTS}, {SUPPLIERS}, every AS ({NEW_ROWS}) SELECT {MA.SHOWN_SQL} FROM every",
    ),
    "stream_usage": (streamed_usage, L.QUERIES["fold_usage"][1]),
    "stream_circuit": (streamed_circuit, L.QUERIES["circuit_trace"][1]),
    "stream_route": (streamed_route, R.QUERIES["route"][1]),
}
