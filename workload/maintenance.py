"""Validation, catalog maintenance and reports."""

from __future__ import annotations

import hashlib
from uuid import uuid4

import pandas as pd
from pyspark.sql import functions as F

from signpost.operators import catalog as C
from signpost.operators import quality as Q
from signpost.operators import reports as G
from signpost.session import shared_folder
from signpost.sources import snapshot as SN
from workload import tables as T

# ---- validation ----


def new_entries(spark, sf_dir):
    """Parts as candidate entries, good and bad in every way a rule looks for."""
    p = T.table(spark, sf_dir, "part")
    size, base = F.col("p_size"), F.translate("p_name", " ", "_")
    return p.select(
        F.col("p_partkey").alias("seq"),
        F.when(size > 46, F.lit(" \n"))
        .when(size > 43, F.col("p_name"))
        .when(size > 40, F.concat(base, F.lit("\n")))
        .when(size > 35, base)
        .otherwise(F.concat(base, F.lit("_"), F.col("p_partkey").cast("string")))
        .alias("name"),
        F.when(size % 5 == 0, F.concat(F.lit("  "), F.col("p_type"), F.lit("\t\n")))
        .when(size % 7 == 0, "   ")
        .otherwise(F.concat("p_type", F.lit(" "), "p_name"))
        .alias("description"),
        F.when(size % 3 == 0, F.lower("p_type")).when(size % 3 == 1, "data").otherwise("").alias("category"),
        F.when(size % 4 > 0, F.split("p_name", " ")).when(size % 8 == 0, F.array().cast("array<string>")).alias("tags"),
        F.col("p_brand").alias("provider"),
    )


NEW = r"""new AS (SELECT p_partkey AS seq,
  CASE WHEN p_size > 46 THEN ' ' || chr(10) WHEN p_size > 43 THEN p_name
       WHEN p_size > 40 THEN replace(p_name, ' ', '_') || chr(10) WHEN p_size > 35 THEN replace(p_name, ' ', '_')
       ELSE replace(p_name, ' ', '_') || '_' || p_partkey END AS name,
  CASE WHEN p_size % 5 = 0 THEN '  ' || p_type || chr(9) || chr(10) WHEN p_size % 7 = 0 THEN '   '
       ELSE p_type || ' ' || p_name END AS description,
  CASE WHEN p_size % 3 = 0 THEN lower(p_type) WHEN p_size % 3 = 1 THEN 'data' ELSE '' END AS category,
  p_size % 4 > 0 AS tagged, p_brand FROM part),
known AS (SELECT lower(split_part(c_mktsegment, ' ', 1)) || '_' || c_custkey AS name FROM customer
  UNION ALL SELECT replace(p_name, ' ', '_') || '_' || p_partkey FROM part WHERE p_size = 7),
judged AS (SELECT *, trim(name, ' ' || chr(10)) = '' AS blank_name,
  NOT regexp_full_match(name, '[a-z]+_[a-z][a-z0-9_]*') AS bad_name,
  trim(description, ' ' || chr(9) || chr(10)) AS d,
  category <> '' AND category NOT IN ('web', 'data', 'file', 'dev', 'ai', 'capture', 'misc') AS bad_category FROM new),
own AS (SELECT *, NOT bad_name AND length(d) >= 10 AND NOT bad_category AS sound FROM judged),
firsts AS (SELECT name, min(seq) AS first FROM own WHERE sound GROUP BY name),
checked AS (SELECT own.*, coalesce(first < seq, false) OR name IN (SELECT name FROM known) AS taken FROM own LEFT JOIN firsts USING (name)),
issues AS (
  SELECT seq, 'name' AS field, CASE WHEN blank_name THEN 'name_required' ELSE 'name_format' END AS code, 'error' AS severity
    FROM checked WHERE blank_name OR bad_name
  UNION ALL SELECT seq, 'description', CASE WHEN d = '' THEN 'description_required' ELSE 'description_short' END, 'error'
    FROM checked WHERE length(d) < 10
  UNION ALL SELECT seq, 'category', 'category_unknown', 'error' FROM checked WHERE bad_category
  UNION ALL SELECT seq, 'name', 'name_taken', 'error' FROM checked WHERE taken
  UNION ALL SELECT seq, 'tags', 'tags_missing', 'warning' FROM checked WHERE NOT tagged)"""


def known_entries(spark, sf_dir):
    customers = T.table(spark, sf_dir, "customer").select(
        F.concat(F.lower("c_mktsegment"), F.lit("_"), F.col("c_custkey").cast("string")).alias("name")
    )
    parts = T.raw_parts(spark, sf_dir).filter(F.col("part_size") == 7).select("name")
    return C.with_catalog_fields(customers.unionByName(parts))


def judged_new(spark, sf_dir):
    return Q.validate_new(new_entries(spark, sf_dir), known_entries(spark, sf_dir))


def issue_codes():
    return F.array_join(F.array_sort(F.transform("issues", lambda i: i["code"])), ",").alias("codes")


def validate_new(spark, sf_dir):
    return judged_new(spark, sf_dir).select("seq", "valid", issue_codes())


def issue_report(spark, sf_dir):
    return Q.issue_report(judged_new(spark, sf_dir))


def part_updates(spark, sf_dir):
    """Changes to every part entry, some naming entries that do not exist."""
    size = F.col("part_size")
    return T.raw_parts(spark, sf_dir).select(
        F.when(size == 50, F.concat("name", F.lit("_gone"))).otherwise(F.col("name")).alias("tool"),
        F.when(size % 6 == 0, F.upper("name")).alias("name"),
        F.when(size % 3 == 0, F.concat(F.col("provider"), F.lit(" item")))
        .when(size % 3 == 1, F.concat("description", F.lit(", revised")))
        .alias("description"),
        F.when(size % 4 == 0, "data").when(size % 4 == 1, F.col("category")).otherwise("").alias("category"),
        F.when(size % 5 == 0, F.array(F.lit("fresh"), F.col("provider"))).alias("tags"),
        F.when(size % 7 == 0, "plugin").alias("source"),
    )


UPDATES = f"""{T.PARTS}, updates AS (SELECT CASE WHEN p_size = 50 THEN c.name || '_gone' ELSE c.name END AS entry,
  CASE WHEN p_size % 6 = 0 THEN upper(c.name) END AS given_name,
  CASE WHEN p_size % 3 = 0 THEN provider || ' item' WHEN p_size % 3 = 1 THEN description || ', revised' END AS new_description,
  CASE WHEN p_size % 4 = 0 THEN 'data' WHEN p_size % 4 = 1 THEN category ELSE '' END AS new_category,
  CASE WHEN p_size % 5 = 0 THEN ['fresh', provider] END AS new_tags,
  CASE WHEN p_size % 7 = 0 THEN 'plugin' END AS new_source FROM part_catalog c JOIN part ON p_partkey = part_key),
judged AS (SELECT u.*, c.* , given_name IS NOT NULL AS bad_name,
  coalesce(new_category NOT IN ('', 'web', 'data', 'file', 'dev', 'ai', 'capture', 'misc'), false) AS bad_category,
  coalesce(length(new_description) < 10, false) AS short,
  coalesce(length(new_description) < length(description) * 0.5, false) AS shrunk
  FROM updates u JOIN part_catalog c ON c.name = u.entry)"""


def validate_update(spark, sf_dir):
    judged = Q.validate_update(part_updates(spark, sf_dir), T.part_catalog(spark, sf_dir))
    return judged.select("entry", "valid", issue_codes())


# ---- maintenance ----

SHOWN = ["name", "description", "source", "category", "provider", "usage_count", "consecutive_failures"]


def shown(catalog):
    return catalog.select(
        *SHOWN,
        T.rounded("success_rate", 6).alias("success_rate"),
        F.unix_micros("last_used_at").alias("last_used_us"),
        F.array_join("triggers", "|").alias("triggers"),
        F.array_join("tags", "|").alias("tags"),
        F.md5("search_text").alias("digest"),
    )


SHOWN_SQL = f"""name, description, source, category, provider, usage_count, consecutive_failures,
  {T.rounded_sql("success_rate", 6)} AS success_rate, last_used_us,
  array_to_string(triggers, '|') AS triggers, array_to_string(tags, '|') AS tags, md5(search_text) AS digest"""


def dedupe_batch(spark, sf_dir):
    parts = T.table(spark, sf_dir, "part")
    batch = parts.select(F.translate("p_name", " ", "_").alias("name"), F.col("p_partkey").alias("seq"), "p_brand", "p_type")
    return C.dedupe_batch(batch)


def delta(spark, sf_dir):
    """Every part again: half under its old name and changed, half under a new name."""
    raw = T.raw_parts(spark, sf_dir)
    even = F.col("part_size") % 2 == 0
    return raw.select(
        F.when(even, F.col("name")).otherwise(F.concat("name", F.lit("_v2"))).alias("name"),
        F.concat(F.lit("Changed: "), "description").alias("description"),
        F.lit("local").alias("source"),
        "category",
        "provider",
        "tags",
        F.lit(3).cast("long").alias("usage_count"),
        F.lit(0.5).alias("success_rate"),
    )


DELTA_CATALOG = T.entry_ctes(
    """SELECT CASE WHEN p_size % 2 = 0 THEN name ELSE name || '_v2' END AS name, 'Changed: ' || description AS description,
    'local' AS source, category, provider, tags FROM part_catalog JOIN part ON p_partkey = part_key""",
    "new",
)
UPSERTED = f"""{T.PARTS}, {DELTA_CATALOG},
upserted AS (SELECT name, description, source, category, provider, usage_count, consecutive_failures, success_rate,
    last_used_us, triggers, tags, search_text FROM part_catalog WHERE name NOT IN (SELECT name FROM new_catalog)
  UNION ALL SELECT n.name, n.description, n.source, n.category, n.provider, coalesce(nullif(o.usage_count, 0), 3), 0,
    coalesce(o.success_rate, 0.5e0), NULL, n.triggers, n.tags, n.search_text
  FROM new_catalog n LEFT JOIN part_catalog o USING (name))"""


def upsert_catalog(spark, sf_dir):
    return shown(C.upsert_catalog(T.part_catalog(spark, sf_dir), delta(spark, sf_dir), T.as_of()))


def purge_source(spark, sf_dir):
    return shown(C.purge_source(T.part_catalog(spark, sf_dir), "provider:Brand#7"))


def supplier_batch(spark, sf_dir):
    """Suppliers as the new entries of the brands numbered like their nations; one unit per balance sign."""
    s = T.table(spark, sf_dir, "supplier")
    return s.select(
        F.concat(F.lit("supply_item_"), F.col("s_suppkey").cast("string")).alias("name"),
        F.concat(F.lit("Supplied by "), "s_name").alias("description"),
        F.concat(F.lit("provider:Brand#"), F.col("s_nationkey").cast("string")).alias("source"),
        F.concat(F.lit("Brand#"), F.col("s_nationkey").cast("string")).alias("provider"),
        F.when(F.col("s_acctbal") < 5000, "a").otherwise("b").alias("unit"),
    )


REPLACED = f"""{T.PARTS}, sup AS (SELECT *, 'provider:Brand#' || s_nationkey AS source,
    CASE WHEN s_acctbal < 5000 THEN 'a' ELSE 'b' END AS unit FROM supplier),
{T.entry_ctes('''SELECT 'supply_item_' || s_suppkey AS name, 'Supplied by ' || s_name AS description, source,
    'misc' AS category, 'Brand#' || s_nationkey AS provider, []::VARCHAR[] AS tags FROM sup
    JOIN (SELECT source, max(unit) AS unit FROM sup GROUP BY source) USING (source, unit)''', "new")},
replaced AS (SELECT name, description, source, category, provider, usage_count, consecutive_failures, success_rate,
    last_used_us, triggers, tags, search_text FROM part_catalog WHERE source NOT IN (SELECT source FROM sup)
  UNION ALL SELECT name, description, source, category, provider, 0, 0, 1e0, NULL, triggers, tags, search_text FROM new_catalog)"""


def replace_source(spark, sf_dir):
    batch = C.last_unit_per_source(supplier_batch(spark, sf_dir), "unit").drop("unit")
    return shown(C.replace_source(T.part_catalog(spark, sf_dir), batch, T.as_of()))


def ordered_names(spark, sf_dir):
    """Names of the parts on lines of the largest quantity, and a name per order customer that no entry has."""
    lines = T.table(spark, sf_dir, "lineitem").filter(F.col("l_quantity") >= 50).select(F.col("l_partkey").alias("part_key"))
    parts = T.raw_parts(spark, sf_dir).join(lines, "part_key", "left_semi").select("name")
    customers = T.table(spark, sf_dir, "orders").select(F.concat(F.lit("cust_"), F.col("o_custkey").cast("string")).alias("name"))
    return parts.unionByName(customers)


DELETED = f"""{T.PARTS}, gone AS (SELECT name FROM part_catalog WHERE part_key IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)
  UNION SELECT 'cust_' || o_custkey FROM orders)"""


def delete_names(spark, sf_dir):
    return shown(C.delete_names(T.part_catalog(spark, sf_dir), ordered_names(spark, sf_dir)))


def missing_names(spark, sf_dir):
    return C.missing_names(T.part_catalog(spark, sf_dir), ordered_names(spark, sf_dir))


def delete_provider(spark, sf_dir):
    return shown(C.delete_provider(T.part_catalog(spark, sf_dir), "Brand#3"))


def deletion_report(spark, sf_dir):
    """Counts of a purge, of a provider's deletion, and of a purge that finds nothing."""
    catalog = T.part_catalog(spark, sf_dir)
    purged = C.deletion_report(catalog, "source", "provider:Brand#7")
    deleted = C.deletion_report(catalog, "provider", "Brand#3")
    return purged.unionAll(deleted).unionAll(C.deletion_report(catalog, "source", "nowhere"))


def create_entries(spark, sf_dir):
    catalog, _ = C.create_entries(known_entries(spark, sf_dir), new_entries(spark, sf_dir), T.as_of())
    return catalog.select("name", "description", "source", "category", "provider", F.array_join("triggers", "|").alias("triggers"))


CREATED = f"""{NEW}, {T.entry_ctes('''SELECT name, description, 'local' AS source, coalesce(nullif(category, ''), 'misc') AS category,
    part.p_brand AS provider, CASE WHEN tagged THEN string_split(p_name, ' ') ELSE [] END AS tags
    FROM checked JOIN part ON p_partkey = seq WHERE sound AND NOT taken''', "made")}"""


def update_entries(spark, sf_dir):
    catalog, _ = C.update_entries(T.part_catalog(spark, sf_dir), part_updates(spark, sf_dir), T.as_of())
    return shown(catalog)


UPDATED = f"""{UPDATES}, {T.entry_ctes('''SELECT entry AS name, coalesce(new_description, description) AS description,
    coalesce(new_source, source) AS source, coalesce(nullif(new_category, ''), category) AS category, provider,
    coalesce(new_tags, tags) AS tags, usage_count, success_rate FROM judged WHERE NOT (bad_name OR bad_category OR short)''', "made")},
updated AS (SELECT name, description, source, category, provider, usage_count, consecutive_failures, success_rate,
    last_used_us, triggers, tags, search_text FROM part_catalog WHERE name NOT IN (SELECT name FROM made_catalog)
  UNION ALL SELECT name, description, source, category, provider, usage_count, 0, success_rate, NULL, triggers, tags, search_text
  FROM made_catalog)"""


def missing_updates(spark, sf_dir):
    return C.missing_updates(T.part_catalog(spark, sf_dir), part_updates(spark, sf_dir))


def digest_embedder(batches):
    """Test embedder: eight components from the digest of the text."""
    for batch in batches:
        digests = [hashlib.md5(t.encode()).digest() for t in batch["search_text"]]
        vectors = [[b / 256 for b in d[:8]] for d in digests]
        yield pd.DataFrame({"name": batch["name"], "embedding": vectors})


def half_embedded(spark, sf_dir):
    """Documents; those with a quality label already carry a vector."""
    labelled = T.table(spark, sf_dir, "labels").select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("name"),
        F.array(F.col("quality").cast("float"), F.col("toxic").cast("float")).alias("embedding"),
    )
    catalog = T.document_catalog(spark, sf_dir)
    return catalog.drop("embedding").join(labelled, "name", "left").select(catalog.columns)


def fill_embeddings(spark, sf_dir):
    filled = C.fill_embeddings(half_embedded(spark, sf_dir), digest_embedder)
    return filled.select("name", F.array_join(F.transform("embedding", lambda x: (x * 256).cast("int")), ",").alias("vector"))


EMBEDDED = f"""WITH {T.DOCUMENTS}, h AS (SELECT name, md5(search_text) AS h FROM doc_catalog)
SELECT name, CASE WHEN doc_id IS NOT NULL THEN quality * 256 || ',' || toxic * 256 ELSE
  array_to_string([CAST('0x' || substr(h, i * 2 + 1, 2) AS INTEGER) FOR i IN range(8)], ',') END AS vector
FROM h LEFT JOIN labels ON name = 'doc_' || doc_id"""


def embedding_report(spark, sf_dir):
    return C.embedding_report(half_embedded(spark, sf_dir), digest_embedder)


def embedding_coverage(spark, sf_dir):
    return G.embedding_coverage(half_embedded(spark, sf_dir))


def counts_by_source(spark, sf_dir):
    return G.counts_by_source(T.document_catalog(spark, sf_dir))


def counts_by_category(spark, sf_dir):
    return G.counts_by_category(T.document_catalog(spark, sf_dir))


# ---- stored catalog ----


def write_catalog(spark, sf_dir):
    """Two versions written and the current one read back."""
    path = f"{shared_folder(spark)}/catalog-{uuid4().hex}"
    SN.write_catalog(T.part_catalog(spark, sf_dir), path)
    SN.write_catalog(C.purge_source(SN.read_catalog(spark, path), "provider:Brand#7"), path)
    return shown(SN.read_catalog(spark, path))


def read_catalog(spark, sf_dir):
    """Events as text rows of a SQL store, some with broken JSON, decoded."""
    e = T.table(spark, sf_dir, "events")
    props = F.col("props")
    rows = e.select(
        F.concat(F.lit("event_"), F.col("event_id").cast("string")).alias("name"),
        F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")).alias("category"),
        F.lit("legacy").alias("plugin_name"),
        F.when(F.col("event_type") == "error", F.concat(props, F.lit("]"))).otherwise(props).alias("input_schema"),
        F.when(F.col("value") < 10, "[broken").otherwise(F.concat(F.lit('["'), F.col("event_type"), F.lit('","x"]'))).alias("tags"),
        F.concat(F.lit("["), F.col("value").cast("string"), F.lit("]")).alias("embedding"),
        F.col("user_id").cast("string").alias("usage_count"),
    )
    decoded = SN.decode_rows(rows)
    return decoded.select(
        "name", "description", "source", "category", "provider", "input_schema", "usage_count", "success_rate",
        F.array_join("tags", "|").alias("tags"), T.rounded(F.col("embedding")[0].cast("double"), 2).alias("first"),
    )


READ = f"""SELECT 'event_' || event_id AS name, '' AS description, 'unknown' AS source,
  CASE WHEN event_type = 'view' THEN 'misc' ELSE event_type END AS category, 'legacy' AS provider,
  CASE WHEN event_type <> 'error' THEN props END AS input_schema, user_id AS usage_count, 1e0 AS success_rate,
  CASE WHEN value < 10 THEN '' ELSE event_type || '|x' END AS tags, {T.rounded_sql("value::FLOAT::DOUBLE", 2)} AS first FROM events"""


def evolve_schema(spark, sf_dir):
    old = T.table(spark, sf_dir, "part").select(
        F.col("p_name").alias("name"), F.col("p_brand").alias("plugin_name"), F.col("p_type").alias("category"),
        F.when(F.col("p_size") > 25, "own").otherwise("").alias("provider"), F.col("p_size").alias("usage_count"),
    )
    return SN.evolve_schema(old).select(
        "name", "description", "source", "category", "provider", "usage_count", "success_rate", F.size("tags").cast("long").alias("n_tags")
    )


CODES = "SELECT seq, count(*) FILTER (severity = 'error') AS errors, string_agg(code, ',' ORDER BY code) AS codes FROM issues GROUP BY seq"

QUERIES = {
    "validate_new": (
        validate_new,
        f"WITH {NEW}, c AS ({CODES}) SELECT seq, coalesce(errors, 0) = 0 AS valid, coalesce(codes, '') AS codes FROM new LEFT JOIN c USING (seq)",
    ),
    "issue_report": (issue_report, f"WITH {NEW} SELECT field, code, severity, count(*) AS rows FROM issues GROUP BY ALL"),
    "validate_update": (
        validate_update,
        f"""WITH {UPDATES} SELECT entry, NOT (bad_name OR bad_category OR short) AS valid,
        array_to_string(list_sort(list_filter([CASE WHEN bad_name THEN 'name_format' END, CASE WHEN bad_category THEN 'category_unknown' END,
          CASE WHEN short THEN 'description_short' END, CASE WHEN shrunk THEN 'description_shrunk' END], lambda x: x IS NOT NULL)), ',') AS codes
        FROM judged""",
    ),
    "dedupe_batch": (
        dedupe_batch,
        """SELECT replace(p_name, ' ', '_') AS name, p_partkey AS seq, p_brand, p_type FROM part
        QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey DESC) = 1""",
    ),
    "upsert_catalog": (upsert_catalog, f"WITH {UPSERTED} SELECT {SHOWN_SQL} FROM upserted"),
    "purge_source": (purge_source, f"WITH {T.PARTS} SELECT {SHOWN_SQL} FROM part_catalog WHERE source <> 'provider:Brand#7'"),
    "replace_source": (replace_source, f"WITH {REPLACED} SELECT {SHOWN_SQL} FROM replaced"),
    "delete_names": (
        delete_names,
        f"WITH {DELETED} SELECT {SHOWN_SQL} FROM part_catalog WHERE name NOT IN (SELECT name FROM gone)",
    ),
    "missing_names": (
        missing_names,
        f"WITH {DELETED} SELECT name FROM gone WHERE name NOT IN (SELECT name FROM part_catalog)",
    ),
    "delete_provider": (delete_provider, f"WITH {T.PARTS} SELECT {SHOWN_SQL} FROM part_catalog WHERE provider <> 'Brand#3'"),
    "deletion_report": (
        deletion_report,
        f"""WITH {T.PARTS},
        purged AS (SELECT 'provider:Brand#7' AS value, count(*) AS deleted FROM part_catalog WHERE source = 'provider:Brand#7'),
        deleted AS (SELECT 'Brand#3' AS value, count(*) AS deleted FROM part_catalog WHERE provider = 'Brand#3'),
        nothing AS (SELECT 'nowhere' AS value, count(*) AS deleted FROM part_catalog WHERE source = 'nowhere')
        SELECT value, deleted, deleted > 0 AS found
        FROM (SELECT * FROM purged UNION ALL SELECT * FROM deleted UNION ALL SELECT * FROM nothing)""",
    ),
    "create_entries": (
        create_entries,
        f"""WITH {CREATED} SELECT name, description, source, category, provider, array_to_string(triggers, '|') AS triggers FROM made_catalog
        UNION ALL SELECT name, NULL, NULL, NULL, NULL, NULL FROM known""",
    ),
    "update_entries": (update_entries, f"WITH {UPDATED} SELECT {SHOWN_SQL} FROM updated"),
    "missing_updates": (
        missing_updates,
        f"WITH {UPDATES} SELECT entry AS name FROM updates WHERE entry NOT IN (SELECT name FROM part_catalog)",
    ),
    "fill_embeddings": (fill_embeddings, EMBEDDED),
    "embedding_report": (
        embedding_report,
        """SELECT (SELECT count(*) FROM documents) - (SELECT count(*) FROM labels) AS embedded,
        (SELECT count(*) FROM labels) AS skipped, 0::BIGINT AS failed""",
    ),
    "embedding_coverage": (
        embedding_coverage,
        """SELECT count(*) AS total, count(quality) AS with_embedding, floor(count(quality) * 100e0 / count(*) + 0.5e0)::BIGINT AS percent
        FROM documents LEFT JOIN labels USING (doc_id)""",
    ),
    "counts_by_source": (counts_by_source, "SELECT source, count(*) AS entries FROM documents GROUP BY source"),
    "counts_by_category": (counts_by_category, "SELECT lang AS category, count(*) AS entries FROM documents GROUP BY lang"),
    "write_catalog": (write_catalog, f"WITH {T.PARTS} SELECT {SHOWN_SQL} FROM part_catalog WHERE source <> 'provider:Brand#7'"),
    "read_catalog": (read_catalog, READ),
    "evolve_schema": (
        evolve_schema,
        """SELECT p_name AS name, '' AS description, 'unknown' AS source, p_type AS category,
        CASE WHEN p_size > 25 THEN 'own' ELSE p_brand END AS provider, p_size::BIGINT AS usage_count, 1e0 AS success_rate, 0::BIGINT AS n_tags FROM part""",
    ),
}
