"""Usage folds and circuit breaker (U1-U8), and the reports built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from signpost.operators import circuit as C
from signpost.operators import reports as G
from signpost.operators import usage as U
from workload import tables as T


def learned(catalog):
    return catalog.select(
        "name", "usage_count", T.rounded("success_rate", 6).alias("success_rate"), "consecutive_failures",
        F.unix_micros("last_used_at").alias("last_used_us"),
    )


def fold_usage(spark, sf_dir):
    folded = U.fold_usage(T.document_attempts(spark, sf_dir))
    return folded.select(
        "name", "uses", T.rounded("gain", 6).alias("gain"), F.unix_micros("last_used_at").alias("last_used_us"),
        "failures_since_success",
    )


def apply_usage(spark, sf_dir):
    return learned(T.used_document_catalog(spark, sf_dir))


def apply_usage_parts(spark, sf_dir):
    """Order lines as attempts on parts that already have statistics; a returned line is a failure."""
    lines = T.table(spark, sf_dir, "lineitem").select(
        F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice").alias("attempt_id"),
        F.col("l_partkey").alias("part_key"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        (F.col("l_returnflag") != "R").alias("success"),
    )
    names = T.raw_parts(spark, sf_dir).select("part_key", "name")
    attempts = lines.join(names, "part_key").drop("part_key")
    return learned(U.apply_usage(T.part_catalog(spark, sf_dir), U.fold_usage(attempts), T.as_of()))


def merge_folds(spark, sf_dir):
    attempts = T.document_attempts(spark, sf_dir)
    noon = F.lit("2024-01-15 12:00:00").cast("timestamp")
    older, newer = attempts.filter(F.col("ts") < noon), attempts.filter(F.col("ts") >= noon)
    merged = U.merge_folds(U.fold_usage(older), U.fold_usage(newer))
    return merged.select(
        "name", "uses", T.rounded("gain", 6).alias("gain"), F.unix_micros("last_used_at").alias("last_used_us"),
        "failures_since_success",
    )


def trace(spark, sf_dir):
    return C.circuit_trace(T.circuit_attempts(spark, sf_dir), recovery_seconds=T.CIRCUIT_RECOVERY)


def circuit_trace(spark, sf_dir):
    return trace(spark, sf_dir).select("attempt_id", "name", "decision", "state", "failures")


def noon(day: str):
    return F.lit(f"2024-01-{day} 12:00:00").cast("timestamp")


def circuit_state_at(spark, sf_dir):
    names = T.document_catalog(spark, sf_dir)
    return C.circuit_state_at(trace(spark, sf_dir), noon("20"), T.CIRCUIT_RECOVERY, names)


def tripped_circuits(spark, sf_dir):
    return C.tripped_circuits(trace(spark, sf_dir))


def reset_circuits(spark, sf_dir):
    """A key is reset at its user's last signup."""
    attempts = T.circuit_attempts(spark, sf_dir)
    signups = T.table(spark, sf_dir, "events").filter(F.col("event_type") == "signup")
    resets = signups.select(
        F.concat(F.lit("doc_"), F.col("user_id").cast("string")).alias("name"), F.col("ts").cast("timestamp").alias("reset_at")
    )
    left = C.circuit_trace(C.reset_circuits(attempts, resets), recovery_seconds=T.CIRCUIT_RECOVERY)
    return left.select("attempt_id", "name", "decision", "state", "failures")


def usage_after_circuit(spark, sf_dir):
    folded = U.fold_usage(C.recorded_attempts(trace(spark, sf_dir)))
    return folded.select("name", "uses", T.rounded("gain", 6).alias("gain"), "failures_since_success")


def top_used(spark, sf_dir):
    return G.top_used(T.used_document_catalog(spark, sf_dir))


def recently_used(spark, sf_dir):
    used = G.recently_used(T.used_document_catalog(spark, sf_dir))
    return used.select("name", F.unix_micros("last_used_at").alias("last_used_us"))


def unstable_entries(spark, sf_dir):
    return G.unstable_entries(T.used_document_catalog(spark, sf_dir))


FOLDED = f"""{T.ATTEMPTS}, {T.FOLD}"""
FOLD_SHOWN = f"""name, uses, {T.rounded_sql("gain", 6)} AS gain, epoch_us(last_used_at) AS last_used_us,
  since AS failures_since_success FROM fold"""
LEARNED = f"""{FOLDED}, learned AS (SELECT 'doc_' || doc_id AS name, coalesce(uses, 0) AS usage_count,
  coalesce(pow(0.9e0, uses) + gain, 1e0) AS success_rate, coalesce(since, uses, 0) AS consecutive_failures, last_used_at
  FROM documents LEFT JOIN fold ON name = 'doc_' || doc_id)"""
STATE = "CASE WHEN opened_at IS NULL THEN 'closed' ELSE 'open' END"
RESET_EV = T.CIRCUIT.replace(
    "FROM events)",
    """FROM events LEFT JOIN (SELECT user_id, max(ts) AS reset_at FROM events WHERE event_type = 'signup' GROUP BY user_id)
  USING (user_id) WHERE reset_at IS NULL OR ts > reset_at)""",
    1,
)

QUERIES = {
    "fold_usage": (fold_usage, f"WITH {FOLDED} SELECT {FOLD_SHOWN}"),
    "apply_usage": (
        apply_usage,
        f"""WITH {LEARNED} SELECT name, usage_count, {T.rounded_sql("success_rate", 6)} AS success_rate, consecutive_failures,
        epoch_us(last_used_at) AS last_used_us FROM learned""",
    ),
    "apply_usage_parts": (
        apply_usage_parts,
        f"""WITH {T.PARTS}, attempts AS (SELECT (l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS attempt_id, name,
          l_shipdate AS ts, l_returnflag <> 'R' AS success FROM lineitem JOIN part_catalog ON part_key = l_partkey), {T.FOLD}
        SELECT c.name, usage_count + coalesce(uses, 0) AS usage_count,
          {T.rounded_sql("CASE WHEN uses IS NULL THEN success_rate ELSE success_rate * pow(0.9e0, uses) + gain END", 6)} AS success_rate,
          CASE WHEN uses IS NULL THEN consecutive_failures ELSE coalesce(since, consecutive_failures + uses) END AS consecutive_failures,
          coalesce(epoch_us(last_used_at), last_used_us) AS last_used_us FROM part_catalog c LEFT JOIN fold USING (name)""",
    ),
    "merge_folds": (merge_folds, f"WITH {FOLDED} SELECT {FOLD_SHOWN}"),
    "circuit_trace": (
        circuit_trace,
        f"WITH RECURSIVE {T.CIRCUIT} SELECT attempt_id, name, decision, {STATE} AS state, failures FROM trace",
    ),
    "circuit_state_at": (
        circuit_state_at,
        f"""WITH RECURSIVE {T.CIRCUIT}, last AS (SELECT * FROM trace WHERE t <= epoch_us(TIMESTAMP '2024-01-20 12:00:00')
          QUALIFY row_number() OVER (PARTITION BY name ORDER BY rn DESC) = 1)
        SELECT 'doc_' || doc_id AS name, CASE WHEN opened_at IS NULL THEN 'closed'
          WHEN epoch_us(TIMESTAMP '2024-01-20 12:00:00') - opened_at >= 43200000000 THEN 'half-open' ELSE 'open' END AS state,
          coalesce(failures, 0)::BIGINT AS failures FROM documents LEFT JOIN last ON name = 'doc_' || doc_id""",
    ),
    "tripped_circuits": (
        tripped_circuits,
        f"""WITH RECURSIVE {T.CIRCUIT}, last AS (SELECT * FROM trace
          QUALIFY row_number() OVER (PARTITION BY name ORDER BY rn DESC) = 1)
        SELECT name, failures, 'open' AS state FROM last WHERE opened_at IS NOT NULL""",
    ),
    "reset_circuits": (
        reset_circuits,
        f"WITH RECURSIVE {RESET_EV} SELECT attempt_id, name, decision, {STATE} AS state, failures FROM trace",
    ),
    "usage_after_circuit": (
        usage_after_circuit,
        f"""WITH RECURSIVE {T.CIRCUIT},
        attempts AS (SELECT attempt_id, name, make_timestamp(t) AS ts, decision = 'ok' AS success FROM trace), {T.FOLD}
        SELECT name, uses, {T.rounded_sql("gain", 6)} AS gain, since AS failures_since_success FROM fold""",
    ),
    "top_used": (
        top_used,
        f"""WITH {LEARNED} SELECT name, usage_count, floor(success_rate * 100 + 0.5e0)::BIGINT AS success_percent
        FROM learned WHERE usage_count > 0 ORDER BY usage_count DESC, name LIMIT 10""",
    ),
    "recently_used": (
        recently_used,
        f"""WITH {LEARNED} SELECT name, epoch_us(last_used_at) AS last_used_us FROM learned WHERE last_used_at IS NOT NULL
        ORDER BY last_used_at DESC, name LIMIT 5""",
    ),
    "unstable_entries": (
        unstable_entries,
        f"""WITH {LEARNED} SELECT name, consecutive_failures FROM learned WHERE consecutive_failures >= 2
        ORDER BY consecutive_failures DESC, name LIMIT 5""",
    ),
}
