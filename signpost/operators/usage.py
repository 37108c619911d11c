"""Learning from an attempt log: success rate, use count, last use, failures in a row.

The moving average has a closed form: after n events the rate is r0 * 0.9^n + sum(0.1 * success * 0.9^k), where k
counts the later events. So a log is folded by aggregation. It is dealt out by ranges of (name, time, attempt), which spread a key by its rows
whatever their times, and numbered in that order; blocks of consecutive numbers are added up before anything else is
exchanged, and the few blocks of a key then combined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signpost import schema as S

#: Attempts of a block at most. Weights within one differ by 0.9^1024, far from the limits of a double.
BLOCK_ROWS = 1024
KEEP = 1 - S.EMA_ALPHA


def decay(n: Column) -> Column:
    return F.pow(F.lit(KEEP), n.cast("double"))


def fold_usage(attempts: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """`attempts(attempt_id, name, ts, success)` -> one row per name.

    `uses` attempts, `gain` to add to the decayed old rate, `last_used_at`, and `failures_since_success`, null
    when the log has no success for the name. Order is (ts, attempt_id).
    """
    order = ["name", "ts", "attempt_id"]
    rows = attempts.select(*order, "success").repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = rows.withColumn("id", F.monotonically_increasing_id())
    # weights count from the block's last number, which need not be one of this key's
    block = F.floor(F.col("id") / F.lit(block_rows))
    to_end = (block + 1) * block_rows - 1 - F.col("id")
    blocks = (
        numbered.withColumns({"block": block, "weight": F.when(F.col("success"), decay(to_end)).otherwise(F.lit(0.0))})
        .groupBy("name", "block")
        .agg(
            F.count("*").alias("n"),
            F.max("id").alias("top"),
            F.sum("weight").alias("weight"),
            F.max("ts").alias("last"),
            F.max(F.when(F.col("success"), F.col("id"))).alias("last_success"),
        )
    )
    newer = Window.partitionBy("name").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    after = F.coalesce(F.sum("n").over(newer), F.lit(0))
    from_top = F.col("weight") / decay((F.col("block") + 1) * block_rows - 1 - F.col("top"))
    return (
        blocks.withColumn("after", after)
        .groupBy("name")
        .agg(
            F.sum("n").alias("uses"),
            F.sum(F.lit(S.EMA_ALPHA) * from_top * decay(F.col("after"))).alias("gain"),
            F.max("last").alias("last_used_at"),
            F.min(F.col("top") - F.col("last_success") + F.col("after")).alias("failures_since_success"),
        )
    )


def learned_rate(old_rate: Column, uses: Column, gain: Column) -> Column:
    return F.coalesce(old_rate, F.lit(1.0)) * decay(uses) + gain


def failures_in_a_row(old: Column, uses: Column, since_success: Column) -> Column:
    return F.coalesce(since_success, F.coalesce(old, F.lit(0)) + uses)


def apply_usage(catalog: DataFrame, folded: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Catalog with a folded log applied; attempts on unknown names are ignored."""
    now = F.current_timestamp() if as_of is None else as_of
    f = folded.select(
        "name", "uses", "gain", F.col("last_used_at").alias("_last"), F.col("failures_since_success").alias("_since")
    )
    used = F.col("uses").isNotNull()
    changed = {
        "usage_count": F.when(used, F.col("usage_count") + F.col("uses")).otherwise(F.col("usage_count")),
        "success_rate": F.when(
            used, learned_rate(F.col("success_rate"), F.col("uses"), F.col("gain"))
        ).otherwise(F.col("success_rate")),
        "consecutive_failures": F.when(
            used, failures_in_a_row(F.col("consecutive_failures"), F.col("uses"), F.col("_since"))
        ).otherwise(F.col("consecutive_failures")),
        "last_used_at": F.coalesce("_last", "last_used_at"),
        "updated_at": F.when(used, now).otherwise(F.col("updated_at")),
    }
    joined = catalog.join(f, "name", "left")
    return joined.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in catalog.columns])


def merge_folds(older: DataFrame, newer: DataFrame) -> DataFrame:
    """Fold of a longer log from the folds of two parts, `older` entirely before `newer`."""
    o, n = older.alias("o"), newer.alias("n")
    uses = F.coalesce("n.uses", F.lit(0))
    return o.join(n, F.col("o.name") == F.col("n.name"), "full_outer").select(
        F.coalesce("o.name", "n.name").alias("name"),
        (F.coalesce("o.uses", F.lit(0)) + uses).alias("uses"),
        (F.coalesce("o.gain", F.lit(0.0)) * decay(uses) + F.coalesce("n.gain", F.lit(0.0))).alias("gain"),
        F.coalesce("n.last_used_at", "o.last_used_at").alias("last_used_at"),
        F.coalesce(
            F.col("n.failures_since_success"), F.col("o.failures_since_success") + uses
        ).alias("failures_since_success"),
    )
