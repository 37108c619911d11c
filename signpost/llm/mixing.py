"""Mixing sources to target weights by a time-varying curriculum.

A schedule gives each source a weight that changes linearly within segments of training time [0, 1). Its integral is
the source's weight in the whole mix. Weights become word targets: the mix is `share` times all words, no source may be
asked for more than `max_repeats` times its own words, and what a capped source cannot give is shared out again by
weight. A source's documents stand in a fixed hashed order, repeated as often as the target asks; a copy whose middle
lies below the target is taken. The demand of a source up to time t is its target times the share of the integral
reached by t; inverting it at a copy's middle gives the copy's training position, by which the result is range-sorted.

Defined cases: a null text has size 0; a null source is a source of its own, sorted last; documents of size 0 are never
taken; repeated rows are separate documents in the same order on every run, since they can only tie when they are alike
in id and size; a source missing from the schedule weighs 0; an empty table gives an empty mix. Columns of the input
travel inside one struct, so no name of theirs can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signpost.llm.common import words, written

#: Hex digits of the order hash that name a bucket: a source is split over 4096 of them, however hot it is.
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def ramps(sources: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0)) -> DataFrame:
    """Schedule for a list of sources (one row each): weights repeat in code point order, null last.

    Every second source is front-loaded: its weight falls from 1.5 to 0.5 times its mean, the others' rises likewise.
    The list has one row per source, which is why one task may number it.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.lit(list(weights)), rank % len(weights))
    first = F.when(rank % 2 == 0, 1.5).otherwise(0.5)
    return sources.select(
        "source",
        F.lit(0.0).alias("start"),
        F.lit(1.0).alias("end"),
        (weight * first).alias("weight_start"),
        (weight * (2.0 - first)).alias("weight_end"),
    )


def _hashed(docs: DataFrame, key: str, source: str, size: Column) -> DataFrame:
    d = docs.select(
        F.col(source).alias("source"),
        F.col(key).alias("key"),
        size.alias("size"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
    )
    order = F.md5(F.concat_ws(":", F.col("key").cast("string"), F.col("size").cast("string")).cast("binary"))
    d = d.withColumn("order_hash", order).withColumn("bucket", F.substring("order_hash", 1, BUCKET_DIGITS))
    # one key of bucket and source, a null source included, for the window and the join alike
    return d.withColumn("slot", _slot(F.col("bucket"), F.col("source")))


def _slot(bucket: Column, source: Column) -> Column:
    """Text that no other bucket or source has: buckets are of one length, and a source stands after a sign."""
    return F.concat(bucket, F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("")))


def source_targets(sizes: DataFrame, schedule: DataFrame, share: float, max_repeats: float) -> DataFrame:
    """(source, source_size, target, total_weight, segments) from sizes per source and the schedule.

    The level that shares the rest out is found by repeated sums over the list of sources: a source whose level exceeds
    its limit is fixed there, until none is above. Only those sums reach the driver.
    """
    area = (F.col("end") - F.col("start")) * (F.col("weight_start") + F.col("weight_end")) / 2
    segment = F.struct("start", "end", "weight_start", "weight_end", area.alias("area"))
    plans = schedule.groupBy("source").agg(
        F.sum(area).alias("total_weight"), F.array_sort(F.collect_list(segment)).alias("segments")
    )
    s, p = sizes.alias("s"), plans.alias("p")
    joined = s.join(p, F.expr("s.source <=> p.source"), "left").select(
        "s.source",
        "s.source_size",
        F.coalesce("p.total_weight", F.lit(0.0)).alias("total_weight"),
        "p.segments",
    )
    joined = written(joined.withColumn("limit", F.col("source_size") * F.lit(float(max_repeats))), "mix-sources")
    total = (joined.agg(F.sum("source_size")).first()[0] or 0) * share
    level, fixed = 0.0, -1
    while True:
        full = (F.col("total_weight") * level >= F.col("limit")) if fixed >= 0 else F.lit(False)
        row = joined.agg(
            F.sum(F.when(full, 1).otherwise(0)).alias("n"),
            F.sum(F.when(full, F.col("limit")).otherwise(0.0)).alias("given"),
            F.sum(F.when(full, 0.0).otherwise(F.col("total_weight"))).alias("open"),
        ).first()
        if (row.n or 0) == fixed or not row.open:
            break
        fixed, level = row.n, (total - row.given) / row.open
    # no open weight left: every weighted source stands at its limit
    asked = F.col("total_weight") * level
    if row.n is not None and not row.open:
        asked = F.when(F.col("total_weight") > 0, F.col("limit")).otherwise(0.0)
    return joined.withColumn("target", F.least("limit", asked)).drop("limit")


def _position(fraction: Column) -> Column:
    """Time at which the demand of the row's source reaches this fraction: the integral of its schedule, inverted."""
    goal = fraction * F.col("total_weight")
    done = F.aggregate(
        "segments",
        F.struct(F.lit(0.0).alias("before"), F.lit(None).cast("double").alias("time")),
        lambda acc, seg: F.struct(
            (acc["before"] + seg["area"]).alias("before"),
            F.coalesce(
                acc["time"],
                F.when((goal - acc["before"] <= seg["area"]) & (seg["area"] > 0), _inside(goal - acc["before"], seg)),
            ).alias("time"),
        ),
    )["time"]
    return F.coalesce(done, F.element_at("segments", -1)["end"])


def _inside(rest: Column, seg: Column) -> Column:
    """Where a linear weight has gathered `rest`, from the segment's start; stable also for a constant weight."""
    slope = (seg["weight_end"] - seg["weight_start"]) / (seg["end"] - seg["start"])
    root = F.sqrt(F.greatest(F.lit(0.0), seg["weight_start"] * seg["weight_start"] + 2 * slope * rest))
    return F.when(rest <= 0, seg["start"]).otherwise(seg["start"] + 2 * rest / (seg["weight_start"] + root))


def plan_mix(
    docs: DataFrame,
    schedule_of=ramps,
    *,
    key: str = "doc_id",
    source: str = "source",
    size: Column | None = None,
    share: float = 1.5,
    max_repeats: float = 2.0,
) -> DataFrame:
    """One row per document: row (its columns), key, source, size, source_size, target, copies, positions (array).

    `schedule_of` makes the schedule from a DataFrame that lists the sources in column `source`.
    """
    size = word_count(F.col("text")) if size is None else size
    hashed = _hashed(docs, key, source, size)
    buckets = written(hashed.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")), "mix-buckets")
    sizes = buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    targets = source_targets(sizes, schedule_of(sizes.select("source")), share, max_repeats)
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = buckets.select(
        "source", "bucket", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("bucket_before")
    )
    t, b = targets.alias("t"), before.alias("b")
    placed = b.join(t, F.expr("b.source <=> t.source")).select("b.*", "source_size", "target", "total_weight", "segments")
    inside = Window.partitionBy("slot").orderBy("order_hash", "key", "size").rowsBetween(Window.unboundedPreceding, -1)
    h = hashed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("h")
    # whole rows are dealt out once, by slot
    q = placed.withColumn("slot", _slot(F.col("bucket"), F.col("source"))).alias("q")
    joined = h.join(q, F.col("h.slot") == F.col("q.slot")).select(
        "h.row", "h.key", "h.source", "h.size", "q.source_size", "q.target", "q.total_weight", "q.segments",
        (F.col("q.bucket_before") + F.col("h.inside")).alias("offset"),
    )
    # copy j is taken if its middle, j * source_size + offset + size / 2, lies below the target
    middle = F.col("offset") + F.col("size") / 2
    below = F.ceil((F.col("target") - middle) / F.col("source_size"))
    copies = F.when(F.col("size") > 0, F.greatest(F.lit(0), below)).otherwise(0).cast("int")
    spots = F.transform(
        F.when(F.col("copies") > 0, F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(F.array().cast("array<int>")),
        lambda j: _position((j * F.col("source_size") + F.col("offset") + F.col("size") / 2) / F.col("target")),
    )
    return (
        joined.withColumn("copies", copies)
        .withColumn("positions", spots)
        .select("row", "key", "source", "size", "source_size", "target", "copies", "positions")
    )


def mix_documents(docs: DataFrame, schedule_of=ramps, **options) -> DataFrame:
    """The mix itself: one row per taken copy, range-sorted by `mix_position`, then id and copy, with the input's columns.

    Input columns named mix_position or mix_copy are replaced by the operator's.
    """
    plan = plan_mix(docs, schedule_of, **options)
    copies = plan.select("row", "key", F.posexplode("positions").alias("mix_copy", "mix_position"))
    own = ("mix_position", "mix_copy")
    return copies.orderBy("mix_position", "key", "mix_copy").select(
        "mix_position", "mix_copy", *[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c.lower() not in own]
    )
