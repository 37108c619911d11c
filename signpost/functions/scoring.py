"""Column expressions used by the ranker."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from signpost import schema as S

MICROS_PER_DAY = 86_400_000_000.0


def round_half_up(x: Column, places: int = 2) -> Column:
    """Round with halves going up, also below zero (built-in `round` sends them away from zero)."""
    scale = F.lit(float(10**places))
    return F.floor(x * scale + F.lit(0.5)) / scale


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 when one is null, empty, all zero or of another length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.when(usable & (norms > 0), dot(a, b) / norms).otherwise(F.lit(0.0))


def recency_factor(last_used_at: Column, as_of: Column) -> Column:
    days = (F.unix_micros(as_of) - F.unix_micros(last_used_at)) / F.lit(MICROS_PER_DAY)
    return F.coalesce(F.exp(-days / F.lit(S.RECENCY_DAYS)), F.lit(1.0))


def usage_bonus(usage_count: Column, recency: Column) -> Column:
    return F.log2(F.coalesce(usage_count, F.lit(0)) + F.lit(1)) * F.lit(S.USAGE_WEIGHT) * recency


def success_bonus(success_rate: Column) -> Column:
    return F.coalesce(success_rate, F.lit(1.0))


def source_weight(source: Column, weights: Mapping[str, float] | None, match: str = "exact") -> Column:
    """Weight of a source, 1.0 when it has none.

    `match='prefix'` also lets the part before the first colon ("mcp" of "mcp:server") find a weight.
    """
    weight = F.lit(None).cast("double")
    if weights:
        pairs = [F.lit(v) for key, value in weights.items() for v in (key, float(value))]
        table = F.create_map(*pairs)
        weight = F.try_element_at(table, source)
        if match == "prefix":
            weight = F.coalesce(weight, F.try_element_at(table, F.substring_index(source, ":", 1)))
    return F.coalesce(weight, F.lit(1.0))
