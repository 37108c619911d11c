"""Connected components of a link table by alternating large and small stars.

Every step is a join and an aggregation whose largest group is one node's links, summed up before the exchange; links and
labels stay in tables. Self-links and repeated links are harmless, nulls are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signpost.llm.common import written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Connect each node's larger (large) or smaller-or-equal (small) neighbours with the smallest of them and itself."""
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    # small: a > b holds, so a node's group is its smaller neighbours
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every linked node; the component is its smallest node. Columns a and b of `links` are its ends."""
    now = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = written(now, "links")
    mark = _mark(now)
    while mark[0]:
        now = written(_star(_star(now, True), False), "links")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
