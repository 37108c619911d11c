"""Chat formatting: cumulative-snapshot collapse, then rendering.

A chat service that logs the whole history on every turn writes each conversation many times, as ever longer prefixes.
Every turn gets the hash of all turns up to it: the exclusive-or of 64-bit hashes of (place, role, text), twice with
different seeds. A conversation whose last hash is the hash of an earlier place of a longer one is a snapshot of it and
is removed by an anti-join; of equal conversations the smallest id stays. What remains is rendered.

A conversation may hold any share of the rows, and so may one turn number of it: all rows are dealt out by ranges of
(conversation, turn, role, text), equal ones by their place in the input. Places and hashes are summed up within such pieces
and then across them. A rendered conversation is one row per block of turn numbers (`part`), and more where a block has over
`most_rows` rows or `most_bytes` bytes, so nothing gathers it whole. Only texts of over `KEY` characters that share these,
conversation, turn and role stay in one piece.

Defined cases: turns are ordered by turn, then role, then text, nulls first; exactly repeated rows are separate turns;
a null turn number comes first; rows without conversation id are one conversation; null and empty text render alike but
are different turns; a null role renders as `unknown`; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signpost.llm.common import written

#: Turn numbers per block.
BLOCK = 256
#: Rows and bytes of a rendered row, up to its last turn.
MOST_ROWS = 4096
MOST_BYTES = 1 << 26
#: Characters of the text by which rows are dealt out.
KEY = 1024


def _same(names: tuple[str, ...], prefix: str):
    """Null-safe equality of columns with those of the other side, which carry the prefix."""
    both = [F.col(n).eqNullSafe(F.col(prefix + n)) for n in names]
    return reduce(lambda a, b: a & b, both)


def _prefixed(names: tuple[str, ...], prefix: str) -> list:
    return [F.col(n).alias(prefix + n) for n in names]


def rendered_turn():
    return F.concat(
        F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("<|end|>\n")
    )


def turn_hashes(
    turns: DataFrame, block: int = BLOCK, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES
) -> DataFrame:
    """conv_id, part, by_rows, by_bytes (together the rendered row), place (from 1), n_turns, h1 and h2 of all turns up to
    the place, role, text."""
    key = F.substring("text", 1, KEY)
    equal = F.when(F.coalesce(F.length("text"), F.lit(0)) <= KEY, F.monotonically_increasing_id()).otherwise(0)
    t = turns.select("conv_id", "turn", "role", "text").select("*", key.alias("key"), equal.alias("equal"))
    t = t.repartitionByRange("conv_id", "turn", "role", "key", "equal").select(
        "conv_id", F.floor(F.col("turn") / block).alias("part"), F.spark_partition_id().alias("piece"), "turn", "role", "text"
    )
    # written, since ranges are drawn anew whenever they are computed
    t = written(t, "chat-turns").withColumn("bytes", F.octet_length(rendered_turn()).cast("long"))
    piece = ("conv_id", "part", "piece")
    inside = Window.partitionBy(*piece).orderBy("turn", "role", "text")
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("inside", F.row_number().over(inside)).withColumn("up_to", F.sum("bytes").over(running))
    sizes = t.groupBy(*piece).agg(F.count(F.lit(1)).alias("rows"), F.sum("bytes").alias("bytes"))
    earlier = Window.partitionBy("conv_id").orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)
    in_part = Window.partitionBy("conv_id", "part").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    sizes = sizes.select(
        *_prefixed(piece, "s_"),
        F.coalesce(F.sum("rows").over(earlier), none).alias("turns_before"),
        F.coalesce(F.sum("rows").over(in_part), none).alias("part_rows"),
        F.coalesce(F.sum("bytes").over(in_part), none).alias("part_bytes"),
        F.sum("rows").over(Window.partitionBy("conv_id")).alias("n_turns"),
    )
    placed = t.join(sizes, _same(piece, "s_")).withColumn("place", F.col("turns_before") + F.col("inside"))
    content = ("place", F.isnull("role"), "role", F.isnull("text"), "text")
    placed = placed.withColumn("x1", F.xxhash64(*content)).withColumn("x2", F.xxhash64(F.lit("second"), *content))
    placed = placed.withColumn("r1", F.bit_xor("x1").over(running)).withColumn("r2", F.bit_xor("x2").over(running))
    parts = placed.groupBy(*piece).agg(F.bit_xor("x1").alias("p1"), F.bit_xor("x2").alias("p2"))
    parts = parts.select(
        *_prefixed(piece, "p_"),
        F.coalesce(F.bit_xor("p1").over(earlier), none).alias("b1"),
        F.coalesce(F.bit_xor("p2").over(earlier), none).alias("b2"),
    )
    hashed = placed.join(parts, _same(piece, "p_")).select(
        "conv_id",
        "part",
        F.floor((F.col("part_rows") + F.col("inside") - 1) / most_rows).alias("by_rows"),
        F.floor((F.col("part_bytes") + F.col("up_to") - F.col("bytes")) / most_bytes).alias("by_bytes"),
        "place",
        "n_turns",
        F.col("r1").bitwiseXOR(F.col("b1")).alias("h1"),
        F.col("r2").bitwiseXOR(F.col("b2")).alias("h2"),
        "role",
        "text",
    )
    return written(hashed, "chat-hashes")


def maximal_conversations(hashed: DataFrame) -> DataFrame:
    """Ids (conv_id) of conversations that are no prefix of a longer one, one of each set of equal ones."""
    whole = (
        hashed.where(F.col("place") == F.col("n_turns"))
        .groupBy("n_turns", "h1", "h2")
        # nulls count as larger than every id
        .agg(F.min("conv_id").alias("conv_id"))
    )
    inner = hashed.where(F.col("place") < F.col("n_turns")).select(
        F.col("place").alias("n_turns"), "h1", "h2"
    ).distinct()
    return whole.join(inner, ["n_turns", "h1", "h2"], "left_anti").select("conv_id", "n_turns")


def collapse_conversations(
    turns: DataFrame, block: int = BLOCK, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES
) -> DataFrame:
    """conv_id, part (from 0), n_turns (of the conversation), n_part_turns, rendered, for maximal conversations."""
    hashed = turn_hashes(turns, block, most_rows, most_bytes)
    keep = maximal_conversations(hashed).select(F.col("conv_id").alias("kept_id"))
    row = ("conv_id", "part", "by_rows", "by_bytes")
    # chosen and numbered before they meet their turns, so that no text is dealt out by conversation
    rows = hashed.groupBy(*row).agg(F.count(F.lit(1)).alias("n_part_turns"), F.max("n_turns").alias("n_turns"))
    rows = rows.join(keep, F.col("conv_id").eqNullSafe(F.col("kept_id")), "left_semi")
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("part", "by_rows", "by_bytes")) - 1
    rows = rows.select(*_prefixed(row, "k_"), number.cast("int").alias("number"), "n_turns", "n_part_turns")
    lines = hashed.groupBy(*row).agg(
        F.array_sort(F.collect_list(F.struct("place", rendered_turn().alias("line")))).alias("lines")
    )
    return lines.join(rows, _same(row, "k_")).select(
        "conv_id",
        F.col("number").alias("part"),
        "n_turns",
        "n_part_turns",
        F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("rendered"),
    )
