"""Benchmark decontamination by SimHash of item-sized windows.

Words are lower-cased (A-Z) and hashed five at a time; an item with fewer words is one shingle. A window of a document has
as many shingles as the item it is held against (the whole document if it has fewer). Sliding a window right to its first
shared shingle never loses one, so the best window starts at a shingle the item has, or ends with the document: these
windows are fingerprinted, and no other can be better. The fingerprint is a 64-bit SimHash, each shingle weighted by its
count. It is cut into 13 blocks; the items' blocks are indexed with all one-bit neighbours. A pair that shares no index
entry differs by two bits in every block, so every pair within radius 25 is found. A window of similarity 0.8 differs in
10 bits on average, with a deviation of 3: 25 is missed once in some ten million. That holds for many different shingles;
where few rule the counts, one more or less of them turns half of the bits, so windows held against an item that repeats
shingles are candidates at any distance. Candidates are
verified by the exact weighted similarity: shared shingle counts over all shingle counts.

Windows of equal content are fingerprinted and verified once, however many documents hold them.

Defined cases: null and empty texts and items without words match nothing; a document of fewer words than an item's
shingles matches only an item of its own words; rows of one id and text count once, rows of one id with other texts are
looked at each; equal similarities give the first window; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signpost.llm.common import lower_ascii, words, written

SHINGLE = 5
SIMILARITY = 0.8
BLOCKS = 13
RADIUS = 2 * BLOCKS - 1
#: Bits of each block: 64 = 12 * 5 + 4.
WIDTHS = [5] * 12 + [4]


def shingled(texts: DataFrame, k: int) -> DataFrame:
    """The input's columns but `text`, and `sh`: hashes of all runs of k words, in order; none for fewer words."""
    keys = [c for c in texts.columns if c != "text"]
    hashed = texts.select(*keys, F.transform(words(lower_ascii(F.col("text"))), lambda w: F.xxhash64(w)).alias("hw"))
    n = F.size("hw")
    starts = F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>"))
    spread = hashed.select(*keys, "hw", starts.alias("starts"))
    sh = F.transform("starts", lambda i: F.xxhash64(F.lit(k), *[F.get("hw", i + j) for j in range(k)]))
    return spread.select(*keys, sh.alias("sh"))


def simhash(window: Column) -> Column:
    """64 bits: bit b is set if more than half of the shingles have it. Two bits are counted in the halves of one long."""
    lanes = F.transform(
        F.sequence(F.lit(0), F.lit(31)),
        lambda i: F.aggregate(
            window,
            F.lit(0).cast("long"),
            lambda acc, h: acc + F.call_function("shiftrightunsigned", h, i).bitwiseAND(F.lit(4294967297)),
        ),
    )
    n = F.size(window)
    bits = F.transform(
        lanes,
        lambda x, i: F.call_function(
            "shiftleft", (x.bitwiseAND(F.lit(4294967295)) * 2 > n).cast("long"), i
        ).bitwiseOR(
            F.call_function("shiftleft", (F.shiftrightunsigned(x, 32) * 2 > n).cast("long"), i + 32)
        ),
    )
    return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(b))


def blocks(fingerprint: Column) -> Column:
    """array<struct<block, value>> of the 13 blocks."""
    out, at = [], 0
    for i, width in enumerate(WIDTHS):
        value = F.shiftrightunsigned(fingerprint, at).bitwiseAND(F.lit(2**width - 1)).cast("int")
        out.append(F.struct(F.lit(i).alias("block"), value.alias("value")))
        at += width
    return F.array(*out)


def neighbours(fingerprint: Column) -> Column:
    """The blocks, and each with one bit turned."""
    out, at = [], 0
    for i, width in enumerate(WIDTHS):
        value = F.shiftrightunsigned(fingerprint, at).bitwiseAND(F.lit(2**width - 1)).cast("int")
        for turned in [0, *[2**b for b in range(width)]]:
            out.append(F.struct(F.lit(i).alias("block"), value.bitwiseXOR(F.lit(turned)).alias("value")))
        at += width
    return F.array(*out)


def shared_weight(window: Column, item: Column, item_repeats: Column) -> Column:
    """Sum over distinct shingles of the smaller of both counts."""
    count = lambda a, h: F.size(F.filter(a, lambda x: x == h))
    general = F.aggregate(
        F.array_intersect(window, item), F.lit(0), lambda acc, h: acc + F.least(count(window, h), count(item, h))
    )
    return F.when(item_repeats, general).otherwise(F.size(F.array_intersect(window, item)))


def _items(benchmark: DataFrame, k: int, shingle: int) -> DataFrame:
    """Items whose shingles have k words, with fingerprint and size."""
    n_words = F.size(words(F.col("text")))
    own = benchmark.select("item_id", "text").where(F.least(n_words, F.lit(shingle)) == k).distinct()
    items = shingled(own, k).select(
        "item_id",
        F.col("sh").alias("item_sh"),
        F.size("sh").alias("n"),
        simhash(F.col("sh")).alias("item_fp"),
        (F.size(F.array_distinct("sh")) < F.size("sh")).alias("repeats"),
    )
    return written(items, "benchmark-items")


def contaminated(
    docs: DataFrame, benchmark: DataFrame, *, shingle: int = SHINGLE, similarity: float = SIMILARITY
) -> DataFrame:
    """doc_id, version (hash of the text), item_id, similarity, word_start, n_words of the best window, for pairs that reach it."""
    lengths = F.least(F.size(words(F.col("text"))), F.lit(shingle))
    # at most `shingle` values
    ks = sorted(r.k for r in benchmark.select(lengths.alias("k")).where("k > 0").distinct().collect())
    found = None
    for k in ks or [shingle]:
        one = _matches(docs, _items(benchmark, k, shingle), k, similarity)
        found = one if found is None else found.unionAll(one)
    return found


def _matches(docs: DataFrame, items: DataFrame, k: int, similarity: float) -> DataFrame:
    d = docs.select("doc_id", F.xxhash64("text").alias("version"), "text")
    known = items.select("item_id", "n", F.explode(F.array_distinct("item_sh")).alias("h"))
    # The outer form: else Spark filters on the array's size first, and computes it twice. Rows without h join nothing.
    hits = written(
        shingled(d, k)
        .select("doc_id", "version", F.size("sh").alias("total"), F.posexplode_outer("sh").alias("pos", "h"))
        .join(known, "h")
        .select("doc_id", "version", "item_id", "n", F.greatest(F.lit(0), F.least("pos", F.col("total") - F.col("n"))).alias("start"))
        .distinct(),
        "benchmark-hits",
    )
    holders = hits.select(F.col("doc_id").alias("i"), F.col("version").alias("v")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("version") == F.col("v"))
    # by exchange at every size, so that the cost follows the input; the text is never sorted for it
    texts = d.join(holders.hint("shuffle_hash"), same, "left_semi").dropDuplicates(["doc_id", "version"])
    t, h = shingled(texts, k).alias("t"), hits.alias("h")
    windows = h.join(t, F.expr("t.doc_id <=> h.doc_id and t.version = h.version")).select(
        "h.*", F.slice("t.sh", F.col("h.start") + 1, F.col("h.n")).alias("window")
    )
    windows = windows.withColumn("content", F.struct(F.xxhash64("window").alias("c1"), F.xxhash64(F.lit("second"), "window").alias("c2")))
    windows = written(windows, "benchmark-windows")
    distinct = windows.select("item_id", "content", "window").dropDuplicates(["item_id", "content"])
    printed = written(distinct.withColumn("fp", simhash(F.col("window"))), "benchmark-fingerprints")
    entries = printed.select("item_id", "content", "fp", F.explode(blocks(F.col("fp"))).alias("b"))
    index = items.select("item_id", "item_fp", F.explode(neighbours(F.col("item_fp"))).alias("e"))
    near = (
        entries.select("item_id", "content", "fp", "b.block", "b.value")
        .join(index.select("item_id", "item_fp", "e.block", "e.value"), ["item_id", "block", "value"])
        .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
        .select("item_id", "content")
    )
    periodic = printed.join(items.where("repeats").select("item_id"), "item_id").select("item_id", "content")
    near = near.unionAll(periodic).distinct()
    shared = shared_weight(F.col("window"), F.col("item_sh"), F.col("repeats"))
    verified = (
        printed.join(near, ["item_id", "content"])
        .join(items.select("item_id", "item_sh", "repeats"), "item_id")
        .withColumn("shared", shared)
        .withColumn("similarity", F.col("shared") / (F.size("window") + F.size("item_sh") - F.col("shared")))
        .where(F.col("similarity") >= similarity)
        .select("item_id", "content", "similarity", (F.size("window") + k - 1).alias("n_words"))
    )
    placed = windows.select("doc_id", "version", "item_id", "content", "start").join(verified, ["item_id", "content"])
    best = F.min(F.struct((-F.col("similarity")).alias("s"), F.col("start").alias("start"), "n_words"))
    return placed.groupBy("doc_id", "version", "item_id").agg(best.alias("best")).select(
        "doc_id",
        "version",
        "item_id",
        (-F.col("best.s")).alias("similarity"),
        F.col("best.start").cast("long").alias("word_start"),
        F.col("best.n_words").cast("long").alias("n_words"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that match no item, with their columns, whatever they are called."""
    hit = contaminated(docs, benchmark, **options).select(F.col("doc_id").alias("hit_id"), F.col("version").alias("hit_version")).distinct()
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("doc_id").alias("own_id"),
        F.xxhash64("text").alias("own_version"),
    )
    left = rows.join(hit, F.col("own_id").eqNullSafe(F.col("hit_id")) & (F.col("own_version") == F.col("hit_version")), "left_anti")
    return left.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
