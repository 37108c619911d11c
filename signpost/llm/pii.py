"""Personal data: patterns, and information-theoretic sanitisation of what gives them away.

Patterns find the protected entities. A term t reveals an entity e as far as they occur together in the corpus:
PMI(t, e) = log2(N n_te / (n_t n_e)) bits of the IC(e) = log2(N / n_e) bits that e holds, with counts over all distinct
texts. IC - PMI = log2(n_t / n_te) bits are left open, whatever the size of the corpus, so a term is judged by its share n_te / n_t: one
half leaves a bit, one leaves nothing. In a text that holds e, terms of a share of at least `remove_at` are removed, those from
`generalise_at` on are replaced by a general word. Entities of every frequency are looked at. Of fewer than `support` common
texts the share is smoothed by one more text, (n_te + n_e / N) / (n_t + 1), which stays below 1: few texts generalise a rare
word, and only `support` of them remove it. An entity of all texts holds no information. Texts without entities are left as
they are.

Offsets count code points; the end is exclusive. Hits of one kind do not overlap; of hits of several kinds that do, the
first by start, then kind, is masked and the others with it.

Defined cases: null and empty texts hold nothing; equal texts count once in the corpus and get equal spans; repeated rows
stay; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signpost.llm.common import lower_ascii, written

KINDS = ("email", "ip", "card", "phone")
SUPPORT = 5
GENERALISE_AT = 0.5
REMOVE_AT = 1.0
#: Bits of the bitmap of texts with copies, and of the parts it is put together from.
BITS, PART = 2**23, 2**15

# Possessive where nothing that follows could need a shorter match: the same matches, without deep recursion.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text with a hit has anywhere; texts without it are not cut up.
GUARDS = {
    "email": lambda text: text.contains("@"),
    "ip": lambda text: text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda text: text.rlike(r"(?:[0-9][\x20-]?){15}[0-9]"),
    "phone": lambda text: text.contains("+"),
}
HITS = "array<struct<start:int,end:int,value:string>>"


def pattern_hits(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches."""
    pairs = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"), F.split(text, pattern, -1).alias("gap")
    )
    return F.aggregate(
        F.filter(pairs, lambda p: p["hit"].isNotNull()),
        F.struct(F.lit(0).alias("at"), F.lit(None).cast(HITS).alias("hits")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["gap"]) + F.length(p["hit"])).alias("at"),
            F.concat(
                F.coalesce(acc["hits"], F.array().cast(HITS)),
                F.array(
                    F.struct(
                        (acc["at"] + F.length(p["gap"])).alias("start"),
                        (acc["at"] + F.length(p["gap"]) + F.length(p["hit"])).alias("end"),
                        p["hit"].alias("value"),
                    )
                ),
            ).alias("hits"),
        ),
        lambda acc: F.coalesce(acc["hits"], F.array().cast(HITS)),
    )


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return acc + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _test(kind: str):
    return lambda hit: _counts(kind, hit)


def _counts(kind: str, hit: Column) -> Column:
    """Whether a match is a hit."""
    value = hit["value"]
    digits = _digits(value)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.cast("double") <= 255)
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), passes_luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def base_hits(docs: DataFrame) -> DataFrame:
    """doc_id, version (hash of the text), per kind the array of hits, and the text where there are any."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("version", F.xxhash64("text"))
    none = F.array().cast(HITS)
    found = d.select(
        "doc_id",
        "version",
        "text",
        *[F.when(GUARDS[k](F.col("text")), pattern_hits(F.col("text"), PATTERNS[k])).otherwise(none).alias(k) for k in KINDS],
    )
    hits = found.select("doc_id", "version", "text", *[F.filter(k, _test(k)).alias(k) for k in KINDS])
    return hits.withColumn("text", F.when(F.size(F.concat(*KINDS)) > 0, F.col("text")))


def placed_words(texts: DataFrame) -> DataFrame:
    """version, spans, term, start, end of the words of texts (version, text, spans) outside their spans."""
    flat = F.split(F.regexp_replace("text", r"[\x09-\x0D]", " "), " ", -1)
    rows = texts.select("version", "spans", F.posexplode(flat).alias("at", "word"))
    before = Window.partitionBy("version").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("word") + 1).over(before), F.lit(0)).cast("int")
    placed = rows.withColumn("start", start).where("word <> ''").withColumn("end", F.col("start") + F.length("word"))
    apart = ~F.exists("spans", lambda s: (s["start"] < F.col("end")) & (s["end"] > F.col("start")))
    term = F.regexp_replace(lower_ascii(F.col("word")), r"^\p{Punct}++|\p{Punct}++$", "")
    return placed.where(apart).withColumn("term", term).where("term <> ''").select("version", "term", "start", "end")


def _identity(kind: str):
    return lambda hit: F.xxhash64(F.lit(kind), hit["value"])


def _terms(text: Column) -> Column:
    """The distinct terms of a text."""
    flat = F.split(lower_ascii(text), r"[\x20\x09-\x0D]+", -1)
    return F.array_distinct(F.transform(F.array_distinct(flat), lambda w: F.regexp_replace(w, r"^\p{Punct}++|\p{Punct}++$", "")))


def has_copies(copies: DataFrame) -> Column:
    """Whether `version` may be one of the `copies(version)`: a test against a bitmap of their hashes, of BITS / 8 bytes
    whatever their number. All copies pass, and of other texts about the share of bits that are set."""
    bit = lambda v: F.pmod(v, F.lit(BITS))
    parts = copies.select(bit(F.col("version")).alias("bit")).groupBy((F.col("bit") / PART).cast("int").alias("part"))
    out = bytearray(BITS // 8)
    for row in parts.agg(F.bitmap_construct_agg(F.col("bit") % PART).alias("bits")).collect():
        out[row.part * PART // 8 : (row.part + 1) * PART // 8] = row.bits
    bitmap = copies.sparkSession.createDataFrame([(out,)], "bits binary").scalar()
    place = bit(F.col("version"))
    byte = F.conv(F.hex(F.substring(bitmap, (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("getbit", byte, (place % 8).cast("int")) == 1


def text_counts(docs: DataFrame, base: DataFrame) -> DataFrame:
    """term, n_t: distinct texts that hold the term.

    All rows are counted, each task's sums before the exchange, and what copies of a text count too much is taken off: only texts
    that have copies are exchanged, once each.
    """
    # the outer form: else Spark filters on the array's size first, and computes it twice
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("version", F.xxhash64("text"))
    copies = written(base.groupBy("version").agg((F.count(F.lit(1)) - 1).alias("extra")).where("extra > 0"), "copies")
    every = rows.select(F.explode_outer(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    held = rows.where(has_copies(copies)).groupBy("version").agg(F.min("text").alias("text")).join(copies, "version")
    extra = held.select("extra", F.explode_outer(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.sum("extra").alias("extra"))
    return every.join(extra, "term", "left").select("term", (F.col("n") - F.coalesce("extra", F.lit(0))).alias("n_t"))


def revealing_terms(
    docs: DataFrame, base: DataFrame, *, support: int, generalise_at: float
) -> DataFrame:
    """version, start, end, share of the words that give an entity of their text away."""
    n_texts = base.select("version").distinct().count()
    spans = F.concat(*KINDS)
    held = base.where(F.size(spans) > 0).groupBy("version").agg(
        F.first(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))).alias("spans"),
        F.first(F.array_distinct(F.concat(*[F.transform(k, _identity(k)) for k in KINDS]))).alias("entities"),
        F.first("text").alias("text"),
    )
    held = written(held, "entity-texts")
    owned = held.select("version", F.explode("entities").alias("entity"))
    # entities of the same texts are told by the same terms: one of them stands for all
    mark = F.xxhash64(F.lit("second"), "version")
    entities = (
        owned.groupBy("entity")
        .agg(F.count(F.lit(1)).alias("n_e"), F.bit_xor("version").alias("v1"), F.bit_xor(mark).alias("v2"))
        .groupBy("n_e", "v1", "v2").agg(F.min("entity").alias("entity"))
        .select("entity", "n_e")
    )
    owned = written(owned.join(entities, "entity"), "entities")
    placed = written(placed_words(held), "entity-words")
    pairs = placed.groupBy("version").agg(F.collect_set("term").alias("terms")).join(owned, "version").select(
        "version", "entity", "n_e", F.explode("terms").alias("term")
    )
    together = pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_te"), F.first("n_e").alias("n_e"))
    together = written(together, "together")
    # how many of all distinct texts hold each of these terms
    terms = together.select("term").distinct()
    # an inner join: a semi join would be moved below the counting
    frequency = text_counts(docs, base).join(terms, "term").where("n_t > 0")
    # few common texts count with one text more that holds the term, and the entity as often as any text does
    chance = F.col("n_e") / F.lit(float(max(n_texts, 1)))
    told_by = F.when(F.col("n_te") >= support, F.col("n_te") / F.col("n_t").cast("double")).otherwise(
        (F.col("n_te") + chance) / (F.col("n_t") + 1.0)
    )
    held_bits = -F.log2(chance)
    told = (
        together.join(frequency, "term")
        .withColumn("share", F.when(held_bits > 0, told_by))
        .where(F.col("share") >= generalise_at - 1e-9)
        .select("entity", "term", "share")
    )
    # by (entity, term), never by the entity alone: an entity of many texts has many terms
    reveals = pairs.join(told, ["entity", "term"]).groupBy("version", "term").agg(F.max("share").alias("share"))
    return placed.join(reveals, ["version", "term"]).select("version", "start", "end", "share")


def find_personal_data(
    docs: DataFrame, *, support: int = SUPPORT, generalise_at: float = GENERALISE_AT
) -> DataFrame:
    """doc_id, version, per kind the array of hits, and `terms`: array<struct<start, end, share>> in order."""
    base = written(base_hits(docs), "base-hits")
    terms = revealing_terms(docs, base, support=support, generalise_at=generalise_at)
    by_text = terms.groupBy("version").agg(F.array_sort(F.collect_list(F.struct("start", "end", "share"))).alias("terms"))
    none = F.array().cast("array<struct<start:int,end:int,share:double>>")
    return base.drop("text").join(by_text, "version", "left").withColumn("terms", F.coalesce("terms", none))


def sanitise(docs: DataFrame, found: DataFrame, *, remove_at: float = REMOVE_AT) -> DataFrame:
    """doc_id and `sanitised`: entities as [EMAIL] and so on, revealing terms as [TERM] or removed."""
    marks = [F.transform(k, _masked(k)) for k in KINDS]
    removed = lambda h: F.when(h["share"] >= remove_at - 1e-9, "").otherwise("[TERM]")
    marks.append(F.transform("terms", lambda h: _mark(h, removed(h))))
    spans = found.select("doc_id", "version", F.array_sort(F.concat(*marks)).alias("marks")).dropDuplicates(["doc_id", "version"])
    t = docs.select(F.col("doc_id").alias("i"), F.coalesce("text", F.lit("")).alias("text")).withColumn("v", F.xxhash64("text"))
    both = t.join(spans, F.col("i").eqNullSafe(F.col("doc_id")) & (F.col("v") == F.col("version")))
    rest = F.aggregate(
        "marks",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, m: F.when(
            m["start"] >= acc["at"],
            F.struct(
                m["end"].alias("at"),
                F.concat(
                    acc["out"],
                    F.array(F.substring("text", acc["at"] + 1, m["start"] - acc["at"]), m["mask"]),
                ).alias("out"),
            ),
        ).otherwise(F.struct(F.greatest(acc["at"], m["end"]).alias("at"), acc["out"].alias("out"))),
    )
    return both.withColumn("rest", rest).select(
        F.col("i").alias("doc_id"),
        F.concat(
            F.array_join("rest.out", ""), F.substring("text", F.col("rest.at") + 1, F.length("text"))
        ).alias("sanitised"),
    )


def _masked(kind: str):
    return lambda hit: _mark(hit, F.lit(f"[{kind.upper()}]"))


def _mark(hit: Column, mask: Column) -> Column:
    return F.struct(hit["start"].alias("start"), hit["end"].alias("end"), mask.alias("mask"))


def span_text(kind: str, hits: Column) -> Column:
    """kind:start:end of the hits, as an array."""
    return F.transform(hits, lambda h: F.concat_ws(":", F.lit(kind), h["start"].cast("string"), h["end"].cast("string")))
