"""N-gram Jaccard join by universe partitioning.

A document is the set of its k-word shingles. Two sets of sizes l <= s with similarity t differ in at most
(1 - t) / (1 + t) * (l + s) shingles. Sizes fall into bands; for each band the universe of shingles is cut by hash into one
segment more than sets of the band may differ from larger partners. By the pigeonhole principle such a pair has an equal
segment, and more generally, whatever allocation of 0 (skip), 1 (equal) or 2 (one shingle more or less at most) to the
segments adds up to their number, the pair meets in one of them. A set is indexed in the scheme of its own band and looked
up in that and the next smaller one.

1. Sets of equal content are one class, known by their fingerprint. Segments without a shingle are allotted 0: a band has a
   few segments more to make up for them, and a set with more empty ones than that is indexed by these too. The signatures
   of the others are exchanged once; those of one class alone end there.
2. Signatures held by several classes give each class a hub it shares most of them with. These pairs are verified exactly:
   linked classes form components, classes of half the similarity asked for, or more, form groups.
3. Pairs within a group are told by what differs from the group's core, the shingles that more than half of it hold:
   x ^ y = (x ^ core) ^ (y ^ core). All pairs whose differences are small enough by their sizes alone are linked through
   the class of largest slack; any other pair must share enough of its differences, so only the rarest of them are
   indexed. No pair of a group is formed but those that share one of these.
4. Signatures that classes of several groups share give candidates: all pairs of different groups where few classes hold
   the signature beside its largest group, which are at most as many for each holder. Other signatures are crowded.
5. A class that has enough segments with a shingle outside crowded signatures shares one of these with each partner. Classes
   with fewer are short and are partitioned anew: segments are indexed with all their one-deletion neighbours, the candidates
   behind each segment are counted, and each class allots its own segments at the least cost, so that it avoids those it
   shares with a large group. A pair that shares crowded signatures alone is short on both sides. Candidates of other groups
   are verified exactly.
6. Before a pair is verified its sketches are compared: the parities of the counts of shingles in some cells, two to four for
   each shingle. Parities that differ are no more than shingles that differ, so no pair that links is lost; whole sets, some
   twenty times as long, are read only for the classes of pairs that remain.

Shingles, classes and signatures are 64-bit hashes; apart from their collisions the join is exact.

Defined cases: a text of fewer than k words is one shingle; null, empty and wordless texts have no shingles and no links,
component_id is their own doc_id; equal texts are linked; rows without doc_id take part, but a component takes its name
from the others; repeated rows stay; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signpost.llm.common import words, written
from signpost.llm.components import components

#: Similarity as a fraction, so that every bound is a whole number.
NUMERATOR, DENOMINATOR = 9, 10
SHINGLE = 3
#: Classes behind a signature, beside those of its largest group, up to which all its pairs of different groups are candidates.
CROWD = 32
#: Rows per output batch of the signature pass, in documents.
SLICE = 256


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising mixer of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of k-word shingles; words are split at ASCII white space, A-Z lower-cased."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    if not len(h):
        return h
    width = min(k, len(h))
    n = len(h) - width + 1
    out = np.full(n, width, np.uint64)
    for j in range(width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
    return np.unique(out)


def fingerprint(tokens: np.ndarray) -> int:
    """64 bits that depend on the set alone."""
    with np.errstate(over="ignore"):
        total = mix(tokens).sum(dtype=np.uint64) + np.uint64(len(tokens))
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


class Bands:
    """Size bands up to any size, and the segments of each."""

    def __init__(self, num: int = NUMERATOR, den: int = DENOMINATOR, top: int = 2**40):
        lows, highs = [], []
        low = 1
        while low <= top:
            high = low * den // num
            lows.append(low)
            highs.append(high)
            low = high + 1
        self.num, self.den = num, den
        self.lows = np.array(lows, np.int64)
        # the largest difference between a set of the band and a larger partner, plus one: segments to be allotted
        self.needed = [(h + h * den // num) * (den - num) // (den + num) + 1 for h in highs]
        self.segments = [self.with_empty(need, low) for need, low in zip(self.needed, lows, strict=True)]

    @staticmethod
    def with_empty(need: int, size: int) -> int:
        """Segments of which `need` hold a shingle, as a rule, in a set of this size; one where only equal sets link."""
        if need == 1:
            return 1
        m = float(need)
        for _ in range(8):
            empty = m * np.exp(-size / m)
            m = min(need + empty + 3 * np.sqrt(empty), 2.0 * need)
        return int(np.ceil(m))

    def of(self, size: int) -> int:
        return int(np.searchsorted(self.lows, size, side="right")) - 1

    def schemes(self, size: int) -> list[int]:
        """The own band, and the next smaller one if it may hold a partner."""
        band = self.of(size)
        smaller = band > 0 and (self.lows[band] - 1) * self.den >= size * self.num
        return [band, band - 1] if smaller else [band]


def segment_sums(tokens: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment of each token, and per segment the sum of its tokens' hashes."""
    seg = ((tokens >> np.uint64(20)) % np.uint64(m)).astype(np.int64)
    sums = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        np.add.at(sums, seg, mix(tokens ^ np.uint64(0x5851F42D4C957F2D)))
    return seg, sums


def signatures(sums: np.ndarray, scheme: int, seg: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        place = mix(np.uint64(scheme + 1) * np.uint64(0xD6E8FEB86659FD93) + seg.astype(np.uint64))
        return mix(sums + place).view(np.int64)


def sketch(tokens: np.ndarray) -> bytes:
    """Parity of the number of tokens in each cell; cells are a power of two, so that a sketch folds to a shorter one."""
    cells = max(64, 1 << (2 * len(tokens) - 1).bit_length())
    with np.errstate(over="ignore"):
        place = mix(tokens ^ np.uint64(0xA0761D6478BD642F)) & np.uint64(cells - 1)
    return np.packbits(np.bincount(place.astype(np.int64), minlength=cells) & 1, bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the size of the symmetric difference of two sets, from their sketches."""
    bits = 8 * min(len(a), len(b))
    x = int.from_bytes(a, "little") ^ int.from_bytes(b, "little")
    width = 8 * max(len(a), len(b))
    while width > bits:
        width //= 2
        x = (x >> width) ^ (x & ((1 << width) - 1))
    return x.bit_count()


def spare_segments(tokens: np.ndarray, bands: Bands) -> int:
    """Segments with a shingle beyond those needed, in the scheme where they are fewest."""
    spare = []
    for scheme in bands.schemes(len(tokens)) if len(tokens) else []:
        m = bands.segments[scheme]
        if m > 1:
            seg = (tokens >> np.uint64(20)) % np.uint64(m)
            spare.append(int((np.bincount(seg.astype(np.int64), minlength=m) > 0).sum()) - bands.needed[scheme])
    return min(spare, default=0)


def _set_rows(bands: Bands, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with np.errstate(over="ignore"):
            for b in batches:
                sets = [(len(t), fingerprint(t), spare_segments(t, bands), sketch(t)) for t in (shingle_set(text, k) for text in b["text"])]
                n, fp, spare, bits = zip(*sets, strict=True) if sets else ((), (), (), ())
                ids = {"doc_id": b["doc_id"].array, "version": b["version"].array}
                yield pd.DataFrame(ids | {"n": n, "fp": fp, "spare": spare, "sketch": bits})

    return run


def class_signatures(tokens: np.ndarray, bands: Bands) -> np.ndarray:
    """Signatures of a set in its schemes: of its segments with a shingle, and where these are too few of the others too."""
    found = []
    for scheme in bands.schemes(len(tokens)) if len(tokens) else []:
        m = bands.segments[scheme]
        # one segment: only equal sets, which are one class, agree
        if m > 1:
            seg, sums = segment_sums(tokens, m)
            held = np.flatnonzero(np.bincount(seg, minlength=m))
            held = held if len(held) >= bands.needed[scheme] else np.arange(m)
            found.append(signatures(sums[held], scheme, held))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _signature_rows(bands: Bands, k: int):
    """Signatures with their class, once per class and task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = set()
        with np.errstate(over="ignore"):
            for b in batches:
                for at in range(0, len(b), SLICE):
                    fps, sigs = [], []
                    for text in b["text"].iloc[at : at + SLICE]:
                        tokens = shingle_set(text, k)
                        fp = fingerprint(tokens)
                        if fp not in seen:
                            seen.add(fp)
                            fps.append(fp)
                            sigs.append(class_signatures(tokens, bands))
                    if fps:
                        owners = np.repeat(np.array(fps, np.int64), [len(x) for x in sigs])
                        yield pd.DataFrame({"sig": np.concatenate(sigs), "fp": owners})

    return run


def _token_rows(k: int):
    """Sets of the texts that have the fingerprint `fp`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with np.errstate(over="ignore"):
            for b in batches:
                for at in range(0, len(b), SLICE):
                    sets = [shingle_set(t, k) for t in b["text"].iloc[at : at + SLICE]]
                    held = [(fp, s.view(np.int64)) for fp, s in zip(b["fp"].iloc[at : at + SLICE], sets, strict=True) if fingerprint(s) == fp]
                    yield pd.DataFrame({"fp": [fp for fp, _ in held], "tokens": [s for _, s in held]})

    return run


def _likely_rows(num: int, den: int):
    """Pairs whose sketches leave a similarity of num / den possible."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            apart = [least_difference(x, y) for x, y in zip(b["sa"], b["sb"], strict=True)]
            kept = np.array(apart, np.int64) * (den + num) <= b["sizes"].to_numpy() * (den - num)
            yield b.loc[kept, ["a", "b"]]

    return run


def _neighbour_rows(bands: Bands):
    """Segments of a class in the schemes where it is short: index or probe, scheme, segment, signature, one-deletion
    signatures. `crowded` are those of its signatures that are crowded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with np.errstate(over="ignore"):
            for b in batches:
                for fp, n, tokens, crowded in zip(b["fp"], b["n"], b["tokens"], b["crowded"], strict=True):
                    tokens = np.asarray(tokens).view(np.uint64)
                    for role, scheme in enumerate(bands.schemes(n)):
                        m = bands.segments[scheme]
                        if m == 1:
                            continue
                        seg, sums = segment_sums(tokens, m)
                        sigs = signatures(sums, scheme, np.arange(m))
                        full = np.bincount(seg, minlength=m) > 0
                        shut = np.isin(sigs, np.asarray(crowded))
                        if not shut.any() or (full & ~shut).sum() >= bands.needed[scheme]:
                            continue
                        less = sums[seg] - mix(tokens ^ np.uint64(0x5851F42D4C957F2D))
                        gone = signatures(less, scheme, seg)
                        order = np.argsort(seg, kind="stable")
                        cuts = np.searchsorted(seg[order], np.arange(m + 1))
                        gone = gone[order]
                        yield pd.DataFrame(
                            {
                                "fp": fp,
                                "n": n,
                                "own": role == 0,
                                "scheme": scheme,
                                "seg": np.arange(m, dtype=np.int32),
                                "sig": sigs,
                                "gone": [gone[cuts[i] : cuts[i + 1]] for i in range(m)],
                            }
                        )

    return run


def allot(equal: np.ndarray, within_one: np.ndarray) -> np.ndarray:
    """0, 1 or 2 per segment, adding up to at least their number, at about the least cost (that of the allotted kind).

    Two units of a segment are bought one by one while the second costs no less than the first, and else at their mean
    price; the cheapest units are taken. Any allotment of this sum is exact, so only cost depends on the choice.
    """
    m = len(equal)
    second = within_one - equal
    whole = second < equal
    price = np.concatenate([np.where(whole, within_one / 2, equal), np.where(whole, within_one / 2, second)])
    owner = np.tile(np.arange(m), 2)
    rank = np.lexsort((np.repeat([0, 1], m), owner, price))[:m]
    out = np.bincount(owner[rank], minlength=m)
    out[whole & (out == 1)] = 2
    return out


def _allotments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for fp, scheme, costs in zip(b["fp"], b["scheme"], b["costs"], strict=True):
            seg = np.array([c["seg"] for c in costs])
            equal, within = (np.array([c[k] for c in costs], float) for k in ("equal", "within"))
            out = allot(equal, within)
            total = equal[out == 1].sum() + within[out == 2].sum()
            yield pd.DataFrame({"fp": fp, "scheme": scheme, "total": total, "seg": seg, "units": out})


def _compared(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """Pairs (a, b) with the size of their intersection, and the sum of their sizes."""
    size, both = F.size, F.array_intersect("ta", "tb")
    return (
        pairs.join(tokens.select(F.col("fp").alias("a"), F.col("tokens").alias("ta")), "a")
        .join(tokens.select(F.col("fp").alias("b"), F.col("tokens").alias("tb")), "b")
        .select("a", "b", size(both).cast("long").alias("shared"), (size("ta") + size("tb")).cast("long").alias("sizes"))
    )


def _likely(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that may have a similarity of num / den or more, by the sketches of their classes."""
    of = lambda x: classes.select(F.col("fp").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    rows = pairs.join(of("a"), "a").join(of("b"), "b")
    rows = rows.select("a", "b", "sa", "sb", (F.col("na").cast("long") + F.col("nb")).alias("sizes"))
    return rows.mapInPandas(_likely_rows(num, den), "a long, b long")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("fp")).unionAll(pairs.select(F.col("b").alias("fp"))).distinct()


def _similar(num: int, den: int) -> Column:
    return F.col("shared") * den >= (F.col("sizes") - F.col("shared")) * num


def _tokens_of(classes: DataFrame, sets: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Whole sets of the classes (column fp), read again from one text each."""
    key = lambda c: [F.col(c).isNull().alias("no_id"), F.coalesce(c, F.lit(0)).alias("id")]
    first = F.min(F.struct("version", F.col("doc_id").alias("holder"))).alias("first")
    holders = sets.select("fp", "version", "doc_id").join(classes, "fp", "left_semi").groupBy("fp").agg(first)
    holders = holders.select("fp", "first.version", *key("first.holder"))
    own = docs.select(F.xxhash64("text").alias("version"), *key("doc_id"), "text")
    # rows that come twice are told apart by nothing: the texts are exchanged once, their sets not at all
    rows = own.join(holders, ["version", "no_id", "id"]).dropDuplicates(["version", "no_id", "id", "fp"])
    return written(rows.select("fp", "text").mapInPandas(_token_rows(k), "fp long, tokens array<long>"), "class-tokens")


def _with_tokens(known: DataFrame, classes: DataFrame, sets: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """The known sets and those of further classes."""
    new = written(classes.join(known.select("fp"), "fp", "left_anti"), "further-classes")
    return known if new.isEmpty() else known.unionAll(_tokens_of(new, sets, docs, k))


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("comp", F.col("fp"))
    named = labels.select(F.col("node").alias("fp"), F.col("component").alias("known"))
    return rows.join(named, "fp", "left").withColumn("comp", F.coalesce("known", "fp")).drop("known")


def _short(crowded: DataFrame, classes: DataFrame) -> DataFrame:
    """fp, n and crowded signatures of classes (sig, fp, n) that have more of these than segments to spare; others have
    enough segments without."""
    # at most one signature for each segment of a class
    by_class = crowded.groupBy("fp", "n").agg(F.collect_list("sig").alias("crowded"))
    return by_class.join(classes.select("fp", "spare"), "fp").where(F.size("crowded") > F.col("spare")).drop("spare")


def _allotted_candidates(short: DataFrame, tokens: DataFrame, labels: DataFrame, bands: Bands) -> DataFrame:
    """Pairs (a, b) of these classes (fp, n, crowded), of different components and both short of segments beside their crowded
    signatures, that meet in an allotted segment."""
    rows = short.join(tokens, "fp").select("fp", "n", "tokens", "crowded")
    schema = "fp long, n int, own boolean, scheme int, seg int, sig long, gone array<long>"
    segs = written(_labelled(rows.mapInPandas(_neighbour_rows(bands), schema), labels), "class-segments")
    equal = segs.select("fp", "n", "comp", "own", "scheme", "seg", "sig", F.lit(False).alias("less"))
    less = segs.select("fp", "n", "comp", "own", "scheme", "seg", F.explode("gone").alias("sig"), F.lit(True).alias("less"))
    every = equal.unionAll(less)
    counts = every.groupBy("sig").agg(
        F.sum(F.when(F.col("less"), 0).otherwise(1)).alias("n_equal"),
        F.sum(F.when(F.col("less"), 1).otherwise(0)).alias("n_less"),
        F.min("comp").alias("low"),
        F.max("comp").alias("high"),
    )
    seen = every.join(counts, "sig")
    foreign = (F.col("low") != F.col("comp")) | (F.col("high") != F.col("comp"))
    cost = lambda c: F.when(foreign, F.col(c)).otherwise(0)
    costs = seen.groupBy("fp", "scheme", "seg").agg(
        F.sum(F.when(F.col("less"), 0).otherwise(cost("n_equal"))).alias("equal"),
        F.sum(F.when(F.col("less"), cost("n_equal")).otherwise(cost("n_equal") + cost("n_less"))).alias("within"),
    )
    filled = segs.select("fp", "scheme", "seg").join(costs, ["fp", "scheme", "seg"], "left").fillna(0, ["equal", "within"])
    # one class's segments: a tenth of its size
    by_class = filled.groupBy("fp", "scheme").agg(F.collect_list(F.struct("seg", "equal", "within")).alias("costs"))
    allotted = by_class.mapInPandas(_allotments, "fp long, scheme int, total double, seg int, units int")
    rows = written(every.join(allotted, ["fp", "scheme", "seg"]).drop("scheme", "seg"), "allotted-segments")
    probe = rows.where("units = 2 or (units = 1 and not less)")
    # of two classes the one with the cheaper allotment looks the other up; in a scheme of the smaller one's band
    meets = F.expr(
        f"""p.sig = i.sig and p.comp <> i.comp and (p.own or i.own) and (p.total < i.total or (p.total = i.total and p.fp < i.fp))
        and least(p.n, i.n) * {bands.den} >= greatest(p.n, i.n) * {bands.num}
        and (not i.less or (p.units = 2 and not p.less))"""
    )
    pairs = probe.alias("p").join(rows.alias("i"), meets)
    return pairs.select(F.greatest("p.fp", "i.fp").alias("a"), F.least("p.fp", "i.fp").alias("b")).distinct()


def _stars(shared: DataFrame) -> DataFrame:
    """(a, b): each class with the hub it shares most signatures with. The hub of a signature is the class among its
    holders that shares most with others, which in a group of near copies is one close to their origin."""
    sizes = shared.groupBy("sig").agg(F.count(F.lit(1)).alias("holders"))
    scores = shared.join(sizes, "sig").groupBy("fp").agg(F.sum("holders").alias("score"))
    ranked = shared.join(scores, "fp").select("sig", "fp", F.struct("score", "fp").alias("rank"))
    hubs = ranked.groupBy("sig").agg(F.max("rank").alias("top")).select("sig", F.col("top.fp").alias("hub"))
    votes = shared.join(hubs, "sig").where("fp <> hub").groupBy("fp", "hub").agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy("fp").agg(F.max(F.struct("votes", "hub")).alias("best"))
    return best.select(F.col("fp").alias("a"), F.col("best.hub").alias("b"))


def _several(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key is held by classes of several components (column comp)."""
    held = rows.groupBy(key).agg(F.min("comp").alias("x"), F.max("comp").alias("y"))
    return rows.join(held.where("x <> y").select(key), key, "left_semi")


def _flipped(array: str, other: str) -> Column:
    """Symmetric difference of two arrays without repeated elements."""
    return F.concat(F.array_except(array, other), F.array_except(other, array))


def _group_differences(groups: DataFrame, labels: DataFrame, tokens: DataFrame, num: int, den: int) -> DataFrame:
    """fp, grp, n, diff and slack for each class of a group that is not one component yet.

    diff is the class's symmetric difference with its group's core. Two classes link when their slacks and
    2 * (num + den) for each element that their differences share add up to 0 or more.
    """
    rows = groups.select(F.col("node").alias("fp"), F.col("component").alias("grp"))
    rows = _several(_labelled(rows, labels), "grp").select("fp", "grp")
    first = tokens.select(F.col("fp").alias("grp"), F.col("tokens").alias("base"))
    apart = rows.join(tokens.select("fp", "tokens"), "fp").join(first, "grp")
    apart = written(apart.select("fp", "grp", F.size("tokens").cast("long").alias("n"), _flipped("tokens", "base").alias("apart")), "apart")
    counts = apart.select("grp", F.explode("apart").alias("token")).groupBy("grp", "token").agg(F.count(F.lit(1)).alias("f"))
    most = counts.join(apart.groupBy("grp").agg(F.count(F.lit(1)).alias("members")), "grp").where("2 * f > members")
    # fewer than twice the mean difference of a group
    cores = most.groupBy("grp").agg(F.collect_list("token").alias("most"))
    every = apart.join(cores, "grp", "left").withColumn("most", F.coalesce("most", F.array().cast("array<long>")))
    every = every.select("fp", "grp", "n", _flipped("apart", "most").alias("diff"))
    slack = F.col("n") * (den - num) - F.size("diff") * F.lit(den + num)
    return written(every.withColumn("slack", slack.cast("long")), "differences")


def _slack_links(every: DataFrame, num: int, den: int) -> DataFrame:
    """Links of each class with the class of largest slack in its group."""
    top = every.groupBy("grp").agg(F.max(F.struct("slack", "fp")).alias("top")).select(F.col("top.fp").alias("fp"))
    tops = every.join(top, "fp", "left_semi").select("grp", F.col("fp").alias("b"), F.col("slack").alias("most"), F.col("diff").alias("other"))
    shared = F.size(F.array_intersect("diff", "other")) * F.lit(2 * (num + den))
    linked = every.join(tops, "grp").where((F.col("fp") != F.col("b")) & (F.col("slack") + F.col("most") + shared >= 0))
    return linked.select(F.col("fp").alias("a"), "b")


def _group_candidates(every: DataFrame, labels: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of one group and different components that share one of the rarest elements of their differences."""
    rows = _several(_labelled(every, labels), "grp")
    rows = written(rows.join(rows.groupBy("grp").agg(F.max("slack").alias("most")), "grp"), "open-differences")
    slim = rows.select("fp", "grp", "comp", "n", "slack", "most", F.size("diff").alias("len"), F.explode("diff").alias("token"))
    counts = slim.groupBy("grp", "token").agg(F.count(F.lit(1)).alias("f"))
    place = F.row_number().over(Window.partitionBy("fp").orderBy("f", "token"))
    unit = 2 * (num + den)
    # an element of one class alone keeps its place, but need not be looked up
    told = slim.join(counts, ["grp", "token"]).withColumn("place", place)
    told = told.where(f"f > 1 and place <= len + 1 - greatest(1, (-slack - most + {unit - 1}) div {unit})")
    told = written(told.select("fp", "grp", "comp", "n", "slack", "len", "token", "place"), "rarest-differences")
    overlap = f"greatest(1, (-x.slack - y.slack + {unit - 1}) div {unit})"
    meets = F.expr(
        f"""x.grp = y.grp and x.token = y.token and x.fp > y.fp and x.comp <> y.comp
        and least(x.n, y.n) * {den} >= greatest(x.n, y.n) * {num}
        and least(x.len - x.place, y.len - y.place) + 1 >= {overlap}"""
    )
    return told.alias("x").join(told.alias("y"), meets).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).distinct()


def _open_rows(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """sig, fp, n, comp, main (largest component of the signature) and rest (its classes of others), for signatures that
    several components share."""
    rows = _labelled(shared, labels)
    parts = rows.groupBy("sig", "comp").agg(F.count(F.lit(1)).alias("held"))
    counts = parts.groupBy("sig").agg(F.sum("held").alias("holders"), F.max(F.struct("held", "comp")).alias("top"))
    several = counts.select("sig", F.col("top.comp").alias("main"), (F.col("holders") - F.col("top.held")).alias("rest"))
    return rows.join(several.where("rest > 0"), "sig")


def _small_group_candidates(rows: DataFrame, bands: Bands) -> DataFrame:
    """Pairs (a, b) of different components that share a signature of at most CROWD classes beside its largest component."""
    few = rows.where(F.col("rest") <= CROWD).select("sig", "fp", "n", "comp", "main")
    # at most CROWD rows of a signature on the right
    x, y = few.alias("x"), few.where("comp <> main").alias("y")
    partners = F.expr(
        f"""x.sig = y.sig and x.comp <> y.comp and (x.comp = x.main or x.fp > y.fp)
        and least(x.n, y.n) * {bands.den} >= greatest(x.n, y.n) * {bands.num}"""
    )
    return x.join(y, partners).select(F.greatest("x.fp", "y.fp").alias("a"), F.least("x.fp", "y.fp").alias("b")).distinct()


def class_links(
    docs: DataFrame, num: int = NUMERATOR, den: int = DENOMINATOR, shingle: int = SHINGLE
) -> tuple[DataFrame, DataFrame]:
    """(doc_id, version, n, fp) per document, version being the hash of its text, and (node, component) of linked classes."""
    bands = Bands(num, den)
    held = docs.select("doc_id", F.xxhash64("text").alias("version"), "text")
    schema = "doc_id long, version long, n int, fp long, spare int, sketch binary"
    sets = written(held.mapInPandas(_set_rows(bands, shingle), schema), "shingle-sets")
    rows = docs.select("text").mapInPandas(_signature_rows(bands, shingle), "sig long, fp long")
    # one exchange: the least and the largest class of a signature stand beside its rows
    holders = Window.partitionBy("sig")
    several = rows.select("sig", "fp", F.min("fp").over(holders).alias("x"), F.max("fp").over(holders).alias("y"))
    several = written(several.where("x <> y").select("sig", "fp").distinct(), "several-holders")
    whole = sets.select("fp", "n", "spare", "sketch").join(several.select("fp").distinct(), "fp", "left_semi")
    classes = written(whole.dropDuplicates(["fp"]), "classes")
    shared = written(several.join(classes.select("fp", "n"), "fp").select("sig", "fp", "n"), "shared-signatures")
    stars = written(_likely(written(_stars(shared), "stars"), classes, num, 2 * den), "likely-stars")
    tokens = _tokens_of(_ends(stars), sets, docs, shingle)
    stars = written(_compared(stars, tokens), "compared-stars")
    links = stars.where(_similar(num, den)).select("a", "b")
    near = written(components(stars.where(_similar(num, 2 * den)).select("a", "b")), "groups")
    every = _group_differences(near, written(components(links), "labels"), tokens, num, den)
    links = written(links.unionAll(_slack_links(every, num, den)), "star-links")
    within = _group_candidates(every, written(components(links), "labels"), num, den)
    rows = written(_open_rows(shared, near), "open-rows")
    short = written(_short(rows.where(F.col("rest") > CROWD).select("sig", "fp", "n"), classes), "short-classes")
    tokens = _with_tokens(tokens, short.select("fp"), sets, docs, shingle)
    pairs = within.unionAll(_small_group_candidates(rows, bands)).unionAll(_allotted_candidates(short, tokens, near, bands))
    pairs = written(_likely(written(pairs.distinct(), "candidates"), classes, num, den), "likely-candidates")
    tokens = _with_tokens(tokens, _ends(pairs), sets, docs, shingle)
    more = _compared(pairs, tokens).where(_similar(num, den)).select("a", "b")
    links = written(links.unionAll(more), "all-links")
    return sets.select("doc_id", "version", "n", "fp"), written(components(links), "labels")


def jaccard_components(docs: DataFrame, num: int = NUMERATOR, den: int = DENOMINATOR, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    sets, labels = class_links(docs, num, den, shingle)
    rows = _labelled(sets, labels)
    named = rows.where("n > 0").groupBy(F.col("comp").alias("named")).agg(F.min("doc_id").alias("first_id"))
    return rows.join(named, (F.col("named") == F.col("comp")) & (F.col("n") > 0), "left").select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("first_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def one_per_component(docs: DataFrame, num: int = NUMERATOR, den: int = DENOMINATOR, shingle: int = SHINGLE) -> DataFrame:
    """One row of each group of linked rows, with its columns, whatever they are called; rows without shingles all stay.

    Rows are told apart by id and text, so texts that share an id are judged each. The row of smallest id stays (none last), of
    smallest text hash among rows of that id, of smallest hash of all columns among rows of that text.
    """
    sets, labels = class_links(docs, num, den, shingle)
    rows = _labelled(sets, labels).where("n > 0")
    # without id: after every id
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "version")
    heads = rows.groupBy("comp").agg(F.min(order).alias("head")).select(
        F.col("head.doc_id").alias("head_id"), F.col("head.version").alias("head_version")
    )
    wordless = F.size(words(F.col("text"))) == 0
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    # an id without null in two columns: join and aggregation deal rows alike, so that they are exchanged once
    key = lambda c: [F.col(c).isNull().alias("no_id"), F.coalesce(c, F.lit(0)).alias("id")]
    own = docs.select(every.alias("row"), *key("doc_id"), F.xxhash64("text").alias("version"), wordless.alias("wordless"))
    heads = heads.select(*key("head_id"), F.col("head_version").alias("version"))
    kept = own.where("not wordless").join(heads, ["no_id", "id", "version"], "left_semi")
    one = kept.groupBy("no_id", "id", "version").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    left = one.select("row").unionAll(own.where("wordless").select("row"))
    return left.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
