"""Phrase collocation mining by HAT-trie counting.

Tasks count runs of words in a burstable trie: a shallow trie over word ids whose leaves are hash containers. A container holds the
paths between two prefixes, (word ids, count) in an open-addressing table filled in batches; one that grows too large bursts
into two at the word, or within one word at the next word, that parts it best. At its memory bound a task spills whole subtrees,
largest first, as sorted runs of (language, words) keys. All runs are written, dealt out by ranges of the key, so by prefix
and, within a prefix that many runs share, by what follows, and merged by sorting. A run is counted once with its longest
extent, as the count of a phrase is the sum over the keys that begin with it: neighbours in the merged order. Each batch of
that order gives the phrases counted within it and, whatever their count, the first and last prefix of each length, which may
go on in the next one; adding up the few parts of a phrase completes it.

One pass counts words, and one runs of two to five. A phrase found often enough has only words and pairs found as often, so
runs are cut at rare words and at pairs and triples that are surely rare. Which are frequent travels as bitmaps of fixed size:
that of words comes from their counts, that of pairs and triples from counts of their hashes, summed by hash over all tasks in a
pass between.
Keys of one hash cost an additional count and never a result.

Scores are whole numbers throughout (38 digits).

Defined cases: null and empty texts have no words; a null language is `und`, which a language of that name shares; equal texts
count each time; repeated rows too; doc_id is not used; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signpost.llm.common import LOWER, UPPER, written
from signpost.operators.windows import rank_within

LONGEST = 5
MIN_COUNT = 100
TOP = 2000
#: Entries of a container that bursts beyond, and of a task's tries before it spills.
BURST = 65_536
ENTRIES = 1_000_000
#: Paths that a container takes at once.
SLICE = 32_768
#: Words of a language that a task takes into its trie at once.
CHUNK = 500_000
#: Bits of a bitmap of frequent keys, and of the parts it is put together from.
BITS, PART = 2**26, 2**15
NO_LANGUAGE = "und"
RARE = -1
#: Bits of a word's place in a packed path; a task knows fewer words.
WIDTH = 21
MOST_WORDS = 2 * ENTRIES
#: Odd multipliers that spread hashes.
SPREAD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)

ENDS = b".,;:!?\n\x0b\x0c\r"
PIECES = bytes.maketrans(UPPER.encode() + b"\t" + ENDS, LOWER.encode() + b" " + b"\n" * len(ENDS))
WORDS = bytes.maketrans(UPPER.encode() + b"\t" + ENDS, LOWER.encode() + b" " + b" " * len(ENDS))
#: Stands between pieces as a word that no lower-cased text has.
BETWEEN = b" A "

RUNS = "key binary, n long"


def escaped(word: bytes) -> bytes:
    """The word without zero bytes, which part a key; order and distinctness stay."""
    return word.replace(b"\x01", b"\x01\x02").replace(b"\x00", b"\x01\x01") if b"\x00" in word or b"\x01" in word else word


class WordIds(dict):
    """Ids of one language's words, RARE for words that are not frequent."""

    def __init__(self, lang: bytes, frequent: bytes):
        super().__init__()
        self.lang, self.frequent, self.words, self.hashes = lang, frequent, [], []
        self[BETWEEN.strip()] = RARE

    def __missing__(self, word: bytes) -> int:
        own = escaped(word)
        bit = zlib.crc32(self.lang + b"\x00" + own) % BITS
        if self.frequent[bit >> 3] >> (bit & 7) & 1:
            self[word] = len(self.words)
            self.words.append(own)
            self.hashes.append(zlib.crc32(own))
        else:
            self[word] = RARE
        return self[word]

    def add_text(self, text: bytes, ids: list[int]) -> None:
        """Append the ids of a text's words, RARE between pieces."""
        ids.extend(map(self.__getitem__, text.translate(PIECES).replace(b"\n", BETWEEN).split()))
        ids.append(RARE)

    def bits(self, *ids: np.ndarray) -> np.ndarray:
        """Bits of runs of two or three ids; those of three lie behind those of two."""
        own = np.array(self.hashes, np.uint64)
        with np.errstate(over="ignore"):
            x = np.uint64(zlib.crc32(self.lang)) * SPREAD[2]
            for part in ids:
                x = (x ^ (x >> np.uint64(29))) * SPREAD[1] + own[part] * SPREAD[0]
            hashed = ((x ^ (x >> np.uint64(31))) * SPREAD[0] >> np.uint64(38)).astype(np.int64)
        return hashed + (len(ids) - 2) * BITS


class Container:
    """Paths between two prefixes as an open-addressing hash table: two packed halves of a path and a count."""

    def __init__(self, size: int = 1024):
        self.used = 0
        self.high, self.low, self.n = (np.zeros(size, np.int64) for _ in range(3))

    def add(self, high: np.ndarray, low: np.ndarray, n: np.ndarray) -> None:
        """Add paths, which may repeat."""
        for at in range(0, len(high), SLICE):
            part = slice(at, at + SLICE)
            self._grow(len(high[part]))
            self._put(high[part], low[part], n[part])

    def _grow(self, more: int) -> None:
        if 2 * (self.used + more) > len(self.n):
            old, size = self.entries(), len(self.n)
            while size < 2 * (self.used + more):
                size *= 2
            self.__init__(size)
            self._put(*old)

    def _put(self, high: np.ndarray, low: np.ndarray, n: np.ndarray) -> None:
        mask = len(self.n) - 1
        with np.errstate(over="ignore"):
            x = high.view(np.uint64) * SPREAD[0] + low.view(np.uint64) * SPREAD[1]
        slot = ((x ^ (x >> np.uint64(32))) & np.uint64(mask)).astype(np.int64)
        while len(slot):
            free = self.n[slot] == 0
            at = slot[free]
            # of several paths for a slot the last one takes it
            self.high[at], self.low[at] = high[free], low[free]
            self.n[at] = -1
            same = (self.high[slot] == high) & (self.low[slot] == low)
            taken = np.unique(at)
            self.used += len(taken)
            self.n[taken] = 0
            np.add.at(self.n, slot[same], n[same])
            left = ~same
            high, low, n, slot = high[left], low[left], n[left], (slot[left] + 1) & mask

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.n)
        return self.high[at], self.low[at], self.n[at]


class Trie:
    """Containers of word-id paths, ordered by the prefixes that part them; `starts` are the prefixes, packed."""

    def __init__(self, burst: int = BURST):
        self.starts, self.containers, self.burst = np.zeros(1, np.int64), [Container()], burst

    @property
    def entries(self) -> int:
        return sum(c.used for c in self.containers)

    def add(self, high: np.ndarray, low: np.ndarray, n: np.ndarray) -> None:
        place = np.searchsorted(self.starts, high, side="right") - 1
        order = np.argsort(place, kind="stable")
        high, low, n = high[order], low[order], n[order]
        cuts = np.searchsorted(place[order], np.arange(len(self.containers) + 1))
        full = []
        for i in np.flatnonzero(np.diff(cuts)):
            part = slice(cuts[i], cuts[i + 1])
            self.containers[i].add(high[part], low[part], n[part])
            if self.containers[i].used > self.burst:
                full.append(i)
        for i in reversed(full):
            self._burst(i)

    def _burst(self, i: int) -> None:
        """Part a container at the word boundary nearest to its middle, of the first word if that parts it, else of the next."""
        high, low, n = self.containers[i].entries()
        middle = np.sort(high)[len(high) // 2]
        for depth in (2, 1, 0):
            prefix = middle >> (depth * WIDTH) << (depth * WIDTH)
            for cut in (prefix, prefix + (1 << (depth * WIDTH))):
                left = high < cut
                if left.any() and not left.all():
                    halves = []
                    for side in (left, ~left):
                        halves.append(Container())
                        halves[-1].add(high[side], low[side], n[side])
                    self.containers[i : i + 1] = halves
                    self.starts = np.insert(self.starts, i + 1, cut)
                    for j in (i + 1, i):
                        if self.containers[j].used > self.burst:
                            self._burst(j)
                    return

    def spill(self, keep: int) -> tuple[np.ndarray, ...]:
        """Entries of the largest subtrees, taken out until at most `keep` entries are left."""
        out, left = [], self.entries
        for c in sorted(range(len(self.containers)), key=lambda c: -self.containers[c].used):
            if left <= keep:
                break
            out.append(self.containers[c].entries())
            left -= self.containers[c].used
            self.containers[c] = Container()
        none = [(np.zeros(0, np.int64),) * 3]
        return tuple(np.concatenate(x) for x in zip(*(out or none), strict=True))


def run_of(ids: WordIds, high: np.ndarray, low: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Paths as (key, n) in the order of the keys."""
    words = pa.array(ids.words, pa.binary())
    by_order = pc.sort_indices(words).to_numpy().astype(np.int64)
    rank = np.zeros(len(words) + 1, np.int64)
    rank[by_order + 1] = np.arange(1, len(words) + 1)
    mask = (1 << WIDTH) - 1
    columns = [rank[half >> (i * WIDTH) & mask] for half, places in ((high, (2, 1, 0)), (low, (1, 0))) for i in places]
    first = (columns[0] << 2 * WIDTH) | (columns[1] << WIDTH) | columns[2]
    order = np.lexsort(((columns[3] << WIDTH) | columns[4], first))
    ranked = words.take(pa.array(by_order))
    for at in range(0, len(order), 10_000):
        part = order[at : at + 10_000]
        parts = [ranked.take(pa.array(c[part] - 1, mask=c[part] == 0)) for c in columns]
        key = pc.binary_join_element_wise(pa.scalar(ids.lang, pa.binary()), *parts, pa.scalar(b"\x00"), null_handling="skip")
        yield pa.RecordBatch.from_arrays([key, pa.array(n[part])], ["key", "n"])


def sorted_run(keys: list[bytes], counts: list[int]) -> Iterator[pa.RecordBatch]:
    column = pa.array(keys, pa.binary())
    order = pc.sort_indices(column)
    run = pa.table([column.take(order), pa.array(counts, pa.int64()).take(order)], names=["key", "n"])
    yield from run.to_batches(max_chunksize=10_000)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[bytes, bytes]]:
    return zip(batch.column("lang").cast(pa.binary()).to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True)


def word_runs(batches: Iterator[pa.RecordBatch], entries: int = ENTRIES) -> Iterator[pa.RecordBatch]:
    """Sorted runs of single words: each language's trie is one container."""
    containers: dict[bytes, Counter] = {}

    def spilled():
        keys, counts = [], []
        for lang, container in containers.items():
            start = escaped(lang) + b"\x00"
            keys += [start + escaped(w) for w in container]
            counts += container.values()
        containers.clear()
        return sorted_run(keys, counts)

    for b in batches:
        for lang, text in _texts(b):
            containers.setdefault(lang, Counter()).update(text.translate(WORDS).split())
            if sum(map(len, containers.values())) > entries // 2:
                yield from spilled()
    yield from spilled()


def chunks(batches: Iterator[pa.RecordBatch], words: bytes, most_words: int = MOST_WORDS):
    """(word ids of a language, array of ids with RARE between runs or None once its words are forgotten) in portions."""
    known: dict[bytes, tuple[WordIds, list]] = {}
    for b in batches:
        for lang, text in _texts(b):
            if lang not in known:
                known[lang] = WordIds(escaped(lang), words), []
            ids, pending = known[lang]
            ids.add_text(text, pending)
            if len(pending) >= CHUNK:
                yield ids, np.array(pending)
                pending.clear()
            if sum(map(len, (i for i, _ in known.values()))) > most_words:
                # what is known of words is bounded too
                for i, rest in known.values():
                    yield i, np.array(rest, np.int64)
                    yield i, None
                known.clear()
    for i, rest in known.values():
        yield i, np.array(rest, np.int64)
        yield i, None


def pair_counts(words: bytes):
    """Counts of hashes of two and three frequent words: rows of one part of the hashes each, with places and counts up to
    255."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def told():
            bits, counts = np.unique(np.concatenate([*held, np.zeros(0, np.int64)]), return_counts=True)
            held.clear()
            cuts = np.searchsorted(bits, np.arange(2 * BITS // PART + 1) * PART)
            parts = np.flatnonzero(np.diff(cuts))
            places, few = (bits % PART).astype(np.uint16), np.minimum(counts, 255).astype(np.uint8)
            rows = [(places[cuts[p] : cuts[p + 1]].tobytes(), few[cuts[p] : cuts[p + 1]].tobytes()) for p in parts]
            columns = [pa.array(parts.astype(np.int32)), *(pa.array([r[i] for r in rows], pa.binary()) for i in (0, 1))]
            return pa.RecordBatch.from_arrays(columns, ["part", "places", "counts"])

        for ids, chunk in chunks(batches, words):
            if chunk is not None:
                good = chunk >= 0
                at = np.flatnonzero(good[:-1] & good[1:])
                held.append(ids.bits(chunk[at], chunk[at + 1]))
                at = np.flatnonzero(good[:-2] & good[1:-1] & good[2:])
                held.append(ids.bits(chunk[at], chunk[at + 1], chunk[at + 2]))
                if sum(map(len, held)) > 4 * ENTRIES:
                    yield told()
        yield told()

    return run


def frequent_parts(min_count: int):
    """Bits of each part of the hashes that are counted often enough; rows sorted by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = None, np.zeros(PART, np.int64)

        def bits():
            packed = np.packbits(total >= min_count, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([packed], pa.binary())], ["part", "bits"])

        for b in batches:
            for p, places, counts in zip(*(b.column(c).to_pylist() for c in ("part", "places", "counts")), strict=True):
                if p != part:
                    if part is not None:
                        yield bits()
                    part, total = p, np.zeros(PART, np.int64)
                total[np.frombuffer(places, np.uint16)] += np.frombuffer(counts, np.uint8)
        if part is not None:
            yield bits()

    return run


def phrase_runs(most: int, words: bytes, pairs: bytes, entries: int = ENTRIES, burst: int = BURST):
    """Sorted runs of two to `most` frequent words: each place once, with as many of the words after it as there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = np.frombuffer(pairs, np.uint8)
        tries: dict[int, Trie] = {}
        for ids, chunk in chunks(batches, words):
            trie = tries.setdefault(id(ids), Trie(burst))
            if chunk is None:
                yield from run_of(ids, *trie.spill(0))
                del tries[id(ids)]
                continue
            trie.add(*packed_paths(ids, chunk, most, frequent))
            if sum(t.entries for t in tries.values()) > entries:
                yield from run_of(ids, *trie.spill(trie.entries // 2))

    return run


def packed_paths(ids: WordIds, chunk: np.ndarray, most: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The longest run from each place that has one of two words at least, packed; words count from 1, 0 is none."""
    joined, tripled = np.zeros(len(chunk), bool), np.zeros(len(chunk) + most, bool)
    at = np.flatnonzero((chunk[:-1] >= 0) & (chunk[1:] >= 0))
    bits = ids.bits(chunk[at], chunk[at + 1])
    joined[at] = frequent[bits >> 3] >> (bits & 7) & 1
    at = np.flatnonzero(joined[:-1] & joined[1:])
    bits = ids.bits(chunk[at], chunk[at + 1], chunk[at + 2])
    tripled[at] = frequent[bits >> 3] >> (bits & 7) & 1
    start = np.flatnonzero(joined)
    columns, alive = [chunk[start] + 1], np.ones(len(start), bool)
    padded, links = np.concatenate([chunk, np.full(most, RARE)]), np.concatenate([joined, np.zeros(most, bool)])
    for k in range(1, 5):
        alive = alive & links[start + k - 1] & (tripled[start + k - 2] if k > 1 else True) if k < most else np.zeros(len(start), bool)
        columns.append(np.where(alive, padded[np.minimum(start + k, len(padded) - 1)] + 1, 0))
    high = (columns[0] << 2 * WIDTH) | (columns[1] << WIDTH) | columns[2]
    return high, (columns[3] << WIDTH) | columns[4], np.ones(len(start), np.int64)


def merged_counts(least: int, most: int, min_count: int):
    """Counts, or parts of counts, of the prefixes of `least` to `most` words of a sorted stream of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            parts = pc.split_pattern(b.column("key").cast(pa.string()), "\x00")
            size = pc.list_value_length(parts).to_numpy()
            row = np.repeat(np.arange(len(b)), size)
            column = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            words = np.full((len(b), most + 1), -1)
            words[row, column] = parts.flatten().dictionary_encode().indices.to_numpy()
            changed = np.logical_or.accumulate(words[1:] != words[:-1], axis=1)
            n = b.column("n").to_numpy()
            keys, counts = [], []
            for level in range(least, most + 1):
                starts = np.concatenate([[0], np.flatnonzero(changed[:, level]) + 1])
                sums = np.add.reduceat(n, starts)
                told = sums >= (min_count if level else 0)
                told[[0, -1]] = True
                told &= words[starts, level] >= 0
                for i, c in zip(starts[told].tolist(), sums[told].tolist(), strict=True):
                    keys.append(b"\x00".join(b.column("key")[i].as_py().split(b"\x00")[: level + 1]))
                    counts.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(counts, pa.int64())], ["key", "n"])

    return run


def _counted(runs: DataFrame, least: int, most: int, min_count: int, name: str) -> DataFrame:
    """parts (language and words, escaped) and n of the prefixes of the runs found often enough, and of no word if asked for."""
    runs = written(runs, f"{name}-runs", compression="zstd")
    merged = runs.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(merged_counts(least, most, min_count), RUNS)
    summed = merged.groupBy("key").agg(F.sum("n").alias("n"))
    parts = F.split(F.col("key").cast("string"), "\x00", -1)
    rows = summed.select("key", parts.alias("parts"), "n").where((F.size("parts") == 1) | (F.col("n") >= min_count))
    return written(rows, name)


def _bitmap(parts: DataFrame, size: int = BITS) -> bytes:
    """A bitmap from its parts (part, bits): size / 8 bytes whatever the number of keys."""
    out = bytearray(size // 8)
    # size / PART rows at most
    for row in parts.collect():
        at = row.part * PART // 8
        out[at : at + PART // 8] = row.bits
    return bytes(out)


def frequent_words(singles: DataFrame) -> bytes:
    bit = F.crc32("key") % BITS
    keys = singles.where(F.size("parts") == 2)
    return _bitmap(keys.groupBy((bit / PART).cast("int").alias("part")).agg(F.bitmap_construct_agg(bit % PART).alias("bits")))


def frequent_pairs(held: DataFrame, words: bytes, min_count: int) -> bytes:
    counts = held.mapInArrow(pair_counts(words), "part int, places binary, counts binary")
    dealt = counts.repartition("part").sortWithinPartitions("part")
    return _bitmap(dealt.mapInArrow(frequent_parts(min(min_count, 255)), "part int, bits binary"), 2 * BITS)


def phrase_counts(docs: DataFrame, *, min_count: int = MIN_COUNT, longest: int = LONGEST, entries: int = ENTRIES, burst: int = BURST) -> DataFrame:
    """parts, n: how often each phrase of 1 to `longest` (2 to 5) words is found, if `min_count` times; parts of one element
    are languages with their number of words."""
    if not 2 <= longest <= 5:
        raise ValueError("phrases have 2 to 5 words")
    held = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.col("text")).where("text <> ''")
    singles = _counted(held.mapInArrow(lambda b: word_runs(b, entries), RUNS), 0, 1, min_count, "words")
    words = frequent_words(singles)
    pairs = frequent_pairs(held, words, min_count)
    runs = held.mapInArrow(phrase_runs(longest, words, pairs, entries, burst), RUNS)
    return singles.unionByName(_counted(runs, 2, longest, min_count, "phrases")).select("parts", "n")


def _key(parts: Column) -> Column:
    return F.array_join(parts, "\x00")


def pair_score(a: str, n: str, left: str, right: str) -> Column:
    """floor(1000 * a * n / (left * right)) of columns of whole numbers."""
    whole = "cast({} as decimal(38,0))"
    return F.expr(f"cast(({whole.format(1000)} * {a} * {n}) div ({whole.format(left)} * {right}) as bigint)")


def collocations(
    docs: DataFrame, *, min_count: int = MIN_COUNT, top: int = TOP, longest: int = LONGEST, entries: int = ENTRIES, burst: int = BURST
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first `top` phrases."""
    counts = phrase_counts(docs, min_count=min_count, longest=longest, entries=entries, burst=burst)
    keyed = written(counts.select(_key(F.col("parts")).alias("key"), "parts", "n"), "phrase-counts")
    found = keyed.where(F.size("parts") > 2).select("key", "parts", F.col("n").alias("a"))
    # a phrase within a longer one found as often is within one a word longer found as often
    inner = lambda start: F.concat(F.slice("parts", 1, 1), F.slice("parts", start, F.size("parts") - 2))
    longer = found.where(F.size("parts") > 3).select(F.explode(F.array(inner(2), inner(3))).alias("within"), "a")
    covered = longer.groupBy(_key(F.col("within")).alias("key")).agg(F.max("a").alias("most"))
    kept = found.join(covered, "key", "left").where("most is null or most < a")
    cut = kept.select("key", "parts", "a", F.explode(F.sequence(F.lit(1), F.size("parts") - 2)).alias("k"))
    first = F.slice("parts", F.lit(1), F.col("k") + 1)
    rest = F.concat(F.slice("parts", 1, 1), F.slice("parts", F.col("k") + 2, F.size("parts")))
    sides = cut.select("key", "parts", "a", "k", _key(first).alias("left_key"), _key(rest).alias("right_key"))
    figures = keyed.select("key", "n")
    scored = (
        sides.join(figures.select(F.col("key").alias("left_key"), F.col("n").alias("l")), "left_key")
        .join(figures.select(F.col("key").alias("right_key"), F.col("n").alias("r")), "right_key")
        .join(keyed.where(F.size("parts") == 1).select(F.col("key").alias("lang_key"), "n"), F.get("parts", F.lit(0)) == F.col("lang_key"))
    )
    score = pair_score("a", "n", "l", "r").alias("score")
    best = scored.groupBy("key", "parts", "a", "n").agg(F.min(F.struct(score, "k", "l", "r")).alias("best"))
    plain = F.transform("parts", lambda p: F.replace(F.replace(p, F.lit("\x01\x01"), F.lit("\x00")), F.lit("\x01\x02"), F.lit("\x01")))
    rows = best.select(plain.alias("parts"), "a", "n", "best.score", "best.l", "best.r").select(
        F.get("parts", F.lit(0)).alias("lang"),
        F.array_join(F.slice("parts", 2, F.size("parts")), " ").alias("phrase"),
        "a", "l", "r", "n", "score",
    )
    ranked = rank_within(rows, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
