"""Top results of a query batch, found block by block.

Entries are dealt out to blocks and queries to batches; a cell is one block met by one batch, and gets the block's postings, the scoring
fields of its entries, the batch's terms, the words found in triggers on either side and the scores of other stages as rows of one
table. Rows are exchanged once and packed; packed blocks and batches meet in a grid of lanes, so that copies are as many as lanes, not
as blocks or batches. Nothing is joined by term or word outside a cell, so no row per (query, entry, shared term or word) is ever exchanged; what
leaves a cell is the best k of each query, or the stage scores of its candidates.

Within a cell terms are taken in the order of their bounds (weight times the largest saturation in the block). Once what is left of a
query's terms could not lift an entry over the query's k-th score so far, only the entries still able to reach it are
finished, from their own postings; the others have lost, whatever they hold. Results are those of scoring everything.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signpost import schema as S
from signpost.session import shuffle_partitions

ENTRIES_PER_BLOCK = 50_000
#: Postings of a block, on average: what a cell holds at once.
POSTINGS_PER_BLOCK = 500_000
#: Tasks that the cells are dealt to, at most; beyond them a task takes several cells, one after another.
MOST_TASKS = 10_000
QUERIES_PER_BATCH = 4_096
#: Lanes that blocks are dealt to, at most: so often a packed batch is exchanged.
LANES = 32
#: Packed batches that a lane holds while its blocks pass, on average.
BATCHES_PER_LANE = 64
#: Scores worked on at once in a cell: arrays of them stay in a core's cache.
CELLS_AT_ONCE = 200_000
#: Share of a query's bounds after which entries are looked at.
FIRST_SHARE = 0.5
#: Cost of looking up a posting of an entry, in postings of a term read in order.
FINISH_COST = 8
#: Scores this close may tie once rounded to two decimals; above the rounding error of sums too.
CLOSE = 0.0101

TERM, POSTING, ENTRY, HIT, WORD, FOUND, NOTHING = range(7)
ROW = {"query_id": None, "name": "string", "term": "string", "x": "double", "y": "double", "z": "double", "w": "double"}


def _frame(df: DataFrame, kind: int, id_type: str, place: Column, **columns: Column) -> DataFrame:
    """Rows of a block or a batch; those of hits also name the block of their entry."""
    types = {"block": "int"} | ROW | {"query_id": id_type}
    cols = [columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in types.items()]
    return df.select(place.cast("int").alias("place"), F.lit(kind).alias("kind"), *cols)


def _packed(rows: DataFrame, places: int, tasks: int) -> DataFrame:
    """`place, packed`: the rows of each block or batch in the order of their kind, dealt out once and then packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches, lambda b: b.column("place").to_numpy()):
            sink = pa.BufferOutputStream()
            own = table.drop_columns(["place"])
            with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(own)
            columns = [table.column("place").slice(0, 1).combine_chunks(), pa.array([sink.getvalue().to_pybytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["place", "packed"])

    dealt = rows.repartition(max(tasks, min(places, MOST_TASKS)), "place").sortWithinPartitions("place", "kind")
    return dealt.mapInArrow(run, "place int, packed binary")


def _by_kind(packed: pa.Buffer) -> list[tuple[int, pa.Table]]:
    table = pa.ipc.open_stream(packed).read_all()
    cut = np.searchsorted(table.column("kind").to_numpy(), np.arange(NOTHING + 1))
    return [(k, table.slice(cut[k], cut[k + 1] - cut[k])) for k in range(NOTHING) if cut[k + 1] > cut[k]]


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each cell: a lane's packed batches come first and stay packed, then its blocks pass."""
    lane, asked = None, []
    for b in batches:
        for i in range(len(b)):
            across, down, side, place = (b.column(c)[i].as_py() for c in ("across", "down", "side", "place"))
            if lane != (across, down):
                lane, asked = (across, down), []
            if side == 0:
                asked.append((place, b.column("packed")[i].as_py()))
                continue
            held = _by_kind(b.column("packed")[i].as_buffer())
            for batch, packed in asked:
                for k, table in sorted(held + _by_kind(pa.py_buffer(packed)), key=lambda x: x[0]):
                    own = table.filter(pc.equal(table.column("block"), place)) if k == HIT else table
                    for rows in own.drop_columns(["block"]).to_batches(max_chunksize=10_000):
                        places = [pa.array(np.full(len(rows), x, np.int32)) for x in (place, batch)]
                        yield pa.RecordBatch.from_arrays([*places, *rows.columns], ["block", "batch", *rows.schema.names])


def cells(
    n_queries: int,
    terms: DataFrame,
    postings: DataFrame,
    n_entries: int,
    entries: DataFrame | None = None,
    hits: list[DataFrame] | None = None,
    words: DataFrame | None = None,
    found: DataFrame | None = None,
    n_postings: int = 0,
) -> DataFrame:
    """Rows of all cells, each cell's together in one task and in the order of their kind.

    `n_queries`, `n_entries` and `n_postings` set the numbers of batches and blocks; `terms(query_id, term, weight)`; `postings(name, term, part)` with the saturated
    frequency; `entries(name, usage, success, recency, factor)`: what is added to an entry's stages, and what the sum is
    multiplied by; `hits(query_id, name, trigger, semantic)`: scores of the other two stages, in parts;
    `words(query_id, word, weight)` and `found(name, word)`: what a query's word adds to the trigger stage of the entries it was found in.
    """
    least = shuffle_partitions(terms)
    batches = max(-(-n_queries // QUERIES_PER_BATCH), 1)
    # terms are read for every block: with several batches fewer blocks already give each task a cell
    blocks = max(-(-n_entries // ENTRIES_PER_BLOCK), -(-n_postings // POSTINGS_PER_BLOCK), -(-least // batches))
    of_name = F.pmod(F.xxhash64("name"), F.lit(blocks)).cast("int")
    of_query = F.pmod(F.xxhash64("query_id"), F.lit(batches)).cast("int")
    id_type = terms.schema["query_id"].dataType.simpleString()
    c = F.col
    asked = _frame(terms, TERM, id_type, of_query, query_id=c("query_id"), term=c("term"), x=c("weight"))
    held = _frame(postings, POSTING, id_type, of_name, name=c("name"), term=c("term"), x=c("part"))
    # every block is there, as hits may name entries that hold nothing else
    held = held.unionByName(_frame(terms.sparkSession.range(blocks), NOTHING, id_type, c("id")))
    if entries is not None:
        figures = {"x": c("usage"), "y": c("success"), "z": c("recency"), "w": c("factor")}
        held = held.unionByName(_frame(entries, ENTRY, id_type, of_name, name=c("name"), **figures))
    for rows in hits or []:
        figures = {"query_id": c("query_id"), "name": c("name"), "x": c("trigger"), "y": c("semantic")}
        asked = asked.unionByName(_frame(rows, HIT, id_type, of_query, block=of_name, **figures))
    if words is not None:
        asked = asked.unionByName(_frame(words, WORD, id_type, of_query, query_id=c("query_id"), term=c("word"), x=c("weight")))
        held = held.unionByName(_frame(found, FOUND, id_type, of_name, name=c("name"), term=c("word")))
    across = min(blocks, LANES)
    down = min(max(-(-batches // BATCHES_PER_LANE), -(-least // across)), batches)
    lanes = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod("place", F.lit(n)).cast("int")
    right = _packed(asked, batches, least).select(lanes(across).alias("across"), dealt(down).alias("down"), F.lit(0).alias("side"), "place", "packed")
    left = _packed(held, blocks, least).select(dealt(across).alias("across"), lanes(down).alias("down"), F.lit(1).alias("side"), "place", "packed")
    met = left.unionByName(right).repartition(across * down, "across", "down").sortWithinPartitions("across", "down", "side", "place")
    types = ROW | {"query_id": id_type}
    return met.mapInArrow(_met, "block int, batch int, kind int, " + ", ".join(f"{x} {t}" for x, t in types.items()))


def _whole(batches: Iterator[pa.RecordBatch], key: Callable[[pa.RecordBatch], np.ndarray]) -> Iterator[pa.Table]:
    """The rows of each key, which stand one after another."""
    held: list[pa.RecordBatch] = []
    at = None
    for b in batches:
        if not len(b):
            continue
        keys = key(b)
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(b)]
        for low, high in zip(cuts, cuts[1:], strict=False):
            if at is not None and keys[low] != at:
                yield pa.Table.from_batches(held)
                held = []
            at = keys[low]
            held.append(b.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held)


def whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    return _whole(batches, lambda b: b.column("block").to_numpy().astype(np.int64) << 32 | b.column("batch").to_numpy())


def _spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places starts[i], starts[i] + 1, ... of counts[i] each, one after another."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)


class Cell:
    """One block of entries met by one batch of queries."""

    def __init__(self, rows: pa.Table):
        kinds = rows.column("kind").to_numpy()
        cut = np.searchsorted(kinds, np.arange(7))
        terms, postings, entries, hits, words, found = (rows.slice(cut[i], cut[i + 1] - cut[i]) for i in range(6))
        number = lambda t, c: t.column(c).to_numpy()
        place = lambda column, known: pc.index_in(column, value_set=known).to_numpy()
        both = lambda column, *tables: pc.unique(pa.chunked_array([x for t in tables for x in t.column(column).chunks], rows.column(column).type))
        names = entries.column("name") if len(entries) else both("name", postings, found, hits)
        order = pc.sort_indices(names)
        self.names = names.take(order)
        if len(entries):
            self.usage, self.success, self.recency, self.factor = (number(entries, f)[order] for f in "xyzw")
        self.queries = both("query_id", terms, hits, words)
        known = pc.unique(terms.column("term"))
        # postings of terms that this batch asks for, by term and by entry
        of_term = pc.index_in(postings.column("term"), value_set=known)
        asked = pc.is_valid(of_term).to_numpy()
        term = of_term.to_numpy()[asked].astype(np.int64) if len(asked) else np.zeros(0, np.int64)
        entry = place(postings.column("name"), self.names)[asked] if len(asked) else term
        part = number(postings, "x")[asked] if len(asked) else np.zeros(0)
        by_term = np.argsort(term, kind="stable")
        self.entry, self.part = entry[by_term], part[by_term]
        self.term_cuts = np.searchsorted(term[by_term], np.arange(len(known) + 1))
        by_entry = np.argsort(entry, kind="stable")
        self.own_term, self.own_part = term[by_entry], part[by_entry]
        self.entry_cuts = np.searchsorted(entry[by_entry], np.arange(len(self.names) + 1))
        largest = np.zeros(len(known))
        np.maximum.at(largest, term, part)
        # each query's terms, largest bound first
        q, t = place(terms.column("query_id"), self.queries), place(terms.column("term"), known)
        weight = number(terms, "x")
        bound = np.maximum(weight * largest[t], 0) if len(t) else np.zeros(0)
        order = np.lexsort((-bound, q))
        self.q, self.t, self.weight, self.bound = q[order], t[order], weight[order], bound[order]
        self.query_cuts = np.searchsorted(self.q, np.arange(len(self.queries) + 1))
        q, e = place(hits.column("query_id"), self.queries), place(hits.column("name"), self.names)
        order = np.argsort(q, kind="stable")
        self.hit_q, self.hit_e = q[order], e[order]
        self.hit_x, self.hit_y = number(hits, "x")[order], number(hits, "y")[order]
        # entries by the word that was found in their triggers, and each query's words
        known = pc.unique(words.column("term"))
        of_word = pc.index_in(found.column("term"), value_set=known)
        asked = pc.is_valid(of_word).to_numpy()
        word = of_word.to_numpy()[asked].astype(np.int64) if len(asked) else np.zeros(0, np.int64)
        by_word = np.argsort(word, kind="stable")
        self.word_entry = place(found.column("name"), self.names)[asked][by_word] if len(asked) else word
        self.word_cuts = np.searchsorted(word[by_word], np.arange(len(known) + 1))
        q, w = place(words.column("query_id"), self.queries), place(words.column("term"), known)
        order = np.argsort(q, kind="stable")
        self.word_q, self.word, self.word_weight = q[order], w[order], number(words, "x")[order]

    def slices(self) -> Iterator[tuple[int, int]]:
        step = max(1, CELLS_AT_ONCE // max(len(self.names), 1))
        for low in range(0, len(self.queries), step):
            yield low, min(low + step, len(self.queries))

    def add_terms(self, scores: np.ndarray, low: int, rows: np.ndarray) -> None:
        """Add the parts of the given query terms to the scores of the queries from `low` on."""
        starts, counts = self.term_cuts[self.t[rows]], np.diff(self.term_cuts)[self.t[rows]]
        at = _spans(starts, counts)
        place = np.repeat(self.q[rows] - low, counts) * scores.shape[1] + self.entry[at]
        scores += np.bincount(place, np.repeat(self.weight[rows], counts) * self.part[at], scores.size).reshape(scores.shape)

    def finish(self, scores: np.ndarray, q: np.ndarray, e: np.ndarray, low: int, rows: np.ndarray) -> None:
        """Add what the remaining terms `rows` give to the pairs (q, e), from the entries' own postings."""
        counts = np.diff(self.entry_cuts)[e]
        at = _spans(self.entry_cuts[e], counts)
        pair = np.repeat(np.arange(len(q)), counts)
        width = len(self.term_cuts)
        left = (self.q[rows] - low) * width + self.t[rows]
        order = np.argsort(left)
        left, weights = left[order], self.weight[rows][order]
        wanted = q[pair] * width + self.own_term[at]
        found = np.minimum(np.searchsorted(left, wanted), max(len(left) - 1, 0))
        hit = left[found] == wanted if len(left) else np.zeros(len(wanted), bool)
        scores[q, e] += np.bincount(pair[hit], weights[found[hit]] * self.own_part[at[hit]], len(q))

    def others(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Trigger and semantic scores of the queries from `low` to `high`, and which entries these stages found."""
        shape = (high - low, len(self.names))
        first, second, candidate = np.zeros(shape), np.zeros(shape), np.zeros(shape, bool)
        hit = slice(*np.searchsorted(self.hit_q, [low, high]))
        place = (self.hit_q[hit] - low, self.hit_e[hit])
        np.add.at(first, place, self.hit_x[hit])
        np.add.at(second, place, self.hit_y[hit])
        candidate[place] = True
        rows = slice(*np.searchsorted(self.word_q, [low, high]))
        word = self.word[rows]
        starts, counts = self.word_cuts[word], np.diff(self.word_cuts)[word]
        at = np.repeat(self.word_q[rows] - low, counts) * shape[1] + self.word_entry[_spans(starts, counts)]
        if len(at):
            first += np.bincount(at, np.repeat(self.word_weight[rows], counts), first.size).reshape(shape)
            candidate.flat[at] = True
        return first, second, candidate

    def stage_scores(self) -> Iterator[tuple[np.ndarray, ...]]:
        """(query, entry, trigger, keyword, semantic) of all candidates of any stage."""
        for low, high in self.slices():
            first, second, candidate = self.others(low, high)
            scores = np.zeros(first.shape)
            self.add_terms(scores, low, np.arange(self.query_cuts[low], self.query_cuts[high]))
            q, e = np.nonzero(candidate | (scores > 0))
            yield q + low, e, first[q, e], scores[q, e], second[q, e]

    def keyword_scores(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, entry, score) of all pairs with a positive score."""
        for low, high in self.slices():
            scores = np.zeros((high - low, len(self.names)))
            self.add_terms(scores, low, np.arange(self.query_cuts[low], self.query_cuts[high]))
            q, e = np.nonzero(scores > 0)
            yield q + low, e, scores[q, e]

    def best(self, k: int, threshold: float) -> Iterator[tuple[np.ndarray, ...]]:
        """(query, entry, trigger, keyword, semantic) of each query's best k that reach the threshold."""
        n = len(self.names)
        for low, high in self.slices():
            shape = (high - low, n)
            first, second, candidate = self.others(low, high)
            scores = np.zeros(shape)
            other = first + second + self.usage + self.success
            rows = np.arange(self.query_cuts[low], self.query_cuts[high])
            upto = np.cumsum(self.bound[rows])
            start = np.append(0.0, upto)[self.query_cuts[self.q[rows]] - self.query_cuts[low]]
            total = np.append(0.0, upto)[self.query_cuts[low + 1 : high + 1] - self.query_cuts[low]] - np.append(0.0, upto)[self.query_cuts[low:high] - self.query_cuts[low]]
            early = upto - start - self.bound[rows] <= FIRST_SHARE * total[self.q[rows] - low]
            self.add_terms(scores, low, rows[early])
            rest = np.bincount(self.q[rows[~early]] - low, self.bound[rows[~early]], high - low)[:, None]
            held = (scores > 0) | candidate
            ends = np.stack([(other + scores) * self.factor, (other + scores + rest) * self.factor])
            lowest, highest = ends.min(axis=0), ends.max(axis=0)
            lowest = np.where(held & ~np.isnan(lowest), lowest, -np.inf)
            floor = np.full((high - low, 1), float(threshold))
            if n > k:
                floor = np.maximum(floor, np.partition(lowest, n - k, axis=1)[:, n - k][:, None])
            q, e = np.nonzero(highest >= floor - CLOSE)
            if int(np.diff(self.entry_cuts)[e].sum()) * FINISH_COST < int(np.diff(self.term_cuts)[self.t[rows[~early]]].sum()):
                self.finish(scores, q, e, low, rows[~early])
            else:
                # so many are left that reading the terms' postings costs less
                self.add_terms(scores, low, rows[~early])
            real = (scores[q, e] > 0) | candidate[q, e]
            q, e = q[real], e[real]
            final = (first[q, e] + scores[q, e] + second[q, e] + self.usage[e] + self.success[e]) * self.factor[e]
            kept = final >= threshold
            q, e, final = q[kept], e[kept], final[kept]
            # names are in order, so a stable sort by score breaks ties by name
            rounded = np.floor(final * 100 + 0.5)
            order = np.lexsort((e, -rounded, q))
            q, e = q[order], e[order]
            begin = np.searchsorted(q, np.arange(high - low))
            top = np.arange(len(q)) - begin[q] < k
            q, e = q[top], e[top]
            yield q + low, e, first[q, e], scores[q, e], second[q, e]


def keyword_scores(rows: DataFrame, id_type: str) -> DataFrame:
    """query_id, name, score of all pairs of the cells that share a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_cells(batches):
            cell = Cell(table)
            if not len(cell.names):
                continue
            for q, e, score in cell.keyword_scores():
                columns = [cell.queries.take(pa.array(q)), cell.names.take(pa.array(e)), pa.array(score)]
                yield from pa.table(columns, names=["query_id", "name", "score"]).to_batches(max_chunksize=100_000)

    return rows.mapInArrow(run, f"query_id {id_type}, name string, score double")


STAGES = ["trigger", "keyword", "semantic"]


def stage_scores_of(rows: DataFrame, id_type: str) -> DataFrame:
    """query_id, name, trigger, keyword, semantic of all candidates of the cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_cells(batches):
            cell = Cell(table)
            if not len(cell.names):
                continue
            for q, e, *stages in cell.stage_scores():
                columns = [cell.queries.take(pa.array(q)), cell.names.take(pa.array(e)), *map(pa.array, stages)]
                yield from pa.table(columns, names=["query_id", "name", *STAGES]).to_batches(max_chunksize=100_000)

    return rows.mapInArrow(run, f"query_id {id_type}, name string, " + ", ".join(f"{c} double" for c in STAGES))


RESULT = ["trigger", "keyword", "semantic", "usage", "success", "recency", "factor"]


def best_of_blocks(rows: DataFrame, id_type: str, k: int, threshold: float = S.THRESHOLD) -> DataFrame:
    """query_id, name, stage scores and the entry's figures: each block's best k of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_cells(batches):
            cell = Cell(table)
            if not len(cell.names):
                continue
            for q, e, *stages in cell.best(k, threshold):
                own = [x[e] for x in (cell.usage, cell.success, cell.recency, cell.factor)]
                columns = [cell.queries.take(pa.array(q)), cell.names.take(pa.array(e)), *map(pa.array, [*stages, *own])]
                yield from pa.table(columns, names=["query_id", "name", *RESULT]).to_batches()

    return rows.mapInArrow(run, f"query_id {id_type}, name string, " + ", ".join(f"{c} double" for c in RESULT))
