"""Exact top-k inner products by no-random-access aggregation over sorted lists.

The vectors are cut into blocks of bounded size inside the tasks that read them; a block is written as one sorted list per
component, of places and values. A query's score is the sum of one contribution per list, weight times value, so a list is read
from its largest value for a positive weight and from its smallest for a negative one. All lists of a block are read
in step. After each step a vector's score is bounded

  above by what was seen of it, plus for each list not yet met the weight times the value last read there,
  below by what was seen of it, plus for each list not yet met the weight times the list's last value,

and the floor is the k-th best lower bound, or the k-th best score found in earlier blocks. A query stops reading a block once no more
vectors than are cheap to settle can still reach the floor (all others are outsiders); the scores of those are then resolved
exactly. At the end of the lists bounds are scores, so stopping late is never wrong.

Queries and blocks meet in cells: bounded ranges of queries times bounded groups of blocks, dealt out by both, so that neither
side is held whole anywhere. A task carries its floors from block to block, and sends its k best per query.

Defined cases: vectors that are null or hold null, NaN or infinite components take no part, nor do those with a component of which
scale * x is 2^27 or more in size, since a score would pass 64 bits; components that the shorter of two vectors lacks count
as zero; a row without id is never a query and ties after the others; rows with the query's id are not its results; equal
query rows are one query, those of one id with other vectors a query each; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signpost.llm.common import written
from signpost.llm.packed import integer_rows
from signpost.operators.windows import rank_within

#: Vectors of a block, and of a row of queries.
BLOCK = 2048
#: Blocks, and rows of queries, of a cell.
CELL_BLOCKS, CELL_QUERIES = 4, 8
#: Tasks of the search.
MOST_TASKS = 2**15
#: Queries that read a block together.
SLICE = 256
#: Shares of the lists after which bounds are looked at.
DEPTHS = (1 / 16, 1 / 8, 3 / 16, 1 / 4, 3 / 8, 1 / 2, 3 / 4, 1.0)
#: Vectors so few that their scores cost less than the next step.
FEW = 32
NO_ID, NO_SCORE = 2**63 - 1, -(2**63 - 1)
#: Share of a score's largest possible size that bounds give away to rounding.
SLACK = 1e-12
PACKED = "place long, n int, dim int, ids binary, lists binary, whole binary"


def _packed_rows(batches: Iterator[pa.RecordBatch], scale: int, sort: bool) -> Iterator[pa.RecordBatch]:
    """Blocks of usable vectors: ids, whole numbers and, if wanted, the sorted lists."""
    number = itertools.count(TaskContext.get().partitionId() << 32)
    ids: list[np.ndarray] = []
    rows: list[np.ndarray] = []

    def block():
        dim = max(map(len, rows))
        whole = np.zeros((len(rows), dim), np.int32)
        for i, r in enumerate(rows):
            whole[i, : len(r)] = r
        order = np.argsort(whole, axis=0, kind="stable").T.astype(np.uint16) if sort else np.zeros(0, np.uint16)
        values = [[next(number)], [len(rows)], [dim], [np.array(ids).tobytes()], [order.tobytes()], [whole.tobytes()]]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(values, kinds, strict=True)], ["place", "n", "dim", "ids", "lists", "whole"]
        )

    for b in batches:
        at, found = integer_rows(b.column("embedding"), scale)
        known = b.column("vec_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)[at]
        for i, r in zip(known, found, strict=True):
            ids.append(i)
            rows.append(r)
            if len(rows) == BLOCK:
                yield block()
                ids.clear()
                rows.clear()
    if rows:
        yield block()


class Queries:
    """Queries of a cell and their best so far."""

    def __init__(self, k: int):
        self.k, self.ids, self.rows, self.scores, self.found = k, [], [], [], []

    def add(self, ids: np.ndarray, whole: np.ndarray) -> None:
        self.ids.append(ids)
        self.rows.append(whole)
        self.scores.append(np.full((len(ids), self.k), NO_SCORE))
        self.found.append(np.full((len(ids), self.k), NO_ID))

    def search(self, block: Block) -> None:
        for i in range(len(self.ids)):
            weights = np.zeros((len(self.ids[i]), block.whole.shape[1]), np.int64)
            shared = min(weights.shape[1], self.rows[i].shape[1])
            weights[:, :shared] = self.rows[i][:, :shared]
            for at in range(0, len(weights), SLICE):
                part = slice(at, at + SLICE)
                block.search(weights[part], self.ids[i][part], self.scores[i][part], self.found[i][part])

    def best(self) -> Iterator[pa.RecordBatch]:
        for ids, rows, scores, found in zip(self.ids, self.rows, self.scores, self.found, strict=True):
            q, r = np.nonzero(scores != NO_SCORE)
            hits = found[q, r]
            versions = [row.tobytes() for row in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[q]),
                    pa.array([versions[i] for i in q], pa.binary()),
                    pa.array(hits, mask=hits == NO_ID),
                    pa.array(scores[q, r]),
                ],
                ["query_id", "version", "vec_id", "score"],
            )


class Block:
    """Sorted lists of a block, read from both ends in steps."""

    def __init__(self, ids: np.ndarray, order: np.ndarray, whole: np.ndarray):
        self.ids, self.whole = ids, whole.astype(np.int64)
        n, dim = whole.shape
        self.steps = []
        values = np.take_along_axis(whole.T, order, axis=1).astype(np.float64)
        self.low, self.high = (values[:, 0], values[:, -1]) if n else (np.zeros(dim), np.zeros(dim))
        seen = np.zeros((2, n, dim))
        column = np.arange(dim)[:, None]
        read = 0
        for share in DEPTHS:
            to = -int(-n * share // 1)
            if to <= read:
                continue
            new = np.zeros((2, n, dim))
            for end, span in enumerate((slice(n - to, n - read), slice(read, to))):
                places = order[:, span]
                new[end, places, column] = values[:, span]
                seen[end, places, column] = 1
            self.steps.append((new, seen.copy(), values[:, n - to], values[:, to - 1]))
            read = to

    def search(self, weights: np.ndarray, own: np.ndarray, scores: np.ndarray, found: np.ndarray) -> None:
        """Update the best scores and ids (views, a row per query) by what the block holds."""
        k = scores.shape[1]
        up, down = np.maximum(weights, 0).T.astype(float), np.minimum(weights, 0).T.astype(float)
        slack = SLACK * (np.abs(weights) @ np.maximum(np.abs(self.low), np.abs(self.high)))
        active = np.arange(len(weights))
        summed = np.zeros((len(self.ids), len(weights)))
        for step, (new, seen, top, bottom) in enumerate(self.steps):
            u, d = up[:, active], down[:, active]
            summed += new[0] @ u + new[1] @ d
            last = step + 1 == len(self.steps)
            met = lambda a, b, u=u, d=d, seen=seen: (a @ u + b @ d) - (seen[0] @ (a[:, None] * u) + seen[1] @ (b[:, None] * d))
            own_row = self.ids[:, None] == own[active]
            upper = summed if last else summed + met(top, bottom)
            upper = np.where(own_row, -np.inf, upper)
            floor = scores[active, -1].astype(float)
            if not last and len(self.ids) >= k:
                lower = np.where(own_row, -np.inf, summed + met(self.low, self.high))
                floor = np.maximum(floor, np.partition(lower, len(lower) - k, axis=0)[len(lower) - k])
            able = upper >= floor - slack[active]
            settled = np.ones(len(active), bool) if last else able.sum(axis=0) <= FEW
            for i in np.flatnonzero(settled):
                q = active[i]
                rows = np.flatnonzero(able[:, i])
                if len(rows):
                    self.resolve(weights[q], rows, scores[q], found[q])
            active, summed = active[~settled], summed[:, ~settled]
            if not len(active):
                return

    def resolve(self, weight: np.ndarray, rows: np.ndarray, scores: np.ndarray, found: np.ndarray) -> None:
        """Final scores of the vectors left; the k best of them and those before stay, ties by id."""
        score = np.concatenate([scores, self.whole[rows] @ weight])
        ids = np.concatenate([found, self.ids[rows]])
        best = np.lexsort((ids, -score))[: len(scores)]
        scores[:], found[:] = score[best], ids[best]


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 5, scale: int = 256, block: int = BLOCK) -> DataFrame:
    """The k best partners of each query of `vectors(vec_id, embedding)`: query_id, version, rank, vec_id, score."""
    rows = vectors.select("vec_id", "embedding")
    lists = written(rows.mapInArrow(lambda bs: _packed_rows(bs, scale, True), PACKED), "sorted-lists")
    asked = rows.where(F.coalesce(is_query, F.lit(False)) & F.col("vec_id").isNotNull()).distinct()
    asked = written(asked.mapInArrow(lambda bs: _packed_rows(bs, scale, False), PACKED), "query-rows")
    groups = max(1, -(-lists.count() // CELL_BLOCKS))
    ranges = max(1, -(-asked.count() // CELL_QUERIES))

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int, block: bool) -> DataFrame:
        placed = df.withColumn(own, F.pmod(F.xxhash64("place"), F.lit(n)).cast("int"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).withColumn("is_block", F.lit(block))

    both = dealt(lists, "group", groups, "range", ranges, True).unionByName(dealt(asked, "range", ranges, "group", groups, False))
    # counted in cells, not in bytes: a cell is much work for few bytes
    spread = both.repartition(min(groups * ranges, MOST_TASKS), "range", "group")
    cells = spread.sortWithinPartitions("range", "group", "is_block", "place")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_range, of_cell, queries = None, None, Queries(k)
        for b in batches:
            for row in b.to_pylist():
                if row["range"] != of_range:
                    yield from queries.best()
                    of_range, of_cell, queries = row["range"], row["group"], Queries(k)
                ids = np.frombuffer(row["ids"], np.int64)
                whole = np.frombuffer(row["whole"], np.int32).reshape(row["n"], row["dim"])
                if row["is_block"] and queries.ids:
                    order = np.frombuffer(row["lists"], np.uint16).reshape(row["dim"], row["n"])
                    queries.search(Block(ids, order, whole))
                elif not row["is_block"] and row["group"] == of_cell:
                    # each cell brings the same queries of its range
                    queries.add(ids, whole)
        yield from queries.best()

    found = cells.mapInArrow(search, "query_id long, version binary, vec_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("vec_id")]
    return rank_within(found, ["query_id", "version"], order, k).select("query_id", "version", "rank", "vec_id", "score")
