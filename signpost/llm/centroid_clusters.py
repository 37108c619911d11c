"""Centroid clustering by PCA-rotated filtering.

Vectors become whole numbers once and are kept beside a rotated form: the leading coordinates along the principal axes, and
the norm of what is left. For a vector x and a centroid c, with p the leading coordinates and r the residual norm,

    |x - c|^2 >= |p(x) - p(c)|^2 + (r(x) - r(c))^2,

since the residuals differ by at least the difference of their norms. A round computes these bounds for all centroids,
takes the exact distance to the one of the smallest bound, and then only those exact distances whose bound does not pass the best
one so far: the survivors, verified in whole numbers. Bounds are floats and get a slack above their rounding error, so rounding
can cost a verification and never a result. Any rotation is right; the principal axes make the bounds tight.

The axes come from sums over all vectors, two passes in all. Every round is one pass: tasks send a row of counts and sums
each, added up by a few tasks before the driver sees them. The centroids (k times dim numbers) travel with the tasks; nothing
else does. A round that moves no centroid is the last, as all further ones would repeat it.

Defined cases: vectors that are null, of another length, or hold null, NaN or infinite components are left out, as are those
with a component of which scale * x is 2^27 or more in size, since a squared distance would pass 64 bits; sums are exact up to
2^36 such vectors. Rows without id sort last among the starting hashes; rows of one hash are ordered by their vectors; repeated rows stay,
each counted; fewer than k vectors give that many centroids; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signpost.llm.common import written
from signpost.llm.packed import integer_rows, pack, tree_sum, unpack

#: Leading coordinates kept.
LEAD = 16
#: Share of the squared norms that bounds give away to rounding.
SLACK = 4e-6


@dataclass(frozen=True)
class Clusters:
    """`rows(vec_id, cluster, distance)`, the centroids, distances summed per cluster, rounds run, and exact distances computed
    per vector and round (k without any filtering)."""

    rows: DataFrame
    centroids: np.ndarray
    inertia: list[int]
    rounds: int
    verified: float


@dataclass(frozen=True)
class Rotation:
    mean: np.ndarray
    axes: np.ndarray

    def of(self, whole: np.ndarray) -> np.ndarray:
        """Leading coordinates, residual norm and squared norm, a row per vector."""
        x = whole - self.mean
        lead = x @ self.axes
        norm = np.einsum("ij,ij->i", x, x)
        rest = np.sqrt(np.maximum(norm - np.einsum("ij,ij->i", lead, lead), 0.0))
        return np.column_stack([lead, rest, norm])


def lower_bounds(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Bounds below the squared distances between two sets of rotated vectors."""
    a, b = rows[:, :-1], centroids[:, :-1]
    squares = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :] - 2 * (a @ b.T)
    return squares - SLACK * (rows[:, -1][:, None] + centroids[:, -1][None, :]) - 1


def nearest(whole: np.ndarray, rotated: np.ndarray, centroids: np.ndarray, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Cluster and exact squared distance of each vector, ties to the smaller number, and exact distances computed."""
    bounds = lower_bounds(rotated, turned)
    first = bounds.argmin(axis=1)

    def exact(rows, c):
        difference = whole[rows].astype(np.int64) - centroids[c]
        return np.einsum("ij,ij->i", difference, difference)

    cluster, best = first.copy(), exact(slice(None), first)
    computed = len(whole)
    for c in range(len(centroids)):
        rows = np.flatnonzero((bounds[:, c] <= best) & (first != c))
        distance = exact(rows, c)
        closer = (distance < best[rows]) | ((distance == best[rows]) & (c < cluster[rows]))
        cluster[rows[closer]], best[rows[closer]] = c, distance[closer]
        computed += len(rows)
    return cluster, best, computed


def whole_vectors(vectors: DataFrame, dim: int, scale: int) -> DataFrame:
    """vec_id and `whole` (int32 numbers) of the usable vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = integer_rows(b.column("embedding"), scale, dim)
            ids = b.column("vec_id").take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pack(rows)], ["vec_id", "whole"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, whole binary")


def principal_axes(whole: DataFrame, dim: int, lead: int) -> Rotation:
    """Mean and leading axes of all vectors."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, o = 0.0, np.zeros(dim), np.zeros((dim, dim))
        for b in batches:
            x = unpack(b.column("whole"), np.int32, dim).astype(float)
            n, s, o = n + len(x), s + x.sum(axis=0), o + x.T @ x
        yield pa.RecordBatch.from_arrays([pack(np.concatenate([[n], s, o.ravel()])[None, :])], ["part"])

    total = tree_sum(whole.mapInArrow(moments, "part binary"), np.float64, 1 + dim + dim * dim)
    n = max(total[0], 1.0)
    mean = total[1 : 1 + dim] / n
    spread = total[1 + dim :].reshape(dim, dim) / n - np.outer(mean, mean)
    return Rotation(mean, np.linalg.eigh(spread)[1][:, ::-1][:, :lead])


def starting_centroids(whole: DataFrame, dim: int, k: int, seed: str) -> np.ndarray:
    """The k vectors of smallest hash of seed and id."""
    hashed = whole.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "whole")
    first = hashed.orderBy(F.asc_nulls_last("h"), "whole").limit(k).collect()
    return np.array([np.frombuffer(r.whole, np.int32) for r in first], np.int64).reshape(len(first), dim)


def cluster_vectors(
    vectors: DataFrame, *, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: str = "3", lead: int = LEAD
) -> Clusters:
    """Cluster `vectors(vec_id, embedding)`: `rounds` rounds of assigning and moving, then a last assignment."""
    lead = min(lead, dim)
    whole = written(whole_vectors(vectors, dim, scale), "whole-vectors")
    rotation = principal_axes(whole, dim, lead)

    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            turned = rotation.of(unpack(b.column("whole"), np.int32, dim))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("whole"), pack(turned)], ["vec_id", "whole", "turned"])

    rows = written(whole.mapInArrow(rotate, "vec_id long, whole binary, turned binary"), "rotated-vectors")
    centroids = starting_centroids(whole, dim, k, seed)
    k = len(centroids)
    computed = assigned = 0

    def assigner(centroids: np.ndarray):
        turned = rotation.of(centroids)

        def assign(b: pa.RecordBatch):
            x = unpack(b.column("whole"), np.int32, dim)
            return x, *nearest(x, unpack(b.column("turned"), np.float64, lead + 2), centroids, turned)

        return assign

    ran = 0
    while ran < rounds and k:
        assign = assigner(centroids)

        def sums(batches: Iterator[pa.RecordBatch], assign=assign) -> Iterator[pa.RecordBatch]:
            total, count, tried = np.zeros((k, dim), np.int64), np.zeros(k, np.int64), 0
            for b in batches:
                x, cluster, _, n = assign(b)
                tried += n
                count += np.bincount(cluster, minlength=k)
                for c in range(k):
                    total[c] += x[cluster == c].sum(axis=0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pack(np.concatenate([[tried], count, total.ravel()])[None, :])], ["part"])

        got = tree_sum(rows.select("whole", "turned").mapInArrow(sums, "part binary"), np.int64, 1 + k + k * dim)
        count, total = got[1 : 1 + k], got[1 + k :].reshape(k, dim)
        computed, assigned, ran = computed + int(got[0]), assigned + int(count.sum()), ran + 1
        moved = np.where(count[:, None] > 0, total // np.maximum(count, 1)[:, None], centroids)
        if (moved == centroids).all():
            break
        centroids = moved
    last = assigner(centroids) if k else None

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                _, cluster, distance, _ = last(b)
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"]
                )

    out = written(rows.mapInArrow(final, "vec_id long, cluster int, distance long"), "clusters")
    inertia = [0] * k
    for row in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect():
        inertia[row.cluster] = int(row.s)
    return Clusters(out, centroids, inertia, ran, computed / max(assigned, 1))


def with_figures(found: Clusters) -> DataFrame:
    """The rows with cluster_inertia, inertia and centroid_sha256."""
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in found.centroids]

    def pick(values, kind):
        return F.get(F.array(*[F.lit(v).cast(kind) for v in values]).cast(f"array<{kind}>"), F.col("cluster"))

    return found.rows.select(
        "vec_id",
        "cluster",
        "distance",
        pick(found.inertia, "long").alias("cluster_inertia"),
        F.lit(sum(found.inertia)).cast("long").alias("inertia"),
        pick(digests, "string").alias("centroid_sha256"),
    )
