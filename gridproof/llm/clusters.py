"""Centroid clustering of integer vectors, with an exact progressive search in Walsh-Hadamard space.

Vectors are turned into integers and, as the centroids are, transformed by a Hadamard matrix whose
rows are ordered from the fewest changes of sign to the most. The matrix keeps distances but for a
factor, the number of components, so the squared differences of coefficients add up, coarse to fine,
to that many times the squared distance. After each step a centroid lies between two bounds, as what
is left of vector and centroid has known lengths; one whose lower bound is over the least upper
bound is strictly worse and is dropped, and those that stay are measured on all coefficients. All is
integer, so ties are ties: of equally near centroids the one of the smaller number is taken.

Scale: a round is one narrow pass over the vectors. A task keeps a row of sums per centroid, and
those rows meet in one small group-by; only the centroids come to the driver. The final pass stores
number, centroid and distance of each vector and reads them again beside the sums of each cluster,
a row per centroid, so nothing that grows with the vectors is shuffled.

Defined cases: vectors that are null, of another length, or hold null or non-finite components are
left out; a vector with a null id is clustered but is taken as a first centroid only after all
others; rows that share an id are rows of their own, and of their ties as first centroids the lesser
components come first; with fewer vectors than centroids each is one; a centroid without vectors
stays as it is; an empty table gives no rows. Components are exact up to where a distance no longer
fits a long, which is an error; other input columns are not carried along."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, written

K, ROUNDS, SEED, SCALE, WIDTH = 16, 3, 1, 64, 64
#: Coefficients after which centroids are dropped.
STEPS = (4, 8, 16, 32)
#: Vectors measured at one time.
ROWS = 4096
#: Components below this have coefficients and sums of squares that fit 64 bits; larger ones go as Python's integers.
SMALL = 1 << 20


def transform(x: np.ndarray) -> np.ndarray:
    """The coefficients of integer rows: butterflies of sums and differences, then the order by sign changes."""
    n, width = x.shape
    out, half = x.copy(), 1
    while half < width:
        pair = out.reshape(n, width // (2 * half), 2, half)
        out = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(n, width)
        half *= 2
    return out[:, _order(width)]


@lru_cache(4)
def _order(width: int) -> np.ndarray:
    """The rows of the Hadamard matrix of a power of two by their changes of sign."""
    if width < 1 or width & (width - 1):
        raise ValueError("the number of components must be a power of two")
    m = np.ones((1, 1), np.int64)
    while len(m) < width:
        m = np.block([[m, m], [m, -m]])
    return np.argsort((np.diff(m, axis=1) != 0).sum(axis=1), kind="stable")


def _over(x: np.ndarray) -> np.ndarray:
    """Integers not below the roots of squares (floats, exact within a part in 10**15)."""
    return np.ceil(np.sqrt(x.astype(float)) * (1 + 1e-12) + 1e-9)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each integer row its centroid's number and the squared distance."""
    n, width = x.shape
    if max(_most(x), _most(centroids)) >= SMALL:
        x, centroids = x.astype(object), centroids.astype(object)
    a, b = transform(x), transform(centroids)
    steps = [s for s in STEPS if s < width]
    row, number = (m.ravel() for m in np.indices((n, len(b))))
    total, start = np.zeros(len(row), a.dtype), 0
    for stop in (*steps, width):
        apart = a[row, start:stop] - b[number, start:stop]
        total = total + (apart * apart).sum(axis=1)
        start = stop
        if stop < width:
            # what is left of both has these lengths, so its difference lies between their difference and sum
            u, w = _over((a[:, stop:] * a[:, stop:]).sum(axis=1)), _over((b[:, stop:] * b[:, stop:]).sum(axis=1))
            far, near = u[row] + w[number], np.maximum(np.abs(u[row] - w[number]) - 2, 0)
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            so_far = total.astype(float)
            least = np.minimum.reduceat(so_far + far * far, first)
            keep = so_far + near * near <= np.repeat(least, np.diff(np.append(first, len(row)))) * (1 + 1e-12)
            row, number, total = row[keep], number[keep], total[keep]
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    best = np.minimum.reduceat(total, first)
    hit = np.flatnonzero(total == np.repeat(best, np.diff(np.append(first, len(row)))))
    hit = hit[np.append(True, row[hit[1:]] != row[hit[:-1]])]
    return number[hit], best // width


def _most(x: np.ndarray) -> int:
    return max(int(x.max()), -int(x.min())) if x.size else 0


def integers(vectors: pa.Array, width: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors that count, and their components times ``scale``, rounded down."""
    at = np.flatnonzero(pc.equal(pc.fill_null(pc.list_value_length(vectors), -1), width).to_numpy(zero_copy_only=False))
    x = vectors.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
    good = np.isfinite(x).all(axis=1)
    with np.errstate(over="ignore"):
        x = np.floor(x[good] * scale)
    if x.size and np.abs(x).max() >= 1 << 62:
        raise OverflowError("a component is too large for distances that fit a long")
    return at[good], x.astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], width: int, scale: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and integer rows, some thousand at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            at, x = integers(part.column(1), width, scale)
            if len(at):
                yield part.column(0).take(pa.array(at)), x


def first_centroids(vectors: DataFrame, k: int = K, seed: int = SEED, width: int = WIDTH, scale: int = SCALE) -> np.ndarray:
    """The integer vectors with the least hashes of seed and id. ``vectors``: id, vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _blocks(batches, width, scale):
            yield pa.RecordBatch.from_arrays([ids, pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), width).cast(pa.list_(pa.int64()))], ["id", "x"])

    rows = vectors.mapInArrow(run, f"id {vectors.schema['id'].dataType.simpleString()}, x array<long>")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    return np.array([r.x for r in rows.orderBy(name.asc_nulls_last(), "x").limit(k).select("x").collect()], np.int64).reshape(-1, width)


def improved(vectors: DataFrame, centroids: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The centroids after one round: means of their vectors, rounded down."""
    width = centroids.shape[1]
    names = ["cluster", "n", *(f"s{i}" for i in range(width))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), width), object)
        for _, x in _blocks(batches, width, scale):
            number, _ = nearest(x, centroids)
            n += np.bincount(number, minlength=len(n))
            exact = x if _most(x) < SMALL else x.astype(object)
            for c in np.unique(number):
                total[c] += exact[number == c].sum(axis=0).astype(object)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), *(pa.array(total[some, i].tolist(), pa.int64()) for i in range(width))], names)

    sums = vectors.mapInArrow(run, ", ".join(f"{c} long" for c in names)).groupBy("cluster").agg(*(F.sum(c).alias(c) for c in names[1:]))
    out = centroids.copy()
    for r in sums.collect():  # a row per centroid
        out[r.cluster] = [s // r.n for s in r[2:]]
    return out


def assigned(vectors: DataFrame, centroids: np.ndarray, scale: int = SCALE) -> DataFrame:
    """id, cluster, distance of each vector that counts."""
    width = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _blocks(batches, width, scale):
            number, distance = nearest(x, centroids)
            yield pa.RecordBatch.from_arrays([ids, pa.array(number, pa.int32()), pa.array(distance.tolist(), pa.int64())], ["id", "cluster", "distance"])

    return vectors.mapInArrow(run, f"id {vectors.schema['id'].dataType.simpleString()}, cluster int, distance long")


def cluster(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, rounds: int = ROUNDS, seed: int = SEED, width: int = WIDTH, scale: int = SCALE
) -> DataFrame:
    """Per vector: its id, cluster, distance (squared), cluster_inertia, inertia, and its final centroid."""
    spark = vectors.sparkSession
    _order(width)  # an error here rather than in a task
    rows = vectors.select(F.col(quoted(vec_id)).alias("id"), F.col(quoted(embedding)).alias("vector"))
    centroids = first_centroids(rows, k, seed, width, scale)
    for _ in range(rounds):
        centroids = improved(rows, centroids, scale)
    found = written(assigned(rows, centroids, scale), "clusters")
    inertia = {r.cluster: r.total for r in found.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}  # a row per centroid
    told = [(c, n, sum(inertia.values()), centroids[c].tolist()) for c, n in sorted(inertia.items())]
    told = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return found.join(F.broadcast(told), "cluster").select(F.col("id").alias(vec_id), "cluster", "distance", "cluster_inertia", "inertia", "centroid")
