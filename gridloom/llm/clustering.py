"""Centroid clustering: exact ball k-means over integer vectors.

A cluster is a ball: its centroid, and a radius that reaches its farthest member. After centroids have moved, only
clusters whose centroid is within twice a ball's radius are its neighbours, sorted by distance. A member nearer to its
centroid than half the way to the first neighbour is in the stable core and stays; others lie in rings between half the
ways to one neighbour and the next, and are compared exactly with the neighbours of the rings that they have passed, and
with no others. All is in whole numbers, so no member is judged by a rounded distance, and ties go to the smaller number.

Rounds run as one job each: a task takes its vectors through the centroids of the rounds so far (rounds * k * d numbers,
in the tasks' closure) and returns counts, sums and radii for each cluster, k * d rows, which are added up; so nothing is
written between rounds and a lost executor's part is computed again from the input. As that repeats earlier rounds, the
vectors and their clusters are written every keep_every rounds and go on from there. Nothing is dealt by cluster, so a
cluster that holds most vectors is no hot key.

Defined cases: vectors without exactly dims entries, with one that is null or not finite, or 2**21 and over, are not kept. Fewer
vectors than k: as many clusters as there are vectors; none: no rows. Repeated rows each count. A null vec_id comes last in the
choice of centroids; equal hashes are ordered by the vectors. An inertia over 64 bits is null. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import written
from gridloom.llm.vectors import whole
from gridloom.llm.whitening import _decimals

BELOW = 2.0**27  # of 64 * c: squared distances of 64 of them fit 64 bits


@dataclass
class Balls:
    """Centroids (k x d), and for each its neighbours by distance, with the squares of their distances."""

    centres: np.ndarray
    near: list[np.ndarray]
    squares: list[np.ndarray]

    @classmethod
    def around(cls, centres: list[list[int]], reach: list[int | None]) -> Balls:
        """reach: a whole number that no member of the ball is farther away than; None: not known."""
        c = np.array(centres, np.int64).reshape(len(centres), -1)
        near, squares = [], []
        for i in range(len(c)):
            d = ((c - c[i]) ** 2).sum(axis=1)
            order = np.argsort(d, kind="stable")
            order = order[(order != i) & np.array([reach[i] is None or int(x) <= 4 * reach[i] ** 2 for x in d[order]], bool)]
            near.append(order)
            squares.append(d[order])
        return cls(c, near, squares)


def _squares(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    d = x - centre
    return np.einsum("ij,ij->i", d, d)


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of all centroids, and the square of its distance."""
    best, square = np.zeros(len(x), np.int32), _squares(x, centres[0])
    for j in range(1, len(centres)):
        d = _squares(x, centres[j])
        better = d < square
        best[better], square[better] = j, d[better]
    return best, square


def moved(x: np.ndarray, own: np.ndarray, balls: Balls) -> tuple[np.ndarray, np.ndarray]:
    """As nearest(), for members of the clusters own: cores stay, rings meet the neighbours they have passed."""
    best, square = own.copy(), _squares(x, balls.centres[own])
    for i in np.unique(own):
        members = np.flatnonzero(own == i)
        passed = np.searchsorted(balls.squares[i], 4 * square[members], side="right")
        for ring in range(passed.max(initial=0)):
            some = members[passed > ring]
            j = balls.near[i][ring]
            d = _squares(x[some], balls.centres[j])
            better = (d < square[some]) | ((d == square[some]) & (j < best[some]))
            best[some[better]], square[some[better]] = j, d[better]
    return best, square


def _assigned(batch: pa.RecordBatch, history: list[Balls], dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The batch's vectors, their clusters after all rounds of history, and squared distances. Vectors without a cluster start at the first."""
    x = batch.column("x").flatten().to_numpy().reshape(-1, dims)
    cluster = batch.column("cluster")
    if cluster.null_count:  # all of them
        own, square = nearest(x, history[0].centres)
        history = history[1:]
    else:
        own, square = cluster.to_numpy(), None
    for balls in history:
        own, square = moved(x, own, balls)
    return x, own, square


@dataclass
class Clusters:
    """What each cluster has: members, sums, squared radius, and squared distances in all."""

    count: list[int]
    sums: list[list[int]]
    radius: list[int]
    inertia: list[int]


def _measured(rows: DataFrame, history: list[Balls], dims: int) -> Clusters:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(history[-1].centres)
        count, radius, inertia, sums = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros(k, object), np.zeros((k, dims), object)
        for batch in batches:
            x, own, square = _assigned(batch, history, dims)
            for i in np.unique(own):
                mine = own == i
                count[i] += mine.sum()
                radius[i] = max(radius[i], square[mine].max())
                inertia[i] += sum(square[mine].tolist())
                sums[i] += x[mine].sum(axis=0).astype(object)
        for i in np.flatnonzero(count):
            yield pa.RecordBatch.from_arrays([pa.array([i] * dims, pa.int32()), pa.array(range(dims), pa.int32()), pa.array([count[i]] * dims, pa.int64()), pa.array([radius[i]] * dims, pa.int64()), _decimals([inertia[i]] * dims), _decimals(list(sums[i]))], ["cluster", "i", "n", "radius", "inertia", "s"])

    added = lambda c: F.sum(c).cast("decimal(38,0)").alias(c)
    found = rows.mapInArrow(run, "cluster int, i int, n long, radius long, inertia decimal(38,0), s decimal(38,0)").groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), added("inertia"), added("s")).collect()
    k = len(history[-1].centres)
    out = Clusters([0] * k, [[0] * dims for _ in range(k)], [0] * k, [0] * k)
    for r in found:
        i = r["cluster"]
        out.count[i], out.radius[i], out.inertia[i], out.sums[i][r["i"]] = r["n"], r["radius"], int(r["inertia"]), int(r["s"])
    return out


def _after(balls: Balls, now: Clusters) -> Balls:
    """The balls of centroids moved to their members' floored means; a cluster without members stays. A ball reaches as far as before, and as far as its centroid moved."""
    centres, reach = [], []
    for old, n, s, radius in zip(balls.centres.tolist(), now.count, now.sums, now.radius, strict=True):
        new = [x // n for x in s] if n else old
        centres.append(new)
        reach.append(isqrt(radius) + 1 + isqrt(sum((a - b) ** 2 for a, b in zip(new, old, strict=True))) + 1)
    return Balls.around(centres, reach)


def clusters(embeddings: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, seed: int = 1, keep_every: int = 8) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_size, cluster_inertia, inertia, centroid_sha256 of embeddings (vec_id, embedding). The first centroids are the k vectors with the least SHA-256 of seed:vec_id."""
    rows = whole(embeddings, BELOW).filter(F.size("x") == dims)
    first = rows.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "x").orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()
    state = rows.withColumn("cluster", F.lit(None).cast("int"))
    schema = "vec_id long, cluster int, distance long, cluster_size long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return rows.sparkSession.createDataFrame([], schema)
    history = [Balls.around([r["x"] for r in first], [None] * len(first))]
    for done in range(1, rounds + 1):
        history.append(_after(history[-1], _measured(state, history, dims)))
        if done % keep_every == 0 and done < rounds:
            state, history = _kept(state, history[:-1], dims), history[-1:]
    now = _measured(state, history, dims)
    long = lambda v: v if v < 1 << 63 else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in history[-1].centres.tolist()]
    of = [pa.array(now.count, pa.int64()), pa.array(list(map(long, now.inertia)), pa.int64()), pa.array([long(sum(now.inertia))] * len(digest), pa.int64()), pa.array(digest)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, own, square = _assigned(batch, history, dims)
            place = pa.array(own)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(own, pa.int32()), pa.array(square), *(c.take(place) for c in of)], ["vec_id", "cluster", "distance", "cluster_size", "cluster_inertia", "inertia", "centroid_sha256"])

    return state.mapInArrow(run, schema)


def _kept(state: DataFrame, history: list[Balls], dims: int) -> DataFrame:
    """state with the clusters that history leads to, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _assigned(batch, history, dims)[1]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), pa.array(own, pa.int32())], ["vec_id", "x", "cluster"])

    return written(state.mapInArrow(run, "vec_id long, x array<long>, cluster int"), "clusters")
