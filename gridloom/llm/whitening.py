"""Embedding whitening: the exact scatter of integer vectors, summed over tasks, and cyclic Jacobi rotations on the driver.

The entries are whole numbers, so sums are exact: one job sums each dimension over the distinct vectors (the fit list,
written once), the next sums the products of entries centred at the whole number nearest to their mean, and the rest of
the mean is taken off exactly. The covariance is therefore rounded once, to extended precision, and small eigenvalues
don't drown in what was cancelled. The driver holds d * d numbers (64: 32 KB), not rows. Jacobi rotations go over all pairs of
dimensions until every off-diagonal entry is negligible beside its two diagonal ones, which keeps small eigenvalues
accurate where a threshold on the whole would not. Components are sorted, scaled and broadcast (d * components numbers);
scoring rows needs no shuffle. The only shuffles are of the distinct vectors and of d * d / 2 partial sums from each task.

Defined cases: rows go whose vector is null or has an entry that is null or not finite, or is 2**40 and over. Vectors of
different lengths are populations of their own, each with its own n, components and errors; empty vectors have none.
Repeated rows are each returned, and count once in the fit. A component whose eigenvalue is below 1e-13 of the trace, or
0, has no rows: its direction is rounding. A deviation over 64 bits is null. Null ids stay. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Context
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import written
from gridloom.llm.vectors import by_length, whole

SHIFT, BELOW, TINY = 1_000_000, 2.0**46, 1e-13
_WHOLE = pa.decimal128(38, 0)
_EXACT = Context(prec=38)


def _decimals(values: list[int]) -> pa.Array:
    return pa.array([_EXACT.create_decimal(int(v)) for v in values], _WHOLE)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        for size, rows, x in by_length(batch.column("x")):
            n, s = found.get(size, (0, np.zeros(size, object)))
            found[size] = n + len(rows), s + x.sum(axis=0).astype(object)
    for size, (n, s) in found.items():
        yield pa.RecordBatch.from_arrays([pa.array([size] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()), _decimals(list(s))], ["size", "i", "n", "s"])


def _products(x: np.ndarray) -> np.ndarray:
    """x' x, exact: in doubles where no sum can leave their 53 bits, else in Python's integers."""
    most = int(np.abs(x).max(initial=0))
    if most * most * len(x) < 1 << 53:
        d = x.astype(np.float64)
        return (d.T @ d).astype(np.int64).astype(object)
    d = x.astype(object)
    return d.T @ d


@dataclass
class Moments:
    """n distinct vectors; their sums; the whole number nearest to each mean, and what the sums have beyond n of it."""

    n: int
    sums: list[int]

    def __post_init__(self) -> None:
        self.centre = [(2 * s + self.n) // (2 * self.n) for s in self.sums]
        self.rest = [s - self.n * c for s, c in zip(self.sums, self.centre, strict=True)]

    def covariance(self, scatter: dict[tuple[int, int], int]) -> np.ndarray:
        """Of what lies about the centres: rounded once, to extended precision."""
        d = len(self.sums)
        out = np.zeros((d, d), np.longdouble)
        for (i, j), s in scatter.items():
            exact = Fraction(self.n * s - self.rest[i] * self.rest[j], self.n * self.n)
            high = float(exact)
            out[i, j] = out[j, i] = np.longdouble(high) + np.longdouble(float(exact - Fraction(high)))
        return out


def jacobi(a: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, of a symmetric matrix, whose largest entry is positive. Sweeps over all pairs of dimensions rotate each off-diagonal entry away, until all are negligible beside the diagonal."""
    a = a.astype(np.longdouble)
    n, eps = len(a), np.finfo(np.longdouble).eps
    v = np.eye(n, dtype=np.longdouble)
    floor = eps * eps * np.abs(a).max(initial=0)
    for _ in range(sweeps):
        rotated = False
        for p in range(n - 1):
            for q in range(p + 1, n):
                x = a[p, q]
                if abs(x) <= max(floor, eps * np.sqrt(abs(a[p, p] * a[q, q]))):
                    continue
                rotated = True
                turn = (a[q, q] - a[p, p]) / (2 * x)
                t = (1 if turn >= 0 else -1) / (abs(turn) + np.sqrt(turn * turn + 1))
                c = 1 / np.sqrt(t * t + 1)
                s = t * c
                for m in (a, v):
                    m[:, p], m[:, q] = c * m[:, p] - s * m[:, q], s * m[:, p] + c * m[:, q]
                a[p], a[q] = c * a[p] - s * a[q], s * a[p] + c * a[q]
                a[p, q] = a[q, p] = 0
        if not rotated:
            break
    values = np.diag(a).copy()
    order = np.argsort(-values, kind="stable")
    v = v[:, order]
    sign = np.sign(v[np.abs(v).argmax(axis=0), np.arange(n)]) if n else np.ones(0)
    return values[order], v * sign


@dataclass
class Whitener:
    """What whitens vectors of one length. matrix: d * components, each column an eigenvector over the root of its eigenvalue."""

    moments: Moments
    values: np.ndarray
    matrix: np.ndarray
    explained: np.ndarray
    error: float = 0.0

    def project(self, x: np.ndarray) -> np.ndarray:
        mean = np.array([float(Fraction(r, self.moments.n)) for r in self.moments.rest])
        return ((x - np.array(self.moments.centre, np.int64)).astype(np.float64) - mean) @ self.matrix

    def deviations(self, x: np.ndarray) -> list[int | None]:
        m = self.moments
        x = x - np.array(m.centre, np.int64)
        most = m.n * int(np.abs(x).max(initial=0)) + max(map(abs, m.rest), default=0)
        if most * most * max(1, len(m.rest)) < 1 << 63:
            return ((m.n * x - np.array(m.rest, np.int64)) ** 2).sum(axis=1).tolist()
        found = ((m.n * x.astype(object) - np.array(m.rest, object)) ** 2).sum(axis=1)
        return [int(v) if v < 1 << 63 else None for v in found]


def fit(rows: DataFrame, components: int = 16) -> dict[int, Whitener]:
    """A Whitener for each length of the vectors of rows (x), which are told apart: the fit list."""
    spark = rows.sparkSession
    listed = written(rows.select("x").dropDuplicates(), "whitening")
    sums: dict[int, dict[int, tuple[int, int]]] = {}
    for r in listed.mapInArrow(_sums, "size int, i int, n long, s decimal(38,0)").groupBy("size", "i").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s")).collect():
        sums.setdefault(r["size"], {})[r["i"]] = (r["n"], int(r["s"]))
    moments = {size: Moments(found[0][0], [found[i][1] for i in range(size)]) for size, found in sums.items()}
    if not moments:
        return {}

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for size, _, x in by_length(batch.column("x")):
                if size:
                    found[size] = found.get(size, 0) + _products(x - np.array(moments[size].centre, np.int64))
        for size, s in found.items():
            i, j = np.triu_indices(size)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), size), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), _decimals(list(s[i, j]))], ["size", "i", "j", "s"])

    products: dict[int, dict[tuple[int, int], int]] = {}
    for r in listed.mapInArrow(scatter, "size int, i int, j int, s decimal(38,0)").groupBy("size", "i", "j").agg(F.sum("s").cast("decimal(38,0)").alias("s")).collect():
        products.setdefault(r["size"], {})[r["i"], r["j"]] = int(r["s"])
    model = {}
    for size, m in moments.items():
        covariance = m.covariance(products[size])
        trace = np.trace(covariance)
        values, vectors = jacobi(covariance)
        keep = np.flatnonzero(values[:components] > TINY * trace)
        model[size] = Whitener(m, values[keep].astype(float), (vectors[:, keep] / np.sqrt(values[keep])).astype(float), (values[keep] / (trace or 1)).astype(float))
    held = spark.sparkContext.broadcast(model)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for size, _, x in by_length(batch.column("x")):
                if size:
                    y = held.value[size].project(x)
                    found[size] = found.get(size, 0) + y.T @ y  # their mean is 0
        for size, s in found.items():
            i, j = np.triu_indices(len(s))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), size), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(s[i, j], pa.float64())], ["size", "i", "j", "s"])

    for r in listed.mapInArrow(spread, "size int, i int, j int, s double").groupBy("size", "i", "j").agg(F.sum("s").alias("s")).collect():
        w = model[r["size"]]
        w.error = max(w.error, abs(r["s"] / w.moments.n - (r["i"] == r["j"])))
    return model


def apply(rows: DataFrame, model: dict[int, Whitener]) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, eigenvalue, identity_error: a row for each component of each of rows (vec_id, x)."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, at, x in by_length(batch.column("x")):
                w = held.value.get(size)
                if w is None or not len(w.values):
                    continue
                k, m = len(w.values), len(at)
                each = lambda v: pa.array(np.repeat(v, k))  # noqa: E731,B023
                place = pa.array(np.repeat(at, k))
                deviation = pa.array(w.deviations(x), pa.int64()).take(each(np.arange(m)))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(place), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, w.moments.n), pa.int64()), deviation, pa.array(w.project(x).ravel()), pa.array(np.tile(w.explained, m)), pa.array(np.tile(w.values, m)), pa.array(np.full(m * k, w.error))], ["vec_id", "component", "n", "deviation", "whitened", "explained", "eigenvalue", "identity_error"])

    return rows.select("vec_id", "x").mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, eigenvalue double, identity_error double")


def whitened(embeddings: DataFrame, components: int = 16) -> DataFrame:
    """The rows of apply() for embeddings (vec_id, embedding), by a fit on their distinct vectors."""
    rows = whole(embeddings, BELOW, SHIFT)
    return apply(rows, fit(rows, components))
