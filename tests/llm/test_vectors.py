"""Whitening and clustering against plain numpy and Python, on hand-made cases and the test tables."""

import hashlib
import os
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from gridloom.llm import clustering, oracles, whitening
from gridloom.llm import queries as q

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
SCHEMA = "vec_id long, embedding array<float>, label int, x string, component string, cluster string, size int"


def frame(spark, vectors, parts=3):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 0, "x", "y", "z", 1) for i, v in vectors], SCHEMA).repartition(parts)


def against_numpy(rows, vectors, k=16):
    """rows of whitened() for vectors (id, entries), all of one length."""
    x = [tuple(int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v) for _, v in vectors]
    fit = sorted(set(x))
    n, d = len(fit), len(fit[0])
    s = [sum(v[i] for v in fit) for i in range(d)]
    centred = np.array([[float(Fraction(n * v[i] - s[i], n)) for i in range(d)] for v in fit])
    cov = centred.T @ centred / n
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1], basis[:, ::-1]
    keep = min(k, int((values > 1e-11 * values.sum()).sum()))
    got = {}
    for r in rows:
        got.setdefault(r.vec_id, {})[r.component] = r
    ids = Counter(i for i, _ in vectors)
    assert len(rows) == sum(ids.values()) * keep
    at = {i: v for (i, _), v in zip(vectors, x, strict=True)}
    white = {}
    for i, v in at.items():
        y = np.array([float(Fraction(n * v[j] - s[j], n)) for j in range(d)])
        for c in range(1, keep + 1):
            r = got[i][c]
            assert r.n == n and r.deviation == sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True))
            assert r.explained == pytest.approx(values[c - 1] / values.sum(), rel=1e-6) and r.identity_error < 1e-9
            if all(abs(values[c - 1] - values[o]) > 1e-6 * values[0] for o in range(d) if o != c - 1):
                assert abs(r.whitened) == pytest.approx(abs(y @ basis[:, c - 1]) / np.sqrt(values[c - 1]), rel=1e-6, abs=1e-6)
        white[v] = [got[i][c].whitened for c in range(1, keep + 1)]
    w = np.array([white[v] for v in fit])
    assert np.abs((w - w.mean(axis=0)).T @ (w - w.mean(axis=0)) / n - np.eye(keep)).max() < 1e-9


def test_whitening_of_odd_vectors(spark):
    rng = np.random.default_rng(4)
    mixed = rng.normal(size=(60, 6)) @ np.diag([900, 40, 3, 1, 0.3, 0.05])
    good = [(i, v) for i, v in enumerate(mixed)] + [(7, mixed[7]), (None, mixed[3]), (200, mixed[5])]
    bad = [(90, None), (91, [1, None, 2, 3, 4, 5]), (92, [float("nan")] * 6), (93, [float("inf")] + [0.0] * 5), (94, [])]
    other = [(300, [1.0, 2.0]), (301, [3.0, 2.5]), (302, [-1.0, 7.0])]
    rows = whitening.whitened(frame(spark, good + bad + other)).collect()
    against_numpy([r for r in rows if r.vec_id not in (300, 301, 302)], good)
    against_numpy([r for r in rows if r.vec_id in (300, 301, 302)], other)
    assert not whitening.whitened(frame(spark, bad)).collect() and not whitening.whitened(frame(spark, [])).collect()
    assert not whitening.whitened(frame(spark, [(1, [2.0, 3.0]), (2, [2.0, 3.0])])).collect()  # no spread at all


def test_small_eigenvalues_keep_their_digits():
    """A matrix whose eigenvalues span fourteen powers of ten, in which doubles would lose the smallest."""
    rng = np.random.default_rng(1)
    basis = np.linalg.qr(rng.normal(size=(20, 20)))[0].astype(np.longdouble)
    for _ in range(3):  # orthogonal to extended precision
        basis = basis @ (1.5 * np.eye(20, dtype=np.longdouble) - 0.5 * basis.T @ basis)
    values = np.longdouble(10.0) ** -np.linspace(0, 14, 20)
    found, vectors = whitening.jacobi((basis * values) @ basis.T)
    assert np.abs(found / values - 1).max() < 1e-4 and np.abs(vectors.T @ vectors - np.eye(20)).max() < 1e-17


@needs_data
def test_whitening_of_the_table(spark):
    rows = q.op11_whitening(spark, DATA).collect()
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    against_numpy(rows, vectors)


def plain_kmeans(vectors, k=16, rounds=3, dims=64):
    kept = [(i, [int(np.floor(64 * float(np.float32(c)))) for c in v]) for i, v in vectors if v is not None and len(v) == dims and all(c is not None and np.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(centres)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            if mine:
                centres[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    last = [near(v) for _, v in kept]
    total = sum(d for d, _ in last)
    return Counter((i, j, d, sum(x for x, o in last if o == j), total, hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, last, strict=True))


def rows_of(df):
    return Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def test_clusters_against_plain_rounds(spark):
    rng = np.random.default_rng(8)
    vectors = [(i, v) for i, v in enumerate(np.vstack([rng.normal(c, 0.4, (40, 4)) for c in (-2, 0, 0.5, 3)]))]
    vectors += [(5, vectors[5][1]), (None, vectors[9][1]), (400, [0.0, 0.0, 0.0]), (401, None), (402, [1.0, None, 1.0, 1.0]), (403, [float("nan")] * 4)]
    vectors += [(500 + i, [i % 3 / 64, i % 2 / 64, 0, 0]) for i in range(30)]  # many ties
    for k, rounds, keep in ((16, 3, 8), (5, 7, 2), (1, 2, 8), (3, 0, 8), (300, 2, 1)):
        assert rows_of(clustering.clusters(frame(spark, vectors), k, rounds, 4, keep_every=keep)) == plain_kmeans(vectors, k, rounds, 4), (k, rounds)
    assert clustering.clusters(frame(spark, []), dims=4).count() == 0 and clustering.clusters(frame(spark, vectors[-40:]), dims=9).count() == 0


def test_balls_leave_out_only_what_is_farther():
    rng = np.random.default_rng(2)
    for _ in range(50):
        x, c = rng.integers(-9, 9, (200, 3)), rng.integers(-9, 9, (7, 3))
        own = rng.integers(0, 7, 200).astype(np.int32)
        reach = [int(np.ceil(np.sqrt(max([((v - c[j]) ** 2).sum() for v in x[own == j]], default=0)))) for j in range(7)]
        for balls in (clustering.Balls.around(c.tolist(), [None] * 7), clustering.Balls.around(c.tolist(), reach)):
            for a, b in zip(clustering.moved(x, own, balls), clustering.nearest(x, c), strict=True):
                assert (a == b).all()


@needs_data
def test_clusters_of_the_table(spark):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    assert rows_of(q.op12_ball_kmeans(spark, DATA)) == plain_kmeans(vectors)
    assert "op12_ball_kmeans" in oracles.ORACLES
