"""The net's gradient against differences, its rounds on held-out tiles, and both inferences against plain passes."""

import numpy as np
import pytest

from gridloom.grid import Grid
from gridloom.operators import convnet


def test_gradient_against_differences():
    rng = np.random.default_rng(0)
    net = convnet.Net(3, 2, 2)
    x, label, mask = rng.normal(size=(3, 8, 12)), rng.normal(size=(8, 12)), rng.random((8, 12)) < 0.8
    found, tape = net.forward(x)
    assert found.shape == (8, 12)
    g = net.backward(tape, convnet.smooth_l1(found, label, mask)[1])
    for k in rng.choice(len(net.vector), 60, replace=False):
        loss = []
        for e in (1e-6, -1e-6):
            v = net.vector.copy()
            v[k] += e
            loss.append(convnet.smooth_l1(convnet.Net(3, 2, 2, v).forward(x)[0], label, mask)[0])
        assert g[k] == pytest.approx((loss[0] - loss[1]) / 2e-6, rel=1e-3, abs=1e-4)


def labelled(spark, h, w):
    """A label that depends on the neighbours of a cell, not on the cell alone."""
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(2, h, w))
    p = np.pad(a, 1, mode="edge")
    label = 0.5 + 0.2 * np.tanh(sum(p[i : i + h, j : j + w] for i in range(3) for j in range(3)) / 3) + 0.1 * (b > 0)
    cells = [(r, c, float(a[r, c]), float(b[r, c]), float(label[r, c]) if (r + c) % 11 else None, int((r * c) % 13 != 5)) for r in range(h) for c in range(w)]
    return Grid(spark.createDataFrame(cells, "row int, col int, a double, b double, label double, hard_mask int"), h, w), a, b


def test_training_and_both_inferences(spark):
    grid, a, b = labelled(spark, 45, 38)
    trained = convnet.train(grid, ["a", "b"], most=40, size=16, width=4, depth=1, rounds=25, batches=2, rate=0.02, check_every=25)
    assert len(trained.losses) == 2 and trained.losses[-1] < 0.6 * trained.losses[0]
    image, net = trained.image({"a": a, "b": b}), trained.net()
    mask = np.array([[(r * c) % 13 != 5 for c in range(38)] for r in range(45)])
    even = np.pad(image, ((0, 0), (0, 1), (0, 0)), mode="reflect")
    whole = np.maximum(net.forward(even)[0][:45], 0)
    for size in (16, 64):
        got = np.full((45, 38), np.nan)
        for r in convnet.surface(grid, trained, size).collect():
            got[r.row, r.col] = np.nan if r.predicted is None else r.predicted
        assert np.allclose(got, np.where(mask, whole, np.nan), equal_nan=True, atol=1e-9)
    total, count = np.zeros((45, 38)), np.zeros((45, 38))
    for y in range(0, 45 - 8, 12):
        for x in range(0, 38 - 8, 12):
            part = image[:, y : y + 20, x : x + 20]
            h, w = part.shape[1:]
            total[y : y + h, x : x + w] += net.forward(np.pad(part, ((0, 0), (0, 20 - h), (0, 20 - w)), mode="reflect"))[0][:h, :w]
            count[y : y + h, x : x + w] += 1
    got = np.full((45, 38), np.nan)
    for r in convnet.infer(grid, trained, 20, 12).collect():
        got[r.row, r.col] = np.nan if r.predicted is None else r.predicted
    assert np.allclose(got, np.where(mask, np.maximum(total / count, 0), np.nan), equal_nan=True, atol=1e-9)
