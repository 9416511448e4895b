"""The forest's trees against plain growing, in blocks and whole, and what the driver holds of them."""

import numpy as np
import pytest

from gridloom.config import V2
from gridloom.operators import forest, model


def plain(x, y, w, depth, least):
    """A tree on one band, grown one node at a time: each row's mean."""
    out = np.full(len(x), (w * y).sum() / w.sum())
    options = []
    for cut in range(int(x.max())):
        left = x <= cut
        a, b = w[left].sum(), w[~left].sum()
        if min(a, b) >= least:
            options.append(((w * y)[left].sum() ** 2 / a + (w * y)[~left].sum() ** 2 / b - (w * y).sum() ** 2 / w.sum(), -cut))
    if depth and options and max(options)[0] > 1e-12:
        left = x <= -max(options)[1]
        out[left], out[~left] = (plain(x[s], y[s], w[s], depth - 1, least) for s in (left, ~left))
    return out


@pytest.mark.parametrize("cap", [40, 150, 10**9])
def test_a_tree_is_the_same_however_few_rows_a_task_holds(cap):
    rng = np.random.default_rng(4)
    x, w = rng.integers(0, 32, 600), rng.poisson(1.0, 600)
    y = np.sin(x / 4) + rng.normal(0, 0.3, 600)
    x, y, w = x[w > 0], y[w > 0], w[w > 0].astype(float)
    passes = []

    def read():
        passes.append(1)
        for k in range(0, len(x), 100):
            yield x[k : k + 100, None].astype(np.uint8), y[k : k + 100], w[k : k + 100]

    grown, gains = forest.grow(read, int(w.sum()), 0, 1, 4, 10, 42, cap)
    assert grown.value[grown.place(x[:, None].astype(np.uint8))] == pytest.approx(plain(x, y, w, 4, 10)) and gains[0] > 0
    assert len(passes) == 1 if cap == 10**9 else len(passes) > 2


def test_trees_stay_in_the_shared_folder(spark):
    rng = np.random.default_rng(5)
    rows = [(k, 0, *map(float, v), int(k % 2), float(np.sin(9 * v[0]) + v[1] * 0.2)) for k, v in enumerate(rng.random((2000, 3)))]
    df = spark.createDataFrame(rows, "row int, col int, a double, b double, c double, code int, label double")
    fitted = model.train_forest(df, V2, bands=["a", "b", "c", "code"], trees=12, depth=12)
    # what the driver holds are thresholds, 31 a band at most
    assert sum(c.nbytes for c in fitted.cuts) <= 4 * 31 * 8 and len(fitted.cuts[3]) == 1
    assert spark.read.parquet(fitted.path).count() == 12
    assert model.r_squared(fitted, df) > 0.95 and model.importances(fitted, ["a", "b", "c", "code"])[0][0] == "a"
    told = fitted.transform(df)
    assert told.columns == [*df.columns, "a_scaled", "b_scaled", "c_scaled", "code_scaled", "prediction"] and told.count() == 2000
    few = forest.train(df, model.scaler(df, ["a"]), ["a"], 3, 5, 10, 42, cap=100)
    whole = forest.train(df, model.scaler(df, ["a"]), ["a"], 3, 5, 10, 42)
    a, b = ({r.row: r.prediction for r in m.transform(df).collect()} for m in (few, whole))
    assert a == pytest.approx(b) and len(a) == 2000
    assert not whole.transform(df.limit(0)).count()


def test_draws_are_poisson_and_differ_between_trees():
    key = np.arange(200_000)
    one, two = forest._draws(key, 0, 42), forest._draws(key, 1, 42)
    for w in (one, two):
        assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs((w == 0).mean() - np.exp(-1)) < 0.01
    assert abs(np.corrcoef(one, two)[0, 1]) < 0.01
