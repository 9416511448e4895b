"""Kernels over tiles with halos against the same kernels over the whole grid, and against plain loops."""

import numpy as np
import pytest

from gridloom.grid import Grid
from gridloom.operators import focal, risk, tiles


def grid_of(spark, z, **layers):
    cells = [(r, c, None if np.isnan(v) else float(v), f"{r}-{c}") for r, line in enumerate(z) for c, v in enumerate(line)]
    return Grid(spark.createDataFrame(cells, "row int, col int, z double, name string").repartition(3), *z.shape, cell=30.0)


def array(df, layer, shape):
    out = np.full(shape, np.nan)
    for r in df.select("row", "col", layer).collect():
        out[r.row, r.col] = np.nan if r[layer] is None else r[layer]
    return out


def test_tiles_give_what_the_whole_grid_gives(spark, monkeypatch):
    rng = np.random.default_rng(1)
    z = rng.normal(300, 80, (37, 23))
    z[5, 6] = z[20, 22] = np.nan
    kernels = {"slope": (focal.slope, {}), "curvature_plan": (focal.curvature, {}), "tri": (focal.tri, {}), "roughness": (focal.roughness, {}), "tpi": (focal.tpi, {}), "landslide": (risk.landslide, {}), "typhoon": (risk.typhoon, {}), "aspect_cos": (focal.terrain, {})}
    whole = {k: array(f(grid_of(spark, z)), k, z.shape) for k, (f, _) in kernels.items()}
    real = tiles.apply
    monkeypatch.setattr(tiles, "apply", lambda *a: real(*a, 8))
    for k, (f, _) in kernels.items():
        got = f(grid_of(spark, z))
        assert np.allclose(array(got, k, z.shape), whole[k], rtol=0, atol=1e-9, equal_nan=True), k
        assert got.count() == z.size and got.filter("name <> concat(row, '-', col)").count() == 0
    for mode in ("reflect", "nearest"):
        tiled = array(focal.gaussian(grid_of(spark, z), "z", 1.5, "b", mode), "b", z.shape)
        monkeypatch.setattr(tiles, "apply", real)
        assert np.allclose(tiled, array(focal.gaussian(grid_of(spark, z), "z", 1.5, "b", mode), "b", z.shape), equal_nan=True)
        monkeypatch.setattr(tiles, "apply", lambda *a: real(*a, 8))


def test_one_exchange(spark):
    g = grid_of(spark, np.ones((9, 9)))
    for df in (risk.landslide(g), focal.slope(g), focal.gaussian(g, "z", 2.0, "b"), risk.typhoon(g)):
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_kernels_against_loops():
    rng = np.random.default_rng(2)
    z = rng.normal(size=(6, 5))
    z[2, 2] = np.nan
    at = lambda i, n: -1 - i if i < 0 else 2 * n - 1 - i if i >= n else i
    for r in range(6):
        for c in range(5):
            lines = [[z[at(r + i, 6), at(c + j, 5)] for j in (-1, 0, 1)] for i in (-1, 0, 1)]
            assert focal.mean(z, 3)[r, c] == pytest.approx(np.mean([np.nanmean(x) for x in lines]))
    d = focal.difference(z, "col", 10.0)
    assert d[0, 0] == (z[0, 1] - z[0, 0]) / 10 and d[0, 2] == (z[0, 3] - z[0, 1]) / 20 and d[2, 1] == (z[2, 1] - z[2, 0]) / 10 and d[2, 2] == (z[2, 3] - z[2, 1]) / 20
    assert np.isnan(focal.difference(np.ones((1, 1)), "row", 1.0)).all()


def test_halo_wider_than_the_tiles(spark, monkeypatch):
    real = tiles.apply
    z = np.arange(60.0).reshape(6, 10) ** 1.5
    whole = array(focal.gaussian(grid_of(spark, z), "z", 2.0, "b"), "b", z.shape)
    monkeypatch.setattr(tiles, "apply", lambda *a: real(*a, 3))
    assert np.allclose(array(focal.gaussian(grid_of(spark, z), "z", 2.0, "b"), "b", z.shape), whole)


def test_bilinear_samples_of_repeated_rows(spark):
    g = grid_of(spark, np.array([[0.0, 10.0, 20.0], [30.0, 40.0, np.nan], [60.0, 70.0, 80.0]]))
    points = spark.createDataFrame([(1, 0.5, 0.5, 7), (1, 0.5, 0.5, 7), (2, 1.0, 1.0, 0), (3, 0.5, 1.5, 0), (4, 5.0, 0.0, 0), (5, None, 1.0, 0), (None, 2.0, 1.5, 0)], "id long, fr double, fc double, value int").repartition(2)
    got = g.sample_bilinear(points, "z")
    assert got.columns == ["id", "fr", "fc", "value", "z"]
    assert sorted(((r.id, r.z) for r in got.collect()), key=str) == sorted([(1, 20.0), (1, 20.0), (2, 40.0), (3, None), (4, None), (5, None), (None, 75.0)], key=str)


def test_the_mosaic_is_of_tiles_that_overlap_both_ways(spark, tmp_path):
    import duckdb

    from gridloom.plans import oracles, queries

    spark.createDataFrame([(r, [float((r * 7 + c * 3) % 11) / 1000 for c in range(64)]) for r in range(70)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {(x.row, x.col): x.predicted for x in queries.tile_mosaic(spark, str(tmp_path)).collect()}
    assert len(got) == 70 * 64
    # rows 22 to 47 lie in the tiles from 0 and from 22, columns 16 to 47 in those from 0 and from 16
    assert got[30, 5] == pytest.approx((30 * 7 + 15) % 11 + 11) and got[30, 30] == pytest.approx((210 + 90) % 11 + 19)
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert {(r, c): v for r, c, v in duckdb.sql(oracles.ORACLES["tile_mosaic"]).fetchall()} == pytest.approx(got)
