"""Reference systems against known points and round trips; sinks that commit whole or leave nothing."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gridloom import crs
from gridloom.grid import Grid
from gridloom.sources import rasters, shapes, sink


def test_known_points_and_round_trips():
    # published control values: the equator at a zone's middle, and a degree of latitude along it
    assert crs.system("EPSG:32631").forward(3.0, 0.0) == pytest.approx((500_000, 0))
    x, y = crs.system("EPSG:32633").forward(15.0, 60.0)
    assert (x, y) == pytest.approx((500_000, 0.9996 * 6_654_072.819), abs=0.01)  # the meridian's arc to 60 degrees on this ellipsoid
    assert crs.system("EPSG:3857").forward(180.0, 0.0)[0] == pytest.approx(20_037_508.342789)
    rng = np.random.default_rng(0)
    for code, lon0 in (("EPSG:3826", 121), ("EPSG:32651", 123), ("EPSG:32751", 123), ("EPSG:3857", 30), ("EPSG:4326", 10)):
        lon, lat = lon0 + rng.uniform(-3, 3, 500), rng.uniform(-75, 75, 500)
        back = crs.system(code).inverse(*crs.system(code).forward(lon, lat))
        assert np.abs(back[0] - lon).max() < 1e-8 and np.abs(back[1] - lat).max() < 1e-8
    with pytest.raises(ValueError):
        crs.system("EPSG:1")
    box = crs.bounds("EPSG:32651", 121.0, 22.0, 122.0, 23.0)
    x, y = crs.system("EPSG:32651").forward(*np.meshgrid(np.linspace(121, 122, 30), np.linspace(22, 23, 30)))
    assert box["west"] <= x.min() + 1 and box["east"] >= x.max() - 1 and box["south"] <= y.min() + 1 and box["north"] >= y.max() - 1


def test_reprojection_there_and_back(spark):
    """Each cell's own coordinates as layers: after both ways they are off by less than a tenth of a cell."""
    n = 40
    cells = spark.range(n * n).select((F.col("id") / n).cast("int").alias("row"), (F.col("id") % n).cast("int").alias("col"))
    source = Grid(cells, n, n, 100.0, 121.0, 24.0, 0.001)
    source = source.with_df(cells.withColumn("lon", source.lon_of(F.col("col"))).withColumn("lat", source.lat_of(F.col("row"))))
    box = crs.bounds("EPSG:3826", 121.0, 23.96, 121.04, 24.0)
    wide, high = int((box["east"] - box["west"]) / 100) + 1, int((box["north"] - box["south"]) / 100) + 1
    target = Grid(cells, high, wide, 100.0, box["west"], box["north"], 100.0)
    there = source.reproject(["lon", "lat"], "EPSG:4326", target, "EPSG:3826")
    assert there.df.count() == high * wide
    back = there.reproject(["lon", "lat"], "EPSG:3826", source, "EPSG:4326").df
    inner = back.filter("row between 3 and 36 and col between 3 and 36")
    off = inner.select(F.max(F.abs(F.col("lon") - source.lon_of(F.col("col")))), F.max(F.abs(F.col("lat") - source.lat_of(F.col("row")))), F.count("lon")).first()
    assert off[0] < 1e-4 and off[1] < 1e-4 and off[2] == 34 * 34
    away = Grid(cells, 3, 3, west=10.0, north=10.0)
    assert source.reproject("lon", "EPSG:4326", away).df.filter("lon is null").count() == 9


def test_shapefiles_read_back(spark, tmp_path):
    rows = [(p, k, 120 + p * 0.1 + k * 0.01, 22.0 + k * 0.02, f"line {p} é" if p else None) for p in range(5) for k in range(p + 1)]
    points = spark.createDataFrame(rows, "path_id long, seq int, lon double, lat double, label string").repartition(3)
    shapes.write_shapefiles(points, f"{tmp_path}/out", ["label"], files=2)
    got = {x.attributes["path_id"]: x for x in shapes.read_shapefile(spark, f"{tmp_path}/out").collect()}
    assert set(got) == {str(p) for p in range(5)} and {x.geom_type for x in got.values()} == {"line"}
    for p in range(5):
        want = [(lon, lat) for q, _, lon, lat, _ in rows if q == p]
        assert [(c.lon, c.lat) for c in got[str(p)].coords] == (want if p else want * 2)
        assert got[str(p)].attributes["label"] == (f"line {p} é" if p else "")
    with pytest.raises(PySparkException):
        shapes.write_shapefiles(points.withColumn("label", F.repeat(F.lit("x"), 300)), f"{tmp_path}/none", ["label"])
    assert not list((tmp_path / "none").glob("*")) if (tmp_path / "none").exists() else True


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    good = spark.range(6).repartition(3).select(F.concat(F.lit("f"), "id").alias("name"), F.encode(F.col("id").cast("string"), "utf-8").alias("data"))
    sink.write_files(good, f"{tmp_path}/a")
    assert {f.name: f.read_text() for f in (tmp_path / "a").iterdir()} == {f"f{k}": str(k) for k in range(6)}
    bad = good.withColumn("data", F.when(F.col("name") == "f4", F.raise_error(F.lit("no"))).otherwise(F.col("data")).cast("binary"))
    with pytest.raises(PySparkException):
        sink.write_files(bad, f"{tmp_path}/b")
    assert not (tmp_path / "b").exists() or not list((tmp_path / "b").iterdir())


def test_windows_read_their_tiles_only(spark, tmp_path):
    cells = spark.range(40 * 40).select((F.col("id") / 40).cast("int").alias("row"), (F.col("id") % 40).cast("int").alias("col"), F.col("id").alias("z"))
    rasters.write_raster(cells, f"{tmp_path}/r", tile=16)
    window = rasters.read_raster(spark, f"{tmp_path}/r", (14, 18), (33, 39), tile=16)
    assert {(x.row, x.col): x.z for x in window.collect()} == {(r, c): r * 40 + c for r in range(14, 18) for c in range(33, 39)}
    assert {f.rsplit("/", 1)[0].split("/r/")[1] for f in window.inputFiles()} >= {"tile_row=0/tile_col=2", "tile_row=1/tile_col=2"}
    assert "PartitionFilters: [isnotnull(tile_row" in window._jdf.queryExecution().executedPlan().toString().replace("PartitionFilters: [isnotnull(tile_col", "PartitionFilters: [isnotnull(tile_row")
