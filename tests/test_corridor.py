"""Operators on hand-computed grids and lines, and invariants."""

import json
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.config import BANDS, LAND_USE, V1, V2
from gridloom.grid import Grid
from gridloom.operators import cost, focal, gate, model, paths, report, risk, search, vector
from gridloom.sources import osm, rasters


def grid(spark, z, cell=30.0):
    z = np.asarray(z, float)
    rows = [(i, j, None if np.isnan(v) else float(v)) for i, line in enumerate(z) for j, v in enumerate(line)]
    return Grid(spark.createDataFrame(rows, "row int, col int, z double"), *z.shape, cell)


def matrix(df, layer, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.row, r.col] = np.nan if r[layer] is None else r[layer]
    return out


def plane(n=5):
    return [[10 * i + 5 * j for j in range(n)] for i in range(n)]


def test_plane(spark):
    g = grid(spark, plane())
    assert matrix(focal.slope(g), "slope", (5, 5)) == pytest.approx(np.full((5, 5), 20.439318), abs=1e-6)
    a = focal.aspect(g).collect()
    assert all((r.aspect_cos, r.aspect_sin) == pytest.approx((0.447214, -0.894427), abs=1e-6) for r in a)
    assert matrix(focal.tri(g), "tri", (5, 5))[1:-1, 1:-1] == pytest.approx(0)
    assert matrix(risk.seismic(g), "seismic", (5, 5)) == pytest.approx(0.753295, abs=1e-6)
    assert matrix(risk.typhoon(g, sigma=0), "typhoon", (5, 5))[0, 0] == pytest.approx(0.536683, abs=1e-2)


def test_flat_and_spike(spark):
    g = grid(spark, np.zeros((10, 10)))
    for f, layer in ((focal.slope, "slope"), (focal.roughness, "roughness"), (focal.tpi, "tpi")):
        assert (matrix(f(g), layer, (10, 10)) == 0).all()
    z = np.zeros((5, 5))
    z[2, 2] = 9
    tri = matrix(focal.tri(grid(spark, z)), "tri", (5, 5))
    assert tri[2, 2] == pytest.approx(9.0) and tri[1, 1] == pytest.approx(1.125) and tri[0, 0] == 0


def test_kernel_and_nulls(spark):
    w = focal.kernel(1.0)
    assert len(w) == 9 and w[4:] == pytest.approx([0.398943, 0.241971, 0.053991, 0.004432, 0.000134], abs=1e-6)
    filled = matrix(focal.fill_mean(grid(spark, [[1, np.nan], [3, 5]])).df, "z", (2, 2))
    assert filled[0, 1] == 3
    g = grid(spark, np.arange(12.0).reshape(3, 4))
    assert matrix(focal.gaussian(g, "z", 0.5, "b", "nearest"), "b", (3, 4)).shape == (3, 4)
    assert set(focal.terrain(grid(spark, plane(6))).columns) >= {"slope", "aspect_cos", "tri", "tpi", "roughness", "curvature_plan"}


def test_distance_and_dilation(spark):
    g = grid(spark, np.zeros((5, 5)), cell=1.0)
    burned = spark.createDataFrame([(2, 2), (2, 2)], "row int, col int")
    d = matrix(vector.distance_field(g, burned, 100.0), "dist", (5, 5))
    assert d[0, 0] == pytest.approx(2 * math.sqrt(2)) and d[0, 2] == 2 and d[2, 2] == 0
    assert matrix(vector.distance_field(g, burned, 2.0), "dist", (5, 5))[0, 0] == 2
    assert (matrix(vector.distance_field(g, burned.limit(0), 7.0), "dist", (5, 5)) == 7).all()
    assert vector.dilate(burned, g, 2).count() == 13
    rng = np.random.default_rng(1)
    hits = rng.random((20, 17)) < 0.04
    g = grid(spark, hits.astype(float), cell=2.0)
    at = np.argwhere(hits)
    want = np.array([[min(2 * np.hypot(*(at - [i, j]).T).min(), 12) for j in range(17)] for i in range(20)])
    assert matrix(vector.distance_field(g, g.df.filter("z = 1"), 12.0), "dist", (20, 17)) == pytest.approx(want)


def test_rasterized_lines_cover_what_they_touch(spark):
    g = Grid(spark.createDataFrame([(0, 0)], "row int, col int"), 12, 10, west=0.0, north=12.0, step=1.0)
    rng = np.random.default_rng(2)
    lines = rng.uniform(-1, 13, (12, 4)).tolist() + [[1.5, 2.5, 1.5, 2.5], [0.2, 3.4, 9.7, 3.4]]
    got = {tuple(r) for r in vector.rasterize_lines(g, spark.createDataFrame(lines, "lon0 double, lat0 double, lon1 double, lat1 double")).collect()}
    dense = set()
    for x0, y0, x1, y1 in lines:
        for t in np.linspace(0, 1, 4001):
            x, y = x0 + t * (x1 - x0), 12 - (y0 + t * (y1 - y0))
            if 0 <= x < 10 and 0 <= y < 12:
                dense.add((int(y), int(x)))
    assert dense <= got and len(got - dense) <= 4  # corners that a sample misses


def test_classes(spark):
    df = spark.createDataFrame([("Farmland", None), (None, "wood"), (None, None), ("xyz", None)], "a string, b string")
    assert [r[0] for r in df.select(vector.classify(F.col("a"), F.col("b"))).collect()] == [2, 1, 8, 8]
    assert len(LAND_USE) == 40 and len(BANDS) == 18
    g = grid(spark, np.zeros((1, 2)))
    cells = spark.createDataFrame([(0, 0, 1), (0, 0, 8)], "row int, col int, code int")
    assert {(r.col, r.code) for r in vector.rasterize_max(cells, g).collect()} == {(0, 8), (1, 8)}


def test_label_and_masks(spark):
    cols = "row int, col int, dist_line double, slope double, landuse int, roughness double, dist_road double, dist_rail double, dist_water double, landslide double, z double, protected int"
    df = spark.createDataFrame([(0, 0, 0.0, 14.0, 1, 15.0, 2000.0, 3000.0, 200.0, 0.2, 10.0, 0), (0, 1, 0.0, 50.0, 1, 15.0, 0.0, 0.0, 0.0, 0.2, 10.0, 0), (0, 2, 0.0, 1.0, 9, 15.0, 0.0, 0.0, 0.0, 0.2, 10.0, 1), (0, 3, 0.0, None, None, None, None, None, None, None, None, None)], cols)
    masked = {r.col: r.hard_mask for r in cost.hard_mask(df, V2).collect()}
    assert masked == {0: 1, 1: 0, 2: 0, 3: 1} and {r.col: r.hard_mask for r in cost.hard_mask(df, V1).collect()}[1] == 0
    label = {r.col: r.label for r in cost.pseudo_label(cost.hard_mask(df, V2), V2, noise=0).collect()}
    assert label[0] == pytest.approx(0.143915, abs=1e-6) and label[1] is None
    assert {r.col: r.soft_mask for r in cost.soft_mask(df, V2).collect()} == {0: 0.1, 1: 0.1, 2: 0.2, 3: 0.2}
    stack = {r.col: r for r in cost.feature_stack(df).collect()}
    assert stack[3].slope == 0 and stack[0].typhoon_risk == 0 and len(stack[0]) == 20


def line(spark, points, path=1):
    return spark.createDataFrame([(path, i + 1, float(x), float(y)) for i, (x, y) in enumerate(points)], "path_id long, seq int, lon double, lat double")


def test_polylines(spark):
    assert paths.lengths(line(spark, [(120, 22), (121, 22)])).first().length_km == pytest.approx(103.097957, abs=1e-5)
    assert paths.lengths(line(spark, [(120, 22), (120, 23)])).first().length_km == pytest.approx(111.194927, abs=1e-5)
    assert paths.lengths(line(spark, [(120, 22)])).first().length_km is None
    assert paths.densify(line(spark, [(120, 22), (120, 22 + 250 / 111194.927)]), 100.0).count() == 3
    p = line(spark, [(120 + i / 10, 22 + (i % 3) / 10) for i in range(9)])
    even = paths.resample(p, 2000.0).orderBy("seq").collect()
    assert (even[0].lon, even[-1].lon) == pytest.approx((120, 120.8)) and [r.seq for r in even] == list(range(len(even)))
    gaps = [math.hypot(a.lon - b.lon, a.lat - b.lat) for a, b in zip(even, even[1:], strict=False)]
    assert max(gaps) <= 2000 / 111000 * 1.05
    four = line(spark, [(120, 22), (120.5, 22.9), (121, 22), (122, 22)])
    assert paths.moving_average(four).orderBy("seq").collect()[1].lat == 22.9
    assert max(r.turn or 0 for r in paths.turn_angles(line(spark, [(120, 0), (121, 0), (121, 1)])).collect()) == pytest.approx(90, abs=0.01)
    assert paths.simplify(line(spark, [(0, 0)]).withColumn("seq", F.col("seq").cast("long"))).count() == 1
    kept = paths.simplify(line(spark, [(0, 0), (1, 0.0001), (2, 0), (3, 1), (4, 0)]).withColumn("seq", F.col("seq").cast("long"))).orderBy("seq").collect()
    assert [r.lon for r in kept] == [0, 2, 3, 4]


@pytest.mark.parametrize(("zs", "want"), [([0, 20, 40, 60, 80, 100, 90, 80, 70, 60, 50, 40], 100), ([0, 10, 20, 30, 25, 35, 45, 55, 65, 75, 85, 95], 95), (range(10), 0)])
def test_climb(spark, zs, want):
    df = spark.createDataFrame([(1, i, float(z)) for i, z in enumerate(zs)], "path_id long, seq int, z double")
    assert paths.monotone_climb(df).first().climb == want


def test_similarity(spark):
    a, b = line(spark, [(120, 22), (120.2, 22)]), line(spark, [(120, 22.01), (120.2, 22.01)])
    there, back = paths.similarity(a, b).first(), paths.similarity(b, a).first()
    assert there.hausdorff_m == pytest.approx(back.hausdorff_m) and there.hausdorff_m == pytest.approx(1112, abs=3)
    assert there.overlap_500m_pct == 0 and there.overlap_1km_pct <= there.overlap_2km_pct == 100
    far = paths.similarity(a, line(spark, [(121, 23), (121.2, 23)])).first()
    assert far.mean_distance_m > 100_000


def test_similarity_looks_at_every_point(spark):
    """A spike at an odd place of one line: the Hausdorff distance is how far it sticks out, either way round."""
    flat = line(spark, [(120 + k / 2000, 22) for k in range(9)])
    spiked = line(spark, [(120 + k / 2000, 22.02 if k == 3 else 22) for k in range(9)])
    for a, b in ((spiked, flat), (flat, spiked)):
        got = paths.similarity(a, b, step_m=10_000.0).first()
        assert got.hausdorff_m == pytest.approx(2224, abs=3)
    assert paths.similarity(spiked, flat, step_m=10_000.0, stride=2).first().hausdorff_m < 1


def test_gate(spark):
    rows = [(p, i, 120 + i / 1000, 22.0, 10.0, 50.0 if p == 2 else 10.0, 10.0 if p == 3 and i < 6 else 900.0, 0 if p == 4 and i == 3 else 1, 9.0 if p == 5 else 1.0) for p in range(1, 6) for i in range(12)]
    s = spark.createDataFrame(rows, "path_id long, seq int, lon double, lat double, z double, slope double, dist_water double, hard_mask int, cost double")
    checked = gate.checks(s, spark.createDataFrame([(1.0,)], "median double"), V2)
    got = {r.path_id: r for r in gate.summary(checked).collect()}
    assert {k: r.fail_reason for k, r in got.items()} == {1: "NONE", 2: "slope", 3: "water", 4: "protected", 5: "cost"}
    assert all(r.n_total == 7 and r.n_passed == (7 if k == 1 else 6) for k, r in got.items())
    assert json.loads(report.nested_checks(checked).filter("path_id = 2").first().report)["slope"]["passed"] is False


def surface(spark, c):
    g = grid(spark, c)
    return g.with_df(g.df.withColumnRenamed("z", "cost"))


def test_search_is_optimal_and_equals_relaxation(spark):
    rng = np.random.default_rng(4)
    c = rng.uniform(0.1, 2, (8, 9))
    c[rng.random(c.shape) < 0.2] = np.nan
    c[0, 0] = c[7, 8] = 1
    g = surface(spark, c)
    routes = spark.createDataFrame([(1, "astar", 1, 0, 0, 7, 8), (2, "astar", 1, 0, 0, 0, 0)], "path_id long, algorithm string, seed int, r0 int, c0 int, r1 int, c1 int")
    found = search.plan(g, routes, V2).filter("path_id = 1").orderBy("seq").collect()
    relaxed = {(r.row, r.col): r.g for r in search.least_cost(g, (0, 0)).collect()}
    if not found:
        assert (7, 8) not in relaxed
        return
    steps = list(zip(found, found[1:], strict=False))
    assert sum(b.cost * (1.414 if a.row != b.row and a.col != b.col else 1) for a, b in steps) == pytest.approx(relaxed[7, 8])
    assert all(c2 == c2 for c2 in (r.cost for r in found))
    left = model.remaining_cost(search.plan(g, routes, V2)).filter("path_id = 1").orderBy("seq").first().remaining
    assert left == pytest.approx(relaxed[7, 8])


def test_no_corner_cutting_and_snap(spark):
    wall = [[1, np.nan], [np.nan, 1]]
    routes = spark.createDataFrame([(1, "astar", 1, 0, 0, 1, 1)], "path_id long, algorithm string, seed int, r0 int, c0 int, r1 int, c1 int")
    assert search.plan(surface(spark, wall), routes, V2).count() == 0
    points = spark.createDataFrame([(1, 0, 1), (2, 9, 9)], "path_id long, row int, col int")
    assert [tuple(r) for r in search.snap(points, surface(spark, wall), 1).collect()] == [(1, 0, 0)]



def test_route_whose_way_leaves_the_crop(spark):
    """A wall with its only gap, and a detour that is cheaper, both outside the crop."""
    wall, dear = np.ones((14, 5)), np.ones((14, 5))
    wall[:12, 2], dear[:12, 2] = np.nan, 99
    routes = spark.createDataFrame([(1, "astar", 0, 1, 0, 1, 4)], "path_id long, algorithm string, seed int, r0 int, c0 int, r1 int, c1 int")
    for z in (wall, dear):
        cells = search.astar(np.where(np.isnan(z), np.inf, z), (1, 0), (1, 4), V2.diagonal)
        found = [(r.row, r.col) for r in search.plan(surface(spark, z), routes, V2, margin=2).orderBy("seq").collect()]
        price = lambda x: sum(z[b] * (V2.diagonal if a[0] != b[0] and a[1] != b[1] else 1) for a, b in zip(x, x[1:]))  # noqa: E731,B023,B905
        assert found[0] == (1, 0) and found[-1] == (1, 4) and abs(price(found) - price(cells)) < 1e-9


def test_swarms_never_get_worse(spark):
    from dataclasses import replace

    small = replace(V2, iterations=12, beetle_iterations=12, particles=6, beetles=10)
    g = surface(spark, np.random.default_rng(5).uniform(0.1, 1, (20, 20)))
    routes = spark.createDataFrame([(1, a, s, 1, 1, 18, 17) for a in ("ipso_sa", "dbo") for s in (1, 2)], "path_id long, algorithm string, seed int, r0 int, c0 int, r1 int, c1 int")
    curves = search.convergence(g, routes, small).orderBy("algorithm", "seed", "iteration").collect()
    again = search.convergence(g, routes, small).orderBy("algorithm", "seed", "iteration").collect()
    assert curves == again
    for a, b in zip(curves, curves[1:], strict=False):
        assert b.iteration == 0 or b.fitness <= a.fitness
    ends = search.plan(g, routes, small).groupBy("algorithm", "seed").agg(F.min_by("row", "seq"), F.max_by("row", "seq")).collect()
    assert {tuple(r)[2:] for r in ends} == {(1, 18)}


def test_reports(spark):
    pairs = spark.createDataFrame([("k", float(d), 0.0) for d in (1, 2, 3, 4, 6)] + [("k", 9.0, None), ("few", 1.0, 0.0)], "k string, a double, b double")
    got = {r.k: r for r in report.paired_t(pairs, "a", "b", ["k"]).collect()}
    assert got["k"].t == pytest.approx(3.719924, abs=1e-6) and got["k"].n == 5 and got["k"].p == pytest.approx(0.02049, abs=1e-4) and got["k"].significance == "*"
    assert got["few"].t is None
    # the published per-route values of a ten-line validation
    h = [4515, 10778, 7336, 3145, 10930, 12390, 5188, 3723, 3502, 766]
    s = report.summary(spark.createDataFrame([(float(x),) for x in h], "hausdorff double"), ["hausdorff"]).first()
    assert s.mean == pytest.approx(6227.17, abs=0.5) and s.median == pytest.approx(4851.29, abs=0.5)
    names = spark.createDataFrame([("A*",), ("My Way",)], "n string").select(report.slug(F.col("n"))).collect()
    assert [r[0] for r in names] == ["astar", "my-way"]


def test_osm(spark, tmp_path):
    way = lambda i, tags, pts, kind="way": {"type": kind, "id": i, "tags": tags, "geometry": [{"lat": y, "lon": x} for x, y in pts]}
    ring = [(0, 0), (1, 0), (1, 1), (0, 0)]
    data = {"elements": [way(1, {"highway": "primary"}, [(0, 0), (1, 1)]), way(2, {"highway": "path"}, ring), way(3, {"building": "yes"}, ring), way(4, {"building": "yes"}, ring[:3]), way(5, {"natural": "wood"}, [*ring[:3], (5, 5)]), way(6, {"boundary": "national_park"}, ring, "relation"), way(7, {"natural": "water"}, ring)]}
    (tmp_path / "a.json").write_text(json.dumps(data))
    rows = osm.read_osm(spark, f"{tmp_path}/a.json")
    got = {k: sorted(r.feature_id for r in df.collect()) for k, df in osm.catalog(rows, spark).items()}
    assert got == {"roads": [1], "water": [7], "protected": [], "landuse": [], "buildings": [3], "railways": [], "airports": []}
    assert all(df.count() == 0 for df in osm.catalog(None, spark).values())
    assert osm.in_box(osm.source(rows, "roads"), 0.5, 0.5, 2, 2).count() == 1
    cut = osm.clip_segments(spark.createDataFrame([(1, -1.0, 0.5, 2.0, 0.5), (2, 5.0, 5.0, 6.0, 6.0)], "id int, lon0 double, lat0 double, lon1 double, lat1 double"), 0, 0, 1, 1).collect()
    assert [tuple(r) for r in cut] == [(1, 0.0, 0.5, 1.0, 0.5)]
    files = spark.read.format("binaryFile").load(f"{tmp_path}/a.json").select("path", "modificationTime")
    assert osm.fresh(files).first().fresh and not osm.fresh(files, -1).first().fresh


def test_geotiff(spark, tmp_path):
    z = np.arange(20, dtype="<i2").reshape(4, 5)
    z[0, 0] = -9999
    data = z.tobytes()
    doubles = struct.pack("<3d", 0.5, 0.5, 0) + struct.pack("<6d", 0, 0, 0, 100.0, 10.0, 0)
    at = 8 + len(data)
    entries = [(256, 3, 1, 5), (257, 3, 1, 4), (258, 3, 1, 16), (259, 3, 1, 1), (273, 4, 1, 8), (278, 3, 1, 4), (339, 3, 1, 2), (33550, 12, 3, at), (33922, 12, 6, at + 24)]
    ifd = struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries) + struct.pack("<I", 0)
    (tmp_path / "a.tif").write_bytes(b"II*\0" + struct.pack("<I", at + len(doubles)) + data + doubles + ifd)
    df = rasters.read_elevation(spark, f"{tmp_path}/a.tif", rows=2)
    got = matrix(df, "z", (4, 5))
    assert np.isnan(got[0, 0]) and got[3, 4] == 19 and df.count() == 20
    assert rasters.read_elevation(spark, f"{tmp_path}/a.tif", west=100.5, east=101.5, south=9.0).count() == 2 * 2
    rasters.write_raster(df, f"{tmp_path}/out", tile=2)
    assert spark.read.parquet(f"{tmp_path}/out").filter("tile_row = 1").count() == 10
    (tmp_path / "e.json").write_text('{"start_lat": 1.5}')
    assert tuple(rasters.read_endpoints(spark, f"{tmp_path}/e.json", {"start_lat": 0.0, "start_lon": 2.0, "end_lat": 3.0, "end_lon": 4.0}).first()) == (1.5, 2.0, 3.0, 4.0)


def test_model(spark):
    rng = np.random.default_rng(6)
    rows = [(i, j, float(a), float(b), float(2 * a - b), 1) for i in range(30) for j in range(30) for a, b in [rng.random(2)]]
    df = spark.createDataFrame(rows, "row int, col int, a double, b double, label double, hard_mask int")
    train, test = model.split(model.valid(df))
    assert train.count() + test.count() == 900 and not train.intersect(test).count()
    forest = model.train_forest(train, V2, bands=["a", "b"], trees=15, depth=8)
    assert model.r_squared(forest, test) > 0.8 and model.importances(forest, ["a", "b"])[0][0] == "a"
    g = Grid(df, 30, 30)
    tiled = model.tiles(g, size=12, stride=8)
    assert tiled.groupBy("tile_row", "tile_col").count().filter("count <> 144").count() == 0
    assert model.mosaic(tiled.withColumn("predicted", F.lit(0.5))).filter("predicted <> 0.5").count() == 0
    assert model.sample(df, 100).count() < 200
    assert model.with_context(g, ["a"], (3,)).filter("a_3 is null").count() == 0


def test_stream_equals_batch(spark, tmp_path):
    from gridloom.streaming.events import hourly

    rows = [(i, 1 + i % 3, "click", float(i), f"2024-01-01 0{i % 4}:30:00") for i in range(40)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, t string").selectExpr("event_id", "user_id", "event_type", "value", "cast(t as timestamp_ntz) ts")
    df.write.parquet(f"{tmp_path}/in")
    stream = hourly(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("hours").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.sql("select * from hours").collect())) == sorted(map(tuple, hourly(df).collect()))
