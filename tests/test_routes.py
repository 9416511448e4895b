"""Smoothing and repair of routes, alignment, models, reports and sources, on small fixtures with expected values."""

import json
import math
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from gridloom.config import BANDS, V2
from gridloom.grid import Grid
from gridloom.operators import cost, focal, gate, model, paths, report, search, vector
from gridloom.sources import osm


def grid_of(spark, rows, **kw):
    cells = [(r, c, v) for r, line in enumerate(rows) for c, v in enumerate(line)]
    df = spark.createDataFrame(cells, "row int, col int, cost double").withColumn("hard_mask", F.col("cost").isNotNull().cast("int"))
    return Grid(df, len(rows), len(rows[0]), **kw)


def ends(spark, *rows):
    return spark.createDataFrame([(k, "astar", 1, *r) for k, r in enumerate(rows)], "path_id long, algorithm string, seed int, r0 int, c0 int, r1 int, c1 int")


def test_a_way_far_around_a_wall(spark):
    """The only gap lies beyond the crop's margin; a route without a way has a status."""
    rows = [[1.0 if c != 2 or r == 100 else None for c in range(5)] for r in range(110)]
    rows[0][4] = None
    grid, routes = grid_of(spark, rows), ends(spark, (0, 0, 1, 4), (0, 0, 0, 4), (5, 0, 5, 1))
    found = search.plan(grid, routes, V2)
    assert found.filter("path_id = 0").agg(F.max("row")).first()[0] == 100
    assert {x.path_id: x.status for x in search.missed(routes, found).collect()} == {0: "OK", 1: "NO_ROUTE", 2: "OK"}
    opened = {(x.path_id, x.informed): x.opened for x in search.opened_cells(grid, ends(spark, (5, 0, 90, 0)).drop("algorithm"), V2).collect()}
    assert opened[0, True] <= opened[0, False]


def test_repair_goes_round_what_smoothing_cuts(spark):
    """A route around a block, smoothed by a straight line through it, is repaired to pass no forbidden cell."""
    rows = [[None if 3 <= r <= 6 and 3 <= c <= 6 else 1.0 for c in range(12)] for r in range(12)]
    grid = grid_of(spark, rows)
    cells = [(0, k, *p) for k, p in enumerate([(8, c) for c in range(3)] + [(r, 2) for r in range(7, 1, -1)] + [(2, c) for c in range(3, 10)])]
    routes = spark.createDataFrame(cells, "path_id long, seq long, row int, col int")
    line = [(0, k, 120 + (0.5 + c) * 0.001, 25.4 - (0.5 + r) * 0.001) for k, (r, c) in enumerate((8 - k * 0.6, k * 0.9) for k in range(11))]
    free = [(1, k, 120.0005 + k * 0.001, 25.4 - 0.0005) for k in range(4)]  # nothing to repair
    inside = [(2, k, 120.0045, 25.4 - 0.0045 - k * 0.0005) for k in range(3)]  # forbidden throughout
    more = spark.createDataFrame([(p, k, 0, k) for p in (1, 2) for k in range(4)], "path_id long, seq long, row int, col int")
    points = spark.createDataFrame(line + free + inside, "path_id long, seq long, lon double, lat double")
    fixed = search.repair(points, routes.unionByName(more), grid).orderBy("path_id", "seq").collect()
    cell = lambda x: (int((25.4 - x.lat) / 0.001), int((x.lon - 120) / 0.001))
    assert all(rows[r][c] is not None for x in fixed for r, c in [cell(x)])
    for p in (0, 1, 2):
        assert [x.seq for x in fixed if x.path_id == p] == list(range(sum(x.path_id == p for x in fixed)))
    mine = [cell(x) for x in fixed if x.path_id == 0]
    assert (mine[0], mine[-1]) == ((8, 0), (2, 9)) and {(2, 4), (2, 5)} <= set(mine)
    assert [(x.lon, x.lat) for x in fixed if x.path_id == 1] == [(x, y) for _, _, x, y in free]
    assert all(cell(x)[0] == 0 for x in fixed if x.path_id == 2)


def test_smooth_is_simplify_resample_average(spark):
    grid = grid_of(spark, [[1.0] * 40 for _ in range(40)])
    cells = [(0, k, k, k // 2) for k in range(40)] + [(1, 0, 5, 5), (1, 1, 5, 6)]
    routes = spark.createDataFrame(cells, "path_id long, seq long, row int, col int")
    got = search.smooth(routes, grid, V2).orderBy("path_id", "seq").collect()
    raw = routes.select("path_id", "seq", grid.lon_of(F.col("col")).alias("lon"), grid.lat_of(F.col("row")).alias("lat"))
    want = paths.moving_average(paths.resample(paths.simplify(raw.filter("path_id = 0"), 90.0), 30.0)).orderBy("seq").collect()
    assert [(x.lon, x.lat) for x in got if x.path_id == 0] == [(x.lon, x.lat) for x in want]
    assert [(x.seq, round(x.lon, 4)) for x in got if x.path_id == 1] == [(0, 120.0055), (1, 120.0065)]


def test_way_points_move_to_the_nearest_passable_cell(spark):
    rows = [[None if c < 5 else 1.0 for c in range(9)] for _ in range(9)]
    points = spark.createDataFrame([(1, 0, 4, 3), (1, 1, 4, 7), (1, 2, 50, 0), (2, 0, 0, 0)], "path_id long, seq long, row int, col int")
    got = {(x.path_id, x.seq): (x.row, x.col) for x in search.repair_waypoints(points, grid_of(spark, rows), 4).collect()}
    assert got == {(1, 0): (2, 5), (1, 1): (4, 7), (1, 2): (50, 0), (2, 0): (0, 0)}


def test_align_and_standard_grid(spark):
    cells = [(r, c, float(10 * r + c), 1.0) for r in range(9) for c in range(12)]
    grid = Grid(spark.createDataFrame(cells, "row int, col int, z double, slope double"), 9, 12)
    ring = spark.createDataFrame([(1, 2, [(120.0031, 25.3999), (120.0061, 25.3999), (120.0061, 25.3969), (120.0031, 25.3969), (120.0031, 25.3999)])], "ring_id long, code int, points array<struct<lon: double, lat: double>>")
    steps = spark.createDataFrame([(120.0001, 25.3995, 120.0001, 25.3915)], "lon0 double, lat0 double, lon1 double, lat1 double")
    out = vector.align(grid, ["z", "slope"], lines={"dist_road": (steps, 200.0)}, polygons={"airport": ring}, landuse=ring, buildings=ring)
    assert (out.height, out.width, out.cell, round(out.step, 6)) == (3, 4, 90.0, 0.003)
    got = {(x.row, x.col): x for x in out.df.collect()}
    assert len(got) == 12
    for (r, c), x in got.items():
        assert x.z == pytest.approx(10 * (3 * r + 1) + 3 * c + 1) and x.slope == 1.0
        assert x.dist_road == pytest.approx(min(200.0, 90.0 * c))
        touched = r <= 1 and 1 <= c <= 2
        assert (x.airport, x.landuse) == ((1, 2) if touched else (0, 8))
    assert grid.to_standard("z", grid.cell) is grid
    assert {(x.row, x.col): x.z for x in grid.to_standard("z").df.collect()}[1, 1] == pytest.approx(44.0)


def test_nearest_points_near_the_poles(spark):
    r = random.Random(4)
    a = [(p, k, r.uniform(-20, 20) if p else r.uniform(0, 0.2), lat + r.uniform(0, 0.1)) for p, lat in ((0, 84.0), (1, -89.0), (2, 10.0)) for k in range(30)]
    b = [(p, k, lon + r.uniform(-0.3, 0.3), lat + r.uniform(-0.02, 0.02)) for p, k, lon, lat in a if k % 2]
    kind = "path_id long, seq long, lon double, lat double"
    far = lambda x, y: 12742000 * math.asin(math.sqrt(math.sin(math.radians(y[3] - x[3]) / 2) ** 2 + math.cos(math.radians(x[3])) * math.cos(math.radians(y[3])) * math.sin(math.radians(y[2] - x[2]) / 2) ** 2))
    got = {(x.path_id, x.seq): x.d for x in paths.nearest_m(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind)).collect()}
    assert got == {x[:2]: pytest.approx(min(far(x, y) for y in b if y[0] == x[0])) for x in a}


def test_percentiles_with_ties_and_few_rows(spark):
    values = [5.0] * 700 + [float(x) for x in range(300)] + [None, float("nan")]
    df = spark.createDataFrame([(v, 1.0 if k == 0 else None) for k, v in enumerate(values)], "v double, one double")
    shares = [0.0, 0.01, 0.05, 0.5, 0.98, 1.0]
    got = {(x.metric, x.share): x.value for x in report.percentiles(df, ["v", "one"], shares, accuracy=50).collect()}
    clean = sorted(v for v in values if v is not None and v == v)
    for s in shares:
        at = s * (len(clean) - 1)
        assert got["v", s] == pytest.approx(clean[int(at)] + (clean[math.ceil(at)] - clean[int(at)]) * (at - int(at)))
        assert got["one", s] == 1.0
    three = spark.createDataFrame([(1.0,), (2.0,), (10.0,)], "v double")
    assert report.percentiles(three, ["v"], [0.01]).first().value == pytest.approx(1.02)
    assert report.percentiles(three.limit(0), ["v"], [0.5]).count() == 0


def test_models_are_saved_and_respect_the_mask(spark, tmp_path):
    r = random.Random(1)
    rows = [(k, k % 7, *(r.random() for _ in BANDS), int(k % 5 > 0)) for k in range(300)]
    df = spark.createDataFrame(rows, "row int, col int, " + ", ".join(f"{b} double" for b in BANDS) + ", hard_mask int").withColumn("label", F.col("slope") * 0.5 + 0.1)
    fitted = model.train_forest(df, replace(V2, trees=5, depth=4))
    stats = fitted.transform(df).agg(F.avg("slope_scaled"), F.stddev_pop("slope_scaled")).first()
    assert stats[0] == pytest.approx(0, abs=1e-9) and stats[1] == pytest.approx(1)
    model.save(fitted, f"{tmp_path}/forest")
    again = model.load(f"{tmp_path}/forest")
    a, b = ({x.row: x.predicted for x in model.predict(m, df).collect()} for m in (fitted, again))
    assert a == b and all((a[k] is None) == (k % 5 == 0) for k in a)
    model.export_training(df.withColumn("label", F.when(F.col("row") < 10, 0.0).otherwise(F.col("label"))), f"{tmp_path}/train")
    assert spark.read.parquet(f"{tmp_path}/train").count() == sum(k >= 10 and k % 5 > 0 for k in range(300))
    learned = model.train_heuristic(df.withColumn("km_to_goal", F.col("row") * 0.1).withColumn("remaining", F.col("row") * 0.2 + F.col("slope")))
    off = learned.transform(df.withColumn("km_to_goal", F.col("row") * 0.1)).select(F.max(F.abs(F.col("prediction") - F.col("row") * 0.2 - F.col("slope")))).first()[0]
    assert off < 0.05


def test_tiles_around_sampled_centres(spark):
    cells = [(r, c, float(r * 40 + c)) for r in range(40) for c in range(40)]
    grid = Grid(spark.createDataFrame(cells, "row int, col int, z double"), 40, 40)
    centres = model.tile_centres(grid.df, 200).collect()
    assert 120 < len(centres) < 280 and 0 < sum(x.held for x in centres) < len(centres)
    assert {(x.row, x.col) for x in model.tile_centres(grid.df, 200).collect()} == {(x.row, x.col) for x in centres}
    one = spark.createDataFrame([(3, 20, True)], "row int, col int, held boolean")
    got = {(x.row, x.col) for x in model.tile_cells(grid, one, 8).collect()}
    assert got == {(r, c) for r in range(0, 7) for c in range(16, 24)}


def test_reports_are_written(spark, tmp_path):
    grid = grid_of(spark, [[1.0] * 12 for _ in range(12)])
    few = replace(V2, iterations=5, beetle_iterations=5, particles=4, beetles=4)
    routes = spark.createDataFrame([(0, a, 1, 1, 1, 9, 9) for a in ("ipso_sa", "dbo")], "path_id long, algorithm string, seed int, r0 int, c0 int, r1 int, c1 int")
    curves = report.convergence_report(search.convergence(grid, routes, few))
    report.write_json(curves, f"{tmp_path}/curves")
    for x in spark.read.json(f"{tmp_path}/curves").collect():
        assert x.iterations == len(x.curve) and x.best_fitness == min(x.curve) == x.curve[-1]
    records = spark.createDataFrame([(1, "A*", 5.0, True, "x"), (1, "DBO", 7.0, False, "y"), (2, "A*", 6.0, True, "z")], "case_id long, algorithm string, hausdorff_m double, quality_passed boolean, coords string")
    summary = report.validation_summary(report.without_columns(records, "coords", "absent"), ["hausdorff_m"]).first()
    assert (summary.n, summary.n_passed, summary.hausdorff_m_mean, summary.hausdorff_m_median) == (3, 2, 6.0, 6.0)
    nested = {x.case_id: json.loads(x.comparison) for x in report.case_comparison(records, "case_id", "algorithm", ["hausdorff_m"]).collect()}
    assert nested == {1: {"astar": {"hausdorff_m": 5.0}, "dbo": {"hausdorff_m": 7.0}}, 2: {"astar": {"hausdorff_m": 6.0}}}
    assert report.best_of(records, ["algorithm"], "hausdorff_m").filter("algorithm = 'A*'").first().coords == "x"


def test_water_check_without_water(spark):
    s = spark.createDataFrame([(1, k, 120 + k * 0.01, 22.0, 1.0, 1.0, 10.0 if k < 5 else 5000.0, 1, 1.0) for k in range(9)], "path_id long, seq int, lon double, lat double, z double, slope double, dist_water double, hard_mask int, cost double")
    dry = s.withColumn("dist_water", F.lit(5000.0))
    of = lambda df: {x.check_id: x for x in gate.checks(df, gate.surface_facts(df), V2).collect()}
    assert not of(s)["water"].passed and of(s)["cost"].value == 1.0
    assert of(dry)["water"].passed and of(dry)["water"].value is None
    assert gate.water_distance(s).first().p95_dist == 10.0


def test_clipped_parts_and_the_cache(spark, tmp_path):
    line = spark.createDataFrame([(7, [(-1.0, 0.5), (0.5, 0.5), (0.5, 2.0), (0.7, 2.0), (0.7, 0.2)]), (8, [(5.0, 5.0), (6.0, 6.0)]), (9, [(-1.0, 1.5), (1.5, -1.0)]), (10, [(-0.5, 1.2), (-0.2, 1.4)])], "feature_id long, coords array<struct<lon: double, lat: double>>")
    assert {x.feature_id for x in osm.touches_box(line, 0, 0, 1, 1).collect()} == {7, 9}
    got = {(x.feature_id, x.part): [(p.lon, p.lat) for p in x.coords] for x in osm.clip_lines(line, 0, 0, 1, 1).collect()}
    assert got[7, 1] == [(0.0, 0.5), (0.5, 0.5), (0.5, 1.0)] and got[7, 2] == [(0.7, 1.0), (0.7, 0.2)] and set(got) == {(7, 1), (7, 2), (9, 1)}
    (tmp_path / "roads_1.json").write_text(json.dumps({"elements": [{"type": "way", "id": 5, "tags": {"highway": "primary"}, "geometry": [{"lat": 1, "lon": 2}, {"lat": 2, "lon": 3}]}]}))
    assert [(x.feature_id, x.fresh) for x in osm.cached(spark, str(tmp_path), "roads").collect()] == [(5, True)]
    assert osm.cached(spark, str(tmp_path), "roads", days=0).first().fresh is False
    assert osm.cached(spark, str(tmp_path), "water").count() == 0 and osm.cached(spark, f"{tmp_path}/absent", "water").count() == 0


def test_bands_keep_their_order(spark):
    grid = grid_of(spark, [[1.0] * 12 for _ in range(12)])
    df = focal.terrain(grid.with_df(grid.df.withColumn("z", F.col("row") * 5.0 + F.col("col"))))
    assert cost.feature_stack(df).columns == ["row", "col", *BANDS]
    assert cost.feature_stack(df).filter("row = 4 and col = 4").first().elevation == 24.0


def test_tiled_and_deflated_rasters(spark, tmp_path):
    import struct
    import zlib

    import numpy as np

    from gridloom.sources import rasters

    z = np.arange(50 * 70, dtype="<i2").reshape(50, 70)
    z[3, 4] = -9999
    tiles, data = [], b""
    for r in range(0, 50, 16):
        for c in range(0, 70, 32):
            block = np.zeros((16, 32), "<i2")
            part = z[r : r + 16, c : c + 32]
            block[: part.shape[0], : part.shape[1]] = part
            packed = zlib.compress(np.diff(block, axis=1, prepend=np.int16(0)).astype("<i2").tobytes())
            tiles.append((len(data), len(packed)))
            data += packed
    head = 8 + 2 + 12 * 12 + 4
    arrays = [struct.pack(f"<{len(tiles)}I", *(head + 8 * len(tiles) + 72 + at for at, _ in tiles)), struct.pack(f"<{len(tiles)}I", *(n for _, n in tiles)), struct.pack("<3d", 0.01, 0.01, 0), struct.pack("<6d", 0, 0, 0, 120.0, 25.0, 0)]
    at = [head, head + 4 * len(tiles), head + 8 * len(tiles), head + 8 * len(tiles) + 24]
    tags = [(256, 4, 1, 70), (257, 4, 1, 50), (258, 3, 1, 16), (259, 3, 1, 8), (317, 3, 1, 2), (322, 4, 1, 32), (323, 4, 1, 16), (324, 4, len(tiles), at[0]), (325, 4, len(tiles), at[1]), (339, 3, 1, 2), (33550, 12, 3, at[2]), (33922, 12, 6, at[3])]
    (tmp_path / "tiled.tif").write_bytes(b"II*\0" + struct.pack("<IH", 8, len(tags)) + b"".join(struct.pack("<HHII", *x) for x in tags) + b"\0\0\0\0" + b"".join(arrays) + data)
    got = {(x.row, x.col): x.z for x in rasters.read_elevation(spark, f"{tmp_path}/tiled.tif", rows=20).collect()}
    assert len(got) == 3500 and got[3, 4] is None and all(v == z[k] for k, v in got.items() if k != (3, 4))
    window = {(x.row, x.col): x.z for x in rasters.read_elevation(spark, f"{tmp_path}/tiled.tif", west=120.305, east=120.4, north=24.8, south=24.7).collect()}
    assert window == {(r, c): float(z[20 + r, 30 + c]) for r in range(10) for c in range(10)}
    cells = [(r, c, None if (r, c) == (1, 1) else r * 7.5 + c) for r in range(20) for c in range(13)]
    grid = Grid(spark.createDataFrame(cells, "row int, col int, cost double"), 20, 13, step=0.01)
    rasters.write_geotiff(grid, "cost", f"{tmp_path}/out", tile=8)
    assert len(list((tmp_path / "out").glob("*.tif"))) == 6 and not list((tmp_path / "out").glob("_staging*"))
    back = {(x.row, x.col): x.z for x in rasters.read_elevation(spark, f"{tmp_path}/out/cost_0000008_0000008.tif").collect()}
    assert back == {(r, c): (8 + r) * 7.5 + 8 + c for r in range(8) for c in range(5)}


def test_shapefiles(spark, tmp_path):
    import struct

    from gridloom.sources import shapes

    def poly(code, parts, points):
        return struct.pack("<i4d2i", code, 0, 0, 1, 1, len(parts), len(points)) + struct.pack(f"<{len(parts)}i", *parts) + b"".join(struct.pack("<2d", *p) for p in points)

    records = [poly(3, [0, 2], [(120.0, 22.0), (120.5, 22.5), (121.0, 23.0), (121.5, 23.5)]), struct.pack("<i2d", 1, 120.25, 22.75), struct.pack("<i", 0), poly(5, [0], [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)])]
    shp, shx = b"\0" * 100, b"\0" * 100
    for k, r in enumerate(records):
        shx += struct.pack(">ii", len(shp) // 2, len(r) // 2)
        shp += struct.pack(">ii", k + 1, len(r) // 2) + r
    fields = b"".join(name.ljust(11, b"\0") + b"C\0\0\0\0" + bytes([size]) + b"\0" * 15 for name, size in ((b"id", 4), (b"volt", 6))) + b"\r"
    dbf = b"\x03\0\0\0" + struct.pack("<IHH", len(records), 32 + len(fields), 11) + b"\0" * 20 + fields + b"".join(b" " + f"w{k}".encode().ljust(4) + f"{k}kV".encode().ljust(6) for k in range(len(records)))
    for kind, data in (("shp", shp), ("shx", shx), ("dbf", dbf)):
        (tmp_path / f"lines.{kind}").write_bytes(data)
    got = {x.feature_id: x for x in shapes.read_shapefile(spark, f"{tmp_path}/lines.shp", records=2).collect()}
    assert {k: x.geom_type for k, x in got.items()} == {0: "line", 1: "point", 3: "polygon"}
    assert got[0].parts == [0, 2] and [(p.lon, p.lat) for p in got[0].coords][2] == (121.0, 23.0)
    assert got[3].attributes == {"id": "w3", "volt": "3kV"} and [(p.lon, p.lat) for p in got[1].coords] == [(120.25, 22.75)]
    (tmp_path / "bare.shp").write_bytes(shp)
    (tmp_path / "bare.shx").write_bytes(shx)
    assert all(x.attributes == {} for x in shapes.read_shapefile(spark, f"{tmp_path}/bare.shp").collect())


def test_command_line(spark, tmp_path):
    from gridloom import __main__ as cli

    cells = [(r, c, None if c == 5 and r < 9 else 1.0) for r in range(12) for c in range(12)]
    spark.createDataFrame(cells, "row int, col int, cost double").write.parquet(f"{tmp_path}/costs")
    (tmp_path / "ends.json").write_text(json.dumps({"start_lat": 25.3995, "start_lon": 120.0005}))
    args = ["--costs", f"{tmp_path}/costs", "--step", "0.001", "--config", f"{tmp_path}/ends.json", "--end-lat", "25.3995", "--end-lon", "120.0105", "--out", f"{tmp_path}/out"]
    assert cli.main(args) == "OK"
    (feature,) = [json.loads(x.value) for x in spark.read.text(f"{tmp_path}/out/route").collect()]
    assert feature["geometry"]["coordinates"][0] == pytest.approx([120.0005, 25.3995]) and min(y for _, y in feature["geometry"]["coordinates"]) < 25.392
    assert spark.read.json(f"{tmp_path}/out/statistics").first().length_km > 1.5
    assert cli.main([*args[:-6], "--end-lat", "10", "--end-lon", "120", "--out", f"{tmp_path}/none"]) == "ENDPOINT_INVALID"


def test_sources_fail_apart(spark, tmp_path):
    (tmp_path / "roads.json").write_text(json.dumps({"elements": [{"type": "way", "id": 5, "tags": {"highway": "primary"}, "geometry": [{"lat": 1, "lon": 2}, {"lat": 2, "lon": 3}]}]}))
    got = osm.catalog({"roads": lambda: osm.read_osm(spark, f"{tmp_path}/roads.json"), "water": lambda: osm.read_osm(spark, f"{tmp_path}/absent.json")}, spark)
    assert {k: v.count() for k, v in got.items()} == {k: int(k == "roads") for k in osm.SOURCES}
    assert {v.schema.simpleString() for v in got.values()} == {got["roads"].schema.simpleString()}


def test_repeated_runs_and_fitness(spark):
    import numpy as np

    routes = spark.createDataFrame([(0, "astar", 0), (1, "dbo", 0)], "path_id long, algorithm string, seed int")
    assert sorted((x.path_id, x.seed) for x in search.repeated(routes, 3).collect()) == [(0, 42), (1, 42), (1, 43), (1, 44)]
    surface = np.add.outer(np.arange(60.0), 2 * np.arange(80.0))
    line = np.array([[0.0, 0.0], [30.0, 40.0], [50.0, 70.0]])
    assert search.fitness(line, surface, V2) == pytest.approx(np.mean([r + 2 * c for r, c in search._line(line)]), rel=0.02)
    assert np.allclose(search._sampled(line, surface), [np.interp(a, [0, 50, 50 + 1300**0.5], [0, 110, 190]) for a in np.linspace(0, 50 + 1300**0.5, 86)])
    blocked = surface.copy()
    blocked[20:40] = np.inf
    assert search.fitness(line, blocked, V2) > 1000
    assert search.fitness(line[:1].repeat(2, axis=0), surface, V2) == 1e10


def test_nearest_points_beyond_the_poles_and_far_apart(spark):
    r = random.Random(5)
    # degrees of latitude may run on beyond 90; the second line is far from most of the first, and its copies are many
    a = [(p, k, 120 + 0.004 * k, lat + r.uniform(0, 0.01)) for p, lat in ((0, 160.0), (1, 89.99), (2, 905.0), (3, 30.0)) for k in range(60)]
    b = [(p, k, lon, lat + 0.005) for p, k, lon, lat in a if k < 12 for _ in range(3)] + [(3, 99, -60.0, 150.0)]
    kind = "path_id long, seq long, lon double, lat double"
    far = lambda x, y: 12742000 * math.asin(math.sqrt(max(0.0, math.sin(math.radians(y[3] - x[3]) / 2) ** 2 + math.cos(math.radians(x[3])) * math.cos(math.radians(y[3])) * math.sin(math.radians(y[2] - x[2]) / 2) ** 2)))
    got = {(x.path_id, x.seq): x.d for x in paths.nearest_m(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind)).collect()}
    assert got == {x[:2]: pytest.approx(min(far(x, y) for y in b if y[0] == x[0]), abs=1e-6) for x in a}


def test_crops_have_a_row_for_each_tile_and_places_meet_tiles_once(spark):
    from gridloom.config import V2
    from gridloom.grid import Grid
    from gridloom.operators import search, tilegraph

    cells = spark.range(300 * 20).selectExpr("cast(id / 20 as int) as row", "cast(id % 20 as int) as col", "case when id % 7 > 0 then 1.0 + id % 3 end as cost")
    g = Grid(cells, 300, 20)
    ends = spark.createDataFrame([(1, "dbo", 1, 3, 1, 290, 15)], "path_id long, algorithm string, seed int, r0 int, c0 int, r1 int, c1 int")
    assert search._crops(g, ends, V2, 4).count() == 2
    assert tilegraph.side(Grid(cells, 120_000, 64)) == 4096 and tilegraph.side(Grid(cells, 5_000, 5_000)) == 512
    points = spark.createDataFrame([(1, 0, 0), (2, -3, 5), (3, 302, 19), (4, 7, 3), (5, 400, 3)], "path_id long, row int, col int")
    found = search.snap(points, g, 6)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2
    free = {(r.row, r.col) for r in cells.filter("cost is not null").collect()}
    near = lambda r, c: min(((max(abs(x - r), abs(y - c)), x, y) for x, y in free))
    assert {x.path_id: (x.row, x.col) for x in found.collect()} == {p: near(r, c)[1:] for p, r, c in [(1, 0, 0), (2, -3, 5), (3, 302, 19), (4, 7, 3)]}


def test_smoothing_where_joins_are_split(spark):
    """One route has nearly all rows, so adaptive joins split it: partitions of the parts that are put together differ in number."""
    tight = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.0", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in tight}
    n, k = 3000, F.col("id")
    cells = spark.range(n * 4).select((k / 4).cast("int").alias("row"), (k % 4).cast("int").alias("col"), F.lit(1.0).alias("cost"), F.lit(1).alias("hard_mask"))
    routes = spark.range(n + 4).select(F.when(k < n, 0).otherwise(k - n + 1).cast("long").alias("path_id"), (k % n).alias("seq"), (k % n).cast("int").alias("row"), F.pmod(F.xxhash64("id"), F.lit(4)).cast("int").alias("col"))
    try:
        for key, value in tight.items():
            spark.conf.set(key, value)
        for repaired in (False, True):
            got = search.smooth(routes.repartition(8), Grid(cells, n, 4), V2, repaired, least=3).groupBy("path_id").agg(F.count("*").alias("n"), F.countDistinct("seq").alias("places")).collect()
            by = {x.path_id: x for x in got}
            assert sorted(by) == [0, 1, 2, 3, 4] and by[0].n == by[0].places > n and all(by[p].n == 1 for p in (1, 2, 3, 4))
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
