"""python -m gridloom --costs PARQUET --out FOLDER [--start-lat ...] [--config JSON]: the cheapest route over a cost raster, smoothed, as GeoJSON and statistics."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from gridloom import session
from gridloom.config import PRESETS
from gridloom.grid import Grid
from gridloom.operators import paths, report, search
from gridloom.sources.rasters import read_endpoints

ENDS = {"start_lat": 25.0, "start_lon": 121.5, "end_lat": 22.6, "end_lon": 120.3}


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="gridloom", description=__doc__)
    for name, value in ENDS.items():
        p.add_argument(f"--{name.replace('_', '-')}", type=float, default=value)
    p.add_argument("--config", help="JSON with any of the ends; they override the options")
    p.add_argument("--preset", choices=sorted(PRESETS), default="v2")
    p.add_argument("--costs", required=True, help="Parquet of row, col, cost (null where impassable)")
    p.add_argument("--west", type=float, default=120.0)
    p.add_argument("--north", type=float, default=25.4)
    p.add_argument("--step", type=float, default=0.0009)
    p.add_argument("--skip-smoothing", action="store_true")
    p.add_argument("--out", required=True)
    return p.parse_args(given)


def main(given: list[str] | None = None) -> str:
    """Writes the route, if there is one; returns OK, ENDPOINT_INVALID or NO_ROUTE."""
    a, spark = arguments(given), session.build()
    ends = {k: getattr(a, k) for k in ENDS}
    if a.config:
        ends = read_endpoints(spark, a.config, ends).first().asDict()
    cells = spark.read.parquet(a.costs)
    height, width = cells.agg(F.max("row") + 1, F.max("col") + 1).first()
    config = PRESETS[a.preset]
    grid = Grid(cells.withColumn("hard_mask", F.col("cost").isNotNull().cast("int")), height, width, config.cell_m, a.west, a.north, a.step)
    points = spark.createDataFrame([(0, ends["start_lat"], ends["start_lon"]), (1, ends["end_lat"], ends["end_lon"])], "path_id long, lat double, lon double")
    found = {r.path_id: r for r in search.snap(points.select("path_id", grid.row_of(F.col("lat")).alias("row"), grid.col_of(F.col("lon")).alias("col")), grid).collect()}
    if len(found) < 2:
        return "ENDPOINT_INVALID"
    routes = spark.createDataFrame([(0, "astar", config.seed, found[0].row, found[0].col, found[1].row, found[1].col)], "path_id long, algorithm string, seed int, r0 int, c0 int, r1 int, c1 int")
    steps = session.checkpointed(search.plan(grid, routes, config))
    if not steps.limit(1).count():
        return "NO_ROUTE"
    line = steps.select("path_id", "seq", grid.lon_of(F.col("col")).alias("lon"), grid.lat_of(F.col("row")).alias("lat")) if a.skip_smoothing else search.smooth(steps.select("path_id", "seq", "row", "col"), grid, config)
    line = session.checkpointed(line)
    features = report.comparison_features(line, line.limit(0))
    report.write_geojson(features, f"{a.out}/route")
    report.write_json(paths.lengths(line), f"{a.out}/statistics")
    return "OK"


if __name__ == "__main__":
    print(main())
