"""Batch validation: from known lines and a surface to routes, their likeness, the gate and a summary.

validate() judges a least-cost route for each case; compare() repeats the swarms over seeds and tests them against the
least-cost route. Both are joins over all cases at once; cases that fail are records too, with the reason.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.config import EngineConfig
from gridloom.grid import Grid
from gridloom.operators import gate, paths, report, search
from gridloom.session import checkpointed

LAYERS = ["z", "slope", "dist_water", "hard_mask", "cost"]
METRICS = ["predicted_length_km", "length_error_pct", "hausdorff_m", "mean_distance_m", "overlap_500m_pct", "overlap_1km_pct", "overlap_2km_pct"]


def endpoints(grid: Grid, actual: DataFrame) -> DataFrame:
    """path_id, r0, c0, r1, c1, inside: the cells of the first and last point of each line (path_id, seq, lon, lat), and whether both are on the grid."""
    point = F.struct("lon", "lat")
    ends = actual.groupBy("path_id").agg(F.min_by(point, "seq").alias("a"), F.max_by(point, "seq").alias("b"))
    cells = ends.select("path_id", grid.row_of(F.col("a.lat")).alias("r0"), grid.col_of(F.col("a.lon")).alias("c0"), grid.row_of(F.col("b.lat")).alias("r1"), grid.col_of(F.col("b.lon")).alias("c1"))
    on = lambda c, n: F.col(c).between(0, n - 1)
    return cells.withColumn("inside", F.coalesce(on("r0", grid.height) & on("r1", grid.height) & on("c0", grid.width) & on("c1", grid.width), F.lit(False)))


def snapped(grid: Grid, ends: DataFrame) -> DataFrame:
    """path_id, r0, c0, r1, c1 of ends on the grid, moved to passable cells; without one in reach, no row."""
    side = lambda r, c: search.snap(ends.filter("inside").select("path_id", F.col(r).alias("row"), F.col(c).alias("col")), grid).select("path_id", F.col("row").alias(r), F.col("col").alias(c))
    return checkpointed(side("r0", "c0").join(side("r1", "c1"), "path_id"))


@dataclass
class Validation:
    """records: a row for each case; checks: the gate's rows; routes: the predicted points; summary: one row."""

    records: DataFrame
    checks: DataFrame
    routes: DataFrame
    summary: DataFrame


def validate(grid: Grid, actual: DataFrame, cases: DataFrame, config: EngineConfig) -> Validation:
    """The least-cost route between the ends of each case's line (cases: path_id, ...; actual: path_id, seq, lon, lat), smoothed, compared with the line, and judged. grid: cost, hard_mask and, for the checks, z, slope and dist_water; a check without its layer passes."""
    cases = cases.dropDuplicates(["path_id"])
    real = checkpointed(actual.select("path_id", "seq", "lon", "lat").join(cases.select("path_id"), "path_id", "left_semi"))
    ends = checkpointed(endpoints(grid, real))
    asked = snapped(grid, ends).select("path_id", F.lit("astar").alias("algorithm"), F.lit(config.seed).alias("seed"), "r0", "c0", "r1", "c1")
    found = checkpointed(search.plan(grid, asked, config)).select("path_id", "seq", "row", "col")
    routes = checkpointed(search.smooth(found, grid, config))
    layers = grid.with_df(grid.df.select("row", "col", *(F.col(x) if x in grid.df.columns else F.lit(None).cast("double").alias(x) for x in LAYERS)))
    checks = checkpointed(gate.checks(layers.sample_nearest(routes), gate.surface_facts(layers.df), config))
    judged = gate.summary(checks)
    reasons = gate.fail_reasons(cases, ends.filter("inside"), found, judged)
    length = lambda df, name: paths.lengths(df).select("path_id", F.col("length_km").alias(f"{name}_length_km"), F.col("n_points").alias(f"n_{name}_vertices"))
    records = cases.join(length(real, "real"), "path_id", "left").join(length(routes, "predicted"), "path_id", "left").join(paths.similarity(routes, real), "path_id", "left")
    records = records.join(judged.drop("fail_reason"), "path_id", "left").join(reasons, "path_id")
    off = F.when(F.col("real_length_km") > 0, F.abs(F.col("predicted_length_km") - F.col("real_length_km")) / F.col("real_length_km") * 100)
    records = records.withColumns({"length_error_pct": off, "quality_passed": F.coalesce("quality_passed", F.lit(False)), "n_passed": F.coalesce("n_passed", F.lit(0)), "n_total": F.coalesce("n_total", F.lit(7)), "n_predicted_vertices": F.coalesce("n_predicted_vertices", F.lit(0))})
    records = checkpointed(records.withColumn("acceptable", F.col("quality_passed")))
    return Validation(records, checks, routes, report.validation_summary(records, METRICS))


def compare(grid: Grid, actual: DataFrame, algorithms: list[str], config: EngineConfig, runs: int = 30) -> DataFrame:
    """path_id, algorithm, seed, hausdorff_m (from the route to the line), overlap_500m_pct over every second point: the swarms once for each of so many seeds, astar once; only runs that found a route."""
    real = checkpointed(actual.select("path_id", "seq", "lon", "lat"))
    ends = snapped(grid, endpoints(grid, real))
    routes = search.repeated(ends.select("*", F.explode(F.array(*(F.lit(a) for a in algorithms))).alias("algorithm")), runs, config.seed)
    found = checkpointed(search.plan(grid, routes, config))
    key = F.xxhash64("path_id", "algorithm", "seed")
    named = checkpointed(found.select("path_id", "algorithm", "seed").distinct().withColumn("run_id", key))
    cells = found.withColumn("run_id", key).select(F.col("run_id").alias("path_id"), "algorithm", "seq", "row", "col")
    cheapest = search.smooth(cells.filter("algorithm = 'astar'").drop("algorithm"), grid, config)
    swarms = search.smooth(cells.filter("algorithm <> 'astar'").drop("algorithm"), grid, config, repaired=False, least=3)
    second = lambda df: df.withColumn("_k", F.row_number().over(Window.partitionBy("path_id").orderBy("seq"))).filter("_k % 2 = 1").drop("_k")
    predicted = second(cheapest.unionByName(swarms))
    lines = named.select(F.col("run_id"), "path_id").join(second(real), "path_id").select(F.col("run_id").alias("path_id"), "seq", "lon", "lat")
    near = paths.nearest_m(predicted, lines).groupBy("path_id").agg(F.max("d").alias("hausdorff_m"), (F.avg((F.col("d") < 500).cast("double")) * 100).alias("overlap_500m_pct"))
    return named.join(near.withColumnRenamed("path_id", "run_id"), "run_id").drop("run_id")


def tested(runs: DataFrame, base: str = "astar", metric: str = "hausdorff_m") -> DataFrame:
    """algorithm, n, t, p, significance: base's metric against each other algorithm's, paired by case and seed; base has one run for all seeds."""
    one = runs.filter(F.col("algorithm") == base).groupBy("path_id").agg(F.avg(metric).alias("a"))
    pairs = runs.filter(F.col("algorithm") != base).select("path_id", "algorithm", F.col(metric).alias("b")).join(one, "path_id")
    return report.paired_t(pairs, "a", "b", ["algorithm"])
