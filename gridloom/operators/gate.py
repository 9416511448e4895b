"""The seven checks of a route, their conjunction, and failure records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.config import EngineConfig
from gridloom.operators import paths, report


def _check(name: str, value: Column, threshold: float, passed: Column) -> Column:
    return F.struct(F.lit(name).alias("check_id"), F.coalesce(passed, F.lit(True)).alias("passed"), value.cast("double").alias("value"), F.lit(float(threshold)).alias("threshold"))


#: Metres from which a field of distances to water says nothing: it holds no water at all.
NO_WATER = 4999.0


def surface_facts(cells: DataFrame) -> DataFrame:
    """One row of a surface (cost, dist_water): median, of the costs, and nearest_water, the least distance."""
    median = report.percentiles(cells, ["cost"], [0.5]).select(F.col("value").alias("median"))
    nearest = cells.agg(F.min("dist_water").alias("nearest_water")) if "dist_water" in cells.columns else cells.limit(1).agg(F.lit(None).cast("double").alias("nearest_water"))
    return nearest.crossJoin(F.broadcast(median))  # one row each


def water_distance(samples: DataFrame) -> DataFrame:
    """path_id, p95_dist: the distance to water that 95 % of a path's samples exceed. A path's samples are one group."""
    return samples.groupBy("path_id").agg(F.percentile("dist_water", F.lit(0.05)).alias("p95_dist"))


def checks(samples: DataFrame, facts: DataFrame, config: EngineConfig) -> DataFrame:
    """path_id, check_id, passed, value, threshold, of samples (path_id, seq, lon, lat, z, slope, dist_water, hard_mask, cost). facts: one row of the whole surface, as surface_facts() gives: median, and nearest_water if the water check is to pass where there is no water. A check whose layer is null throughout passes with a null value."""
    stats = paths.statistics(samples)
    turn = paths.turn_angles(samples).groupBy("path_id").agg(F.max("turn").alias("turn"))
    climb = paths.monotone_climb(samples)
    layers = samples.groupBy("path_id").agg(
        F.max("slope").alias("slope"),
        F.avg((F.col("dist_water") < config.gate_water_m).cast("double")).alias("water"),
        F.count_if(F.col("hard_mask") == 0).alias("forbidden"),
        F.avg("cost").alias("cost"),
    )
    joined = layers.join(stats.select("path_id", "sinuosity"), "path_id").join(turn, "path_id").join(climb, "path_id", "left").crossJoin(F.broadcast(facts))
    dry = F.coalesce(F.col("nearest_water") >= NO_WATER, F.lit(False)) if "nearest_water" in facts.columns else F.lit(False)
    ratio = F.col("cost") / F.when(F.col("median") > 0, F.col("median"))
    rows = F.array(
        _check("slope", F.col("slope"), config.gate_slope, F.col("slope") <= config.gate_slope),
        _check("water", F.when(~dry, F.col("water")), config.gate_water_share, dry | (F.col("water") <= config.gate_water_share)),
        _check("protected", F.col("forbidden"), 0, F.col("forbidden") == 0),
        _check("curvature", F.col("turn"), config.gate_turn, F.col("turn") <= config.gate_turn),
        _check("sinuosity", F.col("sinuosity"), config.gate_sinuosity, F.col("sinuosity") <= config.gate_sinuosity),
        _check("elevation", F.coalesce("climb", F.lit(0.0)), config.gate_climb, F.coalesce("climb", F.lit(0.0)) <= config.gate_climb),
        _check("cost", ratio, config.gate_cost, ratio <= config.gate_cost),
    )
    return joined.select("path_id", F.inline(rows))


def summary(checked: DataFrame) -> DataFrame:
    """path_id, passed, n_passed, n_total, fail_reason: the failing checks by name, or NONE."""
    failing = F.array_join(F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("check_id")))), ",")
    return checked.groupBy("path_id").agg(F.bool_and("passed").alias("quality_passed"), F.count_if("passed").alias("n_passed"), F.count("*").alias("n_total"), F.when(F.count_if(~F.col("passed")) == 0, "NONE").otherwise(failing).alias("fail_reason"))


def fail_reasons(cases: DataFrame, grid_ok: DataFrame, found: DataFrame, gate: DataFrame) -> DataFrame:
    """case_id, fail_reason: ENDPOINT_INVALID without a row in grid_ok (path_id), ASTAR_FAILED without one in found, else the gate's."""
    df = cases.select("path_id").join(grid_ok.select("path_id", F.lit(1).alias("ok")), "path_id", "left").join(found.select("path_id", F.lit(1).alias("found")).distinct(), "path_id", "left").join(gate.select("path_id", F.col("fail_reason").alias("reason")), "path_id", "left")
    return df.select("path_id", F.when(F.col("ok").isNull(), "ENDPOINT_INVALID").when(F.col("found").isNull(), "ASTAR_FAILED").otherwise(F.coalesce("reason", F.lit("NONE"))).alias("fail_reason"))


def acceptable_v1(similar: DataFrame, lengths: DataFrame) -> DataFrame:
    """similar (path_id, hausdorff_m, mean_distance_m, overlap_500m_pct) with length_error_pct, of lengths (path_id, real_km, predicted_km), and acceptable: Hausdorff under 5 km, mean under 2 km, 500 m overlap over 30 %, length error under 30 %."""
    out = similar.join(lengths.select("path_id", F.when(F.col("real_km") > 0, F.abs(F.col("predicted_km") - F.col("real_km")) / F.col("real_km") * 100).alias("length_error_pct")), "path_id", "left")
    good = (F.col("hausdorff_m") < 5000) & (F.col("mean_distance_m") < 2000) & (F.col("overlap_500m_pct") > 30) & (F.col("length_error_pct") < 30)
    return out.withColumn("acceptable", F.coalesce(good, F.lit(False)))


def overall_v1(judged: DataFrame, share: float = 0.67) -> DataFrame:
    """One row: n, n_acceptable and whether the whole is acceptable, from the share on."""
    out = judged.agg(F.count("*").alias("n"), F.count_if("acceptable").alias("n_acceptable"))
    return out.withColumn("overall", F.col("n_acceptable") >= F.col("n") * share)
