"""Polylines as ordered rows (path_id, seq, lon, lat): lengths, sampling, smoothing, comparison and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.config import EARTH_KM
from gridloom.session import checkpointed


def _path() -> Window:
    return Window.partitionBy("path_id").orderBy("seq")


def haversine_m(lon0: Column, lat0: Column, lon1: Column, lat1: Column) -> Column:
    a = F.sin(F.radians(lat1 - lat0) / 2) ** 2 + F.cos(F.radians(lat0)) * F.cos(F.radians(lat1)) * F.sin(F.radians(lon1 - lon0) / 2) ** 2
    return 2 * EARTH_KM * 1000 * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))  # null where a point is


def with_next(paths: DataFrame) -> DataFrame:
    """Adds lon1, lat1 of the next point, and d, the metres to it; null at the end."""
    nxt = paths.withColumn("lon1", F.lead("lon").over(_path())).withColumn("lat1", F.lead("lat").over(_path()))
    return nxt.withColumn("d", haversine_m(F.col("lon"), F.col("lat"), F.col("lon1"), F.col("lat1")))


def lengths(paths: DataFrame) -> DataFrame:
    return with_next(paths).groupBy("path_id").agg((F.sum("d") / 1000).alias("length_km"), F.count("*").alias("n_points"))


def densify(paths: DataFrame, step_m: float = 100.0) -> DataFrame:
    """path_id, seq, lon, lat: each segment in max(1, int(length / step)) equal parts."""
    nxt = with_next(paths)
    parts = F.greatest(F.lit(1), (F.col("d") / step_m).cast("int"))
    cut = nxt.filter("d is not null").select("path_id", F.col("seq").alias("part_of"), F.posexplode(F.sequence(F.lit(1), parts)).alias("k", "i"), parts.alias("n"), "lon", "lat", "lon1", "lat1")
    inner = cut.select("path_id", "part_of", "i", (F.col("lon") + (F.col("lon1") - F.col("lon")) * F.col("i") / F.col("n")).alias("lon"), (F.col("lat") + (F.col("lat1") - F.col("lat")) * F.col("i") / F.col("n")).alias("lat"))
    first = paths.withColumn("rn", F.row_number().over(_path())).filter("rn = 1").select("path_id", F.col("seq").alias("part_of"), F.lit(0).alias("i"), "lon", "lat")
    return first.unionByName(inner).withColumn("seq", F.row_number().over(Window.partitionBy("path_id").orderBy("part_of", "i")) - 1).select("path_id", "seq", "lon", "lat")


def waypoint_path(points: DataFrame, step_m: float = 30.0) -> DataFrame:
    """path_id, seq, lon, lat: each step between way points in max(2, int(length / step)) equal parts."""
    nxt = with_next(points)
    n = F.greatest(F.lit(2), (F.col("d") / step_m).cast("int"))
    cut = nxt.filter("d is not null").select("path_id", F.col("seq").alias("part_of"), F.explode(F.sequence(F.lit(0), n - 1)).alias("j"), n.alias("n"), "lon", "lat", "lon1", "lat1")
    inner = cut.select("path_id", "part_of", "j", (F.col("lon") + F.col("j") / F.col("n") * (F.col("lon1") - F.col("lon"))).alias("lon"), (F.col("lat") + F.col("j") / F.col("n") * (F.col("lat1") - F.col("lat"))).alias("lat"))
    last = nxt.filter("lon1 is null").select("path_id", F.col("seq").alias("part_of"), F.lit(0).alias("j"), "lon", "lat")
    return inner.unionByName(last).withColumn("seq", F.row_number().over(Window.partitionBy("path_id").orderBy("part_of", "j")) - 1).select("path_id", "seq", "lon", "lat")


def resample(paths: DataFrame, spacing_m: float = 30.0) -> DataFrame:
    """path_id, seq, lon, lat: max(int(length / spacing), points) points at equal planar arc length in degrees, ends included. Each segment makes the points that fall into it, so no range join is needed."""
    nxt = paths.withColumn("lon1", F.lead("lon").over(_path())).withColumn("lat1", F.lead("lat").over(_path()))
    nxt = nxt.withColumn("d", F.coalesce(F.sqrt((F.col("lon1") - F.col("lon")) ** 2 + (F.col("lat1") - F.col("lat")) ** 2), F.lit(0.0)))
    whole = Window.partitionBy("path_id")
    end = F.sum("d").over(_path())
    nxt = nxt.withColumn("start", end - F.col("d")).withColumn("total", F.sum("d").over(whole)).withColumn("points", F.count("*").over(whole))
    n = F.greatest((F.col("total") / (spacing_m / 111000.0)).cast("int"), F.col("points").cast("int"))
    nxt = nxt.withColumn("n", n).withColumn("gap", F.when(F.col("n") > 1, F.col("total") / (F.col("n") - 1)).otherwise(F.lit(0.0)))
    # the first sample at or after the segment's start, up to before its end; the last point makes the last sample. All are rows of one
    # flow: Spark zips the partitions of a union of equally dealt tables, which fails where adaptive joins have split some of them
    low = F.ceil(F.col("start") / F.col("gap") - 1e-9).cast("int")
    high = F.least(F.ceil((F.col("start") + F.col("d")) / F.col("gap") - 1e-9) - 1, F.col("n") - 2).cast("int")
    inner = (F.col("d") > 0) & (F.col("gap") > 0)
    nxt = nxt.withColumn("low", F.when(F.col("lon1").isNull(), F.col("n") - 1).when(inner, low)).withColumn("high", F.when(F.col("lon1").isNull(), F.col("n") - 1).when(inner, high))
    made = nxt.withColumn("k", F.explode(F.when(F.col("low") <= F.col("high"), F.sequence("low", "high"))))
    t = (F.col("k") * F.col("gap") - F.col("start")) / F.col("d")
    at = lambda c: F.when(F.col("lon1").isNull(), F.col(c)).otherwise(F.col(c) + t * (F.col(f"{c}1") - F.col(c))).alias(c)
    return made.select("path_id", F.col("k").alias("seq"), at("lon"), at("lat"))


def moving_average(paths: DataFrame, k: int = 2) -> DataFrame:
    """Means over 2k + 1 points; the first and last k points stay."""
    size, at = F.count("*").over(Window.partitionBy("path_id")), F.row_number().over(_path())
    inside = (at > k) & (at <= size - k)
    mean = lambda c: F.when(inside, F.avg(c).over(_path().rowsBetween(-k, k))).otherwise(F.col(c))
    return paths.select("path_id", "seq", mean("lon").alias("lon"), mean("lat").alias("lat"))


def turn_angles(paths: DataFrame) -> DataFrame:
    """path_id, seq, turn: degrees between the steps to and from each inner point, with longitudes scaled by the latitude."""
    f = lambda c, k: (F.lag(c) if k < 0 else F.lead(c)).over(_path())
    scale = F.cos(F.radians("lat"))
    ax, ay = (F.col("lon") - f("lon", -1)) * scale, F.col("lat") - f("lat", -1)
    bx, by = (f("lon", 1) - F.col("lon")) * scale, f("lat", 1) - F.col("lat")
    n = F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by)
    turn = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ax * bx + ay * by) / n))))
    return paths.select("path_id", "seq", F.when(n > 0, turn).alias("turn"))


def monotone_climb(samples: DataFrame, value: str = "z", step: float = 2.0, least: float = 50.0, points: int = 10) -> DataFrame:
    """path_id, climb: the largest range of a monotone run of elevations. Steps below ``step`` don't count; a reversal ends a run whose range is above ``least``. With no more than ``points`` samples: 0."""
    z = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col(value).alias("v")))), lambda x: x["v"])
    state = F.struct(F.lit(None).cast("double").alias("last"), F.lit(0).alias("way"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(0.0).alias("most"))

    def fold(s: Column, v: Column) -> Column:
        d = v - s["last"]
        way = F.when(d > 0, 1).otherwise(-1)
        still = F.abs(d) < step
        turned = (s["way"] != 0) & (way != s["way"])
        close = turned & (s["high"] - s["low"] > least)
        started = F.struct(v.alias("last"), F.lit(0).alias("way"), v.alias("low"), v.alias("high"), F.lit(0.0).alias("most"))
        moved = F.struct(
            v.alias("last"),
            F.when(still, s["way"]).when((s["way"] == 0) | close, way).otherwise(s["way"]).alias("way"),
            F.when(still, s["low"]).when(close, F.least(s["last"], v)).otherwise(F.least(s["low"], v)).alias("low"),
            F.when(still, s["high"]).when(close, F.greatest(s["last"], v)).otherwise(F.greatest(s["high"], v)).alias("high"),
            F.when(~still & close, F.greatest(s["most"], s["high"] - s["low"])).otherwise(s["most"]).alias("most"),
        )
        return F.when(s["last"].isNull(), started).otherwise(moved)

    grouped = samples.filter(F.col(value).isNotNull()).groupBy("path_id").agg(z.alias("zs"))
    folded = F.aggregate("zs", state, fold, lambda s: F.greatest(s["most"], s["high"] - s["low"]))
    return grouped.select("path_id", F.when(F.size("zs") > points, folded).otherwise(0.0).alias("climb"))


def _in_space(lon: Column, lat: Column) -> list[Column]:
    """Metres from the Earth's centre along three axes. haversine_m() of two places is the arc over the straight line between them, at poles and for any degrees, beyond 90 of latitude too."""
    r = EARTH_KM * 1000
    return [r * F.cos(F.radians(lat)) * F.cos(F.radians(lon)), r * F.cos(F.radians(lat)) * F.sin(F.radians(lon)), r * F.sin(F.radians(lat))]


def _cube(x: Column, y: Column, z: Column) -> Column:
    """One number for the three of a cube, which are within 2^20 of 0 each."""
    return (x * F.lit(1 << 21) + y) * F.lit(1 << 21) + z


def nearest_m(a: DataFrame, b: DataFrame, reach_m: float = 2_000.0) -> DataFrame:
    """path_id, seq, d: metres from each point of a to the nearest of b on the same path_id.

    Points fall into cubes in space, three times as wide as reach_m. The nearest point in the cubes within reach, 4.6 in the
    mean, if itself within reach, is exact. The other points, few where two lines are alike, are compared with one point of
    each of their path's cubes, which bounds how far the nearest point is; then they meet the points of the
    cubes that may hold a nearer one.
    """
    key, wide, reach = ["path_id", "seq"], 3.0 * reach_m, 1.000001 * reach_m
    at = lambda v: F.floor(v / wide)
    bb = b.select("path_id", F.col("lon").alias("lon1"), F.col("lat").alias("lat1")).filter("lon1 is not null and lat1 is not null")
    bb = bb.withColumn("cube", _cube(*(at(v) for v in _in_space(F.col("lon1"), F.col("lat1")))))
    aa = a.select(*key, F.col("lon").alias("lon0"), F.col("lat").alias("lat0"))
    d = haversine_m(F.col("lon0"), F.col("lat0"), F.col("lon1"), F.col("lat1"))
    x, y, z = (F.sequence(at(v - reach), at(v + reach)) for v in _in_space(F.col("lon0"), F.col("lat0")))
    cubes = F.flatten(F.flatten(F.transform(x, lambda i: F.transform(y, lambda j: F.transform(z, lambda k: _cube(i, j, k))))))
    met = aa.select("*", F.explode(cubes).alias("cube")).join(bb, ["path_id", "cube"])
    close = checkpointed(met.groupBy(*key).agg(F.min(d).alias("d")).filter(F.col("d") <= reach_m))
    places = bb.groupBy("path_id", "cube").agg(F.min(F.struct("lon1", "lat1")).alias("p")).select("path_id", "cube", *(c.alias(n) for n, c in zip(("x", "y", "z"), _in_space(F.col("p.lon1"), F.col("p.lat1")), strict=True)))
    lost = aa.join(close, key, "left_anti").select("*", *(c.alias(n) for n, c in zip(("x0", "y0", "z0"), _in_space(F.col("lon0"), F.col("lat0")), strict=True)))
    far = F.sqrt((F.col("x") - F.col("x0")) ** 2 + (F.col("y") - F.col("y0")) ** 2 + (F.col("z") - F.col("z0")) ** 2)
    # in straight lines: a cube's points are no farther from one another than its diagonal. Neither step moves or keeps pairs: both stay where path_id has put its rows
    bounds = lost.join(places, "path_id").groupBy(*key, "lon0", "lat0", "x0", "y0", "z0").agg((F.min(far) + 3**0.5 * wide * 1.001).alias("bound"))
    may = bounds.join(places, "path_id").filter(far <= F.col("bound")).select(*key, "lon0", "lat0", "cube")
    return close.unionByName(may.join(bb, ["path_id", "cube"]).groupBy(*key).agg(F.min(d).alias("d")))


def similarity(predicted: DataFrame, real: DataFrame, step_m: float = 100.0, stride: int = 1) -> DataFrame:
    """path_id, hausdorff_m (both ways, over every stride-th point: all of them unless told otherwise), mean_distance_m and overlap shares (predicted to real)."""
    p, r = checkpointed(densify(predicted, step_m)), checkpointed(densify(real, step_m))
    every = lambda x: x.filter(F.col("seq") % stride == 0) if stride > 1 else x
    share = lambda m: F.avg((F.col("d") < m).cast("double")) * 100
    near = nearest_m(p, r).groupBy("path_id").agg(F.max("d").alias("there"), F.avg("d").alias("mean_distance_m"), share(500).alias("overlap_500m_pct"), share(1000).alias("overlap_1km_pct"), share(2000).alias("overlap_2km_pct"))
    if stride > 1:
        near = near.drop("there").join(nearest_m(every(p), every(r)).groupBy("path_id").agg(F.max("d").alias("there")), "path_id")
    back = nearest_m(every(r), every(p)).groupBy("path_id").agg(F.max("d").alias("back"))
    return near.join(back, "path_id").withColumn("hausdorff_m", F.greatest("there", "back")).drop("there", "back")


def one_sided_similarity(predicted: DataFrame, real: DataFrame) -> DataFrame:
    """path_id, directed_hausdorff_m, overlap_500m_pct over the points as they are: another metric than similarity()."""
    return nearest_m(predicted, real).groupBy("path_id").agg(F.max("d").alias("directed_hausdorff_m"), (F.avg((F.col("d") < 500).cast("double")) * 100).alias("overlap_500m_pct"))


def profile(samples: DataFrame) -> DataFrame:
    """path_id, seq, dist_km (along the path) and z."""
    before = F.coalesce(F.sum("d").over(_path().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return with_next(samples).select("path_id", "seq", (before / 1000).alias("dist_km"), "z")


def statistics(samples: DataFrame) -> DataFrame:
    """Length, straight distance, sinuosity, elevation, ascent, slope and cost of paths sampled as (path_id, seq, lon, lat, z, slope, cost), and crossings, how many samples a hard_mask forbids, if they have one."""
    nxt = with_next(samples).withColumn("dz", F.lead("z").over(_path()) - F.col("z"))
    first, last = (F.min_by(F.struct("lon", "lat"), "seq"), F.max_by(F.struct("lon", "lat"), "seq"))
    share = lambda s: F.avg((F.col("slope") > s).cast("double")) * 100
    out = nxt.groupBy("path_id").agg(
        (F.coalesce(F.sum("d"), F.lit(0.0)) / 1000).alias("length_km"), first.alias("a"), last.alias("b"),
        F.min("z").alias("elevation_min"), F.max("z").alias("elevation_max"), F.avg("z").alias("elevation_mean"),
        F.sum(F.greatest(F.lit(0.0), F.coalesce("dz", F.lit(0.0)))).alias("ascent"), F.sum(F.greatest(F.lit(0.0), -F.coalesce("dz", F.lit(0.0)))).alias("descent"),
        F.avg("slope").alias("slope_mean"), F.max("slope").alias("slope_max"), share(15).alias("slope_over_15_pct"), share(25).alias("slope_over_25_pct"), share(35).alias("slope_over_35_pct"),
        F.sum("cost").alias("cost_sum"), F.avg("cost").alias("cost_mean"), F.max("cost").alias("cost_max"), F.count("*").alias("n_vertices"),
        *([F.count_if(F.col("hard_mask") == 0).alias("crossings")] if "hard_mask" in samples.columns else []),
    )
    straight = haversine_m(F.col("a.lon"), F.col("a.lat"), F.col("b.lon"), F.col("b.lat")) / 1000
    return out.withColumn("straight_km", straight).withColumn("sinuosity", F.when(straight > 0, F.col("length_km") / straight).otherwise(1.0)).drop("a", "b")


def progress(points: DataFrame) -> DataFrame:
    """path_id, seq, t: where each point projects onto the line from its path's first to its last point, clamped to 0 to 1."""
    w = Window.partitionBy("path_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ax, ay, bx, by = F.first("lon").over(w), F.first("lat").over(w), F.last("lon").over(w), F.last("lat").over(w)
    df = points.select("path_id", "seq", "lon", "lat", ax.alias("ax"), ay.alias("ay"), (bx - ax).alias("ux"), (by - ay).alias("uy"))
    n = F.col("ux") ** 2 + F.col("uy") ** 2
    t = ((F.col("lon") - F.col("ax")) * F.col("ux") + (F.col("lat") - F.col("ay")) * F.col("uy")) / n
    return df.select("path_id", "seq", F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))).otherwise(0.0).alias("t"))


def simplify(paths: DataFrame, epsilon_m: float = 90.0) -> DataFrame:
    """Ramer-Douglas-Peucker by path: a point stays if it is over epsilon (in degrees, metres / 111 000) from the segment between kept neighbours. One path is one group: its points must fit a task."""
    import numpy as np
    import pandas as pd

    eps = epsilon_m / 111_000.0

    def one(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("seq", ignore_index=True)
        xy = p[["lon", "lat"]].to_numpy()
        keep = np.zeros(len(p), bool)
        keep[[0, -1]] = True
        spans = [(0, len(p) - 1)]
        while spans:
            i, j = spans.pop()
            if j - i < 2:
                continue
            u = xy[j] - xy[i]
            n = u @ u
            if n == 0:
                continue
            v = xy[i + 1 : j] - xy[i]
            t = np.clip(v @ u / n, 0, 1)
            off = np.hypot(*(v - t[:, None] * u).T)
            if off.max() > eps:
                k = i + 1 + int(off.argmax())
                keep[k] = True
                spans += [(i, k), (k, j)]
        return p[keep]

    return paths.select("path_id", "seq", "lon", "lat").groupBy("path_id").applyInPandas(one, "path_id long, seq long, lon double, lat double")

