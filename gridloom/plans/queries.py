"""The engine's operators over the driver's tables.

The tables hold no rasters or routes, so deterministic stand-ins serve: ``embeddings`` is a dense grid of elevations
(z = 1000 v, cells of 30 m), and each user's ``events`` in time order are a path: one that jumps about the whole region
(_paths), or a track with a point every 200 m or so (_tracks), which is what sampling and comparison take at their own steps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.config import BANDS, V2
from gridloom.grid import Grid
from gridloom.operators import convnet, cost, focal, gate, heuristic, model, paths, report, risk, search, spatial, vector
from gridloom.session import checkpointed, r6
from gridloom.plans import validation
from gridloom.sources import osm

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _grid(spark: SparkSession, d: str) -> Grid:
    return Grid.from_embeddings(_t(spark, d, "embeddings"))


def _paths(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("user_id").alias("path_id"), seq.alias("seq"), (120 + (F.col("event_id") % 2000) / 1000.0).alias("lon"), (21.9 + 3.5 * F.col("value") / 500).alias("lat"), F.col("value").alias("z"), "event_id")


def _tracks(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("user_id").alias("path_id"), seq.alias("seq"), (120 + seq * 0.002 + (F.col("event_id") % 11) * 0.0002).alias("lon"), (22 + F.col("user_id") * 0.01 + 0.004 * F.col("value") / 500).alias("lat"), F.col("value").alias("z"))


def _cells(df: DataFrame, *values: str) -> DataFrame:
    return df.select("row", "col", *(r6(v).alias(v) for v in values))


@query
def grid_slope_by_row(spark: SparkSession, d: str) -> DataFrame:
    return focal.slope(_grid(spark, d)).groupBy("row").agg(F.count("*").alias("n"), r6(F.avg("slope")).alias("slope_mean"), r6(F.max("slope")).alias("slope_max"))


@query
def grid_aspect(spark: SparkSession, d: str) -> DataFrame:
    return _cells(focal.aspect(_grid(spark, d)), "aspect_cos", "aspect_sin")


@query
def grid_curvature(spark: SparkSession, d: str) -> DataFrame:
    return _cells(focal.curvature(_grid(spark, d)), "curvature_profile", "curvature_plan")


@query
def grid_tri(spark: SparkSession, d: str) -> DataFrame:
    return _cells(focal.tri(_grid(spark, d)), "tri")


@query
def grid_tpi(spark: SparkSession, d: str) -> DataFrame:
    return _cells(focal.tpi(_grid(spark, d)), "tpi")


@query
def grid_roughness(spark: SparkSession, d: str) -> DataFrame:
    return _cells(focal.roughness(_grid(spark, d)), "roughness")


@query
def grid_gaussian(spark: SparkSession, d: str) -> DataFrame:
    return _cells(focal.gaussian(_grid(spark, d), "z", 2.0, "blurred"), "blurred")


@query
def grid_masked_gaussian(spark: SparkSession, d: str) -> DataFrame:
    g = _grid(spark, d)
    return _cells(focal.masked_gaussian(g.with_df(g.df.withColumn("mask", (F.col("z") > -100).cast("int"))), "z", "mask", 1.0, "blurred"), "blurred")


@query
def hillshade_strided(spark: SparkSession, d: str) -> DataFrame:
    return _cells(focal.hillshade(_grid(spark, d), stride=4), "shade")


@query
def risk_typhoon(spark: SparkSession, d: str) -> DataFrame:
    return _cells(risk.typhoon(_grid(spark, d)), "typhoon")


@query
def risk_seismic(spark: SparkSession, d: str) -> DataFrame:
    return _cells(risk.seismic(_grid(spark, d)), "seismic")


@query
def risk_landslide(spark: SparkSession, d: str) -> DataFrame:
    return _cells(risk.landslide(_grid(spark, d)), "landslide")


@query
def hard_mask(spark: SparkSession, d: str) -> DataFrame:
    return cost.hard_mask(focal.slope(_grid(spark, d)), V2).groupBy("row").agg(F.sum("hard_mask").alias("passable"), F.count("*").alias("n"))


def _coded(spark: SparkSession, d: str) -> Grid:
    """The grid with a land-use code of 1 to 8 by elevation."""
    g = _grid(spark, d)
    return g.with_df(g.df.withColumn("landuse", (F.pmod(F.floor(F.col("z") / 25), F.lit(8)) + 1).cast("int")))


@query
def soft_mask(spark: SparkSession, d: str) -> DataFrame:
    with_code = cost.soft_mask(_coded(spark, d).df, V2).groupBy("landuse").agg(F.count("*").alias("n"), r6(F.avg("soft_mask")).alias("soft_mask"))
    by_slope = cost.soft_mask(focal.slope(_grid(spark, d)), V2).agg(F.lit(0).alias("landuse"), F.count("*").alias("n"), r6(F.avg("soft_mask")).alias("soft_mask"))
    return with_code.unionByName(by_slope)


def _burned(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d).df.filter("z > 300").select("row", "col")


@query
def mask_dilate(spark: SparkSession, d: str) -> DataFrame:
    return vector.dilate(_burned(spark, d), _grid(spark, d), 2)


@query
def distance_field(spark: SparkSession, d: str) -> DataFrame:
    return _cells(vector.distance_field(_grid(spark, d), _burned(spark, d)), "dist")


@query
def building_density(spark: SparkSession, d: str) -> DataFrame:
    g = _grid(spark, d)
    return _cells(vector.building_density(g, _burned(spark, d)), "density")


@query
def landuse_classify(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "part")
    words = F.element_at(F.array(*(F.lit(w) for w in ("Farmland", "dense WOOD", "salt_pond", "muddy", "Urban", "quarry", "sandy beach", "military", "none"))), (F.col("p_partkey") % 9 + 1).cast("int"))
    return p.select(words.alias("landuse"), F.lower("p_type").alias("nature")).groupBy("landuse", "nature", vector.classify(F.col("landuse"), F.col("nature")).alias("code")).count().withColumnRenamed("count", "n")


@query
def landuse_raster_max(spark: SparkSession, d: str) -> DataFrame:
    g = _grid(spark, d)
    marks = _t(spark, d, "lineitem").select((F.col("l_orderkey") % 500).cast("int").alias("row"), (F.col("l_partkey") % 64).cast("int").alias("col"), (F.col("l_suppkey") % 7 + 1).cast("int").alias("code"))
    return vector.rasterize_max(marks, g)


@query
def rasterize_lines(spark: SparkSession, d: str) -> DataFrame:
    g = Grid(spark.range(0).select(F.lit(0).alias("row")), 350, 200, west=120.0, north=25.4, step=0.01)
    nxt = paths.with_next(_paths(spark, d)).filter("lon1 is not null")
    return vector.rasterize_lines(g, nxt.select(F.col("lon").alias("lon0"), F.col("lat").alias("lat0"), "lon1", "lat1")).groupBy("row").agg(F.count("*").alias("cells"), F.min("col").alias("first"), F.max("col").alias("last"))


@query
def geo_to_grid(spark: SparkSession, d: str) -> DataFrame:
    g = Grid(spark.range(0), 3500, 2000)
    at = _paths(spark, d).withColumn("row", g.row_of(F.col("lat"))).withColumn("col", g.col_of(F.col("lon")))
    return at.select("event_id", "row", "col", r6(g.lon_of(F.col("col"))).alias("lon"), r6(g.lat_of(F.col("row"))).alias("lat"))


@query
def resample_grid(spark: SparkSession, d: str) -> DataFrame:
    g = _grid(spark, d)
    return _cells(g.resample("z", 3.0, g.height // 3, g.width // 3), "z")


@query
def bilinear_sample(spark: SparkSession, d: str) -> DataFrame:
    g = _grid(spark, d)
    points = _t(spark, d, "events").select("event_id", (F.col("value") % 400).alias("fr"), ((F.col("event_id") % 630) / 10.0).alias("fc"))
    return g.sample_bilinear(points, "z").select("event_id", r6("z").alias("z"))


@query
def feature_stack(spark: SparkSession, d: str) -> DataFrame:
    g = _coded(spark, d)
    rows = cost.feature_stack(focal.aspect(g).withColumn("slope", focal.slope_of(F.col("dx"), F.col("dy"))))
    return rows.groupBy("landuse_code").agg(F.count("*").alias("n"), *(r6(F.avg(b)).alias(f"{b}_mean") for b in BANDS if b != "landuse_code"))


def _labelled(spark: SparkSession, d: str) -> Grid:
    g = _coded(spark, d)
    df = focal.slope(g).withColumn("dist_line", F.abs("z") * 10).withColumn("dist_water", F.abs(F.col("z") - 50) * 4)
    return g.with_df(cost.soft_mask(cost.hard_mask(df, V2), V2))


@query
def pseudo_label(spark: SparkSession, d: str) -> DataFrame:
    return _cells(cost.pseudo_label(_labelled(spark, d).df, V2, noise=0.0), "label")


def _fused(spark: SparkSession, d: str) -> Grid:
    g = _labelled(spark, d)
    return g.with_df(cost.fuse(g.with_df(cost.pseudo_label(g.df, V2, noise=0.0).withColumn("predicted", F.coalesce("label", F.lit(0.0)))), V2))


@query
def fuse_cost(spark: SparkSession, d: str) -> DataFrame:
    return _cells(_fused(spark, d).df, "cost")


@query
def path_length(spark: SparkSession, d: str) -> DataFrame:
    return paths.lengths(_paths(spark, d)).select("path_id", r6("length_km").alias("length_km"), "n_points")


@query
def path_dense_sample(spark: SparkSession, d: str) -> DataFrame:
    dense = paths.densify(_tracks(spark, d))
    return dense.groupBy("path_id").agg(F.count("*").alias("n"), r6(F.avg("lon")).alias("lon"), r6(F.avg("lat")).alias("lat"), F.max("seq").alias("last"))


@query
def path_resample(spark: SparkSession, d: str) -> DataFrame:
    even = paths.resample(_tracks(spark, d))
    return even.select("path_id", F.col("seq").cast("int").alias("seq"), F.round("lon", 5).alias("lon"), F.round("lat", 5).alias("lat"))


@query
def path_moving_avg(spark: SparkSession, d: str) -> DataFrame:
    return paths.moving_average(_paths(spark, d)).select("path_id", "seq", r6("lon").alias("lon"), r6("lat").alias("lat"))


@query
def path_turn_angle(spark: SparkSession, d: str) -> DataFrame:
    return paths.turn_angles(_paths(spark, d)).groupBy("path_id").agg(F.round(F.max("turn"), 4).alias("turn_max"), F.round(F.avg("turn"), 4).alias("turn_mean"))


@query
def path_monotone_climb(spark: SparkSession, d: str) -> DataFrame:
    return paths.monotone_climb(_paths(spark, d)).select("path_id", r6("climb").alias("climb"))


@query
def path_similarity(spark: SparkSession, d: str) -> DataFrame:
    both = _similar(spark, d)
    return both.select("path_id", F.round("hausdorff_m", 3).alias("hausdorff_m"), F.round("mean_distance_m", 3).alias("mean_distance_m"), *(r6(c).alias(c) for c in ("overlap_500m_pct", "overlap_1km_pct", "overlap_2km_pct")))


def _similar(spark: SparkSession, d: str, stride: int = 1) -> DataFrame:
    """Each track against the next user's, some kilometre away, thinned."""
    real = _tracks(spark, d).select("path_id", "seq", "lon", "lat")
    other = real.filter("seq % 3 = 1").withColumn("path_id", F.col("path_id") - 1)
    return paths.similarity(paths.moving_average(other.join(real.select("path_id").distinct(), "path_id", "left_semi")), real, stride=stride)


@query
def acceptable_v1(spark: SparkSession, d: str) -> DataFrame:
    real = paths.lengths(_tracks(spark, d)).select("path_id", F.col("length_km").alias("real_km"))
    other = paths.lengths(_tracks(spark, d).filter("seq % 3 = 1")).select((F.col("path_id") - 1).alias("path_id"), F.col("length_km").alias("predicted_km"))
    judged = gate.acceptable_v1(_similar(spark, d, stride=2), real.join(other, "path_id"))
    overall = gate.overall_v1(judged).select(F.lit(-1).cast("long").alias("path_id"), F.lit(None).cast("double").alias("length_error_pct"), F.col("overall").alias("acceptable"))
    return judged.select("path_id", F.round("length_error_pct", 4).alias("length_error_pct"), "acceptable").unionByName(overall)


@query
def path_one_sided(spark: SparkSession, d: str) -> DataFrame:
    real = _paths(spark, d).select("path_id", "seq", "lon", "lat")
    return paths.one_sided_similarity(paths.moving_average(real), real).select("path_id", F.round("directed_hausdorff_m", 3).alias("directed_hausdorff_m"), r6("overlap_500m_pct").alias("overlap_500m_pct"))


@query
def waypoint_paths(spark: SparkSession, d: str) -> DataFrame:
    dense = paths.waypoint_path(_tracks(spark, d))
    return dense.groupBy("path_id").agg(F.count("*").alias("n"), r6(F.avg("lon")).alias("lon"), r6(F.avg("lat")).alias("lat"), F.max("seq").alias("last"))


@query
def path_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = paths.statistics(_paths(spark, d).withColumn("slope", F.col("z") / 10).withColumn("cost", F.col("z") / 500).withColumn("hard_mask", (F.col("event_id") % 9 > 0).cast("int")))
    return rows.select("path_id", "n_vertices", "crossings", *(F.round(c, 5).alias(c) for c in ("length_km", "straight_km", "sinuosity", "elevation_min", "elevation_max", "elevation_mean", "ascent", "descent", "slope_mean", "slope_over_25_pct", "cost_sum")))


@query
def elevation_profile(spark: SparkSession, d: str) -> DataFrame:
    return paths.profile(_paths(spark, d)).select("path_id", "seq", F.round("dist_km", 5).alias("dist_km"), r6("z").alias("z"))


@query
def deviation_profile(spark: SparkSession, d: str) -> DataFrame:
    real = _paths(spark, d).select("path_id", "seq", "lon", "lat")
    fifth = paths.moving_average(real).filter("(seq - 1) % 5 = 0")
    return paths.nearest_m(fifth, real).select("path_id", "seq", F.round("d", 3).alias("d"))


@query
def line_progress(spark: SparkSession, d: str) -> DataFrame:
    return paths.progress(_paths(spark, d)).select("path_id", "seq", r6("t").alias("t"))


@query
def rdp_simplify(spark: SparkSession, d: str) -> DataFrame:
    return paths.simplify(_tracks(spark, d).withColumn("seq", F.col("seq").cast("long"))).select("path_id", "seq", r6("lon").alias("lon"), r6("lat").alias("lat"))


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).select("path_id", "seq", "lon", "lat", "z", (F.col("z") / 10).alias("slope"), (F.col("z") * 2).alias("dist_water"), F.when(F.col("event_id") % 500 == 0, 0).otherwise(1).alias("hard_mask"), (F.col("z") / 100).alias("cost"))


def _gate(spark: SparkSession, d: str) -> DataFrame:
    s = _samples(spark, d)
    return gate.checks(s, gate.surface_facts(s), V2)


@query
def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    return _gate(spark, d).select("path_id", "check_id", "passed", F.round("value", 4).alias("value"), "threshold")


@query
def quality_summary(spark: SparkSession, d: str) -> DataFrame:
    return gate.summary(_gate(spark, d))


@query
def fail_reasons(spark: SparkSession, d: str) -> DataFrame:
    p = _paths(spark, d).select("path_id").distinct()
    return gate.fail_reasons(p, p.filter("path_id % 10 <> 3"), p.filter("path_id % 7 <> 1"), gate.summary(_gate(spark, d)))


@query
def anti_join_exclusion(spark: SparkSession, d: str) -> DataFrame:
    return report.exclude(_t(spark, d, "orders").select("o_custkey", "o_orderkey"), _t(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey")), "o_custkey")


@query
def case_lookup(spark: SparkSession, d: str) -> DataFrame:
    cases = _t(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") * 40).alias("c_custkey"))
    return report.look_up(cases, _t(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), "c_custkey", "c_acctbal")


@query
def summary_stats(spark: SparkSession, d: str) -> DataFrame:
    s = report.summary(_t(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return s.select("metric", "n", *(F.round(c, 4).alias(c) for c in ("least", "mean", "median", "most")))


@query
def rollup_summary(spark: SparkSession, d: str) -> DataFrame:
    s = report.by_algorithm(_t(spark, d, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity")
    return s.select("l_returnflag", "l_linestatus", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"), "n_valid")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", F.col("l_quantity").alias("a"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_tax") * 300).alias("b"))


@query
def paired_t(spark: SparkSession, d: str) -> DataFrame:
    few = _pairs(spark, d).filter("l_orderkey % 200 = 0").withColumn("a", F.col("a") - 13).withColumn("l_linestatus", F.concat("l_linestatus", F.lit(" few")))
    rows = report.paired_t(_pairs(spark, d).unionByName(few).drop("l_orderkey"), "a", "b", ["l_returnflag", "l_linestatus"])
    return rows.select("l_returnflag", "l_linestatus", "n", F.round("t", 4).alias("t"), F.round("p", 5).alias("p"), "significance")


@query
def report_union(spark: SparkSession, d: str) -> DataFrame:
    real = _paths(spark, d).select("path_id", "seq", F.round("lon", 3).alias("lon"), F.round("lat", 3).alias("lat"))
    return report.comparison_features(real, real.filter("seq % 2 = 1")).groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("name").alias("names"))


@query
def osm_sources(spark: SparkSession, d: str) -> DataFrame:
    """Ways made of orders: the priority, status and customer are tags, the line items' keys are vertices; those of every other order close a ring."""
    points = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda x: F.struct((x["l_suppkey"] % 10 / 10).alias("lat"), (x["l_partkey"] % 100 / 100).alias("lon"))).alias("geometry"))
    tag = F.create_map(F.lit("highway"), F.when(F.col("o_orderpriority") == "1-URGENT", "primary").otherwise("path"), F.lit("waterway"), F.when(F.col("o_orderstatus") == "F", "river").otherwise("ditch"), F.lit("landuse"), F.when(F.col("o_custkey") % 2 == 0, "farmland"), F.lit("leisure"), F.when(F.col("o_custkey") % 3 == 0, "nature_reserve"), F.lit("building"), F.when(F.col("o_custkey") % 5 == 0, "yes"), F.lit("railway"), F.when(F.col("o_custkey") % 7 == 0, "rail").otherwise("tram"), F.lit("aeroway"), F.when(F.col("o_custkey") % 11 == 0, "runway"))
    ring = F.when(F.col("id") % 2 == 0, F.concat("geometry", F.slice("geometry", 1, 1))).otherwise(F.col("geometry"))
    points = points.withColumn("geometry", ring)
    rows = osm.ways(points.join(_t(spark, d, "orders"), F.col("id") == F.col("o_orderkey")).select(F.lit("way").alias("type"), "id", F.map_filter(tag, lambda _, v: v.isNotNull()).alias("tags"), "geometry"))
    counts = [osm.source(rows, k).agg(F.lit(k).alias("source"), F.count("*").alias("n"), F.coalesce(F.sum(F.size("coords")), F.lit(0)).cast("long").alias("vertices")) for k in osm.SOURCES]
    out = counts[0]
    for x in counts[1:]:
        out = out.unionByName(x)
    return out


@query
def remaining_cost(spark: SparkSession, d: str) -> DataFrame:
    routes = _paths(spark, d).select("path_id", "seq", F.floor(F.col("lat") * 100).cast("int").alias("row"), F.floor(F.col("lon") * 100).cast("int").alias("col"), F.col("z").alias("cost"))
    return model.remaining_cost(routes).select("path_id", "seq", r6("remaining").alias("remaining"))


@query
def tile_mosaic(spark: SparkSession, d: str) -> DataFrame:
    g = _grid(spark, d)
    t = model.tiles(g, size=48, stride=32)
    shifted = t.select("row", "col", (F.col("z") + F.col("tile_row") + F.col("tile_col")).alias("predicted"))
    return _cells(model.mosaic(shifted), "predicted")


@query
def endpoint_snap(spark: SparkSession, d: str) -> DataFrame:
    g = _grid(spark, d)
    g = g.with_df(g.df.withColumn("cost", F.when(F.col("z") < 100, F.col("z") + 1000)))
    points = _t(spark, d, "events").select(F.col("event_id").alias("path_id"), (F.col("event_id") % g.height).cast("int").alias("row"), (F.col("user_id") % 64).cast("int").alias("col"))
    return search.snap(points, g)


def _routes(spark: SparkSession, d: str, *algorithms: str) -> DataFrame:
    n = _t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("path_id"))
    high = _grid(spark, d).height - 1  # ends all over the grid, whatever its height
    row = lambda at: F.floor(at * high / 99).cast("int")
    ends = n.select("path_id", row(F.col("path_id") * 17 % 60).alias("r0"), (F.col("path_id") * 11 % 60).cast("int").alias("c0"), row(F.col("path_id") * 29 % 60 + 40).alias("r1"), (F.col("path_id") * 7 % 60).cast("int").alias("c1"))
    return ends.select("*", F.explode(F.array(*(F.lit(a) for a in algorithms))).alias("algorithm"), F.lit(42).alias("seed"))


def _surface(spark: SparkSession, d: str) -> Grid:
    g = _grid(spark, d)
    return g.with_df(g.df.withColumn("cost", F.when(F.col("z") < 250, (F.col("z") + 1000) / 1000)))


@query
def astar_routes(spark: SparkSession, d: str) -> DataFrame:
    """Each route's steps and cost; a route without a way has a status only."""
    routes = _routes(spark, d, "astar")
    found = checkpointed(search.plan(_surface(spark, d), routes, V2))
    w = Window.partitionBy("path_id").orderBy("seq")
    slanted = (F.lag("row").over(w) != F.col("row")) & (F.lag("col").over(w) != F.col("col"))
    moves = found.withColumn("step", F.when(F.col("seq") > 0, F.col("cost") * F.when(slanted, V2.diagonal).otherwise(1.0)).otherwise(0.0))
    totals = moves.groupBy("path_id").agg(r6(F.sum("step")).alias("total"))
    return search.missed(routes, found).select("path_id", "status").join(totals, "path_id", "left")


@query
def learned_heuristic(spark: SparkSession, d: str) -> DataFrame:
    """What a net tells of the rest of each cheapest route from each of its cells, beside what it costs."""
    g = _surface(spark, d)
    g = g.with_df(checkpointed(focal.slope(g)))
    found = checkpointed(search.plan(g, _routes(spark, d, "astar"), V2))
    rows = checkpointed(heuristic.samples(found, g.df.select("row", "col", "z", "slope"), g, V2.diagonal))
    return heuristic.told(rows, heuristic.train(rows, ["z", "slope"])).select("path_id", "seq", "row", "col", r6("remaining").alias("remaining"), "ahead")


@query
def swarm_routes(spark: SparkSession, d: str) -> DataFrame:
    return search.plan(_surface(spark, d), _routes(spark, d, "ipso_sa", "dbo"), V2)


@query
def rf_surface(spark: SparkSession, d: str) -> DataFrame:
    g = _labelled(spark, d)
    labels = cost.pseudo_label(g.df, V2).select("row", "col", "label", "hard_mask")
    rows = checkpointed(cost.feature_stack(focal.terrain(g)).join(labels, ["row", "col"]))
    train, _ = model.split(model.valid(rows))
    return model.predict(model.train_forest(train, V2), rows)


@query
def unet_surface(spark: SparkSession, d: str) -> DataFrame:
    """A net that learns the labels from five bands, over the whole grid; smaller and trained for fewer rounds than by default."""
    g = _labelled(spark, d)
    bands = ["z", "slope", "landuse", "dist_line", "dist_water"]
    g = g.with_df(checkpointed(cost.pseudo_label(g.df, V2, noise=0.0).select("row", "col", *bands, "label", "hard_mask")))
    return convnet.infer(g, convnet.train(g, bands, most=200, size=32, width=4, depth=2, rounds=12, batches=2, rate=0.01, check_every=6))


def _surveyed(spark: SparkSession, d: str) -> tuple[Grid, DataFrame]:
    """A surface with the layers that the gate checks, and the tracks moved onto it, as far as they fit."""
    g = _surface(spark, d)
    df = focal.slope(g.with_df(g.df.withColumn("hard_mask", F.col("cost").isNotNull().cast("int")).withColumn("dist_water", F.abs(F.col("z") - 50) * 4)))
    return g.with_df(checkpointed(df)), _tracks(spark, d).select("path_id", "seq", "lon", (F.col("lat") + 3.0).alias("lat"))


@query
def validation_batch(spark: SparkSession, d: str) -> DataFrame:
    """All users' tracks as cases: the record of each."""
    g, tracks = _surveyed(spark, d)
    records = validation.validate(g, tracks, tracks.select("path_id").distinct(), V2).records
    return records.select("path_id", "fail_reason", "quality_passed", "n_passed", "n_real_vertices", "n_predicted_vertices", *(F.round(c, 4).alias(c) for c in ("real_length_km", *validation.METRICS)))


@query
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    from gridloom.streaming.events import hourly

    return hourly(_t(spark, d, "events"))


@query
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    from gridloom.streaming.events import sessions

    return sessions(_t(spark, d, "events"))


@query
def terrain_factors(spark: SparkSession, d: str) -> DataFrame:
    return _cells(focal.terrain(_grid(spark, d)), "slope", "aspect_cos", "aspect_sin", "tri", "tpi", "curvature_profile", "curvature_plan", "roughness")


@query
def nearest_sample(spark: SparkSession, d: str) -> DataFrame:
    g = _grid(spark, d)
    at = Grid(g.df, g.height, g.width, step=0.032)
    return at.sample_nearest(_paths(spark, d).select("event_id", "lon", "lat")).select("event_id", "row", "col", r6("z").alias("z"))


@query
def random_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sample by definition: about 10,000 cells by a hash of their place."""
    return model.sample(_grid(spark, d).df, 10_000).select("row", "col")


@query
def channel_normalisation(spark: SparkSession, d: str) -> DataFrame:
    rows = focal.slope(_grid(spark, d)).select("row", "col", "z", "slope")
    return _cells(model.channel_normalised(rows, ["z", "slope"]), "z", "slope")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    coords = F.transform(F.array_sort(F.collect_list(F.struct("seq", "lon", "lat"))), lambda x: F.struct(x["lon"].alias("lon"), x["lat"].alias("lat")))
    return _paths(spark, d).groupBy("path_id", F.floor((F.col("seq") - 1) / 3).alias("k")).agg(coords.alias("coords")).select((F.col("path_id") * 100_000 + F.col("k")).alias("feature_id"), "coords")


@query
def lines_touching_box(spark: SparkSession, d: str) -> DataFrame:
    return osm.touches_box(_lines(spark, d), 120.5, 23.0, 120.8, 23.5).select("feature_id", F.size("coords").alias("n"))


@query
def lines_clipped(spark: SparkSession, d: str) -> DataFrame:
    parts = osm.clip_lines(_lines(spark, d), 120.5, 22.5, 121.5, 24.5)
    lon = lambda f: r6(f(F.transform("coords", lambda p: p["lon"])))
    return parts.select("feature_id", "part", F.size("coords").alias("n"), lon(F.array_min).alias("west"), lon(F.array_max).alias("east"))


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    """A box for each supplier, about a tenth of a degree wide."""
    k = F.col("s_suppkey")
    west, south = 120 + (k * 37 % 187) / 100.0, 21.9 + (k * 53 % 331) / 100.0
    return _t(spark, d, "supplier").select(k.alias("box_id"), west.alias("west"), south.alias("south"), (west + 0.05 + (k % 11) / 100.0).alias("east"), (south + 0.04 + (k % 7) / 100.0).alias("north"))


@query
def lines_in_boxes(spark: SparkSession, d: str) -> DataFrame:
    """All lines against all boxes: how many steps of each line meet each box, and how long they are within it, in degrees."""
    met = spatial.lengths_in_boxes(_lines(spark, d), _boxes(spark, d))
    return met.select("feature_id", "box_id", "n_steps", r6("length").alias("degrees"))


@query
def polygons_in_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Diamonds of customers, cut by the boxes: the area in hundredths of square degrees."""
    x, y = 120.2 + (F.col("c_custkey") * 7 % 1000) / 600.0, 22.2 + (F.col("c_custkey") * 13 % 1000) / 320.0
    half = 0.02 + (F.col("c_custkey") % 5) / 50.0
    point = lambda a, b: F.struct((x + a * half).alias("lon"), (y + b * half).alias("lat"))
    rings = _t(spark, d, "customer").select(F.col("c_custkey").alias("ring_id"), F.array(point(1, 0), point(0, 1), point(-1, 0), point(0, -1), point(1, 0)).alias("points"))
    cut = spatial.clip_polygons(rings, _boxes(spark, d))
    return cut.select("ring_id", "box_id", r6(F.col("area") * 100).alias("area")).filter("area > 0.000001")


@query
def reproject_grid(spark: SparkSession, d: str) -> DataFrame:
    """The elevations, which lie on degrees, on a grid of web Mercator's metres."""
    g = _grid(spark, d)
    x, y = 120.0 * 111319.49079327358, 2922947.0  # the west side and about the north side
    target = Grid(g.df, g.height, g.width, west=x, north=y, step=115.0)
    # what two libraries' sines and logarithms differ by, times the slope, is seen in the sixth decimal
    return g.reproject("z", "EPSG:4326", target, "EPSG:3857").df.select("row", "col", (F.round("z", 3) + F.lit(0.0)).alias("z"))


@query
def quality_reports(spark: SparkSession, d: str) -> DataFrame:
    rows = report.nested_checks(_gate(spark, d))
    names = ("slope", "water", "protected", "curvature", "sinuosity", "elevation", "cost")
    return rows.select("path_id", *(F.get_json_object("report", f"$.{c}.passed").alias(c) for c in names), F.round(F.get_json_object("report", "$.slope.value").cast("double"), 4).alias("slope_value"))


@query
def grid_percentiles(spark: SparkSession, d: str) -> DataFrame:
    rows = report.percentiles(_grid(spark, d).df, ["z"], [0.01, 0.02, 0.05, 0.5, 0.98])
    return rows.select("metric", "share", r6("value").alias("value"))


@query
def best_by_group(spark: SparkSession, d: str) -> DataFrame:
    items = _t(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice", "l_orderkey", "l_linenumber")
    return report.best_of(items, ["l_returnflag", "l_linestatus"], "l_extendedprice")


def _records(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders")
    algorithm = F.element_at(F.array(F.lit("A*"), F.lit("IPSO-SA"), F.lit("DBO")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return o.groupBy((F.col("o_custkey") % 10).alias("case_id"), algorithm.alias("algorithm")).agg(F.round(F.max("o_totalprice"), 2).alias("hausdorff_m"), F.count("*").alias("n"), (F.count_if(F.col("o_totalprice") > 100_000) > 50).alias("quality_passed"))


@query
def case_comparison(spark: SparkSession, d: str) -> DataFrame:
    rows = report.case_comparison(_records(spark, d), "case_id", "algorithm", ["hausdorff_m", "n"])
    at = lambda a: F.get_json_object("comparison", f"$['{a}'].n").cast("long").alias(a.replace("-", "_"))
    return rows.select("case_id", at("astar"), at("ipso-sa"), at("dbo"))


@query
def validation_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = report.validation_summary(report.without_columns(_records(spark, d), "coords"), ["hausdorff_m", "n"])
    return rows.select("n", "n_passed", *(F.round(c, 4).alias(c) for c in ("hausdorff_m_mean", "n_mean", "hausdorff_m_median", "n_median")))


@query
def waypoint_repair(spark: SparkSession, d: str) -> DataFrame:
    g = _grid(spark, d)
    g = g.with_df(g.df.withColumn("cost", F.when(F.col("z") < 100, F.col("z") + 1000)))
    points = _t(spark, d, "events").select(F.col("user_id").alias("path_id"), F.col("event_id").alias("seq"), (F.col("event_id") % (g.height + 3)).cast("int").alias("row"), (F.col("user_id") % 64).cast("int").alias("col"))
    return search.repair_waypoints(points, g)


def _masked_routes(spark: SparkSession, d: str) -> tuple[Grid, DataFrame]:
    g = _surface(spark, d)
    g = g.with_df(g.df.withColumn("hard_mask", F.col("cost").isNotNull().cast("int")))
    return g, checkpointed(search.plan(g, _routes(spark, d, "astar"), V2)).select("path_id", "seq", "row", "col")


@query
def smooth_routes(spark: SparkSession, d: str) -> DataFrame:
    g, routes = _masked_routes(spark, d)
    return search.smooth(routes, g, V2)


@query
def smooth_swarm_routes(spark: SparkSession, d: str) -> DataFrame:
    g, routes = _masked_routes(spark, d)
    return search.smooth(routes, g, V2, repaired=False, least=3)


@query
def align_layers(spark: SparkSession, d: str) -> DataFrame:
    """The elevation and its slope on cells of 90 m, and how far they are from the cells of the tracks."""
    g = _grid(spark, d)
    steps = paths.with_next(_tracks(spark, d)).filter("lon1 is not null").select(F.col("lon").alias("lon0"), (F.col("lat") + 3.0).alias("lat0"), "lon1", (F.col("lat1") + 3.0).alias("lat1"))
    out = vector.align(g.with_df(focal.slope(g)), ["z", "slope"], lines={"dist_line": (steps, 5000.0)})
    return _cells(out.df, "z", "slope", "dist_line")


@query
def polygons_raster(spark: SparkSession, d: str) -> DataFrame:
    """Triangles of customers; how many cells of each row they touch."""
    point = lambda a, b: F.struct((120.00037 + (F.col("c_custkey") * a % 1000) / 500.0).alias("lon"), (22.00041 + (F.col("c_custkey") * b % 1000) / 300.0).alias("lat"))
    corners = F.array(point(7, 13), point(11, 5), point(3, 17), point(7, 13))
    rings = _t(spark, d, "customer").select(F.col("c_custkey").alias("ring_id"), corners.alias("points"))
    g = Grid(rings, 70, 40, west=120.0, north=25.4, step=0.05)
    return vector.rasterize_polygons(g, rings).groupBy("row").agg(F.count("*").alias("cells"), F.min("col").alias("first"), F.max("col").alias("last"))


@query
def opened_cells(spark: SparkSession, d: str) -> DataFrame:
    return search.opened_cells(_surface(spark, d), _routes(spark, d, "astar").drop("algorithm"), V2)


@query
def convergence_curves(spark: SparkSession, d: str) -> DataFrame:
    return report.convergence_report(search.convergence(_surface(spark, d), _routes(spark, d, "ipso_sa", "dbo"), V2))
