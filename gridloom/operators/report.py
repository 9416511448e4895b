"""Validation records, summaries, tests of significance, and their sinks."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exclude(lines: DataFrame, tested: DataFrame, key: str) -> DataFrame:
    """Lines that aren't tested."""
    return lines.join(tested.select(key).distinct(), key, "left_anti")


def look_up(cases: DataFrame, lines: DataFrame, key: str, longest: str) -> DataFrame:
    """Each case with its line; a case without one gets the longest line (one row)."""
    fallback = lines.orderBy(F.desc(longest), key).limit(1).select(F.struct("*").alias("_longest"))
    names = [c for c in lines.columns if c != key]
    joined = cases.join(lines.withColumn("_hit", F.lit(1)), key, "left").crossJoin(F.broadcast(fallback))
    return joined.select(*cases.columns, *(F.when(F.col("_hit") == 1, F.col(c)).otherwise(F.col(f"_longest.{c}")).alias(c) for c in names), F.col("_hit").isNull().alias("fell_back"))


def _long(records: DataFrame, metrics: list[str]) -> DataFrame:
    return records.select(F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics)))).filter("v is not null and not isnan(v)")


def percentiles(records: DataFrame, metrics: list[str], shares: list[float], accuracy: int = 50_000) -> DataFrame:
    """metric, share, value: exact percentiles, interpolated between neighbours; nulls and NaN don't count.

    A sketch brackets each percentile by a few ranks in accuracy; the values below the bracket are counted, those within
    are grouped, and the rank is picked among them. No task holds all values of a metric, as an exact aggregate would.
    """
    long = _long(records, metrics)
    width = 4 / accuracy
    ends = [F.lit(min(1.0, max(0.0, s + d))) for s in shares for d in (-width, width)]
    sketch = long.groupBy("metric").agg(F.percentile_approx("v", F.array(*ends), F.lit(accuracy)).alias("q"), F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
    rows = F.array(*(F.struct(F.lit(s).alias("share"), (F.lit(s) * (F.col("n") - 1)).alias("rank"), (F.col("q")[2 * k] if s > width else F.col("least")).alias("low"), (F.col("q")[2 * k + 1] if s < 1 - width else F.col("most")).alias("high")) for k, s in enumerate(shares)))
    brackets = sketch.select("metric", F.inline(rows))
    key = ["metric", "share"]
    met = long.join(F.broadcast(brackets), "metric")  # a row for each metric and share
    below = met.groupBy(*key).agg(F.count_if(F.col("v") < F.col("low")).alias("below"), F.min(F.when(F.col("v") > F.col("high"), F.col("v"))).alias("next"))
    inside = met.filter("v >= low and v <= high").groupBy(*key, "rank", "v").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*key).orderBy("v"))
    placed = inside.join(F.broadcast(below), key).withColumn("last", F.col("below") + upto - 1).withColumn("first", F.col("last") - F.col("c") + 1)
    at = lambda r: F.max(F.when((F.col("first") <= r) & (F.col("last") >= r), F.col("v")))
    picked = placed.groupBy(*key, "rank", "next").agg(at(F.floor("rank")).alias("lower"), at(F.ceil("rank")).alias("upper")).withColumn("upper", F.coalesce("upper", "next"))
    return picked.select(*key, (F.col("lower") + (F.col("upper") - F.col("lower")) * (F.col("rank") - F.floor("rank"))).alias("value"))


def summary(records: DataFrame, metrics: list[str]) -> DataFrame:
    """metric, n, least, mean, median, most."""
    out = _long(records, metrics).groupBy("metric").agg(F.count("v").alias("n"), F.min("v").alias("least"), F.avg("v").alias("mean"), F.max("v").alias("most"))
    median = percentiles(records, metrics, [0.5]).select("metric", F.col("value").alias("median"))
    return out.join(median, "metric", "left").select("metric", "n", "least", "mean", "median", "most")


def best_of(records: DataFrame, keys: list[str], value: str) -> DataFrame:
    """For each key the row with the least value; of ties the least row."""
    rest = [c for c in records.columns if c not in keys]
    return records.groupBy(*keys).agg(F.min(F.struct(F.col(value).alias("_v"), *rest)).alias("_m")).select(*keys, *(F.col(f"_m.{c}").alias(c) for c in rest))


def by_algorithm(records: DataFrame, case: str, algorithm: str, metric: str) -> DataFrame:
    """Mean, population deviation and count for each case and algorithm, for each case, and over all."""
    return records.rollup(case, algorithm).agg(F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"), F.count(metric).alias("n_valid"))


def paired_t(pairs: DataFrame, a: str, b: str, keys: list[str], least: int = 5) -> DataFrame:
    """keys, n, t, p, significance of the differences a - b where both are there; null with fewer than least pairs."""
    d = F.col(a) - F.col(b)
    out = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(d).alias("_m"), F.stddev_samp(d).alias("_s"))
    t = F.when((F.col("n") >= least) & (F.col("_s") > 0), F.col("_m") / (F.col("_s") / F.sqrt("n")))
    out = out.withColumn("t", t).drop("_m", "_s")
    return out.withColumn("p", _p_value("t", "n")).withColumn("significance", stars(F.col("p")))


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").when(p.isNotNull(), "n.s.")


def two_sided_p(t: float, n: int) -> float:
    """Student's t with n - 1 degrees of freedom, by the continued fraction of the incomplete beta function."""
    df = n - 1
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    swap = x > (a + 1) / (a + b + 2)
    if swap:
        a, b, x = b, a, 1 - x
    c, d, f = 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1)), 0.0
    f = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + top * d), 1 + top / c
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    value = front * f / a
    return 1 - value if swap else value


@F.pandas_udf(T.DoubleType())
def _p_value(t: pd.Series, n: pd.Series) -> pd.Series:
    # one value for each group of the report
    return pd.Series([None if x is None or x != x else two_sided_p(x, int(k)) for x, k in zip(t, n, strict=True)], dtype="float64")


def comparison_features(actual: DataFrame, predicted: DataFrame) -> DataFrame:
    """name, type (actual or predicted) and geometry as GeoJSON, one row for each path of the two sets of points."""

    def lines(points: DataFrame, kind: str) -> DataFrame:
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "lon", "lat"))), lambda x: F.array(x["lon"], x["lat"]))
        return points.groupBy("path_id").agg(ordered.alias("coordinates")).select(F.col("path_id").cast("string").alias("name"), F.lit(kind).alias("type"), F.to_json(F.struct(F.lit("LineString").alias("type"), "coordinates")).alias("geometry"))

    return lines(actual, "actual").unionByName(lines(predicted, "predicted"))


def write_geojson(features: DataFrame, path: str) -> None:
    """One Feature a line (GeoJSON text sequence without the separators)."""
    features.select(F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(F.struct(*(c for c in features.columns if c != "geometry"))), F.lit(',"geometry":'), F.col("geometry"), F.lit("}")).alias("value")).write.mode("overwrite").text(path)


def nested_checks(checked: DataFrame) -> DataFrame:
    """path_id, report: the checks of a route as one JSON map by name."""
    body = F.map_from_entries(F.array_sort(F.collect_list(F.struct("check_id", F.struct("passed", "value", "threshold")))))
    return checked.groupBy("path_id").agg(F.to_json(body).alias("report"))


def slug(name: Column) -> Column:
    known = F.create_map(F.lit("A*"), F.lit("astar"), F.lit("IPSO-SA"), F.lit("ipso-sa"), F.lit("DBO"), F.lit("dbo"))
    return F.coalesce(known[name], F.replace(F.lower(name), F.lit(" "), F.lit("-")))


def convergence_report(curves: DataFrame) -> DataFrame:
    """path_id, algorithm, seed, iterations, best_fitness, curve of (path_id, algorithm, seed, iteration, fitness)."""
    curve = F.transform(F.array_sort(F.collect_list(F.struct("iteration", "fitness"))), lambda x: x["fitness"])
    return curves.groupBy("path_id", "algorithm", "seed").agg(F.count("*").alias("iterations"), F.min("fitness").alias("best_fitness"), curve.alias("curve"))


def without_columns(records: DataFrame, *names: str) -> DataFrame:
    """Records as a report saves them: without the coordinates, say. A name that isn't there is ignored."""
    return records.drop(*names)


def validation_summary(records: DataFrame, metrics: list[str], passed: str = "quality_passed") -> DataFrame:
    """One row of records: n, n_passed, and the mean and the median of each metric."""
    head = records.agg(F.count("*").alias("n"), F.count_if(passed).alias("n_passed"), *(F.avg(m).alias(f"{m}_mean") for m in metrics))
    medians = percentiles(records, metrics, [0.5]).groupBy().pivot("metric", metrics).agg(F.first("value"))
    return head.crossJoin(F.broadcast(medians.select(*(F.col(m).alias(f"{m}_median") for m in metrics))))  # one row each


def case_comparison(records: DataFrame, case: str, algorithm: str, values: list[str]) -> DataFrame:
    """case, comparison: the values of each algorithm as a JSON map by its slug."""
    body = F.map_from_entries(F.array_sort(F.collect_list(F.struct(slug(F.col(algorithm)).alias("a"), F.struct(*values).alias("v")))))
    return records.groupBy(case).agg(F.to_json(body).alias("comparison"))


def write_json(records: DataFrame, path: str) -> None:
    """A JSON object a line: statistics, quality, convergence, summaries and comparisons alike."""
    records.write.mode("overwrite").json(path)
