"""Connected components by alternating large and small stars: joins and aggregates over the edges, a logarithmic number of rounds.

A node with very many edges is aggregated before the exchange, and AQE splits its edges in the join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    out = both.join(least, "a")
    out = out.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else out.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); the component is its smallest node. Nodes without edges have no row."""
    edges = written(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    state = None
    for _ in range(200):  # far more than the logarithmic number of rounds takes
        edges = written(_stars(_stars(edges, True), False), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        state = tuple(now)
    raise RuntimeError("components did not settle")
