"""Vector layers on grids: tags to classes, lines to cells, masks, and bounded distance fields."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.config import LAND_USE
from gridloom.grid import Grid
from gridloom.operators.focal import gaussian


def classify(*texts: Column) -> Column:
    """The code of the first word, in the list's order, that any of the texts contains; else 8."""
    lower = [F.lower(F.coalesce(x, F.lit(""))) for x in texts]
    out = None
    for word, code in LAND_USE:
        hit = lower[0].contains(word)
        for x in lower[1:]:
            hit = hit | x.contains(word)
        out = F.when(hit, code) if out is None else out.when(hit, code)
    return out.otherwise(8)


def touched(grid: Grid, segments: DataFrame, *keep: str) -> DataFrame:
    """row, col and the columns of keep for each cell that each of segments (lon0, lat0, lon1, lat1) touches: a cell counts if the segment meets its closed box. Cells come from the segment's rows; in each row, from the columns it spans there."""
    x0, x1 = (F.col("lon0") - grid.west) / grid.step, (F.col("lon1") - grid.west) / grid.step
    y0, y1 = (grid.north - F.col("lat0")) / grid.step, (grid.north - F.col("lat1")) / grid.step
    df = segments.select(x0.alias("_x0"), y0.alias("_y0"), x1.alias("_x1"), y1.alias("_y1"), *keep)
    low, high = F.greatest(F.floor(F.least("_y0", "_y1")), F.lit(0)), F.least(F.floor(F.greatest("_y0", "_y1")), F.lit(grid.height - 1))
    df = df.filter(low <= high).withColumn("row", F.explode(F.sequence(low.cast("int"), high.cast("int"))))
    # where the segment enters and leaves the row's strip
    flat = F.col("_y0") == F.col("_y1")
    at = lambda y: F.least(F.greatest((y - F.col("_y0")) / F.when(~flat, F.col("_y1") - F.col("_y0")), F.lit(0.0)), F.lit(1.0))
    t0, t1 = F.when(flat, 0.0).otherwise(at(F.col("row"))), F.when(flat, 1.0).otherwise(at(F.col("row") + 1))
    xa, xb = F.col("_x0") + t0 * (F.col("_x1") - F.col("_x0")), F.col("_x0") + t1 * (F.col("_x1") - F.col("_x0"))
    left, right = F.greatest(F.floor(F.least(xa, xb)), F.lit(0)), F.least(F.floor(F.greatest(xa, xb)), F.lit(grid.width - 1))
    df = df.withColumn("_left", left.cast("int")).withColumn("_right", right.cast("int")).filter("_left <= _right")
    return df.select("row", F.explode(F.sequence("_left", "_right")).alias("col"), *keep)


def rasterize_lines(grid: Grid, segments: DataFrame) -> DataFrame:
    """Distinct (row, col) that segments (lon0, lat0, lon1, lat1) touch."""
    return touched(grid, segments).distinct()


def rasterize_max(cells: DataFrame, grid: Grid, code: str = "code", default: int = 8) -> DataFrame:
    """row, col, code for every cell of the grid: the highest code burned there, else the default."""
    return grid.df.select("row", "col").join(cells.groupBy("row", "col").agg(F.max(code).alias(code)), ["row", "col"], "left").withColumn(code, F.coalesce(code, F.lit(default)))


def dilate(cells: DataFrame, grid: Grid, k: int) -> DataFrame:
    """Distinct cells within k steps along rows and columns of (row, col)."""
    near = F.explode(F.flatten(F.array(*(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for j in range(-k + abs(i), k - abs(i) + 1))) for i in range(-k, k + 1)))))
    out = cells.select("row", "col", near.alias("d")).select((F.col("row") + F.col("d.i")).alias("row"), (F.col("col") + F.col("d.j")).alias("col"))
    return out.filter(F.col("row").between(0, grid.height - 1) & F.col("col").between(0, grid.width - 1)).distinct()


def lower_envelope(own: np.ndarray) -> np.ndarray:
    """The least own[p] + (x - p)^2 over all p, for each x, in whole numbers. The leftmost p that gives it never falls as x grows, so places are settled by halving: one between two settled ones looks only between their p, and each of the log n passes looks at some 2 n candidates in all."""
    n = len(own)
    spots = np.arange(n)
    found = own + spots * spots
    at, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
    at[0], best[0] = found.argmin(), found.min()
    step = 1 << max(0, n - 1).bit_length() - 1 if n > 1 else 0
    while step:
        x = spots[step :: 2 * step]
        low, high = at[x - step], np.where(x + step < n, at[np.minimum(x + step, n - 1)], n - 1)
        count = high - low + 1
        starts = np.cumsum(count) - count
        p = np.arange(count.sum()) - np.repeat(starts - low, count)
        # of equal values the leftmost
        least = np.minimum.reduceat((own[p] + (np.repeat(x, count) - p) ** 2) * n + p, starts)
        at[x], best[x] = least % n, least // n
        step //= 2
    return best


#: How many cells the rows have together that one group of distance_field() holds.
BLOCK = 1 << 16


def distance_field(grid: Grid, burned: DataFrame, limit: float = 5000.0) -> DataFrame:
    """row, col, dist of every cell: metres to the nearest burned cell (row, col), limit at most. Two passes: windows find each column's nearest burned row above and below; then blocks of rows, each in one task, take the lower envelope of each row's parabolas, whatever the limit. No row is multiplied, and each axis is exchanged once."""
    reach, cell = int(limit / grid.cell), grid.cell
    cells = grid.df.select("row", "col").join(burned.select("row", "col", F.lit(1).alias("hit")).distinct(), ["row", "col"], "left")
    at = F.when(F.col("hit") == 1, F.col("row"))
    # both run on from row to row; a frame up to the end would be gone through again for each row
    up = Window.partitionBy("col").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("col").orderBy(F.desc("row")).rowsBetween(Window.unboundedPreceding, 0)
    column = cells.select("row", "col", F.least(F.col("row") - F.last(at, ignorenulls=True).over(up), F.last(at, ignorenulls=True).over(down) - F.col("row")).alias("dy"))

    def nearest(block: pa.Table) -> pa.Table:
        block = block.sort_by("row")
        row, col = block["row"].to_numpy(), block["col"].to_numpy()
        dy = np.minimum(block["dy"].fill_null(reach + 1).to_numpy().astype(np.int64), reach + 1)
        dist, ends = np.empty(len(row)), [*np.flatnonzero(np.diff(row)) + 1, len(row)]
        for a, b in zip([0, *ends], ends, strict=False):
            own = np.full(int(col[a:b].max()) + 1, (reach + 1) ** 2)
            own[col[a:b]] = dy[a:b] ** 2
            dist[a:b] = np.minimum(float(limit), np.sqrt(lower_envelope(own)[col[a:b]]) * cell)
        return pa.table({"row": block["row"], "col": block["col"], "dist": dist})

    rows = max(1, BLOCK // max(1, grid.width))
    return column.groupBy(F.floor(F.col("row") / rows)).applyInArrow(nearest, "row int, col int, dist double")


def rasterize_polygons(grid: Grid, rings: DataFrame) -> DataFrame:
    """Distinct (row, col) that polygons touch, of rings (ring_id, points array<struct<lon, lat>>), closed: cells whose centre is inside by the even-odd rule, and cells that the outline touches."""
    step = F.transform(F.sequence(F.lit(0), F.size("points") - 2), lambda i: F.struct(F.col("points")[i].alias("a"), F.col("points")[i + 1].alias("b")))
    whole = rings.filter("size(points) > 1").select(step.alias("edges"))
    edges = whole.select(F.explode("edges").alias("e")).select(F.col("e.a.lon").alias("lon0"), F.col("e.a.lat").alias("lat0"), F.col("e.b.lon").alias("lon1"), F.col("e.b.lat").alias("lat1"))
    x = lambda p: (p["lon"] - grid.west) / grid.step
    y = lambda p: (grid.north - p["lat"]) / grid.step
    # centres of rows, row + 0.5, from an edge's upper end up to before the lower one; a ring's crossings of a row are in its own row, so nothing is exchanged but cells
    first, last = lambda e: F.ceil(F.least(y(e["a"]), y(e["b"])) - 0.5), lambda e: F.ceil(F.greatest(y(e["a"]), y(e["b"])) - 0.5) - 1
    crossed = F.filter(F.transform("edges", lambda e: F.struct(x(e["a"]).alias("x0"), y(e["a"]).alias("y0"), x(e["b"]).alias("x1"), y(e["b"]).alias("y1"), F.greatest(first(e), F.lit(0)).cast("int").alias("low"), F.least(last(e), F.lit(grid.height - 1)).cast("int").alias("high"))), lambda e: (e["y0"] != e["y1"]) & (e["low"] <= e["high"]))
    sides = whole.select(crossed.alias("sides")).filter("size(sides) > 0")
    ends = lambda f, c: f(F.transform("sides", lambda e: e[c]))
    by_row = sides.withColumn("row", F.explode(F.sequence(ends(F.array_min, "low"), ends(F.array_max, "high"))))
    at = lambda e: e["x0"] + (F.col("row") + 0.5 - e["y0"]) / (e["y1"] - e["y0"]) * (e["x1"] - e["x0"])
    xs = F.array_sort(F.transform(F.filter("sides", lambda e: F.col("row").between(e["low"], e["high"])), at))
    spans = by_row.select("row", xs.alias("xs")).filter("size(xs) > 1").select("row", "xs", F.explode(F.sequence(F.lit(0), F.size("xs") - 2, F.lit(2))).alias("k")).select("row", F.col("xs")[F.col("k")].alias("from"), F.col("xs")[F.col("k") + 1].alias("to"))
    left, right = F.greatest(F.ceil(F.col("from") - 0.5), F.lit(0)), F.least(F.ceil(F.col("to") - 0.5) - 1, F.lit(grid.width - 1))
    inside = spans.withColumn("left", left.cast("int")).withColumn("right", right.cast("int")).filter("left <= right").select("row", F.explode(F.sequence("left", "right")).alias("col"))
    return inside.unionByName(rasterize_lines(grid, edges)).distinct()


def building_density(grid: Grid, burned: DataFrame) -> DataFrame:
    """row, col, density: blurred burned cells for each square kilometre."""
    cells = grid.df.select("row", "col").join(burned.select("row", "col", F.lit(1.0).alias("hit")).distinct(), ["row", "col"], "left").withColumn("hit", F.coalesce("hit", F.lit(0.0)))
    sigma = max(2, int(500 / grid.cell))
    return gaussian(grid.with_df(cells), "hit", sigma, "density").select("row", "col", (F.col("density") / (grid.cell / 1000) ** 2).alias("density"))


def align(grid: Grid, layers: list[str], cell: float = 90.0, lines: dict[str, tuple[DataFrame, float]] | None = None, polygons: dict[str, DataFrame] | None = None, landuse: DataFrame | None = None, buildings: DataFrame | None = None) -> Grid:
    """All layers on one grid with cells of another size. layers: those of grid, resampled in one join. lines: segments, by the name of the field of distances to them, and its limit in metres. polygons: rings (ring_id, points), by the name of a layer that is 1 where they touch. landuse: rings with a code, of which the highest counts. buildings: rings, as a density. Fields share the key (row, col), so their joins share its exchange."""
    factor = cell / grid.cell
    out = grid.coarser(factor, grid.df)
    out = out.with_df(grid.resample(layers, factor, out.height, out.width))
    df, key = out.df, ["row", "col"]
    for name, (segments, limit) in (lines or {}).items():
        df = df.join(distance_field(out, rasterize_lines(out, segments), limit).withColumnRenamed("dist", name), key, "left")
    for name, rings in (polygons or {}).items():
        df = df.join(rasterize_polygons(out, rings).withColumn(name, F.lit(1)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    if landuse is not None:
        codes = [r[0] for r in landuse.select("code").distinct().collect()]  # at most eight
        burned = [rasterize_polygons(out, landuse.filter(F.col("code") == c)).withColumn("code", F.lit(c)) for c in codes]
        cells = burned[0] if burned else df.select(*key, F.lit(8).alias("code")).limit(0)
        for x in burned[1:]:
            cells = cells.unionByName(x)
        df = df.join(rasterize_max(cells, out).withColumnRenamed("code", "landuse"), key, "left")
    if buildings is not None:
        df = df.join(building_density(out, rasterize_polygons(out, buildings)), key, "left")
    return out.with_df(df)
