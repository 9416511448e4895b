"""Rasters as DataFrames keyed by (row, col), and the map between cells and coordinates."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.crs import System, system


@dataclass(frozen=True)
class Grid:
    """A dense raster: df has row, col and a column for each layer; cell is the side of a cell in metres."""

    df: DataFrame
    height: int
    width: int
    cell: float = 30.0
    west: float = 120.0
    north: float = 25.4
    step: float = 0.001

    def with_df(self, df: DataFrame) -> Grid:
        return replace(self, df=df)

    @classmethod
    def from_embeddings(cls, embeddings: DataFrame, cell: float = 30.0) -> Grid:
        """Row vec_id, column by place in the vector, elevation z = 1000 times the value."""
        height, width = embeddings.agg(F.max("vec_id") + 1, F.max(F.size("embedding"))).first()
        cells = embeddings.select(F.col("vec_id").cast("int").alias("row"), F.posexplode("embedding").alias("col", "v"))
        return cls(cells.select("row", "col", (F.col("v").cast("double") * 1000).alias("z")), int(height or 0), int(width or 0), cell)

    def row_of(self, lat: Column) -> Column:
        """Truncates toward zero, so that up to one cell beyond the upper edge is row 0."""
        return ((lat - self.north) / -self.step).cast("int")

    def col_of(self, lon: Column) -> Column:
        return ((lon - self.west) / self.step).cast("int")

    def lon_of(self, col: Column) -> Column:
        return self.west + col * self.step + self.step / 2

    def lat_of(self, row: Column) -> Column:
        return self.north - row * self.step - self.step / 2

    def sample_nearest(self, points: DataFrame) -> DataFrame:
        """points (lon, lat, ...) with the layers of their cell; points off the grid go."""
        at = points.withColumn("row", self.row_of(F.col("lat"))).withColumn("col", self.col_of(F.col("lon")))
        return at.join(self.df, ["row", "col"])

    def sample_bilinear(self, points: DataFrame, layer: str) -> DataFrame:
        """points (..., fr, fc: fractional row and column) with the layer interpolated from the four cells around; null off the grid. Equal points each have a row. Each place is sampled once: places meet the cells, points meet places."""
        places = points.select("fr", "fc").filter("fr is not null and fc is not null").distinct()
        corners = places.withColumn("corner", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)))))
        corners = corners.withColumn("row", (F.floor("fr") + F.col("corner.i")).cast("int")).withColumn("col", (F.floor("fc") + F.col("corner.j")).cast("int"))
        weight = (1 - F.abs(F.col("fr") - F.col("row"))) * (1 - F.abs(F.col("fc") - F.col("col")))
        joined = corners.withColumn("weight", weight).filter("weight > 0").join(self.df.select("row", "col", F.col(layer).alias("_value")), ["row", "col"], "left")
        sampled = joined.groupBy("fr", "fc").agg(F.when(F.count_if(F.col("_value").isNull()) == 0, F.sum(F.col("weight") * F.col("_value"))).alias("_sampled"))
        return points.drop(layer).join(sampled, ["fr", "fc"], "left").select(*(F.col(c) for c in points.columns if c != layer), F.col("_sampled").alias(layer))

    def resample(self, layers: str | list[str], factor: float, height: int, width: int, nearest: bool = False) -> DataFrame:
        """row, col and the layers of a grid with cells factor times as large: bilinear at the new cells' centres (at the edge, and beside nulls, by the cells there are), or nearest. One join, however many layers."""
        cells = self.df.sparkSession.range(height * width).select((F.col("id") / width).cast("int").alias("row"), (F.col("id") % width).cast("int").alias("col"))
        at = cells.withColumn("fr", (F.col("row") + 0.5) * factor - 0.5).withColumn("fc", (F.col("col") + 0.5) * factor - 0.5)
        return self._interpolated(at, [layers] if isinstance(layers, str) else layers, nearest)

    def _interpolated(self, at: DataFrame, layers: list[str], nearest: bool) -> DataFrame:
        """row, col and the layers at the fractional rows and columns of at (row, col, fr, fc); no row where there is no cell."""
        source = self.df.select(F.col("row").alias("r"), F.col("col").alias("c"), *(F.col(x).alias(f"_{x}") for x in layers))
        if nearest:
            return at.withColumn("r", F.floor(F.col("fr") + 0.5).cast("int")).withColumn("c", F.floor(F.col("fc") + 0.5).cast("int")).join(source, ["r", "c"], "left").select("row", "col", *(F.col(f"_{x}").alias(x) for x in layers))
        corners = at.withColumn("corner", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)))))
        corners = corners.withColumn("r", (F.floor("fr") + F.col("corner.i")).cast("int")).withColumn("c", (F.floor("fc") + F.col("corner.j")).cast("int"))
        weight = (1 - F.abs(F.col("fr") - F.col("r"))) * (1 - F.abs(F.col("fc") - F.col("c")))
        joined = corners.withColumn("weight", weight).filter("weight > 0").join(source, ["r", "c"])
        mean = lambda x: F.sum(F.col("weight") * F.col(f"_{x}")) / F.sum(F.when(F.col(f"_{x}").isNotNull(), F.col("weight")))
        return joined.groupBy("row", "col").agg(*(mean(x).alias(x) for x in layers))

    def reproject(self, layers: str | list[str], source: str | System, target: Grid, to: str | System = "EPSG:4326", nearest: bool = False) -> Grid:
        """target with the layers of this grid, which is in another reference system: each of its cells' centres goes to degrees, and from there to a place in this grid, where the layers are interpolated from the cells around, or the nearest is taken. Cells beyond this grid are null. west, north and step of both are in the units of their systems."""
        layers = [layers] if isinstance(layers, str) else layers
        here, there = system(source), system(to)
        cells = self.df.sparkSession.range(target.height * target.width).select((F.col("id") / target.width).cast("int").alias("row"), (F.col("id") % target.width).cast("int").alias("col"))
        x, y = here.forward(*there.inverse(target.lon_of(F.col("col")), target.lat_of(F.col("row"))))
        at = cells.withColumn("fr", (self.north - y) / self.step - 0.5).withColumn("fc", (x - self.west) / self.step - 0.5)
        near = at.filter((F.col("fr") >= -0.5) & (F.col("fr") < self.height - 0.5) & (F.col("fc") >= -0.5) & (F.col("fc") < self.width - 0.5))
        found = self._interpolated(near, layers, nearest)
        return target.with_df(cells.join(found, ["row", "col"], "left").select("row", "col", *layers))

    def coarser(self, factor: float, df: DataFrame) -> Grid:
        """A grid with cells factor times as large, of df."""
        return Grid(df, max(1, round(self.height / factor)), max(1, round(self.width / factor)), self.cell * factor, self.west, self.north, self.step * factor)

    def to_standard(self, layer: str = "z", cell: float = 90.0) -> Grid:
        """An elevation grid with cells of another size, in the same reference system; itself if they have it."""
        if cell == self.cell:
            return self
        out = self.coarser(cell / self.cell, self.df)
        return out.with_df(self.resample(layer, cell / self.cell, out.height, out.width))
