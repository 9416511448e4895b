"""Focal operators: kernels over tiles with halos of a dense grid.

However many filters and gradients follow each other, the grid is exchanged once: a chain's halo is as wide as its
kernels reach together. Nulls are NaN within kernels; a gradient takes the cells there are, as at an edge, a mean
leaves nulls out, and a blur is null where it meets one.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.grid import Grid
from gridloom.operators import tiles
from gridloom.operators.tiles import Arrays

_AXIS = {"row": 0, "col": 1}
_EDGE = {"reflect": "symmetric", "nearest": "edge"}


# --- kernels: functions of whole arrays -------------------------------------------------------------------------------


def difference(z: np.ndarray, axis: str, cell: float) -> np.ndarray:
    """Central differences, one-sided at the edges."""
    k = _AXIS[axis]
    gone = np.full_like(np.take(z, [0], k), np.nan)
    before = np.concatenate([gone, np.take(z, range(z.shape[k] - 1), k)], k)
    after = np.concatenate([np.take(z, range(1, z.shape[k]), k), gone], k)
    n = (~np.isnan(before)).astype(int) + ~np.isnan(after)
    return (np.where(np.isnan(after), z, after) - np.where(np.isnan(before), z, before)) / (cell * n)


def _windows(z: np.ndarray, k: int, axis: int, mode: str) -> np.ndarray:
    pad = [(0, 0), (0, 0)]
    pad[axis] = (k, k)
    return np.lib.stride_tricks.sliding_window_view(np.pad(z, pad, mode=_EDGE[mode]), 2 * k + 1, axis)


def mean(z: np.ndarray, size: int, mode: str = "reflect") -> np.ndarray:
    """Over size x size cells: along columns, then along rows."""
    for axis in (1, 0):
        w = _windows(z, size // 2, axis, mode)
        z = np.nansum(w, -1) / (~np.isnan(w)).sum(-1)
    return z


def kernel(sigma: float) -> list[float]:
    r = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def blur(z: np.ndarray, sigma: float, mode: str = "reflect") -> np.ndarray:
    if not sigma:
        return z
    w = np.array(kernel(sigma))
    for axis in (1, 0):
        z = _windows(z, len(w) // 2, axis, mode) @ w
    return z


def steepness(dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
    return np.degrees(np.arctan(np.sqrt(dx * dx + dy * dy)))


def ruggedness(z: np.ndarray) -> np.ndarray:
    return np.abs(z - (9 * mean(z, 3) - z) / 8)


def curvatures(z: np.ndarray, cell: float) -> Arrays:
    dx, dy = difference(z, "col", cell), difference(z, "row", cell)
    dxx, dxy, dyy = difference(dx, "col", cell), difference(dx, "row", cell), difference(dy, "row", cell)
    p = np.maximum(dx * dx + dy * dy, 1e-6) ** 1.5
    p[np.isnan(dx + dy)] = np.nan
    return {"dx": dx, "dy": dy, "curvature_profile": -(dxx * dx * dx + 2 * dxy * dx * dy + dyy * dy * dy) / p, "curvature_plan": -(dxx * dy * dy - 2 * dxy * dx * dy + dyy * dx * dx) / p}


def deviation(z: np.ndarray, size: int) -> np.ndarray:
    m = mean(z, size)
    return np.sqrt(np.maximum(0.0, mean(z * z, size) - m * m))


# --- operators on grids -----------------------------------------------------------------------------------------------


def fill_mean(grid: Grid, layer: str = "z") -> Grid:
    """Nulls and NaN become the layer's mean."""
    clean = F.nanvl(F.col(layer), F.lit(None).cast("double"))
    mean = grid.df.agg(F.avg(clean).alias("mean"))
    # one row
    return grid.with_df(grid.df.crossJoin(F.broadcast(mean)).withColumn(layer, F.coalesce(clean, "mean")).drop("mean"))


def gradients(grid: Grid, layer: str = "z") -> DataFrame:
    """Adds dx (eastward) and dy (southward)."""
    cell = grid.cell
    return tiles.apply(grid, [layer], ["dx", "dy"], 1, lambda a: {"dx": difference(a[layer], "col", cell), "dy": difference(a[layer], "row", cell)})


def slope_of(dx: Column, dy: Column) -> Column:
    return F.degrees(F.atan(F.sqrt(dx * dx + dy * dy)))


def slope(grid: Grid) -> DataFrame:
    return gradients(grid).withColumn("slope", slope_of(F.col("dx"), F.col("dy")))


def aspect(grid: Grid) -> DataFrame:
    angle = F.atan2(-F.col("dy"), F.col("dx"))
    return gradients(grid).withColumn("aspect_cos", F.cos(angle)).withColumn("aspect_sin", F.sin(angle))


def boxes(grid: Grid, means: list[tuple[str, int, str]], mode: str = "reflect") -> DataFrame:
    """Adds means (layer, size, out) over size x size cells."""
    reach = max((size // 2 for _, size, _ in means), default=0)
    return tiles.apply(grid, sorted({x for x, _, _ in means}), [out for *_, out in means], reach, lambda a: {out: mean(a[layer], size, mode) for layer, size, out in means})


def box(grid: Grid, layer: str, size: int, out: str, mode: str = "reflect") -> DataFrame:
    """Mean over size x size cells."""
    return boxes(grid, [(layer, size, out)], mode)


def gaussians(grid: Grid, layers: dict[str, str], sigma: float, mode: str = "reflect") -> DataFrame:
    """Adds each layer blurred, by name of the result."""
    return tiles.apply(grid, sorted(set(layers.values())), list(layers), int(4 * sigma + 0.5), lambda a: {out: blur(a[layer], sigma, mode) for out, layer in layers.items()})


def gaussian(grid: Grid, layer: str, sigma: float, out: str, mode: str = "reflect") -> DataFrame:
    return gaussians(grid, {out: layer}, sigma, mode)


def masked_gaussian(grid: Grid, layer: str, mask: str, sigma: float, out: str, mode: str = "nearest") -> DataFrame:
    """G(mask * x) / max(G(mask), 1e-6) where mask is 1, else null."""

    def run(a: Arrays) -> Arrays:
        x = np.where(a[mask] == 1, a[layer], np.where(np.isnan(a[mask]), np.nan, 0.0))
        return {out: np.where(a[mask] == 1, blur(x, sigma, mode) / np.maximum(blur(a[mask], sigma, mode), 1e-6), np.nan)}

    return tiles.apply(grid, [layer, mask], [out], int(4 * sigma + 0.5), run)


def tri(grid: Grid) -> DataFrame:
    return tiles.apply(grid, ["z"], ["tri"], 1, lambda a: {"tri": ruggedness(a["z"])})


def _tpi_size(grid: Grid, radius_m: float) -> int:
    size = max(3, int(radius_m / grid.cell))
    return size + (size + 1) % 2


def tpi(grid: Grid, radius_m: float = 300.0) -> DataFrame:
    size = _tpi_size(grid, radius_m)
    return tiles.apply(grid, ["z"], ["tpi"], size // 2, lambda a: {"tpi": a["z"] - mean(a["z"], size)})


def roughness(grid: Grid, size: int = 9) -> DataFrame:
    """Population deviation over size x size cells."""
    return tiles.apply(grid, ["z"], ["roughness"], size // 2, lambda a: {"roughness": deviation(a["z"], size)})


def curvature(grid: Grid) -> DataFrame:
    cell = grid.cell
    return tiles.apply(grid, ["z"], ["dx", "dy", "curvature_profile", "curvature_plan"], 2, lambda a: curvatures(a["z"], cell))


def hillshade(grid: Grid, azimuth: float = 315.0, altitude: float = 45.0, stride: int = 1) -> DataFrame:
    """On every stride-th row and column, taken as a grid of its own."""
    df = grid.df.filter((F.col("row") % stride == 0) & (F.col("col") % stride == 0)).withColumn("row", (F.col("row") / stride).cast("int")).withColumn("col", (F.col("col") / stride).cast("int"))
    df = gradients(Grid(df, -(-grid.height // stride), -(-grid.width // stride), grid.cell * stride))
    steep, facing = F.atan(F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2)), F.atan2(-F.col("dy"), F.col("dx"))
    sun, high = math.radians(360 - azimuth + 90), math.radians(altitude)
    shade = math.sin(high) * F.cos(steep) + math.cos(high) * F.sin(steep) * F.cos(sun - facing)
    return df.withColumn("shade", F.greatest(F.lit(0.0), F.least(F.lit(1.0), shade)))


def terrain(grid: Grid, radius_m: float = 300.0, size: int = 9) -> DataFrame:
    """All eight terrain factors on one frame, nulls of z filled, in one exchange."""
    cell, wide = grid.cell, _tpi_size(grid, radius_m)

    def run(a: Arrays) -> Arrays:
        z, c = a["z"], curvatures(a["z"], cell)
        angle = np.arctan2(-c["dy"], c["dx"])
        return c | {"slope": steepness(c["dx"], c["dy"]), "aspect_cos": np.cos(angle), "aspect_sin": np.sin(angle), "tri": ruggedness(z), "tpi": z - mean(z, wide), "roughness": deviation(z, size)}

    return tiles.apply(fill_mean(grid), ["z"], ["slope", "aspect_cos", "aspect_sin", "tri", "tpi", "curvature_profile", "curvature_plan", "roughness"], max(2, wide // 2, size // 2), run)
