"""Risk layers from terrain. Gradients, what they weigh, and the blur of it are one kernel each, so one exchange."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.grid import Grid
from gridloom.operators import focal, tiles
from gridloom.operators.tiles import Arrays


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def typhoon(grid: Grid, sigma: float = 2.0) -> DataFrame:
    """Adds slope and typhoon."""
    cell = grid.cell

    def run(a: Arrays) -> Arrays:
        z, dx, dy = a["z"], focal.difference(a["z"], "col", cell), focal.difference(a["z"], "row", cell)
        slope, facing = focal.steepness(dx, dy), (np.degrees(np.arctan2(-dy, dx)) + 360.0) % 360.0
        windward = np.where((facing >= 45) & (facing < 225), 1.0, 0.3)
        risk = 0.4 * np.clip(slope / 45, 0, 1) + 0.35 * windward + 0.25 * (1 - np.clip(z / 3000, 0, 1))
        return {"slope": slope, "typhoon": focal.blur(risk, sigma)}

    return tiles.apply(grid, ["z"], ["slope", "typhoon"], 1 + int(4 * sigma + 0.5), run)


def seismic(grid: Grid) -> DataFrame:
    return focal.slope(grid).withColumn("seismic", clip(0.6 + 0.3 * clip(F.col("slope") / 40, 0, 1), 0, 1))


def landslide(grid: Grid, sigma: float = 2.0) -> DataFrame:
    """Adds slope, tri, curvature_profile and landslide."""
    cell = grid.cell

    def run(a: Arrays) -> Arrays:
        c, tri = focal.curvatures(a["z"], cell), focal.ruggedness(a["z"])
        slope = focal.steepness(c["dx"], c["dy"])
        risk = 0.45 * np.clip((slope - 15) / 30, 0, 1) + 0.30 * np.clip(tri / 200, 0, 1) + 0.25 * np.clip((c["curvature_profile"] + 0.01) / 0.02, 0, 1)
        return {"slope": slope, "tri": tri, "curvature_profile": c["curvature_profile"], "landslide": focal.blur(risk, sigma)}

    return tiles.apply(grid, ["z"], ["slope", "tri", "curvature_profile", "landslide"], 2 + int(4 * sigma + 0.5), run)
