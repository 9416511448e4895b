"""Tiles with halos: what lets a kernel see a cell's neighbours after a single exchange.

A cell goes to its own tile and to those whose halo it lies in. A tile's task lays its cells out as arrays, which end
where the grid ends, or so many cells beyond the tile; a kernel is a function of whole arrays that applies the grid's
boundary rule at the arrays' ends. Where the grid ends that is right; elsewhere it spoils as many cells of the halo as
the kernel reaches, and the halo is left out of the result. A tile and its halo must fit a task; neither grows with the grid.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.grid import Grid

SIZE = 256
Arrays = dict[str, np.ndarray]


def dealt(grid: Grid, reach: int, size: int = SIZE) -> DataFrame:
    """The grid's cells with tile_row, tile_col of each tile of size x size cells that holds them, or has them within reach."""
    near = lambda axis, n: F.explode(F.sequence(F.greatest(F.floor((F.col(axis) - reach) / size), F.lit(0)), F.least(F.floor((F.col(axis) + reach) / size), F.lit((n - 1) // size))))
    return grid.df.select("*", near("row", grid.height).alias("tile_row")).select("*", near("col", grid.width).alias("tile_col"))


def extent(tile: int, n: int, reach: int, size: int) -> tuple[int, int]:
    """The first row (or column) of a tile with its halo, and the one after its last."""
    return max(0, tile * size - reach), min(n, (tile + 1) * size + reach)


def laid_out(cells: pa.Table, layers: list[str], rows: tuple[int, int], cols: tuple[int, int]) -> Arrays:
    """The layers as arrays of these rows and columns; NaN where a cell is null or missing."""
    r, c = cells["row"].to_numpy() - rows[0], cells["col"].to_numpy() - cols[0]
    out = {}
    for layer in layers:
        out[layer] = np.full((rows[1] - rows[0], cols[1] - cols[0]), np.nan)
        out[layer][r, c] = pc.cast(cells[layer], pa.float64()).to_numpy()
    return out


def apply(grid: Grid, layers: list[str], outs: list[str], reach: int, kernel: Callable[[Arrays], Arrays], size: int = SIZE) -> DataFrame:
    """grid.df with the columns outs (NaN: null) that kernel makes of the layers' arrays; a value of it may depend on cells within reach."""
    kept = [f for f in grid.df.schema if f.name not in outs]
    schema = T.StructType([*kept, *(T.StructField(x, T.DoubleType()) for x in outs)])
    height, width = grid.height, grid.width

    def run(key: tuple[pa.Scalar, ...], cells: pa.Table) -> pa.Table:
        tr, tc = (k.as_py() for k in key)
        rows, cols = extent(tr, height, reach, size), extent(tc, width, reach, size)
        with np.errstate(invalid="ignore", divide="ignore"):
            found = kernel(laid_out(cells, layers, rows, cols))
        r, c = cells["row"].to_numpy(), cells["col"].to_numpy()
        own = (r // size == tr) & (c // size == tc)
        mine = cells.filter(pa.array(own))
        at = r[own] - rows[0], c[own] - cols[0]
        return pa.table([*(mine[f.name] for f in kept), *(pa.array(found[x][at], from_pandas=True) for x in outs)], names=schema.names)

    return dealt(grid, reach, size).groupBy("tile_row", "tile_col").applyInArrow(run, schema)
