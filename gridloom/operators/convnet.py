"""The convolutional cost surface: a small U-Net trained by gradients that Spark sums over tiles, and inference by tiles.

Training runs in rounds. Tiles are written once, packed; in a round, the tasks of the tiles whose turn it is return what their
tiles' gradients add up to, those sums are added up in a tree, and the driver takes one Adam step with a vector of the
net's size. Tasks hold a tile at a time, the driver never holds any. The loss is smooth L1 over passable cells with a
label; tiles held out by a hash of their place choose the weights that are kept. A block is two 3 x 3 convolutions with
rectifiers; halves are taken by maxima, doubling is by repetition and a convolution, beside which the wider block's
output stands. Widths double with each level.

Inference either averages overlapping windows, mirrored where the grid ends (infer), or sees so much around each tile
that the surface is that of one pass over the whole grid (surface).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.grid import Grid
from gridloom.operators import model, tiles
from gridloom.session import checkpointed

BETA = 0.1
_GRADIENT = "loss double, cells double, gradient binary"


# --- the net: helpers over one tile -----------------------------------------------------------------------------------


def _columns(x: np.ndarray) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(np.pad(x, ((0, 0), (1, 1), (1, 1))), (3, 3), (1, 2))


def _conv(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.moveaxis(np.tensordot(_columns(x), w, ([0, 3, 4], [1, 2, 3])), 2, 0)


class Net:
    """A U-Net whose weights are views of one vector."""

    def __init__(self, channels: int, width: int, depth: int, vector: np.ndarray | None = None, seed: int = 42) -> None:
        shapes, n = [], channels
        for level in range(depth + 1):
            shapes += [(width << level, n, 3, 3), (width << level, width << level, 3, 3)]
            n = width << level
        for level in range(depth - 1, -1, -1):
            shapes += [(width << level, n, 3, 3), (width << level, 2 * width << level, 3, 3), (width << level, width << level, 3, 3)]
            n = width << level
        shapes = [s for shape in shapes for s in (shape, shape[:1])] + [(1, width), (1,)]
        sizes = [int(np.prod(s)) for s in shapes]
        if vector is None:
            rng = np.random.default_rng(seed)
            vector = np.concatenate([rng.normal(0, np.sqrt(2 / np.prod(s[1:])), n) if len(s) > 1 else np.zeros(n) for s, n in zip(shapes, sizes, strict=True)])
        self.depth, self.vector = depth, vector
        self.parts = [p.reshape(s) for p, s in zip(np.split(vector, np.cumsum(sizes)[:-1]), shapes, strict=True)]

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        """The surface of x (channels x height x width, both multiples of 2**depth), and what backward() needs."""
        tape, skips, at = [], [], 0

        def block(x: np.ndarray, convs: int) -> np.ndarray:
            nonlocal at
            for _ in range(convs):
                y = np.maximum(_conv(x, self.parts[at]) + self.parts[at + 1][:, None, None], 0)
                tape.append(("conv", at, x, y))
                x, at = y, at + 2
            return x

        for level in range(self.depth + 1):
            x = block(x, 2)
            if level < self.depth:
                skips.append(x)
                c, h, w = x.shape
                quads = x.reshape(c, h // 2, 2, w // 2, 2)
                x = quads.max(axis=(2, 4))
                tape.append(("pool", quads == x[:, :, None, :, None]))
        for _ in range(self.depth):
            x = block(x.repeat(2, axis=1).repeat(2, axis=2), 1)
            x = np.concatenate([x, skips.pop()])
            tape.append(("join", len(x) // 2))
            x = block(x, 2)
        tape.append(("out", at, x))
        return np.tensordot(self.parts[at][0], x, 1) + self.parts[at + 1][0], tape

    def backward(self, tape: list, d: np.ndarray) -> np.ndarray:
        """The gradient of the weights, as one vector, given that of the surface."""
        grads = [np.zeros_like(p) for p in self.parts]
        skips: list[np.ndarray] = []
        doubled = 0
        _, at, x = tape[-1]
        grads[at][0], grads[at + 1][0] = (x * d).sum(axis=(1, 2)), d.sum()
        d = self.parts[at][0][:, None, None] * d
        for kind, *kept in tape[-2::-1]:
            if kind == "join":
                skips.append(d[kept[0] :])
                d, doubled = d[: kept[0]], 1
            elif kind == "pool":
                even = kept[0] / kept[0].sum(axis=(2, 4), keepdims=True)
                c, h, _, w, _ = even.shape
                d = (even * d[:, :, None, :, None]).reshape(c, 2 * h, 2 * w) + skips.pop()
            else:
                at, x, y = kept
                d = d * (y > 0)
                grads[at] += np.tensordot(d, _columns(x), ([1, 2], [1, 2]))
                grads[at + 1] += d.sum(axis=(1, 2))
                d = _conv(d, self.parts[at].transpose(1, 0, 2, 3)[:, :, ::-1, ::-1])
                if doubled:  # this convolution's input was doubled
                    c, h, w = d.shape
                    d, doubled = d.reshape(c, h // 2, 2, w // 2, 2).sum(axis=(2, 4)), 0
        return np.concatenate([g.ravel() for g in grads])


def smooth_l1(found: np.ndarray, label: np.ndarray, mask: np.ndarray) -> tuple[float, np.ndarray]:
    """The sum over the mask's cells, and its gradient."""
    e = np.where(mask, found - label, 0.0)
    small = np.abs(e) < BETA
    return float(np.where(small, e * e / (2 * BETA), np.abs(e) - BETA / 2).sum()), np.where(small, e / BETA, np.sign(e))


def _even(x: np.ndarray, depth: int) -> np.ndarray:
    """Mirrored at its lower and right ends to multiples of 2**depth."""
    return np.pad(x, ((0, 0), (0, -x.shape[1] % (1 << depth)), (0, -x.shape[2] % (1 << depth))), mode="reflect")


@dataclass
class Trained:
    """A net's weights, the bands it reads with their means and deviations, and the loss on held-out tiles, round by round."""

    vector: np.ndarray
    bands: list[str]
    means: np.ndarray
    deviations: np.ndarray
    width: int
    depth: int
    losses: list[float] = field(default_factory=list)

    def net(self) -> Net:
        return Net(len(self.bands), self.width, self.depth, self.vector)

    def image(self, a: tiles.Arrays) -> np.ndarray:
        """The bands, normalised; what is null is a band's mean."""
        x = np.stack([a[b] for b in self.bands])
        return np.nan_to_num((x - self.means[:, None, None]) / self.deviations[:, None, None])


# --- training ---------------------------------------------------------------------------------------------------------


def _packed(grid: Grid, centres: DataFrame, about: Trained, size: int) -> DataFrame:
    """A row for each tile around centres (row, col, held): its bands, labels and mask, mirrored bands and no mask beyond the grid."""
    height, width, k = grid.height, grid.width, size // 2

    def run(key: tuple[pa.Scalar, ...], cells: pa.Table) -> pa.Table:
        r, c = (x.as_py() for x in key[:2])
        rows, cols = (max(0, r - k), min(height, r - k + size)), (max(0, c - k), min(width, c - k + size))
        a = tiles.laid_out(cells, [*about.bands, "label", "hard_mask"], rows, cols)
        short = [(0, size - (rows[1] - rows[0])), (0, size - (cols[1] - cols[0]))]
        x = np.pad(about.image(a), [(0, 0), *short], mode="reflect").astype(np.float32)
        mask = np.pad((a["hard_mask"] == 1) & ~np.isnan(a["label"]), short)
        label = np.pad(np.nan_to_num(a["label"]), short).astype(np.float32)
        return pa.table({"held": [key[2]], "x": pa.array([x.tobytes()], pa.binary()), "label": pa.array([label.tobytes()], pa.binary()), "mask": pa.array([mask.tobytes()], pa.binary())})

    cells = model.tile_cells(grid.with_df(grid.df.select("row", "col", *about.bands, "label", "hard_mask")), centres, size)
    return cells.groupBy("tile_row", "tile_col", "held").applyInArrow(run, "held boolean, x binary, label binary, mask binary")


def _summed(rows: DataFrame, about: Trained, size: int, learn: bool, fan: int = 8) -> tuple[float, float, np.ndarray]:
    """Loss, cells and gradient over tiles: added up within each task, then by groups of tasks, then on the driver, which gets fan vectors at most."""
    net = about.net()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, cells, gradient = 0.0, 0.0, np.zeros(len(net.vector) if learn else 0)
        for batch in batches:
            for x, label, mask in zip(*(batch.column(c) for c in ("x", "label", "mask")), strict=True):
                image = np.frombuffer(x.as_py(), np.float32).reshape(len(about.bands), size, size).astype(float)
                m = np.frombuffer(mask.as_py(), bool).reshape(size, size)
                found, tape = net.forward(image)
                one, d = smooth_l1(found, np.frombuffer(label.as_py(), np.float32).reshape(size, size), m)
                loss, cells = loss + one, cells + m.sum()
                if learn:
                    gradient += net.backward(tape, d)
        yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([float(cells)]), pa.array([gradient.tobytes()], pa.binary())], ["loss", "cells", "gradient"])

    def add(parts: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(g.as_py()) for g in parts["gradient"])
        return pa.table({"loss": [sum(parts["loss"].to_pylist())], "cells": [sum(parts["cells"].to_pylist())], "gradient": pa.array([total.tobytes()], pa.binary())})

    parts = rows.mapInArrow(run, _GRADIENT).groupBy(F.pmod(F.spark_partition_id(), F.lit(fan)).alias("branch")).applyInArrow(add, _GRADIENT).collect()
    return sum(p["loss"] for p in parts), sum(p["cells"] for p in parts), sum((np.frombuffer(p["gradient"]) for p in parts), np.zeros(len(net.vector) if learn else 0))


def train(grid: Grid, bands: list[str], most: int = 1000, size: int = 128, width: int = 16, depth: int = 3, rounds: int = 100, batches: int = 4, rate: float = 3e-3, held: float = 0.2, seed: int = 42, check_every: int = 10) -> Trained:
    """A net that tells label from bands of grid.df (row, col, bands..., label, hard_mask), by about most tiles of size x size (a multiple of 2**depth) around cells that a hash chooses. A round learns from the tiles of one of so many batches."""
    if size % (1 << depth):
        raise ValueError(f"size must be a multiple of {1 << depth}")
    stats = model.channel_statistics(grid.df, bands).first()
    about = Trained(Net(len(bands), width, depth, seed=seed).vector, bands, np.array([stats[f"{b}_mean"] or 0.0 for b in bands]), np.array([stats[f"{b}_std"] or 1.0 for b in bands]), width, depth)
    packed = checkpointed(_packed(grid, model.tile_centres(grid.df, most, held, seed), about, size).withColumn("turn", F.pmod(F.xxhash64("label", "x"), F.lit(batches))))
    mean, power, best = np.zeros_like(about.vector), np.zeros_like(about.vector), (np.inf, about.vector)
    for k in range(rounds + 1):
        if k % check_every == 0 or k == rounds:
            loss, cells, _ = _summed(packed.filter("held"), about, size, False)
            about.losses.append(loss / max(1.0, cells))
            best = min(best, (about.losses[-1], about.vector), key=lambda x: x[0])
        if k == rounds:
            break
        _, cells, gradient = _summed(packed.filter((F.col("turn") == k % batches) & ~F.col("held")), about, size, True)
        gradient = gradient / max(1.0, cells)
        mean, power = 0.9 * mean + 0.1 * gradient, 0.999 * power + 0.001 * gradient * gradient
        about.vector = about.vector - rate * (mean / (1 - 0.9 ** (k + 1))) / (np.sqrt(power / (1 - 0.999 ** (k + 1))) + 1e-8)
    about.vector = best[1]
    return about


# --- inference --------------------------------------------------------------------------------------------------------


def windows(grid: Grid, size: int, stride: int) -> DataFrame:
    """The cells with window_row, window_col: the first row and column of each window that has them. Windows start at every stride, as long as one has cells that the one before doesn't, and end where the grid does."""
    df = grid.df
    for axis, n in (("row", grid.height), ("col", grid.width)):
        last = max(0, -(-(n - size + stride) // stride) - 1)
        among = F.sequence(F.greatest(F.floor((F.col(axis) - size) / stride) + 1, F.lit(0)), F.least(F.floor(F.col(axis) / stride), F.lit(last)))
        df = df.select("*", F.explode(among).alias(f"window_{axis}")).withColumn(f"window_{axis}", F.col(f"window_{axis}") * stride)
    return df


def _masked(df: DataFrame, grid: Grid) -> DataFrame:
    if "hard_mask" not in grid.df.columns:
        return df
    return grid.df.select("row", "col", "hard_mask").join(df, ["row", "col"]).select("row", "col", F.when(F.col("hard_mask") == 1, F.col("predicted")).alias("predicted"))


def infer(grid: Grid, trained: Trained, size: int = 128, stride: int = 96) -> DataFrame:
    """row, col, predicted: the mean over overlapping windows, 0 at least; null where hard_mask isn't 1. A window that the grid cuts off is mirrored to its size."""
    height, width = grid.height, grid.width

    def run(key: tuple[pa.Scalar, ...], cells: pa.Table) -> pa.Table:
        r, c = (x.as_py() for x in key)
        rows, cols = (r, min(height, r + size)), (c, min(width, c + size))
        image = trained.image(tiles.laid_out(cells, trained.bands, rows, cols))
        h, w = image.shape[1:]
        found = trained.net().forward(np.pad(image, ((0, 0), (0, size - h), (0, size - w)), mode="reflect"))[0][:h, :w]
        return pa.table({"row": cells["row"], "col": cells["col"], "predicted": found[cells["row"].to_numpy() - r, cells["col"].to_numpy() - c]})

    seen = windows(grid.with_df(grid.df.select("row", "col", *trained.bands)), size, stride)
    return _masked(model.mosaic(seen.groupBy("window_row", "window_col").applyInArrow(run, "row int, col int, predicted double")), grid)


def surface(grid: Grid, trained: Trained, size: int = tiles.SIZE) -> DataFrame:
    """row, col, predicted as of one pass over the whole grid, 0 at least; null where hard_mask isn't 1. Tiles, whose size is a multiple of 2**depth, come with all that the net sees around them."""
    net, reach = trained.net(), 8 << trained.depth

    def run(a: tiles.Arrays) -> tiles.Arrays:
        image = trained.image(a)
        return {"predicted": np.maximum(net.forward(_even(image, trained.depth))[0][: image.shape[1], : image.shape[2]], 0.0)}

    plain = grid.with_df(grid.df.select("row", "col", *trained.bands))
    return _masked(tiles.apply(plain, trained.bands, ["predicted"], reach, run, size).select("row", "col", "predicted"), grid)
