"""A random forest for regression whose trees are grown and read by tasks: the driver holds thresholds only.

Training rows are packed once into a table of bins (a byte for each band), label and draw. Each tree is a task that goes
through that table in blocks: nodes with more than CAP rows are split by sums over a pass; smaller ones are gathered, as
many as CAP rows allow in a pass, and grown level by level. So a task's memory is bounded by CAP whatever the rows, and
neither rows nor trees are exchanged. Trees are a table too, of which predictions hold one at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.session import shared_dir

#: How many bins a band has at most, as Spark's ML; how many draws of rows one task holds; and how many rows (and bytes) it predicts together.
BINS, CAP, ROWS, BYTES = 32, 2_000_000, 1 << 20, 1 << 26
TREE = "tree int, feature binary, bin binary, child binary, value binary, gains array<double>"
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 12)]))


def thresholds(rows: DataFrame, columns: list[str]) -> list[np.ndarray]:
    """For each column at most BINS - 1 thresholds: between its values if those are few, else at quantiles of all rows."""
    counts = rows.agg(*(F.approx_count_distinct(c).alias(c) for c in columns)).first()
    few = [c for c in columns if counts[c] <= 2 * BINS]
    sets = rows.agg(*(F.collect_set(c).alias(c) for c in few)).first() if few else {}
    values = {c: np.unique(sets[c]) for c in few if len(sets[c]) <= BINS}
    many = [c for c in columns if c not in values]
    found = dict(zip(many, rows.approxQuantile(many, [k / BINS for k in range(1, BINS)], 0.001), strict=True)) if many else {}
    return [(values[c][:-1] + values[c][1:]) / 2 if c in values else np.unique(found[c]) for c in columns]


def _bins(batch: pa.RecordBatch, columns: list[str], cuts: list[np.ndarray]) -> np.ndarray:
    """A row's bin in each column: how many thresholds are under its value."""
    out = np.empty((batch.num_rows, len(columns)), np.uint8)
    for k, (c, cut) in enumerate(zip(columns, cuts, strict=True)):
        x = batch.column(c).to_numpy(zero_copy_only=False).astype(float)
        if np.isnan(x).any():
            raise ValueError(f"{c} has nulls or NaN")
        out[:, k] = np.searchsorted(cut, x)
    return out


def _draws(key: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree draws each row: Poisson with mean 1, by a hash of the row's key."""
    with np.errstate(over="ignore"):
        x = key.view(np.uint64) + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03 & (1 << 64) - 1)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return np.searchsorted(_POISSON, ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53, side="right").astype(np.uint8)


class _Tree:
    """Nodes in arrays: feature (-1 at a leaf), bin (rows up to it go left), the left child's number (the right one is next), and the mean."""

    def __init__(self) -> None:
        self.feature, self.bin, self.child, self.value = np.array([-1], np.int8), np.zeros(1, np.uint8), np.zeros(1, np.int32), np.zeros(1)

    def place(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        at, going = np.zeros(len(bins), np.int32), np.arange(len(bins))
        while len(going := going[self.feature[at[going]] >= 0]):
            node = at[going]
            at[going] = self.child[node] + (bins[going, self.feature[node]] > self.bin[node])
        return at

    def split(self, nodes: np.ndarray, feature: np.ndarray, cut: np.ndarray, means: np.ndarray) -> np.ndarray:
        """Splits nodes; the children's numbers, left and right by turns."""
        first = len(self.feature)
        self.feature[nodes], self.bin[nodes], self.child[nodes] = feature, cut, first + 2 * np.arange(len(nodes))
        n = 2 * len(nodes)
        self.feature, self.bin = np.concatenate([self.feature, np.full(n, -1, np.int8)]), np.concatenate([self.bin, np.zeros(n, np.uint8)])
        self.child, self.value = np.concatenate([self.child, np.zeros(n, np.int32)]), np.concatenate([self.value, means])
        return np.arange(first, first + n)


def _better(best: np.ndarray, feature: np.ndarray, n: np.ndarray, s: np.ndarray, least: int) -> None:
    """Puts a node's best split on feature, from draws n and sums s by bin, into best (gain, feature, bin, n and sum on the left, n and sum) where it gains more."""
    left, sums = n.cumsum(axis=1), s.cumsum(axis=1)
    total, whole = left[:, -1:].copy(), sums[:, -1:].copy()
    right = total - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = sums**2 / left + (whole - sums) ** 2 / right - whole**2 / total
    gain[(left < least) | (right < least)] = -np.inf
    cut, at = gain.argmax(axis=1), np.arange(len(n))
    found = np.column_stack([gain[at, cut], feature, cut, left[at, cut], sums[at, cut], total[:, 0], whole[:, 0]])
    best[:] = np.where(found[:, :1] > best[:, :1], found, best)


def _sums(bins: np.ndarray, label: np.ndarray, drawn: np.ndarray, node: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Draws and their sums of labels, by node and bin of the node's feature."""
    key = node.astype(np.int64) * BINS + bins[np.arange(len(bins)), feature[node]]
    size = len(feature) * BINS
    return np.bincount(key, drawn, size).reshape(-1, BINS), np.bincount(key, drawn * label, size).reshape(-1, BINS)


def grow(read, total: int, tree: int, bands: int, depth: int, least: int, seed: int, cap: int) -> tuple[_Tree, np.ndarray]:
    """A tree, and what splits on each band gained. read(): blocks (bins, label, draws) of the total rows."""
    grown, gains, rng = _Tree(), np.zeros(bands), np.random.default_rng([seed, tree])
    tries = min(bands, int(np.ceil(np.sqrt(bands))))
    choose = lambda k: rng.random((k, bands)).argsort(axis=1)[:, :tries]

    def divide(nodes: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Splits those of nodes that gain by it: their places in nodes, the children, and the children's draws."""
        good = np.flatnonzero(best[:, 0] > 1e-12)
        gain, feature, cut, n, s, all_n, all_s = best[good].T
        np.add.at(gains, feature.astype(int), gain)
        draws = np.column_stack([n, all_n - n]).ravel()
        return good, grown.split(nodes[good], feature.astype(np.int8), cut.astype(np.uint8), np.column_stack([s, all_s - s]).ravel() / draws), draws

    # nodes with too many rows for a task: a pass over all blocks for each level of them
    large, small, level = [0] if total > cap else [], [] if total > cap else [(0, total, 0)], 0
    while large:
        nodes = np.array(large)
        chosen, local = choose(len(nodes)), np.full(len(grown.feature), -1)
        local[nodes] = np.arange(len(nodes))
        parts = np.zeros((tries, 2, len(nodes), BINS))
        for bins, label, drawn in read():
            node = local[grown.place(bins)]
            bins, label, drawn, node = (v[node >= 0] for v in (bins, label, drawn, node))
            for k in range(tries):
                parts[k] += _sums(bins, label, drawn, node, chosen[:, k])
        best = np.full((len(nodes), 7), -np.inf)
        for k in range(tries):
            _better(best, chosen[:, k], *parts[k], least)
        if level == 0:
            grown.value[0] = parts[0, 1].sum() / max(1.0, parts[0, 0].sum())
        _, children, draws = divide(nodes, best)
        level += 1
        sized = list(zip(children.tolist(), draws.tolist(), strict=True)) if level < depth else []
        large, small = [c for c, n in sized if n > cap], small + [(c, n, level) for c, n in sized if 2 * least <= n <= cap]
    while small:
        # as many nodes as fit together, of one level
        level, held, nodes = small[0][2], 0, []
        while small and small[0][2] == level and (not nodes or held + small[0][1] <= cap):
            c, n, _ = small.pop(0)
            nodes.append(c)
            held += n
        nodes, local = np.array(nodes), np.full(len(grown.feature), -1)
        local[nodes] = np.arange(len(nodes))
        kept = []
        for bins, label, drawn in read():
            node = local[grown.place(bins)] if len(grown.feature) > 1 else np.zeros(len(bins), np.int64)
            kept.append([v[node >= 0] for v in (bins, label, drawn, node)])
        bins, label, drawn, node = (np.concatenate(v) for v in zip(*kept, strict=True)) if kept else (np.zeros((0, bands), np.uint8), np.zeros(0), np.zeros(0), np.zeros(0, np.int64))
        del kept
        if len(grown.feature) == 1:
            grown.value[0] = (drawn * label).sum() / max(1, drawn.sum())
        while len(nodes) and level < depth:
            chosen, best = choose(len(nodes)), np.full((len(nodes), 7), -np.inf)
            for k in range(tries):
                _better(best, chosen[:, k], *_sums(bins, label, drawn, node, chosen[:, k]), least)
            good, children, draws = divide(nodes, best)
            level += 1
            # rows go on to children that may be split again
            first, after = np.full(len(nodes), -1), np.full(len(children), -1)
            first[good] = 2 * np.arange(len(good))
            going = np.flatnonzero(draws >= 2 * least)
            after[going] = np.arange(len(going))
            node, moving = first[node], np.flatnonzero(first[node] >= 0)
            bins, label, drawn, node = bins[moving], label[moving], drawn[moving], node[moving]
            parent = node // 2
            node = after[node + (bins[np.arange(len(bins)), best[good, 1].astype(int)[parent]] > best[good, 2].astype(int)[parent])]
            moving = np.flatnonzero(node >= 0)
            bins, label, drawn, node, nodes = bins[moving], label[moving], drawn[moving], node[moving], children[going]
    return grown, gains


@dataclass
class Forest:
    """A trained forest: transform() adds the scaled bands and prediction, the trees' mean. path: the folder of the trees' table, as executors see it."""

    scaler: SQLTransformer
    bands: list[str]
    cuts: list[np.ndarray]
    path: str
    spark: SparkSession

    def transform(self, rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """rows with the scaled bands and prediction; or the columns of keep and prediction."""
        scaled = self.scaler.transform(rows)
        keep, columns, cuts, path = keep if keep is not None else scaled.columns, [f"{b}_scaled" for b in self.bands], self.cuts, self.path

        def told(batches: list[pa.RecordBatch], bins: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            where = np.concatenate(bins)
            total, trees = np.zeros(len(where)), 0
            for grown in _trees(path):
                total += grown.value[grown.place(where)]
                trees += 1
            at = 0
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(total[at : at + batch.num_rows] / trees)], [*batch.schema.names, "prediction"])
                at += batch.num_rows

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, bins, size = [], [], 0
            for batch in batches:
                held.append(batch.select(keep))
                bins.append(_bins(batch, columns, cuts))
                size += held[-1].nbytes
                if size > BYTES or sum(map(len, bins)) > ROWS:
                    yield from told(held, bins)
                    held, bins, size = [], [], 0
            if held:
                yield from told(held, bins)

        wanted = [*keep, *(c for c in columns if c not in keep)]
        return scaled.select(*wanted).mapInArrow(run, T.StructType([*(scaled.schema[c] for c in keep), T.StructField("prediction", T.DoubleType())]))

    def importances(self) -> np.ndarray:
        """Each band's share of what a tree gains, averaged over the trees."""
        gains = self.spark.read.parquet(self.path).select("tree", F.posexplode("gains").alias("band", "gain"), F.aggregate("gains", F.lit(0.0), lambda a, x: a + x).alias("whole"))
        mean = dict(gains.filter("whole > 0").groupBy("band").agg(F.sum(F.col("gain") / F.col("whole"))).collect())
        found = np.array([mean.get(k, 0.0) for k in range(len(self.bands))])
        return found / (found.sum() or 1.0)

    def save(self, path: str) -> None:
        self.spark.read.parquet(self.path).write.mode("overwrite").partitionBy("tree").parquet(f"{path}/trees")
        about = self.spark.createDataFrame([(self.scaler.getStatement(), self.bands, [c.tolist() for c in self.cuts])], "statement string, bands array<string>, cuts array<array<double>>")
        about.coalesce(1).write.mode("overwrite").parquet(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Forest:
        about = spark.read.parquet(f"{path}/about").first()
        return cls(SQLTransformer(statement=about["statement"]), list(about["bands"]), [np.array(c) for c in about["cuts"]], f"{path}/trees", spark)


def _table(path: str) -> ds.Dataset:
    """A table that Spark wrote, by its path or URI."""
    system, at = pa.fs.FileSystem.from_uri(path)
    return ds.dataset(at, filesystem=system, format="parquet", exclude_invalid_files=False)


def _trees(path: str) -> Iterator[_Tree]:
    # a folder for each tree: in the order of their numbers, so that sums are the same wherever the table lies
    for part in sorted(_table(path).get_fragments(), key=lambda x: int(x.path.rsplit("tree=", 1)[1].split("/")[0])):
        for batch in part.to_batches(batch_size=1, batch_readahead=0, fragment_readahead=0):
            for row in batch.to_pylist():
                grown = _Tree()
                grown.feature, grown.bin, grown.child, grown.value = (np.frombuffer(row[c], t) for c, t in (("feature", np.int8), ("bin", np.uint8), ("child", np.int32), ("value", np.float64)))
                yield grown


def train(rows: DataFrame, scaler: SQLTransformer, bands: list[str], trees: int, depth: int, least: int, seed: int, cap: int = CAP) -> Forest:
    """A forest on the scaled bands of rows (bands..., label). cap: how many draws of rows a task holds."""
    spark, columns = rows.sparkSession, [f"{b}_scaled" for b in bands]
    scaled = scaler.transform(rows.withColumn("_key", F.xxhash64(*rows.columns))).select("_key", "label", *columns)
    cuts = thresholds(scaled, columns)
    folder = f"{shared_dir(spark)}/forest-{uuid.uuid4().hex}"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = _bins(batch, columns, cuts)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(len(columns)), len(bins), [None, pa.py_buffer(bins.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("_key"), packed, batch.column("label").cast(pa.float64())], ["key", "bins", "label"])

    scaled.filter("label is not null").mapInArrow(pack, "key long, bins binary, label double").write.parquet(f"{folder}/rows")
    total = spark.read.parquet(f"{folder}/rows").count()
    if not total:
        raise ValueError("no rows to train on")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree in batch.column("id").to_pylist():

                def read(tree: int = tree) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
                    for part in sorted(_table(f"{folder}/rows").get_fragments(), key=lambda x: x.path):
                        for block in part.to_batches(batch_size=1 << 17, batch_readahead=1, fragment_readahead=1):
                            drawn = _draws(block.column("key").to_numpy(), tree, seed)
                            some = np.flatnonzero(drawn)
                            data = block.column("bins")
                            start = data.offset * len(columns)
                            bins = np.frombuffer(data.buffers()[2], np.uint8, block.num_rows * len(columns), start).reshape(-1, len(columns))
                            yield bins[some], block.column("label").to_numpy()[some], drawn[some].astype(float)

                grown, gains = grow(read, total, tree, len(bands), depth, least, seed, cap)
                found = [grown.feature, grown.bin, grown.child, grown.value]
                yield pa.RecordBatch.from_arrays([pa.array([tree], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in found), pa.array([gains.tolist()])], ["tree", "feature", "bin", "child", "value", "gains"])

    spark.range(0, trees, 1, trees).mapInArrow(run, TREE).write.partitionBy("tree").parquet(f"{folder}/trees")
    return Forest(scaler, bands, cuts, f"{folder}/trees", spark)
