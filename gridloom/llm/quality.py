"""Quality classifier: logistic regression over hashed word n-grams, trained with FTRL updates.

A text is a bag of hashed words, word pairs, and runs of one to three word shapes (letter case, digits, marks, length;
a word like the one before has a shape of its own). A score is the logistic of a sparse dot product: the mean weight of
the text's n-grams. Labelled rows are joined to the documents by broadcasting at most ``max_rows`` labels, a documented
sample by hash; their features stream to one task, which runs the updates and returns the weights. Scores need no shuffle.

Defined cases: null and empty texts have no n-grams and score by the intercept alone. Labels other than 0 and 1 are
ignored; of several labels for one document the mean decides (0.5 and more: 1). Repeated rows are scored each. A null
doc_id is never learned from. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm import tokens

BITS = 20
_UPPER = np.zeros(256, np.int32)
_UPPER[65:91] = 1
_LOWER = np.zeros(256, np.int32)
_LOWER[97:123] = 1
_LOWER[128:] = 1  # bytes of letters beyond ASCII, mostly
_DIGIT = np.zeros(256, np.int32)
_DIGIT[48:58] = 1


def fold_of(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def _within(of: np.ndarray, w: tokens.Words) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(of[w.data])])
    return sums[w.ends] - sums[w.starts]


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all n-grams, text by text, and where each text's begin, and the last one's end."""
    w = tokens.words(texts, fold=False)
    n = len(w.first) - 1
    size, upper, lower, digit = w.ends - w.starts, *(_within(x, w) for x in (_UPPER, _LOWER, _DIGIT))
    other = size - upper - lower - digit
    same = np.zeros(len(size), bool)
    same[1:] = (w.hashes[1:] == w.hashes[:-1]) & (w.doc[1:] == w.doc[:-1])
    shape = np.minimum(size, 12) // 4 + 4 * np.minimum(upper, 2) + 12 * (lower > 0) + 24 * (digit > 0) + 48 * np.minimum(other, 3) + 192 * same
    shapes = tokens.Words(w.data, w.starts, w.ends, w.doc, w.first, tokens.mix(shape.astype(np.uint64) + np.uint64(1 << 40)))
    parts = [tokens.ngrams(w, 1), tokens.ngrams(w, 2), *(tokens.ngrams(shapes, k) for k in (1, 2, 3))]
    index, at = [], np.zeros(n + 1, np.int64)
    for h, doc in parts:
        index.append(((h >> np.uint64(64 - BITS)).astype(np.int32), np.searchsorted(doc, np.arange(n + 1))))
        at += index[-1][1]
    out = np.empty(at[-1], np.int32)
    shift = np.zeros(n, np.int64)
    for x, start in index:
        counts = np.diff(start)
        out[np.arange(len(x)) + np.repeat(at[:-1] + shift - start[:-1], counts)] = x
        shift += counts
    return out, at


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, at = features(batch.column("text"))
        rows = [np.unique(x[i:j], return_counts=True) for i, j in zip(at[:-1], at[1:], strict=True)]
        data = [np.concatenate([i.astype("<i4").view(np.float32), (c / max(1, c.sum())).astype("<f4")]).tobytes() for i, c in rows]
        yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("label"), pa.array(data, pa.binary())], ["place", "label", "data"])


class Ftrl:
    """Follow the regularised leader, proximal, one example at a time."""

    def __init__(self, size: int, alpha: float, beta: float, l1: float, l2: float) -> None:
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, i: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, i: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(i)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[i] = n + g * g


def _train(epochs: int, updates: int, alpha: float, beta: float, l1: float, l2: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, rows = Ftrl((1 << BITS) + 1, alpha, beta, l1, l2), []
        for batch in batches:  # held compressed: max_bytes of texts bound them
            rows += zip(batch.column("label").to_pylist(), map(zstandard.ZstdCompressor(1).compress, batch.column("data").to_pylist()), strict=True)
        count, unpack = len(rows), zstandard.ZstdDecompressor().decompress
        for _ in range(max(epochs, min(100, updates // max(1, count)))):
            for label, packed in rows:
                data = np.frombuffer(unpack(packed), "<f4")
                k = len(data) // 2
                # the intercept is the last index
                model.learn(np.append(data[:k].view("<i4"), 1 << BITS), np.append(data[k:].astype(np.float64), 1.0), int(label))
        w = model.weights(slice(None)).astype("<f4")
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(w.tobytes(), 1)], pa.binary()), pa.array([count], pa.int64())], ["weights", "examples"])

    return run


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 16_000, max_bytes: int = 256 << 20, epochs: int = 4, updates: int = 60_000, alpha: float = 1.0, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-4) -> np.ndarray:
    """Weights from docs (doc_id, text) and labels (doc_id, label). At most about max_rows labels, chosen by a hash of the id, are learned from: the bound on what is broadcast and on the one training task, and of those, if their texts are over max_bytes, about as many as max_bytes hold, chosen by another hash. Few rows are passed over more often than epochs says, up to so many updates."""
    clean = labels.filter("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    total = clean.count()
    some = clean.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, max_rows / max(1, total))))
    examples = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select(F.xxhash64("doc_id", F.lit(1)).alias("place"), "label", "text")
    size = examples.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > max_bytes:
        examples = examples.filter(F.pmod("place", F.lit(1 << 20)) < int((1 << 20) * max_bytes / size))
    rows = examples.mapInArrow(_examples, "place long, label int, data binary").repartition(1).sortWithinPartitions("place", "label", "data").mapInArrow(_train(epochs, updates, alpha, beta, l1, l2), "weights binary, examples long").collect()
    return np.frombuffer(zlib.decompress(rows[0]["weights"]), "<f4") if rows else np.zeros((1 << BITS) + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score and the columns of keep, of docs (doc_id, text). The weights are 4 MB, whatever the corpus."""
    docs = docs.select("doc_id", "text", *(c for c in keep if c not in ("doc_id", "text")))
    model = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value
        for batch in batches:
            x, at = features(batch.column("text"))
            sums = np.concatenate([[0.0], np.cumsum(w[x], dtype=np.float64)])
            mean = np.diff(sums[at]) / np.maximum(1, np.diff(at))
            p = pa.array(1 / (1 + np.exp(-np.clip(mean + w[-1], -30, 30))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), p, *(batch.column(c) for c in keep if c != "doc_id")], ["doc_id", "score", *(c for c in keep if c != "doc_id")])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType()), *(docs.schema[c] for c in keep if c != "doc_id")])
    return docs.mapInArrow(run, schema)
