"""Short test items inside long documents: size-partitioned bottom-k MinHash sketches, verified by exact containment.

An item with q distinct shingles is held by a document that has at least ceil(0.75 q) of them. Items are partitioned by
the size of their set, from one power of two up to the next. The partition sets the sketch: the k smallest
hashes of each item, with k the largest q - ceil(0.75 q) + 1 in the partition. A document that holds an item lacks fewer
shingles than the sketch has, so it shares at least one with it: the sketch misses nothing, however long the document is. A document's hashes are looked up in each partition's table of sketches;
documents that meet a sketch are verified by counting the item's whole set. A document with fewer runs of words
than the partition's smallest item needs skips it.

Items are the stated queries. They go to the tasks in blocks of bounded size, one pass over the documents for each
block; documents are read where they lie and nothing of them is shuffled. An item is never split.

Shingles are runs of five words (A-Z lower-cased), told apart by 64-bit hashes. An item with fewer words is one shingle
of all its words, sought among a document's runs of as many words. Defined cases: null or empty items and documents
match nothing; repeated rows match each; a null id stays null; a very long text takes some sixty times its size in its
task for a moment; without items every document stays. Other columns, also those named like results, are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import tokens
from gridloom.llm.common import written

#: Shingles of the items in one block: some 100 MB in a task.
BLOCK_SHINGLES = 2_000_000
_BITS = 22
_SETS = "item_id long, words int, shingles array<long>"
PAIRS = "doc_id long, item_id long, n_item long, n_shared long, containment double"


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = tokens.words(batch.column("text"))
            h, at = tokens.shingle_sets(w, n)
            sets = pa.LargeListArray.from_arrays(pa.array(at, pa.int64()), pa.array(h.view(np.int64))).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(np.minimum(np.diff(w.first), n), pa.int32()), sets], ["item_id", "words", "shingles"])

    return run


class Partition:
    """The items of a block with shingles of equally many words and sets of like size: every distinct hash, the items that have it, and those that have it in their sketch."""

    def __init__(self, ids: list, sets: list[np.ndarray], share: float) -> None:
        self.ids = ids
        self.size = np.array([len(x) for x in sets])
        self.need = np.ceil(share * self.size - 1e-9).astype(np.int64)
        self.least = int(self.need.min())
        k = int((self.size - self.need).max()) + 1
        everything, item = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.size)
        sketched = np.concatenate([np.arange(n) < k for n in self.size])
        self.hashes, of = np.unique(everything, return_inverse=True)
        self.in_all, self.in_sketch = self._lists(of, item), self._lists(of[sketched], item[sketched])

    def _lists(self, of: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(of, kind="stable")
        return np.searchsorted(of[order], np.arange(len(self.hashes) + 1)), item[order]

    def search(self, h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents, items and shared shingles, of distinct (doc, h)."""
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        found = self.hashes[at] == h
        at, doc = at[found], doc[found]
        met = np.unique(self._pairs(self.in_sketch, at, doc))
        mine = np.isin(doc, met // len(self.ids))
        pair, shared = np.unique(self._pairs(self.in_all, at[mine], doc[mine]), return_counts=True)
        keep = np.isin(pair, met) & (shared >= self.need[pair % len(self.ids)])
        return pair[keep] // len(self.ids), pair[keep] % len(self.ids), shared[keep]

    def _pairs(self, lists: tuple[np.ndarray, np.ndarray], at: np.ndarray, doc: np.ndarray) -> np.ndarray:
        sizes = lists[0][at + 1] - lists[0][at]
        ends = np.cumsum(sizes)
        item = lists[1][np.repeat(lists[0][at] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        return np.repeat(doc, sizes) * len(self.ids) + item


class Items:
    """The partitions of a block's items with shingles of equally many words, and which hashes may be in any of them."""

    def __init__(self, ids: list, sets: list[np.ndarray], share: float) -> None:
        sets = [np.sort(x.view(np.uint64)) for x in sets]
        by_size: dict[int, list[int]] = {}
        for k, x in enumerate(sets):
            by_size.setdefault(len(x).bit_length(), []).append(k)
        self.partitions = [Partition([ids[k] for k in some], [sets[k] for k in some], share) for _, some in sorted(by_size.items())]
        self.maybe = np.zeros(1 << _BITS, bool)
        for p in self.partitions:
            self.maybe[p.hashes >> np.uint64(64 - _BITS)] = True


def _blocks(items: DataFrame, share: float, n: int, block_shingles: int) -> Iterator[Broadcast]:
    """The items by the number of words in their shingles, in blocks of bounded size."""
    sets = written(items.select("item_id", "text").mapInArrow(_sets(n), _SETS).filter("size(shingles) > 0"), "item-sets")
    total = sets.agg(F.sum(F.size("shingles"))).first()[0] or 0
    blocks = -(-total // block_shingles)
    for k in range(blocks):
        table = sets.filter(F.pmod(F.xxhash64("item_id", "shingles"), F.lit(blocks)) == k).toArrow()  # a block is bounded
        rows: dict[int, tuple[list, list]] = {}
        for item, words, x in zip(table["item_id"].to_pylist(), table["words"].to_pylist(), table["shingles"], strict=True):
            ids, sets_ = rows.setdefault(words, ([], []))
            ids.append(item)
            sets_.append(x.values.to_numpy())
        if rows:
            yield items.sparkSession.sparkContext.broadcast({m: Items(*x, share) for m, x in sorted(rows.items())})


def contained(docs: DataFrame, items: DataFrame, share: float = 0.75, n: int = 5, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment for docs (doc_id, text) and items (item_id, text) with n_shared >= share * n_item."""
    out = docs.sparkSession.createDataFrame([], PAIRS)
    for block in _blocks(items, share, n, block_shingles):
        out = out.unionAll(docs.select("doc_id", "text").mapInArrow(_search(block, n), PAIRS))
    return out


def without(docs: DataFrame, items: DataFrame, share: float = 0.75, n: int = 5, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """The rows of docs that contain no item, with all their columns."""

    def clean(block: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for found, *_ in _matches(batch.column("text"), block, n):
                    keep[found] = False
                yield batch.filter(pa.array(keep))

        return run

    blocks = _blocks(items, share, n, block_shingles)
    last = next(blocks, None)
    for block in blocks:  # more than one: the passes follow each other
        docs, last = written(docs.mapInArrow(clean(last), docs.schema), "decontaminated"), block
    return docs.mapInArrow(clean(last), docs.schema) if last else docs


def _matches(texts: pa.Array, items: Broadcast, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, Partition]]:
    """Rows, items and shared shingles, for each length of shingle and size of item."""
    w = tokens.words(texts)
    for m, block in items.value.items():
        h, doc = tokens.ngrams(w, m)
        seen = block.maybe[h >> np.uint64(64 - _BITS)]  # so that few are left to sort
        runs = np.bincount(doc, minlength=len(texts))
        h, at = tokens.distinct(h[seen], doc[seen], len(texts))
        doc = np.repeat(np.arange(len(texts)), np.diff(at))
        for part in block.partitions:
            enough = runs[doc] >= part.least
            yield *part.search(h[enough], doc[enough]), part


def _search(items: Broadcast, n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, item, shared, part in _matches(batch.column("text"), items, n):
                if len(d):
                    size = part.size[item]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(d)), pa.array([part.ids[i] for i in item], pa.int64()), pa.array(size, pa.int64()), pa.array(shared, pa.int64()), pa.array(shared / size)], [x.split()[0] for x in PAIRS.split(", ")])

    return run
