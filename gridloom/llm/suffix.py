"""Suffix-array dedup: bytes covered by a long string that also starts earlier are removed.

Each window of ``length`` bytes picks an anchor by its content: the leftmost start of the least hash of 32 bytes within
it. So equal windows pick equal anchors, and the suffixes that start at anchors, one in some 35 bytes, stand for all.
The windows of an anchor lie side by side; the bytes they cover are its context.

A shard of the anchors' hash space keeps the suffixes as a logarithmic index family. New batches become suffix arrays,
sorted by a 64-bit fingerprint of anchor and context instead of by their bytes, which puts equal ones side by side all
the same. A batch is merge-scanned against each level; of equal suffixes only the earliest stays in the index and the
others are marked. The rest becomes a level, and levels of like size merge, so a suffix is rewritten a logarithmic
number of times. An anchor's windows are all removed if its context was seen earlier, and all kept if the anchor stands
nowhere else. Where an anchor has several contexts, its windows go through the same index once more, one by one.

``earlier`` means a smaller doc_id, or the same doc_id and a smaller start. Defined cases: null text is empty; a null
doc_id comes before all others; rows with one doc_id are copies of one document: equal starts in them are one start, so
repeated rows have equal results. Matches never cross rows. Columns not named in ``keep`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm import exchange, tokens
from gridloom.llm.common import settled, written

#: Bytes whose hash makes an anchor.
GRAM = 32
_STEP = 1 << 14
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
#: Suffixes in one batch of the index, if the shard has as many.
BATCH = 1 << 16
_UNIQUE, _REMOVED, _UNCLEAR = range(3)
_ANCHORS, _WINDOWS = 0, 1


class Anchors:
    """The anchors of a piece of texts, by ascending hash: key, context's hash, document, first and last window."""

    def __init__(self, texts: pa.ChunkedArray, length: int) -> None:
        self.length = length
        self.data, self.at = tokens.text_bytes(texts)
        n = len(self.data)
        if n < length:
            self.key = self.context = np.zeros(0, np.uint64)
            self.doc = self.pos = self.low = self.high = np.zeros(0, np.int64)
            return
        h = self._grams()
        # the upper half of the hash, then the place: the least is leftmost among equals
        least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(n - GRAM + 1, dtype=np.uint64)
        span, width = 1, length - GRAM + 1
        while 2 * span <= width:
            least = np.minimum(least[: len(least) - span], least[span:])
            span *= 2
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :]) if width > span else least
        inside = np.ones(n, bool)
        for i, j in zip(self.at[:-1], self.at[1:], strict=True):
            inside[max(i, j - length + 1) : j] = False
        windows = np.flatnonzero(inside[: n - length + 1])
        anchor = (least[windows] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])[: len(anchor)])
        low, high = windows[first], windows[np.append(first[1:], len(windows))[: len(first)] - 1] if len(first) else windows[first]
        anchor = anchor[first]
        key = tokens.mix(h[anchor])  # least hashes are small, keys are even
        del h, least, windows
        order = np.argsort(key, kind="stable")
        self.key, self.low, self.high, anchor = key[order], low[order], high[order], anchor[order]
        self.context = tokens.mix(tokens.range_hashes(self.data, self.low, self.high + length) + (anchor - self.low).astype(np.uint64))
        self.doc = np.searchsorted(self.at, anchor, side="right") - 1
        self.pos = anchor - self.at[self.doc]

    def _grams(self) -> np.ndarray:
        """A hash of the GRAM bytes from each place."""
        eights, out = tokens.eights(self.data), np.empty(len(self.data) - GRAM + 1, np.uint64)
        for i in range(0, len(out), _STEP):  # in steps that a processor's cache holds
            m = min(_STEP, len(out) - i)
            mixed = tokens.mix(eights[i : i + m + GRAM - 8])
            part = mixed[:m] * _FACTORS[0]
            for k in range(1, GRAM // 8):
                part ^= mixed[8 * k : 8 * k + m] * _FACTORS[k]
            out[i : i + m] = tokens.mix(part)
        return out

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The starts of the windows of some anchors, and each one's document."""
        sizes = self.high[which] - self.low[which] + 1
        ends = np.cumsum(sizes)
        starts = np.repeat(self.low[which] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        return starts, np.repeat(self.doc[which], sizes)


class Levels:
    """Sorted levels of distinct suffixes, each with its earliest place. A place is (doc_id, start); ref numbers the suffixes as they came.

    Equal suffixes at one place are twins: the first that came stands for them, and spread() gives them its fate."""

    def __init__(self, n: int) -> None:
        self.levels: list[tuple[np.ndarray, ...]] = []
        self.later = np.zeros(n, bool)
        self.twin_of = np.arange(n, dtype=np.uint32 if n < 1 << 32 else np.uint64)

    def add(self, print_: np.ndarray, doc: np.ndarray, pos: np.ndarray, ref: np.ndarray) -> None:
        order = np.lexsort((pos, doc, print_))
        new = [x[order] for x in (print_, doc, pos, ref)]
        first = np.concatenate([[True], new[0][1:] != new[0][:-1]])[: len(order)]
        head = np.flatnonzero(first)[np.cumsum(first) - 1]
        twin = (new[1] == new[1][head]) & (new[2] == new[2][head])
        self.later[new[3][~twin]] = True
        self.twin_of[new[3][twin]] = new[3][head[twin]]
        new = [x[first] for x in new]
        for level in self.levels:
            at = np.minimum(np.searchsorted(level[0], new[0]), len(level[0]) - 1)
            met = level[0][at] == new[0]
            if not met.any():
                continue
            mine, at = np.flatnonzero(met), at[met]
            before = (level[1][at] < new[1][mine]) | ((level[1][at] == new[1][mine]) & (level[2][at] < new[2][mine]))
            same = (level[1][at] == new[1][mine]) & (level[2][at] == new[2][mine])
            self.later[new[3][mine[before]]] = True
            self.twin_of[new[3][mine[same]]] = level[3][at[same]]
            swap = ~before & ~same
            self.later[level[3][at[swap]]] = True
            for k in (1, 2, 3):
                level[k][at[swap]] = new[k][mine[swap]]
            new = [x[~met] for x in new]
        level = tuple(new)
        while self.levels and len(self.levels[-1][0]) <= 2 * len(level[0]):
            both = [np.concatenate(x) for x in zip(self.levels.pop(), level, strict=True)]
            order = np.argsort(both[0], kind="stable")
            level = tuple(x[order] for x in both)
        if len(level[0]):
            self.levels.append(level)

    def spread(self) -> None:
        # a twin leads to the head of its batch, and that to the one met in a level
        self.later = self.later[self.twin_of[self.twin_of]]

    def refs(self) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *(x[3] for x in self.levels)])


def _place(ids: np.ndarray, null: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return np.where(null > 0, np.iinfo(np.int64).min, ids)[doc]


def _indexed(asked: list[exchange.Arrays], print_: list[np.ndarray], batch: int | None = None) -> Levels:
    """asked: [..., doc, pos, ids, null]. batch: BATCH, unless given."""
    index, held, size, done = Levels(sum(map(len, print_))), [], 0, 0
    for k, (x, p) in enumerate(zip(asked, print_, strict=True)):
        *_, doc, pos, ids, null = x
        held.append((p, _place(ids, null, doc), pos.astype(np.int64), np.arange(done, done + len(p))))
        size, done = size + len(p), done + len(p)
        if size >= (batch or BATCH) or k == len(asked) - 1:
            index.add(*(np.concatenate(y) for y in zip(*held, strict=True)))
            held, size = [], 0
    index.spread()
    return index


def _ask_anchors(shards: int, length: int):
    def run(table: pa.Table) -> Iterator[tuple[int, exchange.Arrays]]:
        a = Anchors(table["text"], length)
        ids = exchange.ids_array(table["doc_id"])
        for s, k in exchange.runs(exchange.shard_of(a.key, shards)):
            yield s, [exchange.steps(a.key[k] >> np.uint64(24)), a.context[k] >> np.uint64(8), a.doc[k].astype(np.uint32), a.pos[k].astype(np.uint32), *ids]

    return run


def _reply_anchors(asked: list[exchange.Arrays], batch: int | None = None) -> Iterator[exchange.Arrays]:
    key = [exchange.total(x[0]) for x in asked]
    index = _indexed(asked, [tokens.mix((k << np.uint64(24)) ^ tokens.mix(x[1])) for k, x in zip(key, asked, strict=True)], batch)
    state = index.later.astype(np.uint8)
    refs, key = index.refs(), np.concatenate([np.zeros(0, np.uint64), *key])
    order = np.argsort(key[refs], kind="stable")
    sorted_ = key[refs][order]
    more = np.concatenate([sorted_[1:] == sorted_[:-1], [False]]) if len(sorted_) else np.zeros(0, bool)
    more[1:] |= more[:-1].copy()
    state[refs[order[more]]] = _UNCLEAR
    # repeated rows: an equal place of an equal suffix fares as the one in the index
    yield from _split(state, asked, key, index)


def _split(state: np.ndarray, asked: list[exchange.Arrays], key: np.ndarray, index: Levels) -> Iterator[exchange.Arrays]:
    kept = np.zeros(len(state), bool)
    kept[index.refs()] = True
    if len(twins := np.flatnonzero(~kept & ~index.later)):
        unclear = np.unique(key[state == _UNCLEAR])
        state[twins[np.isin(key[twins], unclear)]] = _UNCLEAR
    done = 0
    for x in asked:
        yield [state[done : done + len(x[0])]]
        done += len(x[0])


def _ask_windows(shards: int, length: int):
    def run(table: pa.Table, got: dict[int, list[exchange.Arrays]]) -> Iterator[tuple[int, exchange.Arrays]]:
        a = Anchors(table["text"], length)
        starts, doc, h = _unclear(a, got)
        ids = exchange.ids_array(table["doc_id"])
        for s, k in exchange.runs(exchange.shard_of(h, shards)):
            yield s, [exchange.steps(h[k]), doc[k].astype(np.uint32), (starts[k] - a.at[doc[k]]).astype(np.uint32), *ids]

    return run


def _states(a: Anchors, got: dict[int, list[exchange.Arrays]]) -> np.ndarray:
    state = np.concatenate([np.zeros(0, np.uint8), *(x[0] for x in got.get(_ANCHORS, []))])
    if len(state) != len(a.key):
        raise ValueError(f"{len(a.key)} anchors got {len(state)} answers")
    return state


def _unclear(a: Anchors, got: dict[int, list[exchange.Arrays]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, doc = a.windows(np.flatnonzero(_states(a, got) == _UNCLEAR))
    h = tokens.range_hashes(a.data, starts, starts + a.length)
    order = np.argsort(h, kind="stable")
    return starts[order], doc[order], h[order]


def _reply_windows(asked: list[exchange.Arrays], batch: int | None = None) -> Iterator[exchange.Arrays]:
    index, done = _indexed(asked, [exchange.total(x[0]) for x in asked], batch), 0
    for x in asked:
        yield [index.later[done : done + len(x[0])].astype(np.uint8)]
        done += len(x[0])


def _cut(length: int, keep: list[str]):
    def run(table: pa.Table, got: dict[int, list[exchange.Arrays]]) -> pa.RecordBatch:
        a = Anchors(table["text"], length)
        n = len(a.data)
        change = np.zeros(n + 1, np.int32)
        gone = _states(a, got) == _REMOVED
        np.add.at(change, a.low[gone], 1)
        np.add.at(change, a.high[gone] + length, -1)
        starts, _, _ = _unclear(a, got)
        bits = np.concatenate([np.zeros(0, np.uint8), *(x[0] for x in got.get(_WINDOWS, []))])
        if len(bits) != len(starts):
            raise ValueError(f"{len(starts)} windows got {len(bits)} answers")
        starts = starts[bits > 0]
        np.add.at(change, starts, 1)
        np.add.at(change, starts + length, -1)
        covered = np.cumsum(change[:n]) > 0
        edge = np.zeros(n + 1, bool)
        edge[a.at] = True
        begin = np.flatnonzero(covered & (np.concatenate([[True], ~covered[:-1]])[:n] | edge[:n]))
        end = np.flatnonzero(covered & (np.concatenate([~covered[1:], [True]])[:n] | edge[1:])) + 1
        doc = np.searchsorted(a.at, begin, side="right") - 1
        per = np.searchsorted(doc, np.arange(len(a.at)))
        lists = [pa.ListArray.from_arrays(pa.array(per, pa.int32()), pa.array((x - a.at[doc]).astype(np.int64))) for x in (begin, end)]
        left = ~covered
        kept, sums = a.data[left].tobytes(), np.concatenate([[0], np.cumsum(left)])[a.at]
        rows = [kept[i:j] for i, j in zip(sums[:-1], sums[1:], strict=True)]
        if "text" in keep:  # what is left, without characters cut in two
            left = [x.decode(errors="ignore") for x in rows]
            table = table.set_column(table.schema.get_field_index("text"), "text", pa.array(left, pa.string()))
        columns = [table["doc_id"], pa.array(np.diff(a.at)), *lists, pa.array(rows, pa.binary()), *(table[c] for c in keep)]
        return pa.table(columns, ["doc_id", "n_bytes", "span_starts", "span_ends", "kept", *keep]).combine_chunks().to_batches()[0]

    return run


def remove_repeats(docs: DataFrame, length: int = 100, keep: tuple[str, ...] = (), batch: int | None = None, stable: bool = False) -> DataFrame:
    """doc_id, n_bytes, span_starts and span_ends of the removed runs, kept (the other bytes), and the columns of keep, of docs (doc_id, text). A text among keep is what is left of it. batch: suffixes in one batch of the index, BATCH unless given; results don't depend on it. stable: see settled()."""
    docs = settled(docs.select("doc_id", "text", *(c for c in keep if c != "text")), "suffix-docs", stable)
    few, shards = docs.select("doc_id", "text"), exchange.shards_of(docs)
    anchors = written(exchange.answer(exchange.ask(few, _ask_anchors(shards, length), _ANCHORS, shards), shards, partial(_reply_anchors, batch=batch)), "anchors")
    windows = written(exchange.answer(exchange.ask_again(exchange.texts(few).unionAll(anchors), _ask_windows(shards, length), _WINDOWS, shards), shards, partial(_reply_windows, batch=batch)), "windows")
    longs, kinds = T.ArrayType(T.LongType()), (T.LongType(), T.LongType())
    schema = T.StructType([*(T.StructField(c, k) for c, k in zip(("doc_id", "n_bytes", "span_starts", "span_ends", "kept"), (*kinds, longs, longs, T.BinaryType()), strict=True)), *(docs.schema[c] for c in keep)])
    return exchange.meet(exchange.texts(docs).unionAll(anchors).unionAll(windows), _cut(length, list(keep)), schema)


def repeat_digests(removed: DataFrame) -> DataFrame:
    gone = F.aggregate(F.zip_with("span_ends", "span_starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda x, y: x + y)
    return removed.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("span_starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
