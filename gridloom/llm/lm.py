"""Language-model scoring with an Elias-Fano n-gram trie.

The texts of a block (exchange.py), each between a start and an end that count as words, are runs of words of every
length up to the model's order. A run goes to the shard of its first word. A shard adds up the counts of the training
texts and builds its part of the trie: the first words with their counts; then, level by level, for each run of the
level before a pointer to its successors, which only grows and so is an Elias-Fano sequence; the successors of all runs
one after another as a second such sequence, relative to their context; and beside each its discounted probability in 8
bits, and the weight left to the lower order in 16. The levels lie in one memory map and are searched in place, each
within the range that the level before gave: a successor search relative to a context of up to order - 1 words.

score() trains and scores in one pass: a block asks for what it has, whether it is trained on or not, and the answers
meet its texts. train() writes the shards' levels as a table instead, which score_with() loads again for other texts.

p(w | c) = max(n(cw) - d, 0) / n(c) + d * n1(c) / n(c) * p(w | c') with c' one word shorter, and p(w) = (n(w) + 1) /
(N + V + 1): absolute discounting of runs over add-one unigrams, p(w | c') where c never came before. Words are the runs
between ASCII blanks, A-Z lower-cased. A word is a 64-bit hash, a successor 32 bits of one: an unseen run is mistaken
for a seen one about once in 2**32 over the number of its context's successors.

Defined cases: null text is empty and has the end alone; a null doc_id is never trained on and not held out; repeated
rows count and are scored each; a very long text is in one block (exchange.py says what it takes); an empty table gives
no rows, and an empty model scores by p(w) = 1. Other columns, also those named like results, are not read.
"""

from __future__ import annotations

import mmap
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm import exchange, tokens
from gridloom.llm.common import settled, written
from gridloom.llm.elias_fano import EliasFano

START, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
SCORES = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_HALF = np.uint64(32)
#: The logarithms that 8-bit probabilities and 16-bit weights stand for; 0 stands for none.
_ALPHA = np.concatenate([[0.0], 10.0 ** np.linspace(-8, 0, 255)])
_REST = np.concatenate([[0.0], 10.0 ** np.linspace(-8, 0, 65535)])


def _quantise(x: np.ndarray, book: np.ndarray, kind: type) -> np.ndarray:
    at = np.round((np.log10(np.maximum(x, 1e-8)) + 8) / 8 * (len(book) - 2)) + 1
    return np.where(x > 0, at, 0).astype(kind)


class Grams:
    """The runs of up to order words in a block of texts.

    words: distinct hashes, ascending. ids[k]: of each run of k words, in order, its number among the distinct ones.
    keys[k]: for each distinct run of k words, ascending, the number of its first k - 1 and 32 bits of its last one.
    """

    def __init__(self, tables: list[pa.Table], order: int) -> None:
        streams, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for table in tables:
            w = tokens.words(table["text"].combine_chunks())
            size = np.diff(w.first) + 2
            ends = np.cumsum(size)
            stream = np.empty(ends[-1] if len(ends) else 0, np.uint64)
            inner = np.ones(len(stream), bool)
            inner[ends - size] = inner[ends - 1] = False
            stream[ends - size], stream[ends - 1], stream[inner] = START, END, w.hashes
            streams.append(stream)
            sizes.append(size)
        stream, self.sizes = np.concatenate(streams), np.concatenate(sizes)
        del streams
        self.left = np.repeat(np.cumsum(self.sizes), self.sizes).astype(np.int32) - np.arange(len(stream), dtype=np.int32)
        self.words, ids = np.unique(stream, return_inverse=True)
        self.ids, self.keys, half = {1: ids.astype(np.int32)}, {}, (stream >> _HALF).astype(np.uint32)
        del stream, ids
        for k in range(2, order + 1):
            before = self.ids[k - 1][self.left[self.left >= k - 1] >= k]
            self.keys[k], ids = np.unique((before.astype(np.uint64) << _HALF) | half[np.flatnonzero(self.left >= k) + k - 1], return_inverse=True)
            self.ids[k] = ids.astype(np.int32)

    def counts(self, k: int, learn: np.ndarray) -> np.ndarray:
        """How often each distinct run of k words is in the texts to learn. A single start isn't counted."""
        some = np.repeat(learn, self.sizes)
        if k == 1:
            some[np.cumsum(self.sizes) - self.sizes] = False
        return np.bincount(self.ids[k][some[self.left >= k]], minlength=len(self.words) if k == 1 else len(self.keys[k])).astype(np.uint32)

    def parts(self, shards: int, learn: np.ndarray) -> Iterator[exchange.Part]:
        """For each shard its words (steps, counts), and by order the runs: how many each shorter one has, the last words' halves, and counts."""
        counts = {1: self.counts(1, learn)} | {k: self.counts(k, learn) for k in self.keys}
        fans = {k: np.searchsorted(self.keys[k] >> _HALF, np.arange(len(counts[k - 1]) + 1, dtype=np.uint64)) for k in self.keys}
        for s, part in exchange.runs(exchange.shard_of(self.words, shards)):
            i, j = part.start, part.stop
            arrays = [exchange.steps(self.words[i:j]), counts[1][i:j]]
            for k, keys in self.keys.items():
                fan = fans[k][i : j + 1]
                i, j = fan[0], fan[-1]
                arrays += [np.diff(fan).astype(np.uint32), (keys[i:j] & np.uint64(0xFFFFFFFF)).astype(np.uint32), counts[k][i:j]]
            yield 0, s, arrays


def _learn(tables: list[pa.Table]) -> np.ndarray:
    return np.concatenate([np.zeros(0, bool), *(t["learn"].combine_chunks().to_numpy(zero_copy_only=False) for t in tables)])


def _ask(shards: int, order: int):
    wide = exchange.width(shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, pieces in exchange.blocks(batches):
            tables = [t for _, t in pieces]
            yield from exchange.rows(block, 0, Grams(tables, order).parts(shards, _learn(tables)), wide)

    return run


class Trie:
    """One shard's levels in one memory map."""

    def __init__(self, arrays: exchange.Arrays, sizes: list[int]) -> None:
        """arrays: words, counts, weights after words; then for each longer run its probabilities, weights after them, and the two sequences' arrays. sizes: of the two sequences of each level, length and lower bits."""
        places, size = [], 0
        for x in arrays:
            places.append(size)
            size += -(-x.nbytes // 8) * 8
        held, mapped = mmap.mmap(-1, size + 8), []
        for at, x in zip(places, arrays, strict=True):
            held[at : at + x.nbytes] = np.ascontiguousarray(x).tobytes()
            mapped.append(np.frombuffer(held, x.dtype, len(x), at))
        self.sizes = sizes
        self.words, self.counts, self.rest = mapped[:3]
        self.levels = []
        for k in range((len(mapped) - 3) // 8):
            alpha, rest, *more = mapped[3 + 8 * k : 11 + 8 * k]
            sequences = [EliasFano(*sizes[4 * k + 2 * n : 4 * k + 2 * n + 2], *more[3 * n : 3 * n + 3]) for n in (0, 1)]
            self.levels.append((alpha, rest, *sequences))
        self.arrays = mapped

    @classmethod
    def build(cls, asked: list[exchange.Arrays], discount: float) -> Trie:
        """From all that was asked (Grams.parts)."""
        words, number = np.unique(np.concatenate([exchange.total(x[0]) for x in asked]), return_inverse=True)
        counts = np.bincount(number, np.concatenate([x[1] for x in asked]), len(words)).astype(np.uint64)
        levels, sizes, n_before = [], [], len(words)
        for k in range(2, len(asked[0]), 3):
            fan, successor, seen = (np.concatenate([x[k + i] for x in asked]) for i in range(3))
            context = np.repeat(number, fan)
            learned = seen > 0
            key = (context[learned].astype(np.uint64) << _HALF) | successor[learned].astype(np.uint64)
            keys, ids = np.unique(key, return_inverse=True)
            times = np.bincount(ids, seen[learned], len(keys))
            number = np.zeros(len(seen), np.int64)  # what wasn't learned has no successors that were
            number[learned] = ids
            levels.append((keys, times, n_before))
            n_before = len(keys)
        arrays = [words, counts]
        for k, (keys, times, n) in enumerate(levels):
            start = np.searchsorted(keys >> _HALF, np.arange(n + 1, dtype=np.uint64))
            after = np.diff(np.concatenate([[0.0], np.cumsum(times)])[start])
            rest = _quantise(np.where(after > 0, discount * np.diff(start) / np.maximum(after, 1), 1.0), _REST, np.uint16)
            alpha = _quantise(np.maximum(times - discount, 0) / np.maximum(after[(keys >> _HALF).astype(np.int64)], 1), _ALPHA, np.uint8)
            if k:
                arrays.insert(len(arrays) - 6, rest)  # beside the probabilities of the level before
            else:
                arrays.append(rest)
            pointers, successors = EliasFano.encode(start, len(keys) + 1), EliasFano.encode(keys, max(1, n) << 32)
            arrays += [alpha, *pointers.arrays(), *successors.arrays()]
            sizes += [pointers.n, pointers.l, successors.n, successors.l]
        if levels:
            arrays.insert(len(arrays) - 6, np.zeros(0, np.uint16))  # nothing comes after the longest runs
        else:
            arrays.append(np.zeros(0, np.uint16))
        return cls(arrays, sizes)

    def look_up(self, asked: exchange.Arrays) -> exchange.Arrays:
        """Counts of words and weights after them; for each longer run its probability, and the weight after it (but for the longest)."""
        word = exchange.total(asked[0])
        at = np.minimum(np.searchsorted(self.words, word), max(0, len(self.words) - 1))
        at = np.where(self.words[at] == word, at, -1) if len(self.words) else np.full(len(word), -1)
        none = _REST.size - 1  # all weight is left to the lower order
        found = lambda values, at, default, kind: np.where(at >= 0, values[np.maximum(at, 0)], default).astype(kind) if len(values) else np.full(len(at), default, kind)
        out = [found(self.counts, at, 0, np.uint32), found(self.rest, at, none, np.uint16)]
        for k, (alpha, rest, pointers, successors) in enumerate(self.levels):
            fan, successor = asked[2 + 3 * k], asked[3 + 3 * k].astype(np.uint64)
            there = np.maximum(at, 0)
            low, high = (np.where(at >= 0, pointers.get(there + i).astype(np.int64), 0) if len(at) else there for i in (0, 1))
            context = np.repeat(np.arange(len(fan)), fan)
            at = successors.find(low[context], high[context], (there[context].astype(np.uint64) << _HALF) | successor) if len(successor) else np.zeros(0, np.int64)
            out.append(found(alpha, at, 0, np.uint8))
            if k < len(self.levels) - 1:
                out.append(found(rest, at, none, np.uint16))
        return out

    def totals(self) -> np.ndarray:
        return np.array([self.counts.sum(), (self.counts > 0).sum()], np.int64)


def _reply(discount: float):
    def run(asked: list[exchange.Arrays]) -> Iterator[exchange.Arrays]:
        trie = Trie.build(asked, discount)
        for x in asked:
            yield trie.look_up(x)
        yield [trie.totals()]

    return run


def _score(train_tokens: int, train_words: int, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, pieces in exchange.met(batches):
            tables, got = [], []
            for _, table, answers in pieces:
                tables.append(table)
                got += answers.get(0, [])
            g = Grams(tables, order)
            counts, rest, *more = (np.concatenate(x) for x in zip(*got, strict=True))
            if len(counts) != len(g.words) or any(len(x) != len(g.keys[k // 2 + 2]) for k, x in enumerate(more)):
                raise ValueError(f"block {name} asked for {len(g.words)} words and got {len(counts)}, or as for longer runs")
            first = np.cumsum(g.sizes) - g.sizes
            c = counts[g.ids[1]].astype(np.float64)
            base = (c + 1) / (train_tokens + train_words + 1)
            p = base.copy()
            for k in range(2, order + 1):
                alpha, here = more[2 * k - 4], np.flatnonzero(g.left >= k)
                before = g.ids[k - 1][g.left[g.left >= k - 1] >= k]
                p[here + k - 1] = _ALPHA[alpha[g.ids[k]]] + _REST[rest[before]] * p[here + k - 1]
                rest = more[2 * k - 3] if k < order else None
            base[first] = p[first] = 1.0  # the starts
            c[first] = 0
            add = lambda x: pa.array(np.add.reduceat(x, first) if len(first) else np.zeros(0))
            columns = [
                pa.chunked_array([x for t in tables for x in t["doc_id"].chunks], pa.int64()).combine_chunks(),
                pa.array(g.sizes - 1),
                add((c > 0).astype(np.int64)).cast(pa.int64()),
                pa.array(np.full(len(first), train_tokens)),
                add(np.log10(base)),
                add(np.log10(np.maximum(p, 1e-300))),
            ]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCORES.split(", ")])

    return run


def _totals(rows: DataFrame) -> tuple[int, int]:
    """Tokens and distinct words learned, from one row of two numbers for each shard."""
    sums = [exchange.unpack(bytes(r["data"]))[0] for r in rows.select("data").collect()]
    return int(sum(x[0] for x in sums)), int(sum(x[1] for x in sums))


def _asked(docs: DataFrame, learn: Column, shards: int, order: int) -> DataFrame:
    return docs.select("doc_id", "text", F.coalesce(learn, F.lit(False)).alias("learn")).mapInArrow(_ask(shards, order), exchange.ROWS)


def _scored(docs: DataFrame, answers: DataFrame, n: int, v: int, order: int) -> DataFrame:
    return exchange.together(exchange.texts(docs).unionAll(answers)).mapInArrow(_score(n, v, order), SCORES)


def score(docs: DataFrame, learn: Column, discount: float = 0.75, order: int = 3, stable: bool = False) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score (unigrams alone) and score of docs (doc_id, text), by a model of the rows for which learn holds. stable: see settled()."""
    docs = settled(docs.select("doc_id", "text"), "lm-docs", stable)
    shards = exchange.shards_of(docs)
    answers = written(exchange.answer(_asked(docs, learn, shards, order), shards, _reply(discount)), "lm-answers")
    closing = F.col("block") == exchange.CLOSING
    return _scored(docs, answers.filter(~closing), *_totals(answers.filter(closing)), order)


MODEL = "shard int, shards int, levels int, totals binary, sizes array<long>, data binary"


def train(docs: DataFrame, discount: float = 0.75, order: int = 3, stable: bool = False) -> DataFrame:
    """The model of all docs (doc_id, text), a row for each shard: MODEL. It can be written and read again."""
    docs = settled(docs.select("doc_id", "text"), "lm-docs", stable)
    shards = exchange.shards_of(docs)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, asked in exchange.asked_by_shard(batches):
            trie = Trie.build([x for _, parts in asked for *_, x in parts], discount)
            yield pa.RecordBatch.from_pylist([{"shard": shard, "shards": shards, "levels": order, "totals": exchange.pack(trie.totals()), "sizes": trie.sizes, "data": exchange.pack(*trie.arrays)}], pa.schema([("shard", pa.int32()), ("shards", pa.int32()), ("levels", pa.int32()), ("totals", pa.binary()), ("sizes", pa.list_(pa.int64())), ("data", pa.binary())]))

    return exchange.to_shards(_asked(docs, F.lit(True), shards, order), shards).repartitionById(shards, "shard").mapInArrow(build, MODEL)


def score_with(docs: DataFrame, model: DataFrame, stable: bool = False) -> DataFrame:
    """As score(), by a model that train() made. A shard's levels and what is asked of it meet in one task."""
    docs = settled(docs.select("doc_id", "text"), "lm-docs", stable)
    if (head := model.select("shards", "levels").first()) is None:
        head = {"shards": 1, "levels": 1}
    shards, order = head["shards"], head["levels"]
    n, v = _totals(model.select(F.col("totals").alias("data")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[int, Trie] = {}
        for batch in batches:  # a shard's levels come first
            for row in batch.to_pylist():
                if row["levels"] is not None:
                    tries = {row["shard"]: Trie(exchange.unpack(row["data"]), row["sizes"])}
                else:
                    trie = tries.get(row["shard"]) or Trie([np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint16), *([np.zeros(0, np.uint8), np.zeros(0, np.uint16), *EliasFano.encode(np.zeros(2, np.int64), 1).arrays(), *EliasFano.encode(np.zeros(0, np.uint64), 1).arrays()] * (order - 1))], [2, 0, 0, 0] * (order - 1))
                    yield exchange.batch_of([(row["block"], 0, row["shard"], exchange.pack_parts([(*where, trie.look_up(x)) for *where, x in exchange.unpack_parts(row["data"])]))])

    asked = exchange.to_shards(_asked(docs, F.lit(False), shards, order), shards).select("shard", F.lit(None).cast("int").alias("levels"), "block", F.lit(None).cast("array<long>").alias("sizes"), "data")
    levels = model.select("shard", "levels", F.lit(None).cast("long").alias("block"), "sizes", "data")
    # a block is named by its task's place, so blocks come first in a union
    met = asked.unionByName(levels).repartitionById(shards, "shard").sortWithinPartitions("shard", F.col("levels").desc_nulls_last(), "block")
    return _scored(docs, written(exchange.to_blocks(met.mapInArrow(run, exchange.ROWS), shards), "lm-answers"), n, v, order)
