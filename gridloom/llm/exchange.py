"""Packed exchanges between blocks of documents and shards of keys.

An operator that needs something global about each word, shingle or anchor of a text would shuffle a row for each of
them. Instead a block of documents sends each shard of the key space one row with all it has there, as sorted, packed
arrays; the shard answers each block in the order it was asked; and the answers meet the block's texts again. Blocks
are made afresh where they are needed, from the same files in the same order, so an answer fits what was asked; answers
that don't fit fail the job.

A block is about an input split. It is worked on in pieces of about a MB, which bounds the arrays in memory; a piece has
its own arrays in the row. One text is never split: a task needs some sixty times the size of the longest text for a
moment. A shard's task holds all that it was asked, so the number of shards grows with the bytes of the texts and each
is asked about what SHARD_BYTES of texts ask in the mean; keys are spread by hash, and equal keys of one piece are asked
once where the operator allows it.

Blocks and shards both grow with the corpus, so a row for each pair of them would make their number grow with its
square. Beyond ONE_STEP shards a question therefore goes in two steps: a block's row is for a group of as many shards as
the root of their number; a cell, which is a group of blocks and one of shards, meets in one task, which makes of it a row
for each shard; and answers come back through the same cells. Rows then grow with the corpus to the power of three
halves while a cell, a few tens of MB, does not grow.
"""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridloom.llm.common import partitions

#: Bytes of text in one piece, whose arrays take some sixty times as much for a moment, and pieces in one block.
PIECE_BYTES, PIECES = 1 << 20, 12
#: Bytes of texts for each shard at most, in the mean.
SHARD_BYTES = 64 << 20
#: Shards that blocks send to directly at most.
ONE_STEP = 1024
ROWS = "block long, kind int, shard int, data binary"
TEXTS = -1
#: The block of what a shard says when it has answered all.
CLOSING = -1
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
Arrays = list[np.ndarray]
#: A piece's number, the shard, and what it is asked or answers.
Part = tuple[int, int, Arrays]
#: The same with the block before the shard and the piece after it.
Full = tuple[int, int, int, Arrays]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed value. Bytes of equal weight stand together, so that small numbers take little."""
    parts = [len(arrays).to_bytes(4, "little")]
    for x in arrays:
        x = np.ascontiguousarray(x)
        parts += [x.dtype.str.encode().ljust(4), len(x).to_bytes(8, "little"), np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.dtype.itemsize).T).tobytes()]
    return zstandard.ZstdCompressor(1).compress(b"".join(parts))


def unpack(data: bytes) -> Arrays:
    raw = zstandard.decompress(data)
    out, at = [], 4
    for _ in range(int.from_bytes(raw[:4], "little")):
        kind, n = np.dtype(raw[at : at + 4].decode().strip()), int.from_bytes(raw[at + 4 : at + 12], "little")
        at += 12
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel() if n else np.zeros(0, kind))
        at += n * kind.itemsize
    return out


def pack_parts(parts: list[Full]) -> bytes:
    blocks, shards, pieces, arrays = zip(*parts, strict=True)
    return pack(np.array(blocks, np.int64), np.array(shards, np.uint32), np.array(pieces, np.uint32), np.array([len(x) for x in arrays], np.uint32), *(y for x in arrays for y in x))


def unpack_parts(data: bytes) -> list[Full]:
    blocks, shards, pieces, sizes, *arrays = unpack(data)
    ends = np.cumsum(sizes)
    return [(int(b), int(s), int(k), arrays[int(e) - int(n) : int(e)]) for b, s, k, n, e in zip(blocks, shards, pieces, sizes, ends, strict=True)]


def steps(x: np.ndarray) -> np.ndarray:
    """The differences of an ascending array; total() undoes it."""
    return np.diff(x, prepend=x.dtype.type(0))


def total(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x, dtype=x.dtype)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shards of 64-bit keys. A shard is a range of keys."""
    return (keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)


def runs(of: np.ndarray) -> list[tuple[int, slice]]:
    """Each shard that occurs in ascending ones, and where."""
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(of)), bool), of[1:] != of[:-1]]))
    return [(int(of[i]), slice(int(i), int(j))) for i, j in zip(first, np.append(first, len(of))[1:], strict=True)]


def width(shards: int) -> int:
    """How many shards a block's row is for."""
    return 1 if shards <= ONE_STEP else math.isqrt(shards)


def ids_array(ids: pa.ChunkedArray) -> Arrays:
    """Ids and which of them are null, for pack()."""
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    return [ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)]


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["block", "kind", "shard", "data"])


def rows(block: int, kind: int, parts: Iterator[Part], wide: int) -> Iterator[pa.RecordBatch]:
    """A block's rows, one for each group of so many shards, in batches of about a MB."""
    by_group: dict[int, list[Full]] = {}
    for piece, shard, arrays in parts:
        by_group.setdefault(shard // wide, []).append((block, shard, piece, arrays))
    out, size = [], 0
    for g in sorted(by_group):
        out.append((block, kind, g, pack_parts(by_group.pop(g))))
        size += len(out[-1][-1])
        if size >= PIECE_BYTES:
            yield batch_of(out)
            out, size = [], 0
    if out:
        yield batch_of(out)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts that are over PIECE_BYTES only by their last text."""
    if batch.column("text").nbytes <= PIECE_BYTES:
        yield batch
        return
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // PIECE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(i, j - i)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, size = [], 0
    for whole in batches:
        for batch in _slices(whole):
            held.append(batch)
            size += batch.column("text").nbytes
            if size >= PIECE_BYTES:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[int, pa.Table]]]]:
    """Each block must be read to its end before the next."""
    pieces, block = _pieces(batches), TaskContext.get().partitionId() << 32
    for first in pieces:

        def whole(first: pa.Table = first) -> Iterator[tuple[int, pa.Table]]:
            yield 0, first
            for k in range(1, PIECES):
                if (piece := next(pieces, None)) is None:
                    return
                yield k, piece

        yield block, whole()
        block += 1
    tidy()


def shards_of(docs: DataFrame) -> int:
    """How many shards: as many as shuffle partitions, or more if the texts are more than SHARD_BYTES for each."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(partitions(docs.sparkSession), -(-size // SHARD_BYTES))


def tidy() -> None:
    """Gives memory that Arrow and numpy have done with back to the system: an idle worker should hold little."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def ask(docs: DataFrame, questions: Callable[[pa.Table], Iterator[tuple[int, Arrays]]], kind: int, shards: int) -> DataFrame:
    """Rows from blocks to shards or groups of them. questions: gives (shard, arrays) for a piece of docs, which has a column text."""
    wide = width(shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, pieces in blocks(batches):
            yield from rows(block, kind, ((k, shard, arrays) for k, table in pieces for shard, arrays in questions(table)), wide)

    return docs.mapInArrow(run, ROWS)


def _through_cells(df: DataFrame, shards: int, forth: bool) -> DataFrame:
    """Rows of a block and a group of shards become rows of a group of blocks and a shard (forth), or the other way round."""
    if (wide := width(shards)) == 1:
        return df
    cell = [F.expr(f"shiftright(block, 32) div {wide}"), F.col("shard").cast("long")] if forth else [F.col("block"), F.expr(f"shard div {wide}")]

    def turned(block: int, kind: int, group: int, parts: list[Full]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[Full]] = {}
        for part in parts:
            by.setdefault(part[1] if forth else part[0], []).append(part)
        for k in sorted(by):
            data = pack_parts(sorted(by.pop(k), key=lambda x: x[:3]))
            yield batch_of([(block, kind, k, data) if forth else (k, kind, group, data)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for block, kind, shard, data, *here in zip(*(batch.column(c).to_pylist() for c in ("block", "kind", "shard", "data", "blocks", "shards")), strict=True):
                if block == CLOSING:
                    yield batch_of([(block, kind, shard, data)])
                    continue
                if (mine := (here[0], kind, here[1])) != now:
                    if held:
                        yield from turned(*now, held)
                    now, held = mine, []
                held += unpack_parts(data)
        if held:
            yield from turned(*now, held)
        del held
        tidy()

    cells = df.select("*", cell[0].alias("blocks"), cell[1].alias("shards"))
    return cells.repartition(shards, "blocks", "shards").sortWithinPartitions("blocks", "kind", "shards", "block", "shard").mapInArrow(run, ROWS)


def to_shards(asked: DataFrame, shards: int) -> DataFrame:
    """What blocks ask, as rows for single shards."""
    return _through_cells(asked, shards, True)


def to_blocks(answers: DataFrame, shards: int) -> DataFrame:
    """What shards answer, as rows for single blocks."""
    return _through_cells(answers, shards, False)


def asked_by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[tuple[int, int], list[Full]]]]]:
    """Each shard with all that it was asked: block or group of blocks and kind, and parts, in the order of the blocks."""
    by_shard: dict[int, list] = {}
    for batch in batches:
        for row in batch.to_pylist():
            by_shard.setdefault(row["shard"], []).append(((row["block"], row["kind"]), unpack_parts(row["data"])))
    for shard, got in by_shard.items():
        got.sort(key=lambda x: x[0])
        yield shard, got
    del by_shard
    tidy()


def answer(asked: DataFrame, shards: int, reply: Callable[[list[Arrays]], Iterator[Arrays]]) -> DataFrame:
    """Rows back from shards to blocks. reply: gets all that one shard was asked, part by part, and gives an answer to each in order, and one more at most, which is a row of block CLOSING."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, got in asked_by_shard(batches):
            answers = iter(reply([x for _, parts in got for *_, x in parts]))
            for (block, kind), parts in got:
                yield batch_of([(block, kind, shard, pack_parts([(*where, next(answers)) for *where, _ in parts]))])
            for arrays in answers:
                yield batch_of([(CLOSING, got[0][0][1], shard, pack(*arrays))])

    return to_blocks(to_shards(asked, shards).repartitionById(shards, "shard").mapInArrow(run, ROWS), shards)


def texts(docs: DataFrame) -> DataFrame:
    """Rows that carry the blocks' own columns, compressed, a piece in each record batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, pieces in blocks(batches):
            sink, out = pa.BufferOutputStream(), None
            packed = pa.CompressedOutputStream(sink, "zstd")
            for _, table in pieces:
                out = out or pa.ipc.new_stream(packed, table.schema)
                out.write_table(table.combine_chunks())
            out.close()
            packed.close()
            yield batch_of([(block, TEXTS, -1, sink.getvalue().to_pybytes())])

    return docs.mapInArrow(run, ROWS)


def met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[int, pa.Table | None, dict[int, list[Arrays]]]]]]:
    """Each block's pieces: number, texts, and by kind the answers of the shards in order."""

    def whole(stream: bytes | None, got: dict[int, dict[int, list[Arrays]]]) -> Iterator[tuple[int, pa.Table | None, dict[int, list[Arrays]]]]:
        if stream is None:
            for k in sorted(got):
                yield k, None, got[k]
        else:
            for k, batch in enumerate(pa.ipc.open_stream(pa.CompressedInputStream(pa.BufferReader(stream), "zstd"))):
                yield k, pa.Table.from_batches([batch]), got.pop(k, {})

    now, stream, got = None, None, {}
    for batch in batches:
        for k in range(batch.num_rows):
            block, kind, data = batch["block"][k].as_py(), batch["kind"][k].as_py(), batch["data"][k].as_py()
            if block != now:
                if now is not None:
                    yield now, whole(stream, got)
                now, stream, got = block, None, {}
            if kind == TEXTS:
                stream = data
            else:
                for _, _, piece, arrays in unpack_parts(data):
                    got.setdefault(piece, {}).setdefault(kind, []).append(arrays)
    if now is not None:
        yield now, whole(stream, got)
    del stream, got
    tidy()


def together(df: DataFrame) -> DataFrame:
    """All rows of a block in one partition, by kind and shard."""
    return df.repartition("block").sortWithinPartitions("block", "kind", "shard")


def meet(df: DataFrame, work: Callable[[pa.Table | None, dict[int, list[Arrays]]], pa.RecordBatch | None], schema: str | StructType) -> DataFrame:
    """Brings all rows of a block together. work: gets a piece's texts, if they are among the rows, and its answers by kind, and gives rows of the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, pieces in met(batches):
            for _, table, got in pieces:
                if (out := work(table, got)) is not None:
                    yield out

    return together(df).mapInArrow(run, schema)


def ask_again(df: DataFrame, questions: Callable[[pa.Table, dict[int, list[Arrays]]], Iterator[tuple[int, Arrays]]], kind: int, shards: int) -> DataFrame:
    """As ask(), of blocks that meet earlier answers."""
    wide = width(shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, pieces in met(batches):
            yield from rows(block, kind, ((k, shard, arrays) for k, table, got in pieces for shard, arrays in questions(table, got)), wide)

    return together(df).mapInArrow(run, ROWS)
