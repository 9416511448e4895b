"""Byte-level BPE over a global shuffle of distinct pre-tokens.

Texts are cut into pre-tokens by runs of character classes, which gives the matches of the split pattern. A block of
texts (exchange.py) knows its pre-tokens as positions in its own list of distinct ones. Each distinct pre-token goes to
the shard its hash names, where every different one is encoded once; the ids come back to the blocks that asked, which
put them together by position. Hashes choose shards only: what is distinct is told by comparing bytes. A list that
doesn't fit the ids that came back fails the job.

Decoding joins the ids with the table of token bytes, which has one row for each id and so is bounded by the vocabulary:
the table is broadcast and joined where the ids lie, a batch of documents at a time. (The same join in DataFrame
functions, a table in one row and transform() over a document's ids, copies the table for every document.)

Defined cases: null text is empty and has no ids; repeated rows are encoded each; a very long text is one piece of its
block (exchange.py says what it takes). Other columns, also those named like results, are not read. An id that the table
lacks fails the job.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import exchange, tokens
from gridloom.llm.common import settled

_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
ENCODED = "doc_id long, n_tokens long, ids binary"


@functools.lru_cache(1)
def _classes() -> np.ndarray:
    """Each code point's class in the split pattern: a letter, a number, a space or another."""
    out = np.full(0x110000, _OTHER, np.uint8)
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(pattern, points):
            out[np.fromiter(map(ord, m[0]), np.int64)] = kind
    out[[0x1C, 0x1D, 0x1E, 0x1F]] = _OTHER  # separators that are no white space in Unicode
    return out


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each character's code point and first byte, of valid UTF-8."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.int32)
    points = lead.copy()
    for low, high, n in ((0xC0, 0xE0, 1), (0xE0, 0xF0, 2), (0xF0, 0x100, 3)):
        k = np.flatnonzero((lead >= low) & (lead < high))
        value = lead[k] & (0x3F >> n)
        for i in range(1, n + 1):
            value = (value << 6) | (data[at[k] + i] & 0x3F)
        points[k] = value
    return points, at


def pre_tokens(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where each match of the split pattern starts, in bytes; texts lie one after another and each ends a match."""
    if not len(data):
        return np.zeros(0, np.int64)
    ch, at = code_points(data)
    n = len(ch)
    kind = _classes()[ch]
    fresh = np.zeros(n + 1, bool)
    fresh[np.searchsorted(at, offsets)] = True
    begins = fresh[:n].copy()
    begins[0] = True
    begins[1:] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(begins)
    ends = np.append(runs[1:], n)
    # a run of spaces leaves its last one, which a blank gives to the run that follows
    left = ends[(kind[runs] == _SPACE) & ~fresh[ends]]
    cut = begins.copy()
    cut[left - 1] = True
    cut[left[ch[left - 1] == 32]] = False
    # an apostrophe that starts a match takes the letters of a contraction
    one = runs[(ends - runs == 1) & (ch[runs] == 39) & cut[runs] & (ends < n)]
    one = one[(kind[one + 1] == _LETTER) & ~fresh[one + 1]]
    second = ch[one + 1]
    short = np.isin(second, [ord(x) for x in "stmd"])
    third = ch[np.minimum(one + 2, n - 1)]
    inside = (one + 2 < n) & ~begins[np.minimum(one + 2, n - 1)]
    long = inside & (((third == ord("e")) & ((second == ord("r")) | (second == ord("v")))) | ((third == ord("l")) & (second == ord("l"))))
    cut[one[short | long] + 1] = False
    for taken, length in ((short, 2), (long, 3)):
        rest = one[taken] + length
        cut[rest[rest < n]] = True  # if the letters end there, the next run starts a match anyway
    return at[np.flatnonzero(cut)]


def _binary(sizes: np.ndarray, data: np.ndarray) -> pa.Array:
    at = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])


class Block:
    """The distinct pre-tokens of a block of texts, shard by shard. places: for each piece, its pre-tokens' numbers among them, and how many each text has."""

    def __init__(self, tables: Iterator[pa.Table], shards: int, positions: bool) -> None:
        words, self.places = [pa.array([], pa.large_binary())], []
        for table in tables:
            data, offsets = tokens.text_bytes(table["text"])
            starts = pre_tokens(data, offsets)
            found = _binary(np.diff(np.append(starts, len(data))), data).dictionary_encode()
            words.append(found.dictionary)
            if positions:
                self.places.append((found.indices.to_numpy(), np.diff(np.searchsorted(starts, offsets))))
        sizes = [len(x) for x in words[1:]]
        found = pa.concat_arrays(words).dictionary_encode()
        data, at = tokens.text_bytes(found.dictionary)
        of = exchange.shard_of(tokens.range_hashes(data, at[:-1], at[1:]), shards)
        order = np.argsort(of, kind="stable")
        self.runs = exchange.runs(of[order])
        self.words = found.dictionary.take(pa.array(order))
        if positions:
            number = np.empty(len(order), np.int32)
            number[order] = np.arange(len(order), dtype=np.int32)
            number = number[found.indices.to_numpy()]
            ends = np.cumsum(sizes)
            self.places = [(number[end - size : end][i], per_text) for end, size, (i, per_text) in zip(ends, sizes, self.places, strict=True)]

    def questions(self) -> Iterator[exchange.Part]:
        data, at = tokens.text_bytes(self.words)
        for s, k in self.runs:
            yield 0, s, [np.diff(at[k.start : k.stop + 1]).astype(np.uint32), data[at[k.start] : at[k.stop]]]


def _ask(shards: int):
    wide = exchange.width(shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, pieces in exchange.blocks(batches):
            yield from exchange.rows(block, 0, Block((table for _, table in pieces), shards, False).questions(), wide)

    return run


def ranks_file(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


@functools.lru_cache(2)
def encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}, special_tokens={})


def _reply(ranks: object, pattern: str):
    def run(asked: list[exchange.Arrays]) -> Iterator[exchange.Arrays]:
        encode = encoding(ranks.value, pattern).encode_ordinary
        found = _binary(np.concatenate([x[0] for x in asked]), np.concatenate([x[1] for x in asked])).dictionary_encode()
        number = found.indices.to_numpy()
        ids = [np.array(encode(x.decode()), np.uint32) for x in found.dictionary.to_pylist()]
        sizes = np.array([len(x) for x in ids], np.int64)
        starts, flat, done = np.cumsum(sizes) - sizes, np.concatenate([np.zeros(0, np.uint32), *ids]), 0
        for lengths, _ in asked:
            mine = number[done : done + len(lengths)]
            done += len(lengths)
            yield [sizes[mine].astype(np.uint32), flat[tokens.ragged(starts[mine], sizes[mine])]]

    return run


def _assemble(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, pieces in exchange.met(batches):
            tables, got = [], []
            for _, table, answers in pieces:
                tables.append(table)
                got += answers.get(0, [])
            block = Block(iter(tables), shards, True)
            sizes = np.concatenate([np.zeros(0, np.int64), *(x[0].astype(np.int64) for x in got)])
            flat = np.concatenate([np.zeros(0, np.uint32), *(x[1] for x in got)])
            if len(sizes) != len(block.words):
                raise ValueError(f"block {name} asked for {len(block.words)} pre-tokens and got {len(sizes)}")
            starts = np.cumsum(sizes) - sizes
            for table, (number, per_text) in zip(tables, block.places, strict=True):
                ids = flat[tokens.ragged(starts[number], sizes[number])]
                at = np.concatenate([[0], np.cumsum(sizes[number])])[np.concatenate([[0], np.cumsum(per_text)])]
                packed = pa.Array.from_buffers(pa.binary(), len(table), [None, pa.py_buffer((4 * at).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks(), pa.array(np.diff(at)), packed], [x.split()[0] for x in ENCODED.split(", ")])

    return run


def encode(docs: DataFrame, path: str, pattern: str, stable: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) of docs (doc_id, text). stable: see settled()."""
    docs = settled(docs.select("doc_id", "text"), "bpe-docs", stable)
    shards, ranks = exchange.shards_of(docs), docs.sparkSession.sparkContext.broadcast(ranks_file(path))  # a MB or so
    answers = exchange.answer(docs.mapInArrow(_ask(shards), exchange.ROWS), shards, _reply(ranks, pattern))
    return exchange.together(exchange.texts(docs).unionAll(answers)).mapInArrow(_assemble(shards), ENCODED)


def token_bytes(spark: SparkSession, path: str) -> DataFrame:
    """id, bytes: the table of token bytes."""
    rows = [(int(b), base64.b64decode(a)) for a, b in map(bytes.split, ranks_file(path).splitlines())]
    return spark.createDataFrame(pa.table({"id": pa.array([x for x, _ in rows], pa.int32()), "bytes": pa.array([x for _, x in rows], pa.binary())}))


def decode(encoded: DataFrame, table: DataFrame) -> DataFrame:
    """encoded (doc_id, n_tokens, ids) with decoded, the bytes that the ids stand for by table (id, bytes): a broadcast join on the id, in Arrow batches."""
    rows = table.select("id", "bytes").toArrow()  # as large as the vocabulary
    held = encoded.sparkSession.sparkContext.broadcast((rows["id"].to_numpy(), *tokens.text_bytes(rows["bytes"])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, data, at = held.value
        place = np.full(int(known.max(initial=-1)) + 2, -1)  # the last stands for all above
        place[known] = np.arange(len(known))
        sizes = np.diff(at)
        for batch in batches:
            flat, ends = tokens.text_bytes(batch.column("ids"))
            ids = flat.view("<u4")
            found = place[np.minimum(ids, len(place) - 1)]
            if (found < 0).any():
                raise ValueError(f"no token has the id {ids[found < 0][0]}")
            total = np.concatenate([[0], np.cumsum(sizes[found])])[ends // 4]
            decoded = data[tokens.ragged(at[found], sizes[found])]
            out = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(total.astype(np.int64)), pa.py_buffer(decoded)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_tokens", "ids")), out], ["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, f"{ENCODED}, decoded binary")


def bpe_digests(decoded: DataFrame) -> DataFrame:
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
