"""Words, shingles and hashes of whole Arrow batches of texts, with numpy.

A batch is one byte array with document offsets, as Arrow holds it. A byte range is hashed eight bytes at a time, each
eight mixed by a bijection that is far from linear: ranges of up to eight bytes and equal length never collide, up to
sixteen they are chained, and longer ones add up their eights, each mixed with its place. Different ranges then have
equal hashes by a chance of 2**-64 a pair. What must not rest on that (the pre-tokens of BPE) compares bytes instead.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A-Z to a-z; every other byte stays.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: Bytes between words: tab to carriage return, and space.
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which each bit depends on all others."""
    y = x >> np.uint64(30)
    y ^= x
    y *= np.uint64(0xBF58476D1CE4E5B9)
    t = y >> np.uint64(27)
    y ^= t
    y *= np.uint64(0x94D049BB133111EB)
    np.right_shift(y, np.uint64(31), out=t)
    y ^= t
    return y


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes that start at each place, as one integer; zeros lie beyond the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each range, one range after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


_FIRST, _NEXT, _PLACE = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344), np.uint64(0xA4093822299F31D0)


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each range of bytes, which depends on its bytes and length alone."""
    x, size = eights(data), ends - starts
    part = np.minimum(size, 8).astype(np.uint64)
    # of fewer than eight bytes, the others are cut off
    head = np.where(part > 0, x[starts] << (np.uint64(64) - np.maximum(part, np.uint64(1)) * np.uint64(8)), np.uint64(0))
    h = mix(head ^ mix(size.astype(np.uint64) ^ _FIRST))
    more = np.flatnonzero(size > 8)
    middle = more[size[more] <= 16]
    # the last eight bytes may overlap the first: length and both tell all
    h[middle] = mix(h[middle] ^ _NEXT ^ mix(x[ends[middle] - 8]))
    long = more[size[more] > 16]
    if len(long):
        count = (size[long] - 1) // 8  # the eights after the first; the last ends where the range does
        place = ragged(np.zeros(len(long), np.int64), count)
        at = np.minimum(np.repeat(starts[long] + 8, count) + 8 * place, np.repeat(ends[long] - 8, count))
        parts = mix(x[at] ^ mix(place.astype(np.uint64) + _PLACE))
        h[long] = mix(h[long] ^ mix(np.add.reduceat(parts, np.cumsum(count) - count)))
    return h


def text_bytes(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes, and where each text starts and the last one ends. A null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type) and not pa.types.is_large_binary(texts.type):
        texts = texts.cast(pa.large_binary() if pa.types.is_binary(texts.type) else pa.large_string())
    if texts.null_count:
        texts = pc.fill_null(texts, b"" if pa.types.is_large_binary(texts.type) else "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


@dataclass
class Words:
    """The words of a batch in order. doc: each word's text; first: where each text's words start, and the last one's end."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    hashes: np.ndarray


def words(texts: pa.Array, fold: bool = True) -> Words:
    data, offsets = text_bytes(texts)
    if fold:
        data = FOLD[data]
    inner = ~BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inner[:-1]])[: len(data)] & ~edge[:-1]
    starts = np.flatnonzero(inner & ~before)
    after = np.concatenate([inner[1:], [False]])[: len(data)] & ~edge[1:]
    ends = np.flatnonzero(inner & ~after) + 1
    first = np.searchsorted(starts, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(data, starts, ends, doc, first, range_hashes(data, starts, ends))


def ngrams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words within a text, in order, and each one's text."""
    if len(w.hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(w.hashes) - n + 1
    h = w.hashes[:m].copy()
    for i in range(1, n):
        h = mix(h + _NEXT) ^ w.hashes[i : m + i]
    inside = w.doc[:m] == w.doc[n - 1 :]
    return mix(h[inside] + np.uint64(n)), w.doc[:m][inside]


def shingle_sets(w: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Each text's set of n-word shingles as sorted distinct hashes, one after the other, and where each starts, and the last one ends. A text with fewer words has the run of all of them as its only shingle; one without words has none."""
    h, doc = ngrams(w, n)
    size = np.diff(w.first)
    if len(short := np.flatnonzero((size > 0) & (size < n))):
        extra = np.zeros(len(short), np.uint64)
        for k, d in enumerate(short):
            x = w.hashes[w.first[d] : w.first[d] + 1]
            for i in range(w.first[d] + 1, w.first[d + 1]):
                x = mix(x + _NEXT) ^ w.hashes[i : i + 1]
            extra[k] = (x + np.uint64(size[d]))[0]
        h, doc = np.concatenate([h, mix(extra)]), np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        h, doc = h[order], doc[order]
    return distinct(h, doc, len(size))


def distinct(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of each document; doc ascends."""
    at = np.searchsorted(doc, np.arange(n + 1))
    h = h.copy()
    for i in range(n):
        h[at[i] : at[i + 1]].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[keep], np.concatenate([[0], np.cumsum(keep)])[at]
