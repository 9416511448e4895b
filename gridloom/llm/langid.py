"""Language ID: averaged embeddings of hashed subwords under a linear softmax, trained by SGD, with calibrated rejection.

Subwords are runs of two to four bytes of the text (A-Z lower-cased, blanks alike), hashed to 65 536 embeddings. The
logits of a text are its mean embedding times a matrix; as both are linear, scoring adds one row of per-subword logits
for each subword and divides, without a shuffle. At most ``max_rows`` documents of each language, chosen by a hash, go
to one task for training, and fewer of all languages alike if their texts would be over ``max_bytes``; a fifth of them are held back to fit a temperature, so that scores are probabilities, and the
score below which a text is rejected: that of all but the least certain hundredth of the right calls.

Defined cases: null texts and texts without a letter are ``und`` with score 0. Rows without an id or language are not
learned from. With no rows to learn from, every text is ``und``. Repeated rows are judged each. Other columns are not read.
A very long text is one value of its batch and the arrays of its runs take some fifty times its size for a moment; if it is among
those chosen, training is over ``max_bytes`` by what it has more than the mean. Over MAX_LANGS languages fail the job: map
rare ones to one name, or leave them out, before training.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import tokens

BITS, SIZE, NGRAMS = 16, 16, (2, 3, 4)
#: Languages that a model may have.
MAX_LANGS = 2_000
#: Bytes of a piece that training learns from, beside the whole text, so that short texts are known too.
PIECE = 400
_MULTIPLY = np.uint32(0x9E3779B1)
_SAME = tokens.FOLD.copy()
_SAME[np.flatnonzero(tokens.BLANK)] = 32


def subwords(data: np.ndarray) -> list[np.ndarray]:
    """For each length, the bucket of the run that starts at each byte."""
    x = _SAME[data].astype(np.uint32)
    out, key = [], x
    for n in range(2, max(NGRAMS) + 1):
        key = (key[:-1] << np.uint32(8)) | x[n - 1 :] if len(key) else key
        if n in NGRAMS:
            h = (key ^ (key >> np.uint32(15)) ^ np.uint32(n)) * _MULTIPLY
            out.append(((h ^ (h >> np.uint32(13))) * _MULTIPLY) >> np.uint32(32 - BITS))
    return out


def _bag(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    parts = subwords(np.frombuffer(text, np.uint8))
    i, c = np.unique(np.concatenate(parts), return_counts=True)
    return i, (c / max(1, c.sum())).astype(np.float32)


def _fit(epochs: int, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learn, check = [], []
        for batch in batches:
            for lang, text, held in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), batch.column("held").to_pylist(), strict=True):
                text = text.encode()
                if len(text) >= min(NGRAMS):
                    pieces = [text] if held else [text, *(text[i : i + PIECE] for i in range(0, len(text) if len(text) > PIECE else 0, PIECE))]
                    (check if held else learn).extend((lang, *_bag(x)) for x in pieces if len(x) >= max(NGRAMS))
        if not learn:
            return
        langs = sorted({x[0] for x in learn})
        number = {x: k for k, x in enumerate(langs)}
        rng = np.random.default_rng(7)
        embed = rng.uniform(-0.5, 0.5, (1 << BITS, SIZE)).astype(np.float32) / SIZE
        matrix = np.zeros((SIZE, len(langs)), np.float32)
        steps, k = epochs * len(learn), 0
        for _ in range(epochs):
            for j in rng.permutation(len(learn)):
                lang, i, x = learn[j]
                step = rate * (1 - k / steps)
                hidden = x @ embed[i]
                p = _softmax(hidden @ matrix)
                p[number[lang]] -= 1
                embed[i] -= np.outer(x, step * (matrix @ p))
                matrix -= step * np.outer(hidden, p)
                k += 1
        table = embed @ matrix
        logits = np.array([x @ table[i] for _, i, x in check]).reshape(len(check), len(langs))
        right = np.array([number.get(x[0], -1) for x in check], np.int64)
        known = right >= 0
        scale, reject = 1.0, 0.0
        if known.any():
            losses = {s: -np.log(np.maximum(1e-12, _softmax(logits[known] * s)[np.arange(known.sum()), right[known]])).mean() for s in 2.0 ** np.arange(-4, 4.25, 0.25)}
            scale = float(min(losses, key=losses.get))
            p = _softmax(logits[known] * scale)
            good = p.max(axis=1)[p.argmax(axis=1) == right[known]]
            reject = float(np.quantile(good, 0.01)) if len(good) else 0.0
        model = {"langs": langs, "table": (table * scale).astype(np.float32), "reject": reject}
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(pickle.dumps(model), 1)], pa.binary())], ["model"])

    return run


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(docs: DataFrame, max_rows: int = 500, max_bytes: int = 32 << 20, epochs: int = 3, rate: float = 4.0) -> dict:
    """A model from docs (doc_id, text, lang): {langs, table, reject}. At most about max_rows documents of each language and max_bytes of texts of all are learned from, chosen by a hash of the id: the bounds on the one training task."""
    usable = docs.select("doc_id", "text", "lang").filter("doc_id is not null and lang is not null and text is not null")
    counts = usable.groupBy("lang").agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).limit(MAX_LANGS + 1).collect()
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    part = {r["lang"]: min(1.0, max_rows / r["rows"]) for r in counts}
    fewer = min(1.0, max_bytes / max(1.0, sum(part[r["lang"]] * r["bytes"] for r in counts)))
    share = docs.sparkSession.createDataFrame([(k, x * fewer * (1 << 20)) for k, x in part.items()], "lang string, below double")
    # at most MAX_LANGS rows
    some = usable.join(F.broadcast(share), "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("below"))
    rows = some.select("lang", "text", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5)) == 0).alias("held"), F.xxhash64("doc_id", F.lit(2)).alias("place"))
    found = rows.repartition(1).sortWithinPartitions("place", "lang", "text").mapInArrow(_fit(epochs, rate), "model binary").collect()
    return pickle.loads(zlib.decompress(found[0]["model"])) if found else {"langs": [], "table": np.zeros((1 << BITS, 0), np.float32), "reject": 0.0}  # noqa: S301  made by this job


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score, rejected of docs (doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table, reject = (held.value[k] for k in ("langs", "table", "reject"))
        names = np.array([*langs, "und"], object)
        columns = [np.ascontiguousarray(table[:, k]) for k in range(len(langs))]
        for batch in batches:
            data, at = tokens.text_bytes(batch.column("text"))
            logits, count = np.zeros((len(at) - 1, len(langs))), np.zeros(len(at) - 1)
            for n, bucket in zip(NGRAMS, subwords(data), strict=True):
                ends = np.minimum(np.maximum(at[1:] - n + 1, at[:-1]), len(bucket))
                starts = np.minimum(at[:-1], len(bucket))
                count += ends - starts
                for k, column in enumerate(columns):
                    sums = np.concatenate([[0.0], np.cumsum(column[bucket], dtype=np.float64)])
                    logits[:, k] += sums[ends] - sums[starts]
            best, score = np.full(len(count), len(langs)), np.zeros(len(count))
            letters = np.array(batch.column("letters").to_pylist(), bool)
            if langs and len(count):
                p = _softmax(logits / np.maximum(1, count)[:, None])
                best, score = np.where(letters, p.argmax(axis=1), len(langs)), np.where(letters, p.max(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names[best], pa.string()), pa.array(score), pa.array((score < reject) | ~letters)], ["doc_id", "lang_pred", "score", "rejected"])

    rows = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
