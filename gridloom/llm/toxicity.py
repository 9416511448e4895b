"""Toxicity: a linear-chain conditional random field that tags toxic spans, and document scores from its marginals.

Tokens are runs of letters, digits and bytes beyond ASCII, lower-cased. Each has hashed features: the word, its beginnings
of 3 to 8 bytes, its ends of 3 and 5, and the words beside it. Two tags, clean and toxic; a tag's score is the
sum of its features' weights and of the transition from the tag before. Marginals come from forward and backward passes
over whole texts, in blocks of tokens side by side, joined by the blocks' products.

Labels are of documents, so tokens are labelled first: in toxic documents, those with a feature that occurs in more toxic
documents than chance explains (a binomial bound, corrected for the number of features) and in few others; every token of
a clean document is clean. The field is then trained on the stretches around such tokens, wherever they occur, and on
others of clean documents, by stochastic gradients of its log-likelihood. A fifth of the documents is held back to
turn marginals into scores: logistic regression on the highest marginal, their sum and the length. Where spans are known, ``spans``
takes the place of the first step.

Training is one task, on at most about ``max_rows`` labelled documents, chosen by a hash of the id, and of those, if their
texts are over ``max_bytes``, about as many as that holds. The model is 4 MB, broadcast; scoring needs no shuffle.

Defined cases: null and empty texts, and texts without tokens, have no spans and score by the length alone. Labels other
than 0 and 1 are ignored; of several labels for one document the mean decides (0.5 and more: 1). A null doc_id is never
learned from. Repeated rows are scored each. Very long texts are scored whole: a batch needs some 400 bytes a token. Without labels of both kinds, all score
the share of toxic labels (0.5 without labels). Other columns are not read.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm import tokens

BITS, BLOCK = 20, 64
STARTS, ENDS = range(3, 9), (3, 5)
#: Tokens on each side of a labelled one that training sees, and tokens in one of its stretches.
CONTEXT, STRETCH = 8, 24
#: Stretches whose gradients are added up for one step.
BATCH = 192
_INNER = np.zeros(256, bool)
_INNER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass
class Tokens:
    """The tokens of a batch in order. first: where each text's tokens start, and the last one's end; at: where each text's bytes start."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    at: np.ndarray
    features: np.ndarray


def tokenized(texts: pa.Array) -> Tokens:
    """Tokens with their features' hashes, a row for each token; 0 stands for a feature that a token doesn't have."""
    raw, at = tokens.text_bytes(texts)
    data = tokens.FOLD[raw]
    # capitals of two bytes, from A with grave to Thorn
    accents = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    data[accents] += 0x20
    inner = _INNER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.concatenate([[False], inner[:-1]])[: len(data)] & ~edge[:-1]
    after = np.concatenate([inner[1:], [False]])[: len(data)] & ~edge[1:]
    starts, ends = np.flatnonzero(inner & ~before), np.flatnonzero(inner & ~after) + 1
    first = np.searchsorted(starts, at)
    size, n = ends - starts, len(starts)
    word = tokens.range_hashes(data, starts, ends)
    bucket = lambda h, kind: ((tokens.mix(h + np.uint64(kind)) >> np.uint64(64 - BITS)) | np.uint64(1)).astype(np.int32)
    columns = [bucket(word, 1)]
    for k in STARTS:
        columns.append(np.where(size > k, bucket(tokens.range_hashes(data, starts, np.minimum(starts + k, ends)), 2), 0))
    for k in ENDS:
        columns.append(np.where(size > k, bucket(tokens.range_hashes(data, np.maximum(ends - k, starts), ends), 3), 0))
    same = np.zeros(n + 1, bool)
    same[first[(first > 0) & (first < n)]] = True  # a text's first token has none before it
    for shift, kind in ((1, 4), (-1, 5)):
        beside = np.zeros(n, np.int32)
        if n > 1:
            inside = ~same[1:n]
            if shift > 0:
                beside[1:] = np.where(inside, bucket(word[:-1], kind), 0)
            else:
                beside[:-1] = np.where(inside, bucket(word[1:], kind), 0)
        columns.append(beside)
    return Tokens(starts, ends, first, at, np.column_stack(columns) if n else np.zeros((0, len(columns)), np.int32))


def log_odds(features: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """How much more each token's features speak for toxic than for clean. weights[0] is 0."""
    return weights[features].sum(axis=1, dtype=np.float64)


def _step(clean: np.ndarray, toxic: np.ndarray, s: np.ndarray, move: np.ndarray, opens: np.ndarray | None, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One token further in every column, scaled to sum to 1. opens: columns where this is a text's first token, which start weighs."""
    a, b = clean * move[0, 0] + toxic * move[1, 0], (clean * move[0, 1] + toxic * move[1, 1]) * s
    if opens is not None:
        a, b = np.where(opens, start[0], a), np.where(opens, start[1] * s, b)
    total = a + b
    return a / total, b / total


def _along(scores: np.ndarray, move: np.ndarray, start: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each token, the log-odds of toxic given all tokens of its text up to it, itself included. scores: tokens of all texts; first: where texts start, and the last one ends; move: weights of transitions, from x to; start: weights of a first token's tags. Blocks of tokens go side by side, first to find what each leads to from either tag, then from what the blocks before it lead to."""
    n = len(scores)
    if not n:
        return np.zeros(0)
    size = np.diff(first)
    blocks = -(-size // BLOCK)
    left = np.repeat(first[:-1], blocks) + BLOCK * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    right = np.minimum(left + BLOCK, np.repeat(first[1:], blocks))
    at = left + np.arange(BLOCK)[:, None]
    inside = at < right
    weight = np.exp(np.clip(np.where(inside, scores[np.minimum(at, n - 1)], 0.0), -30, 30))
    opens = np.zeros(len(left), bool)
    opens[(np.cumsum(blocks) - blocks)[blocks > 0]] = True
    # only blocks that another one follows need what they lead to
    goes_on = np.flatnonzero(np.concatenate([~opens[1:], [False]]))
    toxic = np.zeros(len(left))
    if len(goes_on):
        ends, gains = [], []
        for tag in (0.0, 1.0):
            a, b = np.full(len(goes_on), 1 - tag), np.full(len(goes_on), tag)
            gain = np.zeros(len(goes_on))
            for k in range(BLOCK):
                s = weight[k, goes_on]
                if k == 0:
                    total = np.where(opens[goes_on], 1.0, a * move[0, 0] + b * move[1, 0] + (a * move[0, 1] + b * move[1, 1]) * s)
                else:
                    total = a * move[0, 0] + b * move[1, 0] + (a * move[0, 1] + b * move[1, 1]) * s
                gain += np.log(total)
                a, b = _step(a, b, s, move, opens[goes_on] if k == 0 else None, start)
            ends.append(b)
            gains.append(gain)
        # the share of toxic at a block's end, by the tag before it; and how likely each tag before makes the block
        for j, e0, e1, ratio in zip((goes_on + 1).tolist(), ends[0].tolist(), ends[1].tolist(), np.exp(np.clip(gains[1] - gains[0], -700, 700)).tolist(), strict=True):
            q = toxic[j - 1] * ratio
            q = q / (1 - toxic[j - 1] + q)
            toxic[j] = e0 + (e1 - e0) * q
    clean = 1 - toxic
    out = np.empty((BLOCK, len(left)))
    for k in range(BLOCK):
        clean, toxic = _step(clean, toxic, weight[k], move, opens if k == 0 else None, start)
        out[k] = np.log(np.maximum(toxic, 1e-300)) - np.log(np.maximum(clean, 1e-300))
    found = np.empty(n)
    found[at[inside]] = out[inside]
    return found


def marginals(scores: np.ndarray, first: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The probability that each token is toxic. scores: log-odds of its features; first: where texts start, and the last one ends; moves: scores of transitions, from x to. A clean tag stands before a text, and any after it."""
    move = np.exp(moves)
    forward = _along(scores, move, move[0], first)
    back = _along(scores[::-1], move.T, np.ones(2), len(scores) - first[::-1])[::-1]
    # both have the token's own score
    return 1 / (1 + np.exp(-np.clip(forward + back - np.clip(scores, -30, 30), -500, 500)))


def weak_labels(features: np.ndarray, doc: np.ndarray, toxic: np.ndarray, least: float = 0.7, chance: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """For each token, whether it has a feature that speaks for toxic documents, and its tag: that, in a toxic document. A feature speaks if at least the share least of the documents that have it is toxic, and if chance would give as many with a probability below chance over the number of features. doc: each token's document; toxic: by document."""
    own = features[:, : 1 + len(STARTS) + len(ENDS)]  # not the words beside
    count = np.zeros((2, 1 << BITS), np.int64)
    # each document's features once, some documents at a time
    cuts = np.searchsorted(doc, np.arange(0, len(toxic) + 64, 64))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        pairs = np.unique((own[a:b].astype(np.int64) + (doc[a:b, None].astype(np.int64) << BITS))[own[a:b] > 0])
        for tag in (0, 1):
            count[tag] += np.bincount((pairs & ((1 << BITS) - 1))[toxic[pairs >> BITS] == tag], minlength=1 << BITS)
    n, base = count.sum(axis=0), np.clip(toxic.mean(), 1e-6, 1 - 1e-6)
    q = np.clip(count[1] / np.maximum(n, 1), 1e-12, 1 - 1e-12)
    bits = n * (q * np.log(q / base) + (1 - q) * np.log((1 - q) / (1 - base)))
    speaks = (q >= least) & (bits > np.log(max(1, (n > 0).sum()) / chance))
    hit = speaks[own].any(axis=1)
    return hit, hit & toxic[doc]


def train_field(features: np.ndarray, tag: np.ndarray, rows: np.ndarray, size: np.ndarray, epochs: int, rate: float, decay: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the features and scores of transitions, by AdaGrad over the stretches of tokens: rows, of size tokens each, index features and tag. The gradient is what the tags have less what the marginals expect."""
    weights, moves = np.zeros(1 << BITS), np.zeros((2, 2))
    power, move_power = np.full(1 << BITS, 1e-8), np.full((2, 2), 1e-8)
    rng = np.random.default_rng(11)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            index = np.concatenate([np.arange(rows[i], rows[i] + size[i]) for i in some])
            first = np.concatenate([[0], np.cumsum(size[some])])
            scores = log_odds(features[index], weights)
            p = marginals(scores, first, moves)
            y = tag[index].astype(float)
            keep = np.ones(len(index), bool)
            keep[first[:-1]] = False  # transitions into what isn't a stretch's first
            keep[0] = False
            pair = _pairs(scores, p, first, moves)[:, :, keep]
            seen = np.array([[(1 - y[:-1]) * (1 - y[1:]), (1 - y[:-1]) * y[1:]], [y[:-1] * (1 - y[1:]), y[:-1] * y[1:]]])[:, :, keep[1:]]
            g = (seen.sum(axis=2) - pair.sum(axis=2)) / len(some) - decay * moves
            move_power += g * g
            moves += rate * g / np.sqrt(move_power)
            bucket, where = np.unique(features[index], return_inverse=True)
            g = np.bincount(where.ravel(), np.repeat((y - p) / len(some), features.shape[1])) - decay * weights[bucket]
            power[bucket] += g * g
            weights[bucket] += rate * g / np.sqrt(power[bucket])
            weights[0] = 0.0
    return weights, moves


def _pairs(scores: np.ndarray, p: np.ndarray, first: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The probability of each pair of tags of a token and the one before, from x to x token; of a text's first token it means nothing."""
    move = np.exp(moves)
    forward = _along(scores, move, move[0], first)
    logit = np.log(np.maximum(p, 1e-300)) - np.log(np.maximum(1 - p, 1e-300))
    a = 1 / (1 + np.exp(-np.clip(np.concatenate([[0.0], forward[:-1]]), -500, 500)))  # toxic before, by what lies before
    b = 1 / (1 + np.exp(-np.clip(logit - forward + np.clip(scores, -30, 30), -500, 500)))  # toxic here, by itself and what follows
    joint = np.array([[(1 - a) * (1 - b) * move[0, 0], (1 - a) * b * move[0, 1]], [a * (1 - b) * move[1, 0], a * b * move[1, 1]]])
    return joint / joint.sum(axis=(0, 1))


def summary(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text: 1, the log-odds of its most toxic token, and the logs of the sum of marginals and of the number of tokens."""
    n = len(first) - 1
    some = np.flatnonzero(np.diff(first))
    most, total = np.full(n, 1e-9), np.zeros(n)
    if len(some):
        most[some] = np.clip(np.maximum.reduceat(p, first[some]), 1e-9, 1 - 1e-9)
        total[some] = np.add.reduceat(np.where(p > 0.02, p, 0.0), first[some])
    return np.column_stack([np.ones(n), np.log(most / (1 - most)), np.log1p(total), np.log1p(np.diff(first))])


def calibrated(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _untrained(share: float) -> dict:
    return {"weights": np.zeros(1 << BITS, np.float32), "moves": np.array([[0.0, -30.0], [0.0, -30.0]]), "score": None, "share": share}


def _fit(epochs: int, rate: float, decay: float, most_plain: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, labels, held, marks = [], [], [], []
        for batch in batches:
            t = tokenized(batch.column("text"))
            parts.append((t.features, np.diff(t.first)))
            labels += batch.column("label").to_pylist()
            held += batch.column("held").to_pylist()
            for k, spans in enumerate(batch.column("spans").to_pylist()):
                marks.append(None if spans is None else _marked(t, k, batch.column("text")[k].as_py() or "", spans))
        toxic, held = np.array(labels, bool), np.array(held, bool)
        if not len(toxic) or toxic.all() or not toxic.any():
            model = _untrained(float(toxic.mean()) if len(toxic) else 0.5)
        else:
            features, size = np.concatenate([x for x, _ in parts]), np.concatenate([n for _, n in parts])
            doc, first = np.repeat(np.arange(len(size)), size), np.concatenate([[0], np.cumsum(size)])
            learn = ~held[doc]
            hit, tag = np.zeros(len(doc), bool), np.zeros(len(doc), bool)
            number = np.cumsum(~held) - 1
            hit[learn], tag[learn] = weak_labels(features[learn], number[doc[learn]], toxic[~held])
            for k, m in enumerate(marks):
                if m is not None:
                    tag[first[k] : first[k + 1]] = m
                    hit[first[k] : first[k + 1]] |= m
            # stretches: those with a token that speaks, and as many others of clean documents
            start = np.concatenate([np.arange(first[k], first[k + 1], STRETCH) for k in np.flatnonzero(size)])
            length = np.minimum(start + STRETCH, first[1:][doc[start]]) - start
            near = np.convolve(hit, np.ones(2 * CONTEXT + 1), "same") > 0.5
            spoken = np.add.reduceat(near.astype(int), start) > 0
            plain = np.flatnonzero(~spoken & ~toxic[doc[start]] & learn[start])
            plain = np.random.default_rng(5).permutation(plain)[: max(most_plain, int(spoken.sum()))]
            use = np.concatenate([np.flatnonzero(spoken & learn[start]), plain])
            weights, moves = train_field(features, tag, start[use], length[use], epochs, rate, decay)
            p = marginals(log_odds(features, weights), first, moves)
            x = summary(p, first)
            back = held if held.any() and toxic[held].any() and not toxic[held].all() else np.ones(len(held), bool)
            model = {"weights": weights.astype(np.float32), "moves": moves, "score": calibrated(x[back], toxic[back].astype(float)), "share": float(toxic.mean())}
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(pickle.dumps(model), 1)], pa.binary())], ["model"])

    return run


def _marked(t: Tokens, k: int, text: str, spans: list[dict]) -> np.ndarray:
    """Which tokens of text k overlap one of the spans (start, end, in characters)."""
    out = np.zeros(t.first[k + 1] - t.first[k], bool)
    at, to = t.starts[t.first[k] : t.first[k + 1]] - t.at[k], t.ends[t.first[k] : t.first[k + 1]] - t.at[k]
    for s in spans:
        a, b = len(text[: s["start"]].encode()), len(text[: s["end"]].encode())
        out |= (at < b) & (to > a)
    return out


def train(docs: DataFrame, labels: DataFrame, spans: DataFrame | None = None, max_rows: int = 6_000, max_bytes: int = 24 << 20, epochs: int = 5, rate: float = 0.5, decay: float = 1e-5, most_plain: int = 8_000) -> dict:
    """A model from docs (doc_id, text) and labels (doc_id, label). spans: (doc_id, start, end), in characters, of documents whose toxic tokens are known; of others they are told by weak_labels()."""
    clean = labels.filter("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    total = clean.count()
    some = clean.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, max_rows / max(1, total))))
    if spans is None:
        some = some.withColumn("spans", F.lit(None).cast("array<struct<start:int,end:int>>"))
    else:
        known = spans.select("doc_id", F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")).alias("span"))
        some = some.join(known.join(some.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.array_sort(F.collect_list("span")).alias("spans")), "doc_id", "left")
    # at most about max_rows rows
    examples = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select(F.xxhash64("doc_id", F.lit(1)).alias("place"), (F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(5)) == 0).alias("held"), "label", "text", "spans")
    size = examples.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > max_bytes:
        examples = examples.filter(F.pmod("place", F.lit(1 << 20)) < int((1 << 20) * max_bytes / size))
    rows = examples.repartition(1).sortWithinPartitions("place", "label", "text").mapInArrow(_fit(epochs, rate, decay, most_plain), "model binary").collect()
    return pickle.loads(zlib.decompress(rows[0]["model"])) if rows else _untrained(0.5)  # noqa: S301  made by this job


def score(docs: DataFrame, model: dict, least: float = 0.5) -> DataFrame:
    """doc_id, score (0 to 1), n_tokens, and spans array<struct<start, end, p>>: runs of tokens whose marginal is least or more, by characters, and the highest marginal of each."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            column = batch.column("text")
            t = tokenized(column)
            p = marginals(log_odds(t.features, m["weights"]), t.first, m["moves"])
            if m["score"] is None:
                value = np.full(len(column), m["share"])
            else:
                value = 1 / (1 + np.exp(-np.clip(summary(p, t.first) @ m["score"], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(value), pa.array(np.diff(t.first)), pa.array(_spans(t, p, least, column), _SPANS)], ["doc_id", "score", "n_tokens", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("n_tokens", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("p", T.DoubleType())])))]))


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))


def _spans(t: Tokens, p: np.ndarray, least: float, column: pa.Array) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in range(len(t.first) - 1)]
    hot = np.flatnonzero(p >= least)
    doc = np.searchsorted(t.first, hot, side="right") - 1
    data, before = None, None
    for k, d in zip(hot.tolist(), doc.tolist(), strict=True):
        if d != before:
            data, before, last = column[d].as_py().encode(), d, -2
        if k == last + 1:
            out[d][-1]["end"] += len(data[t.ends[k - 1] - t.at[d] : t.ends[k] - t.at[d]].decode())
            out[d][-1]["p"] = max(out[d][-1]["p"], float(p[k]))
        else:
            start = len(data[: t.starts[k] - t.at[d]].decode())
            out[d].append({"start": start, "end": start + len(data[t.starts[k] - t.at[d] : t.ends[k] - t.at[d]].decode()), "p": float(p[k])})
        last = k
    return out
