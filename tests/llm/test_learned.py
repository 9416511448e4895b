"""The learned operators against plain trainers and scorers, and on documents that were held out."""

import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import bpe, langid, lm, quality, suffix
from gridloom.llm import queries as q
from gridloom.llm.common import small_batches

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def shape(word, before):
    data = word.encode()
    upper, digit = sum(65 <= b < 91 for b in data), any(48 <= b < 58 for b in data)
    lower = sum(97 <= b < 123 or b >= 128 for b in data)
    other = len(data) - upper - lower - sum(48 <= b < 58 for b in data)
    return (min(len(data), 12) // 4, min(upper, 2), lower > 0, digit, min(other, 3), word == before)


def bag(text):
    """The n-grams of a text by name, and their shares."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    shapes = [shape(w, b) for w, b in zip(words, [None, *words], strict=False)]
    grams = [("w", *words[i : i + n]) for n in (1, 2) for i in range(len(words) - n + 1)] + [("s", n, *shapes[i : i + n]) for n in (1, 2, 3) for i in range(len(shapes) - n + 1)]
    return {k: v / len(grams) for k, v in Counter(grams).items()}


def test_quality_against_a_plain_trainer(spark):
    """Follow the regularised leader over dictionaries, on the same rows in the same order, gives the same scores."""
    small_batches(spark, 5)
    texts = ["the cat sat", "Spam SPAM 99!!", "a quiet text, with marks.", "BUY now now now", "", "x1 y2 z3", "the cat ran off", None]
    labels = {0: 1, 1: 0, 2: 1, 3: 0, 4: 0, 5: 1}
    docs = spark.createDataFrame([(i, t, 0.5, "w") for i, t in enumerate(texts)], "doc_id long, text string, score double, weights string").repartition(3)
    order = [r.doc_id for r in spark.createDataFrame([(i,) for i in labels], "doc_id long").orderBy(F.xxhash64("doc_id", F.lit(1))).collect()]
    z, n = Counter(), Counter()

    def weight(k):
        return 0.0 if abs(z[k]) <= 1e-4 else (math.copysign(1e-4, z[k]) - z[k]) / (1 + math.sqrt(n[k]) + 1e-4)

    for _ in range(7):
        for i in order:
            x = bag(texts[i]) | {"": 1.0}
            w = {k: weight(k) for k in x}
            p = 1 / (1 + math.exp(-sum(w[k] * v for k, v in x.items())))
            for k, v in x.items():
                g = (p - labels[i]) * v
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) * w[k]
                n[k] += g * g
    weights = quality.train(docs, spark.createDataFrame(list(labels.items()), "doc_id long, label int"), epochs=7, updates=0)
    got = {r.doc_id: r.score for r in quality.score(docs, weights).collect()}
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(1 / (1 + math.exp(-sum(weight(k) * v for k, v in (bag(t) | {"": 1.0}).items()))), abs=2e-3)
    few = quality.train(docs, spark.createDataFrame(list(labels.items()), "doc_id long, label int"), max_bytes=1)
    assert not few.any()


def test_language_against_a_plain_scorer(spark):
    small_batches(spark, 5)
    rows = [(i, ("abc " if i % 2 else "xyz ") * (i % 7 + 1), "ab" if i % 2 else "xy", 9) for i in range(60)] + [(99, "é", "ab", 9), (100, "long abc " * 30_000, "ab", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int").repartition(2)
    model = langid.train(docs.filter("doc_id < 50"))
    for r in langid.predict(docs, model).filter("doc_id < 100").collect():
        data = bytes(32 if b in b"\t\n\x0b\x0c\r " else b + 32 if 65 <= b < 91 else b for b in rows[r.doc_id if r.doc_id < 60 else 60][1].encode())
        logits, runs = np.zeros(2), 0
        for n in (2, 3, 4):
            for i in range(len(data) - n + 1):
                h = int.from_bytes(data[i : i + n], "big")
                h = ((h ^ (h >> 15) ^ n) * 0x9E3779B1) & 0xFFFFFFFF
                h = ((h ^ (h >> 13)) * 0x9E3779B1) & 0xFFFFFFFF
                logits += model["table"][h >> 16]
                runs += 1
        e = np.exp(logits / max(1, runs) - (logits / max(1, runs)).max())
        assert (r.lang_pred, r.score) == (model["langs"][int(e.argmax())], pytest.approx(float(e.max() / e.sum()), abs=1e-5))


def test_language_against_a_plain_trainer(spark):
    r = random.Random(11)
    words = {"ab": ["abba", "baa", "aab", "bab"], "xy": ["xyx", "yyx", "xxy", "abba"]}
    rows = [(i, " ".join(r.choice(words[lang if r.random() < 0.7 else "ab"]) for _ in range(r.choice((2, 9, 150)))), lang) for i, lang in enumerate(["ab", "xy"] * 25)]
    docs = spark.createDataFrame([*rows, (None, "abba", "xy"), (70, None, "xy"), (71, "xyx", None), (72, "ab", "ab")], "doc_id long, text string, lang string").repartition(3)
    epochs, rate = 2, 1.0
    model = langid.train(docs, epochs=epochs, rate=rate)
    marks = {x.doc_id: (x.place, x.held) for x in docs.select("doc_id", F.xxhash64("doc_id", F.lit(2)).alias("place"), (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5)) == 0).alias("held")).collect()}

    def bag(data):
        runs = Counter()
        for n in (2, 3, 4):
            for i in range(len(data) - n + 1):
                h = int.from_bytes(data[i : i + n], "big")
                h = ((h ^ (h >> 15) ^ n) * 0x9E3779B1) & 0xFFFFFFFF
                runs[(((h ^ (h >> 13)) * 0x9E3779B1) & 0xFFFFFFFF) >> 16] += 1
        return {b: c / runs.total() for b, c in runs.items()}

    def shares(logits):
        e = [math.exp(x - max(logits)) for x in logits]
        return [x / sum(e) for x in e]

    learn, check = [], []
    for i, text, lang in sorted(rows, key=lambda x: (marks[x[0]][0], x[2], x[1])):
        data, which = text.encode(), ["ab", "xy"].index(lang)
        if marks[i][1]:
            check.append((which, bag(data)))
        else:
            learn.append((which, bag(data)))
            learn += [(which, bag(data[k : k + 400])) for k in range(0, len(data), 400) if len(data) > 400 and len(data[k : k + 400]) >= 4]
    assert check and any(len(x[1]) > 400 for x in rows)
    rng = np.random.default_rng(7)
    embed = (rng.uniform(-0.5, 0.5, (1 << 16, 16)) / 16).tolist()
    matrix = [[0.0, 0.0] for _ in range(16)]
    done = 0
    for _ in range(epochs):
        for j in rng.permutation(len(learn)):
            which, x = learn[j]
            step = rate * (1 - done / (epochs * len(learn)))
            hidden = [sum(v * embed[b][d] for b, v in x.items()) for d in range(16)]
            p = shares([sum(hidden[d] * matrix[d][k] for d in range(16)) for k in (0, 1)])
            p[which] -= 1
            for b, v in x.items():
                for d in range(16):
                    embed[b][d] -= v * step * sum(m * q for m, q in zip(matrix[d], p, strict=True))
            for d in range(16):
                for k in (0, 1):
                    matrix[d][k] -= step * hidden[d] * p[k]
            done += 1
    weight = lambda b: [sum(embed[b][d] * matrix[d][k] for d in range(16)) for k in (0, 1)]
    logits = [(which, [sum(v * weight(b)[k] for b, v in x.items()) for k in (0, 1)]) for which, x in check]
    scales = [2 ** (k / 4) for k in range(-16, 17)]
    scale = min(scales, key=lambda s: -sum(math.log(shares([s * y for y in x])[which]) for which, x in logits))
    certain = [shares([scale * y for y in x]) for _, x in logits]
    right = [max(p) for (which, _), p in zip(logits, certain, strict=True) if p.index(max(p)) == which]
    assert model["langs"] == ["ab", "xy"]
    for b in {b for _, x in learn + check for b in x}:
        assert model["table"][b] == pytest.approx([scale * y for y in weight(b)], abs=2e-3)
    assert model["reject"] == pytest.approx(float(np.quantile(right, 0.01)), abs=2e-3)
    assert langid.train(docs, max_bytes=0)["langs"] == []


@needs_data
def test_quality_of_documents_held_out(spark):
    rows = q.op2_quality(spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").filter("held_out").select("score", "predicted", "quality").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert len(good) > 20 and len(bad) > 5
    assert sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / len(good) / len(bad) > 0.95
    assert sum(r.predicted == r.quality for r in rows) > 0.9 * len(rows)


@needs_data
def test_language_of_documents_held_out(spark):
    rows = q.op3_language(spark, DATA).filter("held_out").join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("lang is not null and lang_pred <> 'und'").collect()
    assert len(rows) > 100 and sum(r.lang == r.lang_pred for r in rows) > 0.97 * len(rows)


def test_long_texts_and_names_that_clash(spark):
    """A text of some MB beside short ones, and columns named like what the operators return or use, change nothing."""
    small_batches(spark)
    rng = np.random.default_rng(3)
    long = " ".join(f"w{x}" for x in rng.integers(0, 5000, 400_000))
    rows = [(0, long), (1, "short one"), (2, long[:5000]), (3, None)]
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    names = ["n_tokens", "ids", "decoded", "block", "kind", "shard", "data", "learn", "score", "rejected", "letters", "kept", "n_bytes", "span_starts", "tokens", "sign"]
    clash = plain.select("*", *(F.lit("x").alias(c) for c in names))
    ranks = q.public_tokenizers.path("byte_bpe_50k.tiktoken")
    encode = bpe.encoding(bpe.ranks_file(ranks), q.public_tokenizers.PATTERN).encode_ordinary
    table = bpe.token_bytes(spark, ranks)
    for r in bpe.decode(bpe.encode(clash, ranks, q.public_tokenizers.PATTERN), table).collect():
        text = rows[r.doc_id][1] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == encode(text) and bytes(r.decoded) == text.encode()
    cut = {r.doc_id: r for r in suffix.repeat_digests(suffix.remove_repeats(clash)).collect()}
    assert cut[2].n_removed == 5000 and cut[1].n_removed == 0 and cut[0].n_bytes == len(long)
    scored = {r.doc_id: r for r in lm.score(clash, F.lit(True)).collect()}
    assert scored[0].n_tokens == 400_001 and scored[3].n_tokens == 1
    for df in (plain, clash):
        model = langid.train(df.withColumn("lang", F.lit("en")))
        assert {r.doc_id: r.lang_pred for r in langid.predict(df, model).collect()} == {0: "en", 1: "en", 2: "en", 3: "und"}
