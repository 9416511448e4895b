"""The chain against all its taggings, and the scores on planted words and documents that were held out."""

import itertools
import os
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import queries as q
from gridloom.llm import toxicity
from gridloom.llm.common import small_batches

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def taggings(scores, moves):
    """The weight of each tagging of one text."""
    for tags in itertools.product((0, 1), repeat=len(scores)):
        yield tags, np.exp(sum(s * t for s, t in zip(scores, tags, strict=True)) + sum(moves[a, b] for a, b in zip((0, *tags), tags, strict=False)))


def test_marginals_and_pairs_against_all_taggings(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 3)
    rng = np.random.default_rng(0)
    for _ in range(20):
        sizes = rng.integers(0, 10, 6)
        first = np.concatenate([[0], np.cumsum(sizes)])
        scores, moves = rng.normal(0, 3, first[-1]), rng.normal(0, 2, (2, 2))
        p = toxicity.marginals(scores, first, moves)
        pair = toxicity._pairs(scores, p, first, moves) if len(scores) else None
        for a, b in zip(first[:-1], first[1:], strict=True):
            ways = list(taggings(scores[a:b], moves))
            total = sum(w for _, w in ways)
            for k in range(b - a):
                assert p[a + k] == pytest.approx(sum(w for t, w in ways if t[k]) / total, abs=1e-9)
                if k:
                    for x, y in itertools.product((0, 1), repeat=2):
                        assert pair[x, y, a + k] == pytest.approx(sum(w for t, w in ways if t[k - 1 : k + 1] == (x, y)) / total, abs=1e-9)


def test_long_chains_against_one_step_at_a_time():
    rng = np.random.default_rng(1)
    scores, moves = rng.normal(-2, 4, 3000), np.array([[1.0, -2.0], [-1.0, 0.5]])
    alpha, beta = np.zeros((3000, 2)), np.zeros((3000, 2))
    for k in range(3000):
        for t in (0, 1):
            before = [0.0, -np.inf] if not k else alpha[k - 1]
            alpha[k, t] = np.logaddexp(before[0] + moves[0, t], before[1] + moves[1, t]) + t * scores[k]
    for k in range(2998, -1, -1):
        for t in (0, 1):
            beta[k, t] = np.logaddexp(moves[t, 0] + beta[k + 1, 0], moves[t, 1] + scores[k + 1] + beta[k + 1, 1])
    both = alpha + beta
    assert np.allclose(toxicity.marginals(scores, np.array([0, 3000]), moves), 1 / (1 + np.exp(both[:, 0] - both[:, 1])), atol=1e-9)


def test_tokens_and_their_neighbours():
    t = toxicity.tokenized(pa.array(["Éa bc, d", None, "", "bc é", "-- "]))
    data = "Éa bc, dbc é-- ".encode()
    assert [data[a:b].decode() for a, b in zip(t.starts, t.ends, strict=True)] == ["Éa", "bc", "d", "bc", "é"] and t.first.tolist() == [0, 3, 3, 3, 5, 5]
    f = t.features
    assert f[1, 0] == f[3, 0] and f[1, -2] > 0 and f[3, -2] == 0 and f[2, -1] == 0 and f[4, -1] == 0 and f[0, -2] == 0
    lower, upper = (toxicity.tokenized(pa.array([x])).features for x in ("école", "ÉCOLE"))
    assert (lower == upper).all()


def planted(n, seed):
    rng = np.random.default_rng(seed)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "tes", "ru") for b in ("na", "po", "sti", "ven", "qua")]
    rows = []
    for i in range(n):
        text = list(rng.choice(words, rng.integers(3, 60)))
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rng.integers(1, 4)):
                text.insert(rng.integers(0, len(text)), "grimbo" + str(rng.choice(["", "na", "po", "!"])))
        rows.append((i, " ".join(text), int(toxic)))
    return rows


def test_planted_words_are_tagged(spark):
    small_batches(spark)
    rows = planted(600, 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int").repartition(3)
    labels = docs.select("doc_id", F.col("spans").alias("label")).filter("doc_id < 400")
    model = toxicity.train(docs, labels)
    for r in toxicity.score(docs, model).collect():
        text, toxic = rows[r.doc_id][1:]
        assert (r.score >= 0.3) == bool(toxic), (r.doc_id, r.score)
        assert [text[s.start : s.end] for s in r.spans] == re.findall(r"grimbo\w*(?:\W+grimbo\w*)*", text)
    # spans that are given take the place of what is told from labels
    some = [(i, m.start(), m.end()) for i, text, _ in rows for m in re.finditer("tesven", text)]
    known = toxicity.train(docs, spark.createDataFrame([(i, int("tesven" in t)) for i, t, _ in rows], "doc_id long, label int"), spark.createDataFrame(some, "doc_id long, start int, end int"))
    for r in toxicity.score(docs, known).collect():
        text = rows[r.doc_id][1]
        assert [text[s.start : s.end] for s in r.spans] == re.findall(r"tesven(?: tesven)*", text)


def test_odd_cases(spark):
    small_batches(spark)
    long = "plain words and more " * 60_000 + "grimbo " + "plain words " * 20_000
    rows = planted(300, 5) + [(900, None, 0), (901, "", 0), (902, "... --", 0), (903, long, 0), (None, "grimbo grimbo", 0), (904, "a grimbo here", 0), (904, "a grimbo here", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int").repartition(3)
    labels = spark.createDataFrame([(i, t) for i, _, t in rows[:300]] + [(None, 1), (3, 7), (4, None), (901, 0)], "doc_id long, label int")
    found = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    by = {r.doc_id: r for r in found}
    assert by[900].score == by[901].score == by[902].score < 0.3 and by[None].score > 0.3 and sum(r.doc_id == 904 and r.score > 0.3 for r in found) == 2
    assert [(s.start, s.end) for s in by[903].spans] == [(len("plain words and more ") * 60_000, len("plain words and more ") * 60_000 + 6)]
    none = toxicity.train(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.5}
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs, labels.filter("label = 0"))).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), none).count() == 0


@needs_data
def test_documents_held_out(spark):
    rows = q.op13_toxicity(spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").filter("held_out").collect()
    bad, good = [r.score for r in rows if r.toxic == 1], [r.score for r in rows if r.toxic == 0]
    assert len(bad) > 5 and len(good) > 50
    assert sum((a > b) + 0.5 * (a == b) for a in bad for b in good) / len(bad) / len(good) > 0.8
    assert sum(r.predicted == 1 for r in rows if r.toxic == 0) <= 0.02 * len(good)
