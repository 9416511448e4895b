import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import lm
from gridloom.llm.common import small_batches
from gridloom.llm.elias_fano import EliasFano
from tests.llm.words import thue_morse


def test_elias_fano_finds_what_is_there():
    rng = np.random.default_rng(3)
    for n, bound in ((0, 1), (1, 1), (5, 6), (1000, 1 << 20), (1000, 1 << 44), (3000, 3001)):
        values = np.sort(rng.integers(0, bound, n)).astype(np.uint64)
        e = EliasFano.encode(values, bound)
        assert (e.get(np.arange(n)) == values).all()
        distinct = EliasFano.encode(values := np.unique(values), bound)
        ask = np.concatenate([values, rng.integers(0, bound, 50).astype(np.uint64)])
        found = distinct.find(np.zeros(len(ask), np.int64), np.full(len(ask), len(values)), ask)
        assert [i if i >= 0 else None for i in found.tolist()] == [dict(zip(values.tolist(), range(n), strict=False)).get(x) for x in ask.tolist()]


@pytest.mark.parametrize("order", [2, 3, 5])
def test_against_brute_force(spark, order):
    small_batches(spark, 5)
    r = random.Random(5)
    texts = [" ".join(r.choice(["the", "The", "of", "cat", f"w{r.randint(0, 40)}", "é x"]) for _ in range(r.randint(0, 40))) for _ in range(60)] + ["", None, " \n\t", "the the"]
    df = spark.createDataFrame([*enumerate(texts), (None, "the of"), (3, texts[3])], "doc_id long, text string").repartition(3)
    rows = lm.score(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, order=order).collect()
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for i, t in enumerate(texts)}
    learned = [x for i in [*range(len(texts)), 3] if zlib.crc32(str(i).encode()) % 7 != 2 for x in [tokens[i]]]
    held(rows, tokens, learned, order)
    assert len(rows) == len(texts) + 2
    assert lm.score(df.limit(0), F.lit(True)).count() == 0


def held(rows, tokens, learned, order):
    """Rows against scores by counts in dictionaries."""
    c = Counter(x for t in learned for x in t)
    runs, after, fan = Counter(), Counter(), Counter()
    for t in learned:
        s = (0, *t)
        runs.update(s[i : i + k] for k in range(2, order + 1) for i in range(len(s) - k + 1))
    for run, k in runs.items():
        after[run[:-1]] += k
        fan[run[:-1]] += 1
    n, v = sum(c.values()), len(c)
    for row in rows:
        t = tokens[row.doc_id] if row.doc_id is not None else ["the", "of", None]
        base, model, s = [(c[x] + 1) / (n + v + 1) for x in t], [], (0, *t)
        for i, p in enumerate(base):
            for k in range(2, min(order, i + 2) + 1):
                run = s[i + 2 - k : i + 2]
                if after[run[:-1]]:
                    p = max(runs[run] - 0.75, 0) / after[run[:-1]] + 0.75 * fan[run[:-1]] / after[run[:-1]] * p
            model.append(p)
        assert (row.n_tokens, row.n_known, row.train_tokens) == (len(t), sum(c[x] > 0 for x in t), n)
        assert row.base_score == pytest.approx(sum(map(math.log10, base)))
        assert row.score == pytest.approx(sum(map(math.log10, model)), abs=0.02 * len(t))


def test_a_model_that_is_written_scores_other_texts(spark, tmp_path):
    small_batches(spark, 5)
    r = random.Random(6)
    some = lambda k: [" ".join(r.choice(["a", "b", "cc", f"w{r.randint(0, 9)}"]) for _ in range(r.randint(0, 30))) for _ in range(k)]
    old, new = some(40), [*some(15), "", None, thue_morse(1024), "never seen"]
    old += [old[1], thue_morse(1024, True)]
    kind = "doc_id long, text string"
    for order in (1, 2, 4):
        lm.train(spark.createDataFrame(list(enumerate(old)), kind).repartition(3), order=order).write.parquet(f"{tmp_path}/{order}")
        rows = lm.score_with(spark.createDataFrame(list(enumerate(new)), kind).repartition(2), spark.read.parquet(f"{tmp_path}/{order}")).collect()
        assert len(rows) == len(new)
        held(rows, {i: [*(t or "").split(), None] for i, t in enumerate(new)}, [[*t.split(), None] for t in old], order)
    empty = lm.train(spark.createDataFrame([], kind))
    held(lm.score_with(spark.createDataFrame([(0, "a b")], kind), empty).collect(), {0: ["a", "b", None]}, [], 1)
