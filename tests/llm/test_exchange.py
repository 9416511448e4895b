import random

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from gridloom.llm import bpe, exchange, jaccard, lm, suffix
from gridloom.llm.common import small_batches
from tests.llm.words import thue_morse


def corpus(seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdé") for _ in range(r.randint(1, 6))) for _ in range(80)]
    some = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared = [some(45) for _ in range(4)]
    texts = [some(r.randint(0, 25)) + " " + r.choice(shared) + " " + some(r.randint(0, 25)) for _ in range(50)]
    texts += [shared[0] + " end", shared[0] + " ends", "", None, texts[3], thue_morse(1024), thue_morse(1024, True)]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    return [*rows, rows[0], (None, texts[0])]


def results(spark, rows, tmp):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    path = P.path("byte_bpe_50k.tiktoken")
    lm.train(df, order=3).write.parquet(tmp)
    frames = {
        "repeats": suffix.repeat_digests(suffix.remove_repeats(df)),
        "model": lm.score(df, F.col("doc_id") % 3 > 0),
        "written model": lm.score_with(df, spark.read.parquet(tmp)),
        "links": jaccard.linked(df),
        "ids": bpe.encode(df, path, P.PATTERN),
    }
    return {name: sorted(([round(x, 9) if isinstance(x, float) else x for x in row] for row in df.collect()), key=str) for name, df in frames.items()}


def test_two_steps_give_what_one_gives(spark, monkeypatch, tmp_path):
    small_batches(spark, 5)
    monkeypatch.setattr(exchange, "shards_of", lambda _: 11)
    rows = corpus(8)
    assert exchange.width(11) == 1
    one = results(spark, rows, f"{tmp_path}/one")
    monkeypatch.setattr(exchange, "ONE_STEP", 4)
    assert exchange.width(11) == 3
    assert results(spark, rows, f"{tmp_path}/two") == one
    assert results(spark, [], f"{tmp_path}/none") == dict.fromkeys(one, [])


def test_rows_are_for_groups(spark, monkeypatch):
    monkeypatch.setattr(exchange, "ONE_STEP", 4)
    rows = [(i, str(i)) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    every = lambda table: ((s, [np.array(table["doc_id"].to_numpy()), np.array([s])]) for s in range(16))
    asked = exchange.ask(df, every, 0, 16)
    assert asked.count() == 6 * 4
    at = exchange.to_shards(asked, 16)
    assert at.groupBy("shard").count().agg(F.min("count"), F.max("count"), F.count("*")).first()[:] == (2, 2, 16)
    back = exchange.to_blocks(at, 16).collect()
    assert sorted((r.block >> 32, r.shard) for r in back) == [(b, g) for b in range(6) for g in range(4)]
    seen = sorted((int(i), s) for r in back for b, s, _, (ids, mark) in exchange.unpack_parts(r.data) for i in ids if (b, s) == (r.block, mark[0]) and s // 4 == r.shard)
    assert seen == [(i, s) for i in range(90) for s in range(16)]


@pytest.mark.parametrize("of", [[], [3], [0, 0, 2, 5, 5]])
def test_runs(of):
    assert [(s, k.start, k.stop) for s, k in exchange.runs(np.array(of, np.uint64))] == [(s, of.index(s), of.index(s) + of.count(s)) for s in sorted(set(of))]
