import hashlib
import random

import public_tokenizers as P
from tests.llm.test_documents import corpus, grams, words
from tests.llm.test_suffix import brute, covered

import corpus_pipeline
from gridloom.llm import bpe, quality


def test_pipeline_against_brute_force(spark, tmp_path):
    r = random.Random(8)
    texts = [t for t in corpus(9) if t is not None] + [None]
    junk = {len(texts) + k: " ".join(["spam"] * r.randint(30, 60)) for k in range(12)}
    rows = [(i, t, "en", "s", len(t or ""), 0.5, "x", 7) for i, t in [*enumerate(texts), *junk.items()]]
    items = [" ".join(texts[i].split()[3:]) for i in (5, 6)] + ["nowhere to be seen at all"]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, n_bytes long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, int(i not in junk), 0) for i, *_ in rows], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    # the classifier is held to what it learned; the other stages to brute force
    weights = quality.train(df, labels.filter(quality.fold_of("doc_id", 5) != 0).withColumnRenamed("quality", "label"))
    kept = {x.doc_id for x in quality.score(df, weights).filter("score >= 0.3").collect()}
    assert not kept & {i for i in junk if i != min(junk)}
    docs = {i: t for i, t, *_ in rows if i in kept}
    ids = sorted(docs)
    near = {i: i for i in ids}

    def root(i):
        while near[i] != i:
            i = near[i]
        return i

    for a in ids:
        for b in ids:
            x, y = grams(docs[a]), grams(docs[b])
            if b < a and x and y and 100 * len(x & y) >= 75 * len(x | y):
                low, high = sorted((root(a), root(b)))
                near[high] = low
    docs = {i: docs[i] for i in ids if root(i) == i}
    left = {i: bytes(c for c, g in zip((docs[i] or "").encode(), gone, strict=True) if not g).decode(errors="ignore") for i, gone in zip(docs, covered([(i, (t or "").encode()) for i, t in docs.items()], 100), strict=True)}
    assert any(left[i] != (docs[i] or "") for i in docs)
    out = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    enc = bpe.encoding(bpe.ranks_file(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)
    for i in docs:
        w = words(left[i])
        leaks = any(m and 100 * len(m & {tuple(w[j : j + n]) for j in range(len(w) - n + 1)}) >= 75 * len(m) for item in items for m, n in [(grams(item), min(5, len(words(item))))])
        assert (i in out) != leaks
        if not leaks:
            assert bytes(out[i].ids) == b"".join(x.to_bytes(4, "little") for x in enc.encode_ordinary(left[i]))
            assert out[i].decoded_sha256 == hashlib.sha256(left[i].encode()).hexdigest()
    assert set(out) <= set(docs)


def test_near_duplicates_of_null_and_repeated_ids(spark):
    r = random.Random(5)
    some = lambda k: " ".join(f"w{r.randint(0, 999)}" for _ in range(k))
    base = [some(40) for _ in range(6)]
    near = lambda k: base[k] + " more"
    rows = [
        (None, base[0]), (None, base[1]), (None, near(1)), (None, near(2)), (2, base[2]), (9, near(2)),  # null ids: alone, alike, and with named ones
        (3, base[3]), (3, base[4]), (3, base[4]), (4, near(4)), (7, base[5]), (7, near(5)), (7, base[5]),  # an id with two texts, and repeated rows
        (5, ""), (5, None), (5, ""), (6, " "), (None, ""), (None, None),  # no shingles
    ]
    picked = None
    for seed in range(2):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string").repartition(3)
        kept = [(x.doc_id, x.text) for x in corpus_pipeline.near_duplicate_stage(spark, df, "").collect()]
        bare = [(i, t) for i, t in kept if not (t or "").strip()]
        assert sorted(str(i) for i, _ in bare) == ["5", "6", "None", "None"]
        kept = [x for x in kept if x not in bare]
        one = [[(None, base[0])], [(None, base[1]), (None, near(1))], [(2, base[2])], [(3, base[3])], [(3, base[4])], [(7, base[5]), (7, near(5))]]
        assert len(kept) == len(one) and all(sum(x in kept for x in group) == 1 for group in one)
        picked = picked or kept
        assert sorted(kept, key=str) == sorted(picked, key=str)  # whatever the order of the rows


def test_stages_pass_other_columns_whatever_their_names(spark, tmp_path):
    kind = "doc_id long, text string, n_chars long, score double, kept string, rest string, row_key long, live long, sign string, `a b` string, span_starts string, learn string"
    rows = [(i, None if i == 3 else f"the words of document {i} " * 9, 1, 0.5, "k", "r", 9, 8, "s", f"ab{i}", "p", "l") for i in range(12)]
    spark.createDataFrame(rows, kind).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 2), 0) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "not here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema == docs.schema
        for x in out.collect():
            assert x[2 if stage is not corpus_pipeline.repeat_stage else 3 :] == rows[x.doc_id][2 if stage is not corpus_pipeline.repeat_stage else 3 :]
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.schema == docs.schema and not empty.count()
    assert corpus_pipeline.token_stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    bare = corpus_pipeline.quality_stage(spark, docs.select("text", "doc_id"), str(tmp_path))
    assert bare.columns == ["text", "doc_id"]
    bare.collect()
