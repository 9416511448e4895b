"""Quality, language, decontamination and near duplicates against brute force or held-out rows."""

import random
import re

from pyspark.sql import functions as F

from gridloom.llm import decontaminate, jaccard, langid, quality
from gridloom.llm.common import small_batches


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def grams(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}


def corpus(seed, n=60):
    r = random.Random(seed)
    some = lambda k: " ".join(f"w{r.randint(0, 400)}" for _ in range(k))
    base = [some(r.randint(1, 60)) for _ in range(n)]
    out = [*base, "", None, " \n", "one", "One", "a b c d", "a b c d", base[0], base[0].upper()]
    for _ in range(2 * n):
        w = r.choice(base).split()
        for _ in range(r.randint(0, 4)):
            w.insert(r.randrange(len(w) + 1), some(1))
        out.append(" ".join(w[r.randint(0, 2) :]))
    return out


def test_jaccard_components(spark, monkeypatch):
    small_batches(spark, 9)
    monkeypatch.setattr(jaccard, "LEADERS", 1)
    monkeypatch.setattr(jaccard, "LARGE", 3)
    texts = corpus(3)
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "y"), (None, texts[1], "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, sign string").repartition(4)
    sets = [grams(t) for t in texts]
    near = list(range(len(texts)))

    def root(i):
        while near[i] != i:
            i = near[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = sorted((root(i), root(j)))
                near[y] = x
    want = [(i, len(sets[i or 0]) if i is not None else len(sets[1]), root(i) if i is not None else root(1)) for i, _, _ in rows]
    assert sorted(map(tuple, jaccard.linked(df).collect()), key=str) == sorted(want, key=str)
    assert jaccard.linked(df.limit(0)).count() == 0


def test_contained_items(spark):
    small_batches(spark, 9)
    texts = corpus(4)
    r = random.Random(1)
    items = [" ".join((texts[i] or "x").split()[2:]) for i in range(30)] + ["one", "b c", "", None, "w1 w2 w3 w4 w5 w6"]
    docs = [t if r.random() < 0.5 else f"{t} {r.choice(items)} end" for t in texts]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs)], "doc_id long, text string, item_id int").repartition(3)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = set()
    for k, item in enumerate(items):
        n = min(5, len(words(item)))
        mine = grams(item)
        for i, t in enumerate(docs):
            w = words(t)
            have = mine & {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if n else set()
            if mine and 100 * len(have) >= 75 * len(mine):
                want.add((i, k, len(mine), len(have)))
    for limit in (1_000_000, 50):
        got = decontaminate.contained(df, bench, block_shingles=limit).collect()
        assert {(x.doc_id, x.item_id, x.n_item, x.n_shared) for x in got} == want and len(got) == len(want)
        kept = {x.doc_id for x in decontaminate.without(df, bench, block_shingles=limit).collect()}
        assert kept == set(range(len(docs))) - {i for i, *_ in want}
    assert decontaminate.contained(df, bench.limit(0)).count() == 0
    assert decontaminate.contained(df.limit(0), bench).count() == 0


def test_quality_is_learned(spark):
    r = random.Random(2)
    good = lambda: " ".join(r.choice("the of cat dog house tree runs sees".split()) + r.choice(["", ",", ""]) for _ in range(40))
    bad = lambda: r.choice([" ".join(["spam"] * 40), " ".join(w.upper() + "!!" for w in good().split())])
    rows = [(i, (good if i % 3 else bad)(), int(i % 3 > 0)) for i in range(300)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(1000, None, "x"), (1001, "", "x"), (None, "the cat", "x"), (1, rows[1][1], "x")], "doc_id long, text string, score string").repartition(3)
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i % 5] + [(3, None), (None, 1), (7, 5)], "doc_id long, label int")
    weights = quality.train(docs, labels)
    got = {x.doc_id: x.score for x in quality.score(docs, weights).collect()}
    held = [(i, q) for i, _, q in rows if i % 5 == 0]
    assert all((got[i] >= 0.5) == bool(q) for i, q in held)
    assert got[1000] == got[1001] and 0 <= got[1000] <= 1
    assert quality.score(docs.limit(0), weights).count() == 0
    assert {x.score for x in quality.score(docs, quality.train(docs, labels.limit(0))).collect()} == {0.5}


def test_language_is_learned(spark):
    r = random.Random(3)
    letters = {"aa": "abcde ", "bb": "éèàüß ", "cc": "klmno "}
    text = lambda lang: "".join(r.choice(letters[lang]) for _ in range(r.randint(20, 200)))
    rows = [(i, text(x), x) for i in range(240) for x in [list(letters)[i % 3]]]
    df = spark.createDataFrame([*rows, (900, None, "aa"), (901, " 12 !", "bb"), (None, text("cc"), "cc"), (902, text("aa"), None), (903, "é", "bb")], "doc_id long, text string, lang string").repartition(2)
    model = langid.train(df.filter("doc_id % 4 <> 2"))
    got = {x.doc_id: x for x in langid.predict(df, model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows if i % 4 == 2)
    assert [(got[i].lang_pred, got[i].score) for i in (900, 901)] == [("und", 0.0)] * 2 and got[902].lang_pred == "aa"
    nothing = langid.train(df.limit(0))
    assert {x.lang_pred for x in langid.predict(df, nothing).collect()} == {"und"}
    assert langid.predict(df.limit(0), model).count() == 0
    assert df.filter(F.col("lang") == "aa").count() > 0


def test_many_texts_without_ids(spark):
    """Rows that share an id, or have none, come once each: their number doesn't square before their sets are told apart."""
    small_batches(spark)
    rows = [(None, f"text {i} has words of its own number {i * 7} and {i % 50} more {i * 31}") for i in range(3000)] + [(7, rows_text) for rows_text in ("a b c d e f g", "h i j k l m n", "a b c d e f g")]
    got = jaccard.linked(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == 3003 and sum(r.doc_id is None for r in got) == 3000
    assert {r.component_id for r in got if r.doc_id == 7} == {7}
