import hashlib
import random

from gridloom.llm import suffix
from gridloom.llm.common import small_batches
from tests.llm.words import thue_morse


def covered(rows, length):
    """For each row, which bytes go."""
    seen = {}
    for doc, text in rows:
        for p in range(len(text) - length + 1):
            w, at = text[p : p + length], (-1 << 70 if doc is None else doc, p)
            seen[w] = min(seen.get(w, at), at)
    for doc, text in rows:
        gone = [False] * len(text)
        for p in range(len(text) - length + 1):
            if seen[text[p : p + length]] < (-1 << 70 if doc is None else doc, p):
                gone[p : p + length] = [True] * length
        yield gone


def brute(rows, length):
    """n_removed, spans and kept bytes of each row."""
    out = []
    for (doc, text), gone in zip(rows, covered(rows, length), strict=True):
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(text), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(text, gone, strict=True) if not g)).hexdigest()))
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    vocabulary = [word() for _ in range(60)]
    some = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    shared = [some(40) for _ in range(4)]
    texts = [some(r.randint(0, 30)) + r.choice(shared)[r.randint(0, 30) :] + some(r.randint(0, 30)) for _ in range(60)]
    texts += [thue_morse(2048), thue_morse(2048, True), "a" * 450, "ab" * 200, "x y " * 90, "", None, texts[3], texts[3] + "!", texts[4][5:]]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    return [*rows, rows[0], (None, texts[0]), (rows[1][0], rows[2][1])]


def test_against_brute_force(spark):
    small_batches(spark, 7)
    rows = corpus(1)
    for length in (100, 40):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = [tuple(r) for r in suffix.repeat_digests(suffix.remove_repeats(df, length)).collect()]
        want = brute([(d, (t or "").encode()) for d, t in rows], length)
        assert sorted(got, key=str) == sorted(want, key=str)


def test_many_batches_in_the_index(spark, monkeypatch):
    monkeypatch.setattr(suffix, "BATCH", 5)
    asked = []
    r = random.Random(2)
    import numpy as np

    want = {}
    pieces = [[(r.randint(0, 40), r.randint(0, 30), r.randint(0, 9)) for _ in range(r.randint(1, 9))] for _ in range(60)]
    for piece in pieces:
        for p, d, s in piece:
            want[p] = min(want.get(p, (d, s)), (d, s))
        ids = np.array(sorted({d for _, d, _ in piece}), np.int64)
        asked.append([np.searchsorted(ids, [d for _, d, _ in piece]).astype(np.uint32), np.array([s for *_, s in piece], np.uint32), ids, np.zeros(len(ids), np.uint8)])
    index = suffix._indexed(asked, [np.array([p for p, *_ in x], np.uint64) for x in pieces])
    assert index.later.tolist() == [want[p] < (d, s) for x in pieces for p, d, s in x]


def test_repeated_rows_over_many_batches(spark):
    """Copies of a row fare alike wherever the batches end: also those of a passage that an earlier document has."""
    small_batches(spark, 7)
    rows = corpus(3)
    rows += [(d, t) for d, t in rows if d is not None and d % 3 == 0] + rows[:20]
    random.Random(4).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [tuple(r) for r in suffix.repeat_digests(suffix.remove_repeats(df, 60, batch=4)).collect()]
    want = brute([(d, (t or "").encode()) for d, t in rows], 60)
    assert sorted(got, key=str) == sorted(want, key=str)


def test_twins_in_levels(spark):
    """One place in three batches, and an earlier one of the same suffix before, between or after them."""
    import numpy as np

    for docs in ([5, 5, 3, 3, 5, 5], [3, 5, 5, 3, 5, 5], [5, 5, 5, 5, 3, 3], [5, 5, 3, 3, 1, 3]):
        pieces = [np.array(docs[k : k + 2], np.int64) for k in (0, 2, 4)]
        asked = [[np.arange(2, dtype=np.uint32), np.zeros(2, np.uint32), ids, np.zeros(2, np.uint8)] for ids in pieces]
        index = suffix._indexed(asked, [np.full(2, 7, np.uint64)] * 3, batch=2)
        assert index.later.tolist() == [d > min(docs) for d in docs]


def test_no_rows(spark):
    assert suffix.repeat_digests(suffix.remove_repeats(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
