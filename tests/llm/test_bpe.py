import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import bpe, tokens
from tests.llm.words import thue_morse

_CHARS = st.text(st.sampled_from(list("abstrelmvd' ''  \n\t .!?12éñ世🙂 \x1c")) | st.characters(exclude_categories=["Cs"]), max_size=40)


@settings(max_examples=400, deadline=None)
@given(st.lists(_CHARS | st.none(), max_size=4))
def test_pre_tokens_are_the_matches_of_the_pattern(texts):
    data, offsets = tokens.text_bytes(pa.array(texts, pa.string()))
    starts = bpe.pre_tokens(data, offsets)
    cut = [data.tobytes()[i:j].decode() for i, j in zip(starts, np.append(starts, len(data))[1:], strict=True)]
    assert cut == [x for t in texts for x in regex.findall(P.PATTERN, t or "")]


def test_an_unknown_id_fails(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    df = spark.createDataFrame([(1, 1, (10**6).to_bytes(4, "little"))], bpe.ENCODED)
    with pytest.raises(Exception, match="no token has the id"):
        bpe.decode(df, bpe.token_bytes(spark, path)).collect()


def test_queries_equal_the_library(spark):
    texts = ["", None, "it's  ok\n\n we'll see''s", "x" * 20000, " a" * 9000, "ñandú 世界 123", *(thue_morse(n, flip) for n in (1024, 2048, 4096) for flip in (False, True))] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    path = P.path("byte_bpe_50k.tiktoken")
    enc = bpe.encoding(bpe.ranks_file(path), P.PATTERN)
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(df, path, P.PATTERN), bpe.token_bytes(spark, path)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert np.frombuffer(got[i].ids, "<u4").tolist() == enc.encode_ordinary(t or "")
        assert bytes(got[i].decoded) == (t or "").encode()
    assert bpe.encode(df.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
