import base64
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewell.llm import encode

pytestmark = pytest.mark.skipif(not os.path.exists(encode.TOKENIZER), reason="no tokenizer files")


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(encode.TOKENIZER, "rb"))}
    return tiktoken.Encoding("own", pat_str=encode.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return encode.Encoder(encode.read_ranks(encode.TOKENIZER))


@settings(max_examples=200, deadline=None)
@given(text=st.text(max_size=80))
def test_equals_reference(text, encoder, reference):
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    ids = encoder.encode(text)
    assert list(ids) == reference.encode_ordinary(text)
    assert reference.decode(ids) == text


def test_special_and_long_pieces(encoder, reference):
    rng = random.Random(1)
    for text in ("<|endoftext|> plain", "a" * 5000, "=" * 3000 + "\n\n   x", "".join(rng.choice("aäбж点 1") for _ in range(5000)), "thethethe" * 800):
        assert list(encoder.encode(text)) == reference.encode_ordinary(text)
    assert list(encoder.encode(None)) == list(encoder.encode("")) == []


def test_pattern_is_the_public_one():
    import public_tokenizers as P

    assert encode.PATTERN == P.PATTERN


def test_memory_is_bounded(encoder):
    own = encode.Encoder(encoder.ranks)
    own.MOST = 10
    for k in range(100):
        own.encode(f"word{k} {k}")
    assert len(own) <= 11


def test_table(spark, reference):
    rows = [(1, "Let O be the circumcentre.", 9), (2, None, 9), (3, "", 9), (3, "", 9), (None, "x y", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted((r["doc_id"] or 0, list(r["ids"])) for r in encode.encode_texts(df, "doc_id", "text").collect())
    assert got == sorted((i or 0, reference.encode_ordinary(t or "")) for i, t, _ in rows)
    assert encode.encode_texts(df.limit(0), "doc_id", "text").collect() == []
