import random

import numpy as np
import pytest

from tracewell.llm import spans

SCHEMA = "doc_id long, text string"


def brute(docs, span):
    """doc -> covered places, as sets."""
    where = {}
    for d, t in docs:
        for i in range(len(t or "") - span + 1):
            where.setdefault(t[i : i + span], set()).add(d)
    out = {}
    for d, t in docs:
        for i in range(len(t or "") - span + 1):
            if len(where[t[i : i + span]]) > 1:
                out.setdefault(d, set()).update(range(i, i + span))
    return out


def data(seed, span):
    rng = random.Random(seed)
    letters = "abcdeéж点𝔘 \n"
    fresh = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = [fresh(rng.randint(span - 3, 3 * span)) for _ in range(6)]
    docs = [(k, fresh(rng.randint(0, 60)) + (rng.choice(shared) if rng.random() < 0.6 else "") + fresh(rng.randint(0, 90))) for k in range(60)]
    return docs + [(100, None), (101, ""), (102, "-" * 120), (103, "-" * 90 + "x"), (104, docs[0][1]), (105, docs[0][1])]


@pytest.mark.parametrize("seed,span", [(1, 20), (2, 21), (3, 40)])
def test_spans_equal_brute_force(spark, seed, span):
    docs = data(seed, span)
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    got = {}
    for r in spans.shared_spans(df, "doc_id", "text", span).collect():
        piece = set(range(r["start"], r["end"]))
        assert not piece & got.get(r["doc_id"], set())
        got.setdefault(r["doc_id"], set()).update(piece)
    assert got == brute(docs, span) and got


def test_empty_and_extra_columns(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdef") for _ in range(900))
    df = spark.createDataFrame([(1, text, 3, "m"), (2, "zz" + text[:500], 4, "n"), (None, text, 5, "o")], SCHEMA + ", doc int, mark string")
    got = {tuple(r) for r in spans.shared_spans(df, "doc_id", "text").collect()}
    assert got == {(1, 0, 500), (2, 2, 502)}
    assert spans.shared_spans(df.limit(0), "doc_id", "text").collect() == []


def test_rabin_karp_and_winnowing():
    rng = random.Random(2)
    text = "".join(rng.choice("ab") for _ in range(400))
    h = spans.RabinKarp(spans._BASES[0]).windows(spans.code_points(text), 7)
    assert len(h) == 394
    seen = {}
    for i, x in enumerate(h.tolist()):
        assert seen.setdefault(text[i : i + 7], x) == x
    assert len(set(seen.values())) == len(seen)
    picked = set(spans.winnowed(h, 30).tolist())
    for i in range(len(h) - 29):
        low = h[i : i + 30].min()
        assert {j for j in range(i, i + 30) if h[j] == low} <= picked
    assert len(spans.winnowed(h[:10], 30)) == 0
    assert spans.winnowed(np.array([5, 5, 5], np.uint64), 2).tolist() == [0, 1, 2]
