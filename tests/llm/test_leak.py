import random

import pytest

from tests.llm import helpers as h
from tracewell.llm.leak import ItemIndex, leaked_items
from tracewell.llm.words import words


def brute(docs, items, run=12):
    grams = {}
    for k, t in items:
        w = words(t)
        for i in range(len(w) - run + 1):
            grams.setdefault(tuple(w[i : i + run]), set()).add(k)
    out = set()
    for d, t in docs:
        w = words(t)
        for i in range(len(w) - run + 1):
            out |= {(d, k) for k in grams.get(tuple(w[i : i + run]), ())}
    return out


def data(seed):
    rng = random.Random(seed)
    items = [(k, h.scene(rng, 3)) for k in range(60)]
    items += [(60, items[0][1] + " More words."), (61, "too short"), (62, None), (63, "a a a a a a a a a a a a a a a a"), (64, items[3][1])]
    docs = []
    for d in range(150):
        w = h.scene(rng, 8).split()
        if rng.random() < 0.6:
            own = (items[rng.randrange(60)][1]).split()
            n = rng.choice((9, 11, 12, 13, 20))
            a = rng.randrange(max(1, len(own) - n))
            at = rng.randrange(len(w))
            w[at:at] = own[a : a + n]
        docs.append((d, " ".join(w)))
    docs += [(900, None), (901, ""), (902, "a " * 40), (903, items[5][1].upper().replace(" ", "  \n"))]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_index_equals_brute_force(seed):
    docs, items = data(seed)
    index = ItemIndex([(k, words(t)) for k, t in items])
    got = {(d, int(index.items[k])) for d, t in docs for k in index.held(words(t))}
    assert got == brute(docs, items) and got


def test_table_and_shards(spark):
    docs, items = data(4)
    d = spark.createDataFrame(docs + docs[:5] + [(None, items[0][1])], "doc_id long, text string").withColumnRenamed("doc_id", "doc_id")
    i = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert {(r[0], r[1]) for r in leaked_items(d, "doc_id", "text", i, "item_id", "text").collect()} == want
    assert {(r[0], r[1]) for r in leaked_items(d, "doc_id", "text", i, "item_id", "text", shard_bytes=3_000).collect()} == want


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "x")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert leaked_items(docs, "doc_id", "text", items, "item_id", "text").collect() == []
    items = spark.createDataFrame([(1, " ".join("abcdefghijklmn"))], "item_id long, text string")
    assert leaked_items(docs.limit(0), "doc_id", "text", items, "item_id", "text").collect() == []


def test_counts_of_words(spark):
    text = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    items = spark.createDataFrame([(5, " ".join(f"w{k}" for k in range(5, 20)))], "item_id long, text string")
    assert [tuple(r) for r in leaked_items(docs, "doc_id", "text", items, "item_id", "text").collect()] == [(1, 5, 4, 15)]
