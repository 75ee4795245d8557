import itertools
import os
import random

import numpy as np
import pytest

from tests.llm import helpers as h
from tracewell.llm import dealing, overlap
from tracewell.llm.overlap import coverage, spans, split_overlaps
from tracewell.llm.words import words
from tracewell.session import shared_path

SCHEMA = "tbl int, rec long, train boolean, text string"


def brute(rows):
    out = set()
    for (t, a, x, p), (u, b, y, q) in itertools.combinations(rows, 2):
        if t == u and None not in (x, y) and x != y and p and q and h.near(p, q):
            out.add((t, a, b) if x else (t, b, a))
    return out


def run(spark, rows, **kw):
    found = split_overlaps(spark.createDataFrame(rows, SCHEMA).repartition(3), **kw).collect()
    return {(r["tbl"], r["train_id"], r["held_id"]) for r in found}, found


@pytest.mark.parametrize("seed,passages", [(1, 10**6), (2, 300)])
def test_overlaps_equal_brute_force(spark, seed, passages):
    rng = random.Random(seed)
    rows = [(rng.randint(0, 1), i, rng.choice((True, True, False, None)), t) for i, t in h.corpus(seed, 40, 5)]
    got, found = run(spark, rows, passages=passages)
    assert got == brute(rows) and got
    for r in found:
        assert 0 < sum(x["end"] - x["start"] for x in r["spans"]) <= r["words"] and 3 * r["common"] >= r["n_train"] + r["n_held"]


def test_copies_repeats_and_same_text_in_both_tables(spark):
    text = h.scene(random.Random(3), 5)
    rows = [(0, 1, True, text), (0, 1, True, text), (0, 2, False, text), (0, 3, False, text), (1, 4, False, text)]
    got, found = run(spark, rows)
    assert got == {(0, 1, 2), (0, 1, 3)} and all([(x["start"], x["end"]) for x in r["spans"]] == [(0, r["words"])] for r in found)


def test_a_training_text_meets_only_what_shares_a_triple(spark, monkeypatch):
    """The work doesn't grow as training texts times shards of evaluation texts: each text is read once, and a bucket
    holds a share of the entries; parts and passes change no result."""
    rng = random.Random(12)
    rows = [(rng.randint(0, 1), i, rng.choice((True, True, False)), t) for i, t in h.corpus(12, 40, 5)]
    dealt, sent = dealing._dealt, []

    def counted(*args):
        out = dealt(*args)
        sent.append(sum(len(r["data"]) // dealing.ENTRY.itemsize for r in out.collect()))
        return out

    monkeypatch.setattr(dealing, "_dealt", counted)
    assert run(spark, rows, passages=200)[0] == brute(rows)
    triples = sum(len(h.triple_set(t)) // 2 + 1 for *_, t in rows if t and len(words(t)) > 2)
    assert len(sent) == 1 and sent[0] <= triples
    assert run(spark, rows, counters=1 << 6, part=40, entries_a_pass=500)[0] == brute(rows) and len(sent) > 2
    assert overlap.PASSAGES > 0


def test_empty_nulls_and_one_sided(spark):
    assert run(spark, [])[0] == set()
    assert run(spark, [(0, 1, True, None), (0, 2, False, ""), (0, None, False, "a b c d"), (0, 3, True, "a b")])[0] == set()
    assert run(spark, [(0, 1, True, "a b c d e f"), (0, 2, True, "a b c d e f")])[0] == set()


def test_extra_columns(spark):
    df = spark.createDataFrame([(0, 1, True, "a b c d e", 3, "x"), (0, 2, False, "a b c d e", 4, "y")], SCHEMA + ", n int, symbols string")
    assert [(r["train_id"], r["held_id"]) for r in split_overlaps(df).collect()] == [(1, 2)]


def test_spans_are_merged_windows():
    assert spans(np.array([True, True, False, False, False, True])) == [{"start": 0, "end": 4}, {"start": 5, "end": 8}]
    assert spans(np.array([True] * 4)) == [{"start": 0, "end": 6}] and spans(np.zeros(3, bool)) == []


def test_coverage_merges_over_all_training_texts(spark):
    rng = random.Random(6)
    rows = [(0, i, rng.random() < 0.7, t) for i, t in h.corpus(6, 25, 6)]
    want: dict[int, set[int]] = {}
    texts = {i: t for _, i, _, t in rows}
    for _, a, b in brute(rows):
        w, own = words(texts[b]), h.triple_set(texts[a])
        want.setdefault(b, set()).update(*[range(k, k + 3) for k in range(len(w) - 2) if tuple(w[k : k + 3]) in own])
    got = {r["held_id"]: (r["covered"], r["words"]) for r in coverage(split_overlaps(spark.createDataFrame(rows + rows[:9], SCHEMA))).collect()}
    assert got == {b: (len(v), len(words(texts[b]))) for b, v in want.items()} and got


def test_one_id_with_two_texts(spark):
    a, b = h.scene(random.Random(1), 5), h.scene(random.Random(2), 5)
    rows = [(0, 1, True, a), (0, 2, False, a), (0, 2, False, b), (0, 3, False, b), (0, 4, True, b)]
    assert run(spark, rows)[0] == {(0, 1, 2), (0, 4, 2), (0, 4, 3)}


def test_a_blank_split_is_another_split(spark, tmp_path):
    from tracewell.llm.queries import _split_records

    rows = [(1, " Train "), (2, " "), (3, None), (4, "eval")]
    for name, rec, text in (("illustrations", "illus_id", "description"), ("problems", "problem_id", "statement")):
        spark.createDataFrame([(k, split, "one two three four") for k, split in rows], f"{rec} long, split string, {text} string").write.parquet(f"{tmp_path}/{name}.parquet")
    got = {(r["tbl"], r["rec"], r["train"]) for r in _split_records(spark, str(tmp_path)).collect()}
    assert got == {(k, rec, train) for k in (0, 1) for rec, train in ((1, True), (2, False), (3, None), (4, False))}


def test_one_copy_of_prefixes_and_tables(spark, monkeypatch):
    """Only triples on both sides are ever staged, and tables are one file in the shared folder, gone once read; a
    broadcast has a copy on the driver and on each executor."""
    rng, prefixes, sent, folders = random.Random(21), [], [], set()
    one_sided = [" ".join(f"{'ab'[k % 2]}{k}w{i}" for i in range(50)) for k in range(40)]
    both = h.scene(rng, 5)
    rows = [(0, k, k % 2 == 0, t) for k, t in enumerate([*one_sided, both, both])]

    def staged(df, what, **kw):
        out = stage(df, what, **kw)
        if what == "prefixes":
            prefixes.append(sum(len(r["prefix"]) // 8 for r in out.collect()))
        return out

    stage, broadcast, sc = overlap.stage, type(spark.sparkContext).broadcast, spark.sparkContext
    monkeypatch.setattr(overlap, "stage", staged)
    monkeypatch.setattr(type(sc), "broadcast", lambda self, x: sent.append(getattr(x, "nbytes", 0)) or broadcast(self, x))
    monkeypatch.setattr(overlap, "shared_path", lambda *a: folders.add(path := shared_path(*a)) or path, raising=False)
    assert run(spark, rows)[0] == {(0, 40, 41)}
    assert prefixes == [2 * (len(h.triple_set(both)) // 2 + 1)] and max(sent) < 1 << 20
    assert folders and not any(os.path.exists(x.removeprefix("file://")) for x in folders)
