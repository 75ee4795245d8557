import random

import numpy as np
import pytest

from tests.llm import helpers as h
from tracewell.llm import dealing, neardup
from tracewell.llm import words as w
from tracewell.llm.neardup import BKTree, near_groups

SCHEMA = "illus_id long, description string"


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return {(r[0], r[1]) for r in near_groups(df, "illus_id", "description", **kw).collect()}


@pytest.mark.parametrize("seed,hot", [(1, 256), (2, 256), (3, 3)])
def test_groups_equal_brute_force(spark, seed, hot):
    rows = h.corpus(seed)
    assert run(spark, rows, hot=hot, counters=1 << 12) == h.groups(h.near_pairs(rows))


def test_hot_shard_of_near_copies(spark):
    """A third of all rows are edits of one text: blocks and components, not all pairs."""
    rng = random.Random(9)
    base = h.scene(rng, 6)
    rows = [(k, h.edited(rng, base, 0.01)) for k in range(60)] + [(1000 + k, h.scene(rng, 6)) for k in range(120)]
    assert run(spark, rows, hot=5, counters=1 << 12) == h.groups(h.near_pairs(rows))


def test_hot_triples_dealt_into_parts(spark):
    rng = random.Random(10)
    base = h.scene(rng, 6)
    rows = [(k, h.edited(rng, base, 0.02)) for k in range(50)] + h.corpus(5, 20, 4)[:40]
    assert run(spark, rows, counters=1 << 3, part=20, hot=8) == h.groups(h.near_pairs(rows))


def test_entries_are_shuffled_in_passes_of_bounded_size(spark, monkeypatch):
    rows = h.corpus(11, 40, 4)
    passes, dealt = [], dealing._dealt

    def counted(*args):
        out = dealt(*args)
        passes.append(sum(len(r["data"]) // dealing.ENTRY.itemsize for r in out.collect()))
        return out

    monkeypatch.setattr(dealing, "_dealt", counted)
    assert run(spark, rows, entries_a_pass=400) == h.groups(h.near_pairs(rows))
    assert len(passes) > 3 and max(passes) < 600


def test_large_shards_compare_all_pairs():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    e = np.zeros(900, dealing.ENTRY)
    e["shard"], e["rec"], e["n"] = np.repeat([2, 4], [700, 200]), np.arange(900), rng.integers(40, 130, 900)
    e["sketch"] = base ^ (rng.integers(0, 1 << 63, (900, 4), dtype=np.uint64) & rng.integers(0, 1 << 63, (900, 4), dtype=np.uint64) & rng.integers(0, 1 << 63, (900, 4), dtype=np.uint64))
    got = {(r["a"], r["b"]) for b in neardup.shard_pairs(e) for r in b.to_pylist() if r["kind"] == "pair"}
    i, j = np.triu_indices(900, 1)
    ok = (e["shard"][i] == e["shard"][j]) & dealing.close(e, i, j)
    assert got == set(zip(i[ok].tolist(), j[ok].tolist())) and 0 < len(got) < ok.size


def test_an_id_with_two_texts_links_their_groups(spark):
    a, b = h.scene(random.Random(1), 5), h.scene(random.Random(2), 5)
    assert run(spark, [(1, a), (5, a), (5, b), (7, b)]) == {(1, 1), (1, 5), (1, 7)}


def test_marks_of_triples_seen_twice():
    rng = np.random.default_rng(3)
    parts = [rng.integers(0, 400, 90) for _ in range(6)]
    tables = [np.zeros(128, np.uint8) for _ in range(2)]
    for k, t in enumerate(tables):
        w.marks(iter(parts[3 * k : 3 * k + 3]), t)
    a, b = tables
    both = a | b | ((a & b & 0x0F) << 4)
    where, n = np.unique(np.concatenate(parts), return_counts=True)
    assert w.seen_twice(both, where.astype(np.uint64)).tolist() == (n > 1).tolist()


def test_exact_copies_ties_and_repeated_rows(spark):
    text = h.scene(random.Random(4), 4)
    rows = [(7, text), (3, text), (3, text), (9, text.upper()), (11, "something else entirely with other words in it")]
    assert run(spark, rows) == {(3, 3), (3, 7), (3, 9)}


def test_empty_table_extra_columns_and_long_text(spark):
    assert run(spark, []) == set()
    long = " ".join(f"word{k}" for k in range(30_000))
    df = spark.createDataFrame([(1, long, 5, "x"), (2, long + " more", 6, "y"), (None, long, 7, "z")], "illus_id long, description string, rec int, key string")
    got = {tuple(r) for r in near_groups(df, "illus_id", "description").collect()}
    assert got == {(1, 1), (1, 2)}


def test_bk_tree_finds_all_within():
    rng = random.Random(5)
    tree, points = BKTree(), [rng.getrandbits(24) for _ in range(300)]
    for k, p in enumerate(points):
        tree.add(p, k)
    for _ in range(50):
        q, r = rng.getrandbits(24), rng.randint(0, 12)
        assert {k for k, _ in tree.within(q, r)} == {k for k, p in enumerate(points) if (p ^ q).bit_count() <= r}
    assert list(BKTree().within(1, 9)) == []
    assert neardup.HOT >= 2
