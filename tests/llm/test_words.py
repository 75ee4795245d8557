import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewell.llm import words as w


def test_words_of_mixed_text():
    assert w.words("Let P_1 be ﬁne: Ä̈, 点A３!") == ["let", "p", "1", "be", "fine", "ä", "点a3"]
    assert w.words(None) == w.words("") == w.words(" \t…") == []


@settings(max_examples=60, deadline=None)
@given(st.text(st.characters(exclude_categories=("Cs", "Cn")), max_size=60))
def test_words_are_letters_and_digits(text):
    import regex
    import unicodedata

    assert w.words(text) == regex.findall(r"[\p{L}\p{N}]+", unicodedata.normalize("NFKC", text).lower())


def test_windows_depend_on_order_and_content():
    s = w.Symbols()
    a, b = s.of("a b c d"), s.of("b a c d")
    assert len(w.window_hashes(a)) == 2
    assert w.window_hashes(a)[1] != w.window_hashes(b)[1] or w.window_hashes(a)[0] != w.window_hashes(b)[0]
    assert len(w.window_hashes(s.of("a b"))) == 0


@settings(max_examples=80, deadline=None)
@given(st.sets(st.integers(0, 2**63), max_size=40), st.sets(st.integers(0, 2**63), max_size=40))
def test_sketch_and_prefix_bounds(x, y):
    a, b = (np.array(sorted(v), np.uint64) for v in (x, y))
    near = w.near_from_counts(len(x & y), len(x), len(y))
    assert near == (bool(x & y) and 2 * len(x & y) >= len(x | y))
    d = (int.from_bytes(w.parity_sketch(a), "big") ^ int.from_bytes(w.parity_sketch(b), "big")).bit_count()
    assert d <= len(x ^ y)
    if near:
        counts = np.zeros(1 << 10, np.uint8)
        counts[np.arange(0, 1 << 10, 3)] = 200
        assert set(w.prefix_order(a, counts).tolist()) & set(w.prefix_order(b, counts).tolist())
        assert 3 * d <= len(x) + len(y)


def test_symbols_forget():
    s = w.Symbols()
    s.MOST = 3
    one = s.of("a b c d e")
    assert (one == s.of("a b c d e")).all() and len(s) <= 5


def test_merged_table_adds_and_saturates(spark):
    df = spark.range(0, 1000, 1, 7).selectExpr("cast(id % 10 as int) as k")

    def fill(batches, table):
        for b in batches:
            w.add_saturating(table, b.column(0).to_numpy())

    got = w.merged_table(df, fill, 1 << 17, "add")
    assert got[:10].tolist() == [100] * 10 and got[10:].sum() == 0
    assert w.merged_table(df.unionAll(df).unionAll(df), fill, 1 << 17, "add")[0] == 255
