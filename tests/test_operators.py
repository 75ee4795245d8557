import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewell.operators import curate as cu
from tracewell.operators import generate, report
from tracewell.operators.components import connected_components
from tracewell.operators.rates import live_rate, wilson
from tracewell.session import clear_staged, stage, unstage
from tracewell.sources import files
from tracewell.streaming import events as ev


def components(edges):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {(x, top(x)) for x in list(up)}


@pytest.mark.parametrize("edges", [[(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 60)] + [(100, 101), (101, 102), (102, 100)], [(9, 3), (3, 9), (5, 5), (None, 4), (7, 3), (60, 50)], []])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    want = components([e for e in edges if None not in e and e[0] != e[1]])
    assert {tuple(r) for r in connected_components(df).collect()} == want


def test_latest_first_k_and_ordinals(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 5, "c"), (None, 1, "d"), (None, 0, "e")], "k int, t int, v string")
    assert {r["v"] for r in cu.latest(df, ["k"], [F.desc("t")]).collect()} == {"b", "c", "d"}
    assert cu.first_k(df, ["k"], [F.col("t")], 2).count() == 5
    ids = cu.ordinals(spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("x")), ["x"])
    assert all(r["id"] == r["x"] for r in ids.collect()) and ids.count() == 1000
    assert cu.ordinals(df.limit(0), ["t"]).collect() == []


def test_repeat_and_disjoint(spark):
    df = spark.createDataFrame([(1, 0), (2, 3)], "k int, n int")
    assert sorted((r["k"], r["copy"]) for r in cu.repeated(df, F.col("n")).collect()) == [(1, 1), (2, 1), (2, 2), (2, 3)]
    cu.must_be_disjoint(df.filter("k = 1"), df.filter("k = 2"), ["k"])
    with pytest.raises(ValueError):
        cu.must_be_disjoint(df, df, ["k"])


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 50), st.integers(0, 50))
def test_wilson_stays_within_bounds(spark, a, b):
    hits, n = min(a, b), max(a, b)
    low, high = wilson(F.lit(hits), F.lit(n))
    lo, hi, rate = spark.range(1).select(low, high, live_rate(F.lit(hits), F.lit(n))).first()
    assert 0 <= lo <= rate + 1e-12 and rate - 1e-12 <= hi <= 1
    assert (lo, hi, rate) == (0.0, 1.0, 0.0) if n == 0 else lo < hi


def test_threshold_scans(spark):
    cells = spark.createDataFrame([(1, 0.9), (2, 0.2), (3, 0.5), (4, 0.1), (5, 0.0)], "chain int, rate double")
    assert report.first_failing_cell(cells, ["chain"], "rate", 0.3).first()["chain"] == 4
    assert report.first_failing_cell(cells, ["chain"], "rate", 0.05).first()["chain"] == 5
    assert report.first_failing_cell(cells, ["chain"], "rate", 0.0).collect() == []
    assert report.first_failing_cell(cells.limit(0), ["chain"], "rate", 0.3).collect() == []
    two = spark.createDataFrame([("a", 1, 0.9), ("a", 2, 0.8), ("a", 4, 0.9), ("b", 2, 0.9), ("c", 1, 0.4)], "m string, chain int, rate double")
    assert {tuple(r) for r in report.reliable_up_to(two, ["m"], "chain", "rate", 0.7, 6).collect()} == {("a", 2, None), ("b", None, None), ("c", None, 1)}


def test_jsonl_with_torn_line(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"id": 1, "v": "a"}\n\n{"id": 2}\n{"id": 3, "v": "to')
    got = files.read_jsonl(spark, str(p), "id bigint, v string")
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (2, None)]
    with pytest.raises(Exception, match="MALFORMED"):
        files.read_jsonl(spark, str(p), "id bigint, v string", torn="fail").collect()
    assert {tuple(r) for r in files.with_defaults(got, {"v": "none", "w": 4}).collect()} == {(1, "a", 4), (2, "none", 4)}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("m", "c1", 0.5, None), ("m", "c2", 1.0, "x|y"), ("n", "c1", 0.0, "z")], "model string, cell string, rate double, note string")
    files.write_csv(df, str(tmp_path / "c"), ["cell", "rate"])
    assert spark.read.csv(str(tmp_path / "c"), header=True).columns == ["cell", "rate"]
    assert {r["model"]: r["json"] for r in files.nested_json(df, "model", "cell", ["rate"]).collect()}["m"] == '{"c1":{"rate":0.5},"c2":{"rate":1.0}}'
    assert files.markdown(df.filter("cell = 'c2'")) == "| model | cell | rate | note |\n| --- | --- | --- | --- |\n| m | c2 | 1 | x\\|y |\n"
    with pytest.raises(ValueError):
        files.markdown(df, limit=2)
    merged = files.merged_results(df, df.filter("model = 'm' and cell = 'c1'").withColumn("rate", F.lit(0.75)), ["model", "cell"])
    assert {(r["model"], r["cell"]): r["rate"] for r in merged.collect()} == {("m", "c1"): 0.75, ("m", "c2"): 1.0, ("n", "c1"): 0.0}
    files.check_metadata({"k": 1, "z": 2}, {"k": 1})
    with pytest.raises(ValueError):
        files.check_metadata({"k": 1}, {"k": 2})


def test_generated_scenes(spark):
    a = {tuple(map(str, r)) for r in generate.scenes(spark, 60, seed=3).collect()}
    b = {tuple(map(str, r)) for r in generate.scenes(spark, 60, seed=3).repartition(7).collect()}
    assert a == b and len(a) == 60
    for r in generate.chains(spark, 80, 3, mixed=True, seed=1).collect():
        assert r["chain"] == 3 == len(r["tags"]) and r["tags"][-1] in ("foot", "intersection") and len(r["names"]) == 6
        assert all(abs(v) <= generate.FAR for v in [*r["xs"], *r["ys"]])


def test_stream_counts_late_and_repeated_events(spark, tmp_path):
    rows = [(1, "2026-01-01 10:00:00", "click", 1.0), (1, "2026-01-01 10:00:00", "click", 1.0), (2, "2026-01-01 11:00:00", "view", 2.0), (3, "2026-01-02 09:00:00", "click", 4.0)]
    df = spark.createDataFrame(rows, "event_id long, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.write.parquet(str(tmp_path / "in"))
    q = ev.run_once(ev.windowed_counts(ev.event_stream(spark, str(tmp_path / "in"), df.schema)), "stream_test", str(tmp_path / "ck"))
    assert not q.isActive
    assert {(str(r["start"])[:10], r["event_type"], r["n"], r["total"]) for r in spark.table("stream_test").collect()} == {("2026-01-01", "click", 1, 1.0), ("2026-01-01", "view", 1, 2.0), ("2026-01-02", "click", 1, 4.0)}


def test_merge_latest_is_repeatable(spark, tmp_path):
    schema = "k string, t int, v int"
    path = str(tmp_path / "lww")
    first, second = spark.createDataFrame([("a", 1, 10), ("b", 1, 20)], schema), spark.createDataFrame([("a", 2, 11), ("b", 0, 19), ("c", 1, 30)], schema)
    assert ev.latest_table(spark, path) is None
    for epoch, batch in ((0, first), (1, second), (1, second), (2, first.limit(0)), (3, first)):
        ev.merge_latest(batch, epoch, path, ["k"], "t")
    assert {tuple(r) for r in ev.latest_table(spark, path).collect()} == {("a", 2, 11), ("b", 1, 20), ("c", 1, 30)}
    (tmp_path / "lww" / "epoch=4").mkdir()  # a version that broke off
    assert ev.latest_table(spark, path).count() == 3


def test_merge_latest_folds_its_parts(spark, tmp_path):
    path = str(tmp_path / "fold")
    for epoch in range(7):
        ev.merge_latest(spark.createDataFrame([("a", epoch, epoch), (f"k{epoch}", 0, epoch)], "k string, t int, v int"), epoch, path, ["k"], "t", compact=2)
    ev.merge_latest(spark.createDataFrame([("a", 5, 5), ("k5", 0, 5)], "k string, t int, v int"), 5, path, ["k"], "t", compact=2)
    assert {(r["k"], r["v"]) for r in ev.latest_table(spark, path).collect()} == {("a", 6), *((f"k{e}", e) for e in range(7))}
    assert len([x for x in (tmp_path / "fold").iterdir() if x.name.startswith("epoch=")]) <= 5


def test_staged_tables_are_cleared(spark):
    a, b = stage(spark.range(5), "a"), stage(spark.range(6), "b")
    assert a.count() == 5
    unstage(a)
    assert b.count() == 6 and clear_staged(spark) >= 1 and clear_staged(spark) == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST|does not exist|NOT_FOUND"):
        spark.read.parquet(b._tracewell_path).count()
