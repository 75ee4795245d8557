import random

from tracewell.llm.sample import proportional_samples, repair


def test_repair_meets_targets_floors_and_limits():
    rng = random.Random(3)
    for seed in range(60):
        keys = [f"k{i}" for i in range(rng.randint(1, 8))]
        have = {k: rng.choice((0, 1, 5, 40, 300)) for k in keys}
        cuts = sorted(rng.randint(0, 1000) for _ in keys[1:])
        target = dict(zip(keys, (b - a for a, b in zip([0, *cuts], [*cuts, 1000]))))
        floor, size = {k: rng.choice((0, 2)) for k in keys}, rng.randint(0, 200)
        took = repair(have, target, floor, size, seed)
        n = min(size, sum(have.values()))
        assert sum(took.values()) == n and all(0 <= took[k] <= have[k] for k in keys)
        if sum(min(have[k], floor[k]) for k in keys) <= n:
            assert all(took[k] >= min(have[k], floor[k]) for k in keys)
        off = lambda t: sum(abs(1000 * t[k] - target[k] * n) for k in keys)
        for a in keys:  # no single swap helps
            for b in keys:
                if a != b and took[a] > min(have[a], floor[a]) and took[b] < have[b]:
                    assert off({**took, a: took[a] - 1, b: took[b] + 1}) >= off(took)


def rows(n, seed=1):
    rng = random.Random(seed)
    names = ["Foot-Altitude ", "foot_altitude", " incenter", "TANGENT", "tangent", "two circles", None, "rare"]
    weights = [9, 30, 12, 2, 9, 3, 2, 0.2]
    return [(i, rng.choices(names, weights)[0], rng.choice(("A", "b")), None if i % 17 == 0 else "text") for i in range(n)]


SCHEMA = "problem_id long, topic string, source string, statement string"
TARGETS = "request_id int, field_name string, category string, target_pm int, min_rows int, sample_rows long"


def test_sample_and_report(spark):
    data = rows(2000)
    asked = [(1, "topic", "foot_altitude", 500, 5, 200), (1, "topic", "tangent", 300, 5, 200), (1, "topic", "two_circles", 150, 5, 200), (1, "topic", "rare", 50, 30, 200), (2, "source", "a", 1000, 1, 5000), (2, "source", "none", 0, 1, 5000)]
    df = spark.createDataFrame(data + data[:300], SCHEMA + "").withColumnRenamed("problem_id", "problem_id")
    sample, report = proportional_samples(df, spark.createDataFrame(asked, TARGETS), "problem_id", "statement", ("topic", "source"))
    by = {(r["request_id"], r["category"]): r for r in report.collect()}
    norm = lambda c: None if c is None else c.strip().lower().replace("-", "_").replace(" ", "_")
    live = {i: (norm(t), norm(s)) for i, t, s, x in data if x}
    for (request, category), r in by.items():
        field = 0 if request == 1 else 1
        assert r["available"] == sum(v[field] == category for v in live.values())
        target = next(a for a in asked if (a[0], a[2]) == (request, category))
        assert r["needed"] == max(target[4], -(-target[3] * target[5] // 1000)) and r["short"] == (r["available"] < r["needed"])
    drawn = sample.collect()
    one = [r for r in drawn if r["request_id"] == 1]
    assert len(one) == 200 and len({r["id"] for r in one}) == 200
    for r in one:
        assert r["topic"] is None or live[r["id"]][0] == r["topic"]
    assert sum(r["topic"] == "rare" for r in one) == by[1, "rare"]["taken"] == min(30, by[1, "rare"]["available"])
    assert len({r["id"] for r in drawn if r["request_id"] == 2}) == len(live)
    again, _ = proportional_samples(df.repartition(5), spark.createDataFrame(asked, TARGETS), "problem_id", "statement", ("topic", "source"))
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, drawn), key=str)


def test_empty_tables(spark):
    df, asked = spark.createDataFrame(rows(20), SCHEMA), spark.createDataFrame([(1, "topic", "incenter", 1000, 1, 4)], TARGETS)
    sample, report = proportional_samples(df.limit(0), asked, "problem_id", "statement", ("topic", "source"))
    assert sample.collect() == [] and [r["available"] for r in report.collect()] == [0]
    sample, report = proportional_samples(df, asked.limit(0), "problem_id", "statement", ("topic", "source"))
    assert sample.collect() == [] and report.collect() == []


def test_report_says_what_the_sample_missed(spark):
    df = spark.createDataFrame([(k, "a" if k % 2 else "b", "s", "x") for k in range(100)], SCHEMA)
    asked = spark.createDataFrame([(1, "topic", "a", 500, 0, 10), (1, "topic", "b", 500, 8, 10)], TARGETS)
    sample, report = proportional_samples(df, asked, "problem_id", "statement", ("topic", "source"))
    assert {(r["category"], r["taken"], r["short"], r["unmet"]) for r in report.collect()} == {("a", 2, False, True), ("b", 8, False, False)}
    assert sample.groupBy("topic").count().collect() and sample.count() == 10


def test_targets_in_two_fields(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(k, rng.choice("ab"), "s2" if k < 33 else "s1", "x") for k in range(400)], SCHEMA)
    asked = [(1, "topic", "a", 300, 0, 100), (1, "topic", "b", 700, 0, 100), (1, "source", "s2", 250, 5, 100), (1, "source", "s1", 750, 0, 100)]
    sample, report = proportional_samples(df, spark.createDataFrame(asked, TARGETS), "problem_id", "statement", ("topic", "source"))
    got = {(r["field_name"], r["category"]): (r["available"], r["taken"], r["unmet"]) for r in report.collect()}
    assert got["source", "s2"] == (33, 25, False) and got["source", "s1"] == (367, 75, False) and got["topic", "a"][1:] == (30, False) and got["topic", "b"][1:] == (70, False)
    rows_ = {r["problem_id"]: r for r in df.collect()}
    assert all(rows_[r["id"]]["topic"] == r["topic"] and rows_[r["id"]]["source"] == r["source"] for r in sample.collect())


def test_joint_repair_cannot_be_improved_by_a_swap():
    rng = random.Random(9)
    for seed in range(25):
        keys = [(("t", t), ("s", s)) for t in "abc" for s in "xyz"]
        have = {k: rng.choice((0, 3, 20, 90)) for k in keys}
        target = {("t", "a"): 200, ("t", "b"): 500, ("t", "c"): 300, ("s", "x"): 600, ("s", "y"): 100, ("s", "z"): 300}
        floor, size = {("t", "a"): 4, ("s", "y"): 6}, rng.randint(20, 60)
        took = repair(have, target, floor, size, seed)
        n = min(size, sum(have.values()))
        count = lambda t: {c: sum(v for k, v in t.items() if c in k) for c in target}
        off = lambda t: sum(abs(1000 * v - target[c] * n) for c, v in count(t).items())
        low = {c: min(v, count(took)[c]) for c, v in ((c, min(count(have)[c], floor.get(c, 0))) for c in target)}
        assert sum(took.values()) == n and all(0 <= took[k] <= have[k] for k in keys)
        for a in keys:
            for b in keys:
                new = {**took, a: took[a] - 1, b: took[b] + 1} if a != b else took
                if took[a] and took[b] < have[b] and all(count(new)[c] >= low[c] for c in target):
                    assert off(new) >= off(took)


def test_a_hot_category_and_repeated_rows_with_other_content(spark):
    df = spark.range(30_000).selectExpr("id as problem_id", "case when id % 3 = 0 then 'hot' else concat('c', id % 50) end as topic", "'s' as source", "'x' as statement", "0 as t")
    df = df.unionAll(df.filter("problem_id < 900").selectExpr("problem_id", "'late' as topic", "source", "statement", "1 as t"))
    asked = spark.createDataFrame([(1, "topic", "hot", 900, 1, 3000), (1, "topic", "late", 100, 1, 3000)], TARGETS)
    sample, report = proportional_samples(df, asked, "problem_id", "statement", ("topic", "source"), latest="t")
    assert {r["category"]: (r["available"], r["taken"]) for r in report.collect()} == {"hot": (9700, 2700), "late": (900, 300)}
    assert {r["topic"]: r["count"] for r in sample.groupBy("topic").count().collect()} == {"hot": 2700, "late": 300} and sample.select("id").distinct().count() == 3000
