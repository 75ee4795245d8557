import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tracewell.functions import classify as cl
from tracewell.functions import grading as gr
from tracewell.functions.figure_parser import named_points
from tracewell.operators import families


def hits(group, found, truth, atol):
    near = lambda n, m: n in found and max(abs(found[n][0] - truth[m][0]), abs(found[n][1] - truth[m][1])) <= atol
    return max(sum(near(n, m) for n, m in zip(group, p)) for p in permutations(group))


@pytest.mark.parametrize("size", [1, 2, 3, 4, 7])
def test_groups_get_the_best_assignment(size):
    rng = random.Random(size)
    for _ in range(30):
        names = [f"P{k}" for k in range(size)]
        truth = {n: (rng.randint(0, 2), rng.randint(0, 2)) for n in names}
        found = {n: (rng.randint(0, 2), rng.randint(0, 2)) for n in names if rng.random() < 0.9}
        g = gr.graded(found, truth, [names], 0.5)
        assert g["matched"] == hits(names, found, truth, 0.5) == sum(dict(g["ok"]).values()) and g["total"] == size and sorted(dict(g["of"]).values()) == names


def test_grades(spark):
    fig = "\\begin{tikzpicture}\n\\coordinate (A) at (1,2);\n\\coordinate (B) at (3,4);\n\\end{tikzpicture}"
    rows = [(fig, 1.0, 1.04), ("Here: " + fig, 1.0, 1.04), (fig, 1.06, 0.0), ("no figure", 1.0, 1.0), (None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "text string, x double, y double").withColumn("truth", F.create_map(F.lit("A"), F.array("x", F.lit(2.05)), F.lit("B"), F.array(F.lit(3.0), F.lit(4.0))))
    got = [r["g"] for r in df.select(gr.grade(F.col("text"), F.col("truth")).alias("g")).collect()]
    assert [(g["passed"], g["figure_only"], g["matched"], g["coord_accuracy"]) for g in got] == [(True, True, 2, 1.0), (False, False, 2, 1.0), (False, True, 1, 0.5), (False, False, 0, 0.0), (False, False, 0, 0.0)]
    only = df.select(gr.grade(F.col("text"), F.col("truth"), only=F.array(F.lit("B")), compiles=F.lit(False)).alias("g")).first()["g"]
    assert (only["total"], only["coords_all_correct"], only["passed"]) == (1, True, False)
    empty = df.select(gr.grade(F.col("text"), F.expr("cast(map() as map<string, array<double>>)")).alias("g")).first()["g"]
    assert (empty["total"], empty["coords_all_correct"], empty["coord_accuracy"]) == (0, False, 0.0)


def test_log_of_a_typesetter(spark):
    log = "noise\nREF 10pt 20pt 30pt 20pt 10pt\nREF 10pt 20pt 30pt 20pt 10pt 60pt\nP 1pt 1pt\nP 20pt 40.0pt\nQ undef\n\nR x y"
    frame, points = gr.canvas_log(F.col("log"))
    r = spark.createDataFrame([(log,), (None,)], "log string").select(frame.alias("f"), points.alias("p")).select("p", gr.frame_units(F.element_at("p", "P"), F.col("f")).alias("at")).collect()
    assert tuple(r[0]["at"]) == (0.5, 0.5) and r[0]["p"]["Q"] is None and r[0]["p"]["R"] is None and r[1]["at"] is None and r[1]["p"] == {}


@pytest.mark.parametrize("tag", list(families.FAMILIES))
def test_family_figures_state_their_points(tag):
    for row in range(6):
        _, _, said, figure, points, derived, unordered = families.problem(row, 3, tag)
        read = named_points(figure)
        assert set(derived) <= {n for n, _ in points} and all(max(abs(read[n][0] - p[0]), abs(read[n][1] - p[1])) <= 0.002 for n, p in points)
        assert all(n in said for n in derived) and (unordered == []) == (tag not in ("tangent", "two_circles"))


def test_circle_scenes():
    assert families.circle_scene(4, 1, 5, True) == families.circle_scene(4, 1, 5, True)
    seen = set()
    for row in range(150):
        for symbolic in (False, True):
            _, _, _, figure, points, chain, _, tags = families.circle_scene(row, 2, 6, row % 2 == 0, symbolic=symbolic)
            read = named_points(figure)
            assert chain == len(tags) == len(points) <= 6 and all(max(abs(read[n][0] - p[0]), abs(read[n][1] - p[1])) <= gr.ATOL for n, p in points)
            seen |= set(tags)
        assert not set(families.circle_scene(row, 2, 6, False, easy_only=True)[-1]) & set(families.HARD_OPS)
        forced = families.circle_scene(row, 2, 5, True, force_op="foot_altitude")[-1]
        assert "intersection" not in forced and forced.count("foot_altitude") <= 1
    assert seen == {"point_on_circle", "reflect_x", "reflect_y", "midpoint", "intersection", "foot_altitude"}


def test_rules(spark):
    texts = ["a 7-gon", "a 6-gon", "an 8 sided shape", "a regular polygon with 12 sides", "an octagon", "8 sides", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(F.coalesce(cl.many_corners(F.lower("t")), F.lit(False))).collect()] == [True, False, True, True, True, False, False]
    both = spark.createDataFrame([("A=(1,2). Output a single TikZ figure",), ("A at (1,2). Output a single TikZ figure",), ("A = (-1,2)",), (None,)], "t string")
    assert [r[0] for r in both.select(cl.looks_templated(F.col("t"))).collect()] == [True, False, False, False]
