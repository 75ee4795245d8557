"""Closed-form properties of the geometry columns."""

import pytest
from pyspark.sql import functions as F

from tracewell.functions import geometry as g

TRIANGLES = [(0, 0, 6, 0, 1, 4), (-3, 2, 5, -1, 2, 7), (1, 1, 4, 1, 1, 5), (0, 0, 10, 1, 4, 9), (-7, -7, 7, -6, 0, 6.5)]


@pytest.fixture(scope="module")
def tri(spark):
    return spark.createDataFrame([tuple(map(float, t)) for t in TRIANGLES], "ax double, ay double, bx double, by double, cx double, cy double")


A, B, C = g.Named("ax", "ay"), g.Named("bx", "by"), g.Named("cx", "cy")


def zeros(tri, *columns):
    for r in tri.select(*[F.round(c, 7).alias(f"c{k}") for k, c in enumerate(columns)]).collect():
        assert all(v == 0 for v in r), r


def test_centres(tri):
    o, i, h, m = g.circumcenter(A, B, C), g.incenter(A, B, C), g.orthocenter(A, B, C), g.centroid(A, B, C)
    to_side = lambda p, q: g.dist(i, g.foot(i, p, q))
    u, v = g.sub(h, A), g.sub(C, B)
    zeros(tri, g.dist(o, A) - g.dist(o, B), g.dist(o, B) - g.dist(o, C), to_side(A, B) - to_side(B, C), to_side(B, C) - to_side(C, A), u.x * v.x + u.y * v.y, g.area2(o, m, h))


def test_feet_mirrors_and_turns(tri):
    f, r = g.foot(A, B, C), g.reflect_over_line(A, B, C)
    u, v = g.sub(A, f), g.sub(C, B)
    t = g.bisector_foot(A, B, C)
    zeros(tri, u.x * v.x + u.y * v.y, g.area2(f, B, C), g.dist(r, B) - g.dist(A, B), g.dist(g.rotate(A, B, 77), B) - g.dist(A, B), g.area2(t, B, C), g.dist(t, B) * g.dist(A, C) - g.dist(t, C) * g.dist(A, B))


def test_circles(tri):
    far = g.pt(20, 20)
    out = []
    for p in g.tangent_points(A, F.lit(3.0), far):
        u, v = g.sub(p, A), g.sub(far, p)
        out += [g.dist(p, A) - 3, u.x * v.x + u.y * v.y]
    for p in g.circle_circle(A, F.lit(50.0), B, F.lit(49.0)):
        out += [g.dist(p, A) - 50, g.dist(p, B) - 49]
    zeros(tri, *out)
    assert {r[0] for r in tri.select(g.circle_circle(A, F.lit(1.0), A, F.lit(1.0))[0].x).collect()} == {None}


def test_degenerate_is_null(spark):
    one = spark.range(1)
    p, q, r = g.pt(0, 0), g.pt(1, 1), g.pt(2, 2)
    for c in (g.circumcenter(p, q, r).x, g.foot(p, q, q).x, g.line_intersection(p, q, r, g.pt(3, 3)).x, g.tangent_points(p, F.lit(1.0), p)[0].x, g.orthocenter(p, p, p).y):
        assert one.select(c).first()[0] is None


def test_number_text(spark):
    row = spark.range(1).select(g.fixed2(F.lit(-0.001)), g.fixed2(F.lit(2.5)), g.compact(F.lit(3.0)), g.compact(F.lit(-1.25)), g.compact(F.lit(-0.00001))).first()
    assert list(row) == ["0.00", "2.50", "3", "-1.25", "0"]
