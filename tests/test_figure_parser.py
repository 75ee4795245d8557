import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewell.functions import figures as fg
from tracewell.functions.figure_calls import circles, constructions, segments
from tracewell.functions.figure_parser import expand_macros, groups, named_points, point, scalar


@pytest.mark.parametrize(
    "text,value",
    [
        ("1+2*3", 7), ("-(2)**2", -4), ("2**-1", 0.5), ("7//2", 3), ("{4.5*cos(60)}", 2.25), ("sqrt(16)/pi", 4 / math.pi), ("atan(1)", 45), ("abs(-3)", 3), (" .5 ", 0.5), ("2^3", None), ("1e3", None), ("", None),
        ("__import__", None), ("1/0", None), ("sqrt(-1)", None), ("(1", None), ("1 2", None), ("foo(1)", None), (None, None), ("9**9**9**9", None), ("(-8)**(1/3)", None),
    ],
)
def test_scalars(text, value):
    got = scalar(text)
    assert got is None if value is None else got == pytest.approx(value)


KNOWN = {"A": (0.0, 0.0), "B": (4.0, 2.0), "C": (1.0, 5.0)}


@pytest.mark.parametrize(
    "text,at",
    [
        ("A", (0, 0)), ("Z", None), ("1,2", (1, 2)), ("90:2", (0, 2)), ("$(A)!0.5!(B)$", (2, 1)), ("$(A)!(C)!(B)$", (2.8, 1.4)), ("$(A)!(Z)!(B)$", None), ("$(A)!(C)!(A)$", None), ("$(A)+(B)-(C)$", (3, -3)),
        ("B |- C", (4, 5)), ("B -| C", (1, 2)), ("{2*3},{1+1}", (6, 2)), ("1,2,3", None), ("$-(B)+(C)$", (-3, 3)), ("$(B)+(1,1)$", (5, 3)), ("$(A)!{1/4}!(B)$", (1, 0.5)),
    ],
)
def test_points(text, at):
    got = point(text, KNOWN)
    assert got is None if at is None else got == pytest.approx(at, abs=1e-9)


def test_figures():
    p = named_points(r"\coordinate (M) at ($(A)!0.5!(B)$);\coordinate (A) at (0,0);\coordinate (B) at (4,2);\coordinate (A) at (9,9);\node at (M) {$N$};\node[right] at (1,1) {$A$};")
    assert p == {"A": (1, 1), "B": (4, 2), "M": (2, 1), "N": (2, 1)}
    assert named_points(r"\draw[name path=u] (0,0) -- (4,4); \draw[name path=v] (0,4) -- (4,0); \path[name intersections={of=u and v, by=X}]; \coordinate (Y) at ($(X)!0.5!(0,0)$);")["Y"] == (1, 1)
    assert named_points(r"\def\r{2}\pgfmathsetmacro{\rr}{\r*2}\coordinate (P) at (0:\rr);")["P"] == pytest.approx((4, 0))
    assert named_points(None) == named_points("") == named_points(r"\coordinate (A) at (B);\coordinate (B) at (A);") == {}
    assert expand_macros("plain") == "plain" and groups("a(b(c)d)e)(f)") == ["b(c)d", "f"]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="()$!+-|:,.0123456789ABab;{} \\", max_size=60))
def test_never_raises(text):
    named_points("\\coordinate (A) at (" + text)
    named_points(text + " node {$A$}")


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.floats(-9, 9), st.floats(-9, 9)), min_size=1, max_size=6))
def test_parser_inverts_emitter(pts):
    text = "".join(f"\\coordinate (P{k}) at ({x:.4f},{y:.4f});" for k, (x, y) in enumerate(pts))
    got = named_points(text)
    assert all(got[f"P{k}"] == pytest.approx(p, abs=1e-4) for k, p in enumerate(pts))


def test_constructions():
    c = constructions(r"\tkzDefTriangleCenter[circum](A,B,C)\tkzGetPoint{O} \tkzDefMidPoint(A,B)\tkzGetPoint{M} \tkzDefPointBy[projection=onto B--C](A)\tkzGetPoint{H} \tkzDefLine[bisector](B,A,C)\tkzGetPoint{r} \tkzInterLL(A,r)(B,C)\tkzGetPoint{D} \tkzInterLL(A,B)(C,D)\tkzGetPoint{X} \coordinate (M) at ($(A)!0.3!(B)$); \coordinate (Q) at ($(A)!0.3!(B)$);")
    assert (c["O"].kind, c["O"].parents) == ("circumcenter", ["A", "B", "C"]) and c["M"].kind == "midpoint" and c["H"].parents == ["A", "B", "C"]
    assert (c["D"].kind, c["D"].parents) == ("bisector_meet", ["B", "A", "C", "B", "C"]) and c["X"].parents == ["A", "B", "C", "D"] and c["Q"].kind == "partway" and c["Q"].t == 0.3 and "r" not in c
    by = constructions(r"\tkzDefPointBy[rotation = center A angle -30.5](B) \tkzGetPoint{R}\tkzDefPointBy[symmetry=center A](B)\tkzGetPoint{S}\tkzDefPointBy[translation= from A to B](C)\tkzGetPoint{T}\tkzDefPointBy[reflection=over A--B](C)\tkzGetPoint{U}\tkzDefGravityCenter(A,B,C)\tkzGetPoint{G}\tkzDefTriangleCenter[other](A,B,C)\tkzGetPoint{N}\tkzDefMidPoint(A,B) x \tkzGetPoint{K}")
    assert {k: (v.kind, v.parents, v.angle) for k, v in by.items()} == {"R": ("rotation", ["B", "A"], -30.5), "S": ("point_reflection", ["B", "A"], None), "T": ("translation", ["C", "A", "B"], None), "U": ("reflection", ["C", "A", "B"], None), "G": ("centroid", ["A", "B", "C"], None)}
    calc = constructions(r"\coordinate (F) at ($(A)!(P)!(B)$);\coordinate (M) at ($ (A) ! 1/2 ! (B) $);\coordinate (N) at (1,2);\coordinate (V) at ($(A)+(B)$);")
    assert {k: (v.kind, v.parents) for k, v in calc.items()} == {"F": ("foot", ["P", "A", "B"]), "M": ("midpoint", ["A", "B"])}
    assert constructions(None) == {}


def test_segments_and_circles():
    assert segments(r"\tkzDrawPolygon(A,B,C) \tkzDrawSegment(B,A) \draw (C) -- (D) -- cycle; \tkzDrawSegments(A,D D,E)") == ["A-B", "B-C", "A-C", "C-D", "A-D", "D-E"]
    assert segments(r"\draw[thick] (A) -- (1,2) -- (B) -- (C); \tkzDrawLine(B,A)") == ["B-C", "A-B"] and segments(None) == []
    got = [(c.center, c.through, c.cx, c.cy, c.r) for c in circles(r"\tkzDrawCircle[red](O,A) \draw[thick] (A) circle (2); \draw (1,2) circle (3.5) (B) circle(1); \draw (C) circle (\r); \fill (D) circle (1);")]
    assert got == [("O", "A", None, None, None), ("A", None, None, None, 2.0), (None, None, 1.0, 2.0, 3.5), ("B", None, None, None, 1.0)]


def test_macros_and_long_chains():
    assert expand_macros(r"\def\a{2}\newcommand{\b}{\a+1}\newcommand*\c{4}\pgfmathsetmacro\d{5}(\a,\b,\c,\d,\aa)").endswith("((2),((2)+1),(4),(5),\\aa)")
    n = 40  # each point from the next one in the text
    text = "".join(f"\\coordinate (P{k}) at ($(P{k + 1})+(1,0)$);" for k in range(n)) + f"\\coordinate (P{n}) at (0,0);"
    assert named_points(text)["P0"] == (n, 0)


def test_columns(spark):
    df = spark.createDataFrame([(r"\coordinate (A) at (1,2);\draw (A) circle (2);",), (None,), (r"\coordinate (A) at (1,2);\draw (A) circle (2);",), ("",)], "t string")
    rows = df.select(fg.points_of("t").alias("p"), fg.circles_of("t").alias("c"), fg.edges_of("t").alias("e"), fg.constraints_of("t").alias("k"), fg.macros_expanded("t").alias("m")).collect()
    assert [len(r["p"]) for r in rows] == [1, 0, 1, 0] and rows[2]["p"]["A"]["y"] == 2 and rows[0]["c"][0]["r"] == 2 and rows[0]["e"] == [] and rows[0]["k"] == {} and rows[1]["m"] is None
    assert df.limit(0).select(fg.points_of("t")).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="()$[]{}!+-,;0123AB \\", max_size=60))
def test_streams_never_raise(text):
    for whole in (text, "\\draw" + text, "\\coordinate (A) at " + text, "\\tkzDefPointBy[rotation=center A angle " + text):
        constructions(whole), segments(whole), circles(whole), expand_macros("\\def\\a" + whole)
