"""Geometry queries over integer triangles made from lineitem keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.catalog import table
from tracewell.functions import geometry as g
from tracewell.plans import CATALOG

KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
_K = ", ".join(KEY)
TRI_SQL = f"""
raw AS (SELECT {_K}, (l_partkey % 9)::DOUBLE ax, (l_suppkey % 9)::DOUBLE ay, (l_orderkey % 9)::DOUBLE bx, (l_linenumber % 9)::DOUBLE by_,
  ((l_partkey + l_orderkey) % 9)::DOUBLE cx, ((l_suppkey + 3 * l_linenumber) % 9)::DOUBLE cy FROM lineitem),
t AS (SELECT *, (bx-ax)*(cy-ay)-(cx-ax)*(by_-ay) AS s2, sqrt((bx-cx)*(bx-cx)+(by_-cy)*(by_-cy)) la, sqrt((cx-ax)*(cx-ax)+(cy-ay)*(cy-ay)) lb, sqrt((ax-bx)*(ax-bx)+(ay-by_)*(ay-by_)) lc FROM raw),
tri AS (SELECT * FROM t WHERE abs(s2) >= 12 AND least(la, lb, lc) >= 3),
o AS (SELECT *, ((ax*ax+ay*ay)*(by_-cy)+(bx*bx+by_*by_)*(cy-ay)+(cx*cx+cy*cy)*(ay-by_))/(2*s2) ox, ((ax*ax+ay*ay)*(cx-bx)+(bx*bx+by_*by_)*(ax-cx)+(cx*cx+cy*cy)*(bx-ax))/(2*s2) oy FROM tri)"""


def triangles(spark, sf) -> DataFrame:
    """Row keys with corners A, B, C; twice the area is at least 12 and every side at least 3."""
    d = table(spark, sf, "lineitem").select(
        *KEY,
        (F.col("l_partkey") % 9).cast("double").alias("ax"), (F.col("l_suppkey") % 9).cast("double").alias("ay"),
        (F.col("l_orderkey") % 9).cast("double").alias("bx"), (F.col("l_linenumber") % 9).cast("double").alias("by_"),
        ((F.col("l_partkey") + F.col("l_orderkey")) % 9).cast("double").alias("cx"), ((F.col("l_suppkey") + 3 * F.col("l_linenumber")) % 9).cast("double").alias("cy"),
    )
    return d.filter((F.abs(g.area2(A, B, C)) >= 12) & (F.least(g.dist(A, B), g.dist(B, C), g.dist(C, A)) >= 3))


A, B, C = g.Named("ax", "ay"), g.Named("bx", "by_"), g.Named("cx", "cy")


def _r(x: str, name: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0 AS {name}"


def _geo(name: str, columns, sql: str, base: str = "tri") -> None:
    """Registers a query that adds columns to every triangle."""
    CATALOG.add(name, f"WITH {TRI_SQL} SELECT {_K}, {sql} FROM {base}")(lambda spark, sf: triangles(spark, sf).select(*KEY, *columns()))


def _point(name: str, fn, x: str, y: str, base: str = "tri") -> None:
    _geo(name, lambda: g.rounded(fn(), "p"), f"{_r(x, 'p_x')}, {_r(y, 'p_y')}", base)


_geo("geo_fmt", lambda: [g.fixed2((F.col("ax") - F.col("bx")) / 7).alias("text")], "printf('%.2f', CASE WHEN round((ax-bx)/7, 2) = 0 THEN 0.0 ELSE round((ax-bx)/7, 2) END) AS text")
_geo(
    "geo_compact_number",
    lambda: [g.compact((F.col("ax") - F.col("bx")) / 4).alias("text")],
    "CASE WHEN abs((ax-bx)/4 - round((ax-bx)/4)) < 1e-9 THEN round((ax-bx)/4)::BIGINT::VARCHAR ELSE regexp_replace(regexp_replace(printf('%.4f', (ax-bx)/4), '0+$', ''), '\\.$', '') END AS text",
)
_point("geo_polar", lambda: g.polar(A, F.col("bx"), F.col("cx") * 40), "ax + bx*cos(radians(cx*40))", "ay + bx*sin(radians(cx*40))")
_point("geo_midpoint", lambda: g.midpoint(A, B), "(ax+bx)/2", "(ay+by_)/2")
_geo(
    "geo_reflect_axis",
    lambda: [(-F.col("ay") + 0.0).alias("over_x_y"), (-F.col("ax") + 0.0).alias("over_y_x")],
    "-ay + 0.0 AS over_x_y, -ax + 0.0 AS over_y_x",
)
_DEN = "((bx-ax)*(1-cy)-(by_-ay)*(2-cx))"
_T = f"(((cx-ax)*(1-cy)-(cy-ay)*(2-cx))/CASE WHEN abs({_DEN}) >= 1e-9 THEN {_DEN} END)"
_point("geo_line_intersection", lambda: g.line_intersection(A, B, C, g.pt(2, 1)), f"ax + {_T}*(bx-ax)", f"ay + {_T}*(by_-ay)")
_F = "(((ax-bx)*(cx-bx)+(ay-by_)*(cy-by_))/(la*la))"
_point("geo_foot", lambda: g.foot(A, B, C), f"bx + {_F}*(cx-bx)", f"by_ + {_F}*(cy-by_)")
_geo("geo_area_dist", lambda: [g.area2(A, B, C).alias("area2"), F.round(g.dist(A, B), 6).alias("ab")], "s2 AS area2, round(lc, 6) AS ab")
_point("geo_circumcenter", lambda: g.circumcenter(A, B, C), "ox", "oy", "o")
_point("geo_incenter", lambda: g.incenter(A, B, C), "(la*ax+lb*bx+lc*cx)/(la+lb+lc)", "(la*ay+lb*by_+lc*cy)/(la+lb+lc)")
_point("geo_orthocenter", lambda: g.orthocenter(A, B, C), "ax+bx+cx-2*ox", "ay+by_+cy-2*oy", "o")
_point("geo_centroid", lambda: g.centroid(A, B, C), "(ax+bx+cx)/3", "(ay+by_+cy)/3")
_point("geo_bisector_foot", lambda: g.bisector_foot(A, B, C), "(lb*bx+lc*cx)/(lb+lc)", "(lb*by_+lc*cy)/(lb+lc)")
_geo(
    "geo_tangent",
    lambda: [c for k, p in enumerate(g.tangent_points(A, F.lit(2.0), B)) for c in g.rounded(p, f"t{k}")],
    ", ".join(
        _r(f"ax + (4*(bx-ax) - ({s})*2*sqrt(greatest(lc*lc-4, 0))*(by_-ay))/(lc*lc)", f"t{k}_x") + ", " + _r(f"ay + (4*(by_-ay) + ({s})*2*sqrt(greatest(lc*lc-4, 0))*(bx-ax))/(lc*lc)", f"t{k}_y")
        for k, s in ((0, 1), (1, -1))
    ),
)
_geo(
    "geo_transforms",
    lambda: [*g.rounded(g.rotate(A, B, 37), "rot"), *g.rounded(g.reflect_over_line(A, B, C), "ref"), *g.rounded(g.symmetry(A, B), "sym"), *g.rounded(g.translate(A, B, C), "tra")],
    ", ".join([
        _r("bx + (ax-bx)*cos(radians(37)) - (ay-by_)*sin(radians(37))", "rot_x"), _r("by_ + (ax-bx)*sin(radians(37)) + (ay-by_)*cos(radians(37))", "rot_y"),
        _r(f"2*(bx + {_F}*(cx-bx)) - ax", "ref_x"), _r(f"2*(by_ + {_F}*(cy-by_)) - ay", "ref_y"),
        _r("2*bx-ax", "sym_x"), _r("2*by_-ay", "sym_y"), _r("ax+cx-bx", "tra_x"), _r("ay+cy-by_", "tra_y"),
    ]),
)
_CC = "CASE WHEN lc > 1e-9 AND lc <= 5 + 3 AND lc >= 2 THEN lc END"
_AL = f"((25 - 9 + lc*lc)/(2*({_CC})))"
_UP = f"sqrt(greatest(25 - {_AL}*{_AL}, 0))"
_geo(
    "geo_circle_circle",
    lambda: [c for k, p in enumerate(g.circle_circle(A, F.lit(5.0), B, F.lit(3.0))) for c in g.rounded(p, f"m{k}")],
    ", ".join(_r(f"ax + ({_AL}*(bx-ax) - ({s})*{_UP}*(by_-ay))/({_CC})", f"m{k}_x") + ", " + _r(f"ay + ({_AL}*(by_-ay) + ({s})*{_UP}*(bx-ax))/({_CC})", f"m{k}_y") for k, s in ((0, 1), (1, -1))),
)
_Q = [("ax", "ay"), ("bx", "by_"), ("cx", "cy"), ("4.0", "4.0")]
_geo(
    "geo_convex",
    lambda: [g.is_convex(A, B, C, g.pt(4, 4)).alias("convex")],
    "(" + " AND ".join(f"(({b[0]})-({a[0]}))*(({c[1]})-({a[1]}))-(({c[0]})-({a[0]}))*(({b[1]})-({a[1]})) > 0" for a, b, c in ((_Q[i], _Q[(i + 1) % 4], _Q[(i + 2) % 4]) for i in range(4))) + ") AS convex",
)
_geo(
    "geo_polygon",
    lambda: [c for k in (1, 3) for c in g.rounded(g.polygon_vertex(A, B, 7, F.lit(k)), f"v{k}")],
    ", ".join(
        _r(f"ax + (bx-ax)*cos(radians({51 * k})) - (by_-ay)*sin(radians({51 * k}))", f"v{k}_x") + ", " + _r(f"ay + (bx-ax)*sin(radians({51 * k})) + (by_-ay)*cos(radians({51 * k}))", f"v{k}_y") for k in (1, 3)
    ),
)


def _composite():
    o, h, i = g.circumcenter(A, B, C), g.orthocenter(A, B, C), g.incenter(A, B, C)
    return [
        *g.rounded(g.midpoint(o, h), "nine"), *g.rounded(g.midpoint(B, C), "medial"), *g.rounded(g.foot(A, B, C), "orthic"),
        *g.rounded(g.foot(i, B, C), "contact"), *g.rounded(g.symmetry(A, o), "antipode"), *g.rounded(g.reflect_over_line(h, B, C), "mirror"),
        F.round(F.abs(g.area2(o, g.centroid(A, B, C), h)), 5).alias("euler"),
    ]


def _on_bc(x: str, y: str) -> tuple[str, str]:
    t = f"((({x})-bx)*(cx-bx)+(({y})-by_)*(cy-by_))/(la*la)"
    return f"(bx + {t}*(cx-bx))", f"(by_ + {t}*(cy-by_))"


_H, _I = ("ax+bx+cx-2*ox", "ay+by_+cy-2*oy"), ("(la*ax+lb*bx+lc*cx)/(la+lb+lc)", "(la*ay+lb*by_+lc*cy)/(la+lb+lc)")
_geo(
    "geo_composite",
    _composite,
    ", ".join(
        _r(v, f"{n}_{c}")
        for n, xy in (
            ("nine", (f"(ox+{_H[0]})/2", f"(oy+{_H[1]})/2")), ("medial", ("(bx+cx)/2", "(by_+cy)/2")), ("orthic", _on_bc("ax", "ay")), ("contact", _on_bc(*_I)),
            ("antipode", ("2*ox-ax", "2*oy-ay")), ("mirror", tuple(f"2*{f}-({h})" for f, h in zip(_on_bc(*_H), _H))),
        )
        for c, v in zip("xy", xy)
    )
    + ", 0.0::DOUBLE AS euler",
    "o",
)
_geo(
    "geo_acute",
    lambda: [g.is_acute(A, B, C).alias("acute")],
    "((bx-ax)*(cx-ax)+(by_-ay)*(cy-ay) > 0.3 AND (cx-bx)*(ax-bx)+(cy-by_)*(ay-by_) > 0.3 AND (ax-cx)*(bx-cx)+(ay-cy)*(by_-cy) > 0.3) AS acute",
)


def _scalars():
    a, b, c = g.dist(B, C), g.dist(C, A), g.dist(A, B)
    s2 = F.abs(g.area2(A, B, C))
    t2 = c * c - 4.0
    return [
        F.round(a * b * c / (2 * s2), 6).alias("circumradius"), F.round(s2 / (a + b + c), 6).alias("inradius"), F.round(s2 / a, 6).alias("altitude"),
        F.round(g.dist(A, g.midpoint(B, C)), 6).alias("median"), F.round(F.sqrt(F.greatest(t2, F.lit(0.0))), 6).alias("tangent"),
    ]


_geo(
    "geo_scalars",
    _scalars,
    """round(la*lb*lc/(2*abs(s2)), 6) AS circumradius, round(abs(s2)/(la+lb+lc), 6) AS inradius, round(abs(s2)/la, 6) AS altitude,
    round(sqrt((ax-(bx+cx)/2)*(ax-(bx+cx)/2)+(ay-(by_+cy)/2)*(ay-(by_+cy)/2)), 6) AS median, round(sqrt(greatest(lc*lc-4, 0)), 6) AS tangent""",
)


@CATALOG.add(
    "geo_reject",
    f"""WITH {TRI_SQL} SELECT {_K}, CASE WHEN least(la, lb, lc) < 0.15 THEN 'coincident' WHEN least(la, lb, lc) < 3 THEN 'side' WHEN abs(s2) < 12 THEN 'area'
    WHEN NOT ((bx-ax)*(cx-ax)+(by_-ay)*(cy-ay) > 0.3 AND (cx-bx)*(ax-bx)+(cy-by_)*(ay-by_) > 0.3 AND (ax-cx)*(bx-cx)+(ay-cy)*(by_-cy) > 0.3) THEN 'obtuse'
    WHEN abs((ax+bx+cx)/3) > 7 OR abs((ay+by_+cy)/3) > 7 THEN 'bounds' ELSE 'ok' END AS verdict FROM t""",
)
def geo_reject(spark, sf) -> DataFrame:
    """The first reason, in order, to reject a candidate triangle."""
    d = table(spark, sf, "lineitem").select(
        *KEY,
        (F.col("l_partkey") % 9).cast("double").alias("ax"), (F.col("l_suppkey") % 9).cast("double").alias("ay"),
        (F.col("l_orderkey") % 9).cast("double").alias("bx"), (F.col("l_linenumber") % 9).cast("double").alias("by_"),
        ((F.col("l_partkey") + F.col("l_orderkey")) % 9).cast("double").alias("cx"), ((F.col("l_suppkey") + 3 * F.col("l_linenumber")) % 9).cast("double").alias("cy"),
    )
    side, m = F.least(g.dist(A, B), g.dist(B, C), g.dist(C, A)), g.centroid(A, B, C)
    verdict = (
        F.when(side < 0.15, "coincident").when(side < 3, "side").when(F.abs(g.area2(A, B, C)) < 12, "area").when(~g.is_acute(A, B, C), "obtuse")
        .when((F.abs(m.x) > 7) | (F.abs(m.y) > 7), "bounds").otherwise("ok")
    )
    return d.select(*KEY, verdict.alias("verdict"))
