"""Plane geometry as native columns: points are pairs of double columns, so every formula stays inside codegen."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Pt(NamedTuple):
    x: Column
    y: Column


class Named:
    """A point of two named columns; made without a running session, unlike Pt."""

    def __init__(self, x: str, y: str) -> None:
        self._x, self._y = x, y

    @property
    def x(self) -> Column:
        return F.col(self._x).cast("double")

    @property
    def y(self) -> Column:
        return F.col(self._y).cast("double")


def pt(x: Column | str | float, y: Column | str | float) -> Pt:
    one = lambda v: F.col(v).cast("double") if isinstance(v, str) else v.cast("double") if isinstance(v, Column) else F.lit(float(v))
    return Pt(one(x), one(y))


def add(p: Pt, q: Pt) -> Pt:
    return Pt(p.x + q.x, p.y + q.y)


def sub(p: Pt, q: Pt) -> Pt:
    return Pt(p.x - q.x, p.y - q.y)


def scale(p: Pt, k: Column | float) -> Pt:
    return Pt(p.x * k, p.y * k)


def dist(p: Pt, q: Pt) -> Column:
    d = sub(p, q)
    return F.sqrt(d.x * d.x + d.y * d.y)


def area2(a: Pt, b: Pt, c: Pt) -> Column:
    """Twice the signed area."""
    return (b.x - a.x) * (c.y - a.y) - (c.x - a.x) * (b.y - a.y)


def midpoint(p: Pt, q: Pt) -> Pt:
    return scale(add(p, q), 0.5)


def polar(o: Pt, r: Column, degrees: Column) -> Pt:
    return Pt(o.x + r * F.cos(F.radians(degrees)), o.y + r * F.sin(F.radians(degrees)))


def _safe(n: Column, d: Column, least: float = 0.0) -> Column:
    """n / d, null where |d| is at most `least`."""
    return n / F.when(F.abs(d) > least, d)


def line_intersection(a: Pt, b: Pt, c: Pt, d: Pt, eps: float = 1e-9) -> Pt:
    """Where lines ab and cd meet; null where they are (nearly) parallel."""
    u, v, w = sub(b, a), sub(d, c), sub(c, a)
    den = u.x * v.y - u.y * v.x
    t = (w.x * v.y - w.y * v.x) / F.when(F.abs(den) >= eps, den)
    return Pt(a.x + t * u.x, a.y + t * u.y)


def foot(p: Pt, a: Pt, b: Pt, eps: float = 1e-9) -> Pt:
    """Projection of p on the line ab; null where a and b coincide."""
    u, w = sub(b, a), sub(p, a)
    d = u.x * u.x + u.y * u.y
    t = (w.x * u.x + w.y * u.y) / F.when(d >= eps, d)
    return Pt(a.x + t * u.x, a.y + t * u.y)


def circumcenter(a: Pt, b: Pt, c: Pt) -> Pt:
    """Null for a degenerate triangle."""
    d = 2 * area2(a, b, c)
    sq = lambda p: p.x * p.x + p.y * p.y
    x = sq(a) * (b.y - c.y) + sq(b) * (c.y - a.y) + sq(c) * (a.y - b.y)
    y = sq(a) * (c.x - b.x) + sq(b) * (a.x - c.x) + sq(c) * (b.x - a.x)
    return Pt(_safe(x, d), _safe(y, d))


def incenter(a: Pt, b: Pt, c: Pt) -> Pt:
    """Corners weighted by the opposite sides."""
    la, lb, lc = dist(b, c), dist(c, a), dist(a, b)
    s = la + lb + lc
    return Pt(_safe(la * a.x + lb * b.x + lc * c.x, s), _safe(la * a.y + lb * b.y + lc * c.y, s))


def centroid(a: Pt, b: Pt, c: Pt) -> Pt:
    return Pt((a.x + b.x + c.x) / 3, (a.y + b.y + c.y) / 3)


def orthocenter(a: Pt, b: Pt, c: Pt) -> Pt:
    o = circumcenter(a, b, c)
    return Pt(a.x + b.x + c.x - 2 * o.x, a.y + b.y + c.y - 2 * o.y)


def bisector_foot(a: Pt, b: Pt, c: Pt) -> Pt:
    """Where the bisector at a meets bc, which it divides as ab to ac."""
    ab, ac = dist(a, b), dist(a, c)
    s = ab + ac
    return Pt(_safe(ac * b.x + ab * c.x, s), _safe(ac * b.y + ab * c.y, s))


def tangent_points(o: Pt, r: Column, p: Pt) -> tuple[Pt, Pt]:
    """Touching points of the tangents from p; on the line op where p lies inside; null where p is o."""
    v = sub(p, o)
    d2 = v.x * v.x + v.y * v.y
    along, across = _safe(r * r, d2), _safe(r * F.sqrt(F.greatest(d2 - r * r, F.lit(0.0))), d2)
    return tuple(Pt(o.x + along * v.x - s * across * v.y, o.y + along * v.y + s * across * v.x) for s in (1, -1))


def rotate(p: Pt, o: Pt, degrees: Column | float) -> Pt:
    r = F.radians(degrees if isinstance(degrees, Column) else F.lit(float(degrees)))
    v = sub(p, o)
    return Pt(o.x + v.x * F.cos(r) - v.y * F.sin(r), o.y + v.x * F.sin(r) + v.y * F.cos(r))


def reflect_over_line(p: Pt, a: Pt, b: Pt) -> Pt:
    f = foot(p, a, b)
    return Pt(2 * f.x - p.x, 2 * f.y - p.y)


def symmetry(p: Pt, o: Pt) -> Pt:
    return Pt(2 * o.x - p.x, 2 * o.y - p.y)


def translate(p: Pt, a: Pt, b: Pt) -> Pt:
    return Pt(p.x + b.x - a.x, p.y + b.y - a.y)


def circle_circle(o1: Pt, r1: Column, o2: Pt, r2: Column, eps: float = 1e-9) -> tuple[Pt, Pt]:
    """The meeting points; null where the circles are apart, nested or have one centre."""
    v = sub(o2, o1)
    d = dist(o1, o2)
    ok = (d > eps) & (d <= r1 + r2) & (d >= F.abs(r1 - r2))
    d = F.when(ok, d)
    along = (r1 * r1 - r2 * r2 + d * d) / (2 * d)
    up = F.sqrt(F.greatest(r1 * r1 - along * along, F.lit(0.0)))
    return tuple(Pt(o1.x + (along * v.x - s * up * v.y) / d, o1.y + (along * v.y + s * up * v.x) / d) for s in (1, -1))


def is_convex(*corners: Pt) -> Column:
    """All turns go left."""
    n = len(corners)
    out = F.lit(True)
    for i in range(n):
        out = out & (area2(corners[i], corners[(i + 1) % n], corners[(i + 2) % n]) > 0)
    return out


def is_acute(a: Pt, b: Pt, c: Pt, least: float = 0.3) -> Column:
    def dot(o: Pt, p: Pt, q: Pt) -> Column:
        u, v = sub(p, o), sub(q, o)
        return u.x * v.x + u.y * v.y

    return (dot(a, b, c) > least) & (dot(b, c, a) > least) & (dot(c, a, b) > least)


def polygon_vertex(o: Pt, p: Pt, n: int, k: Column) -> Pt:
    """Corner k of the n-gon about o with corner p; the step is a whole number of degrees."""
    return rotate(p, o, k * float(360 // n))


def fixed2(x: Column) -> Column:
    """Two decimals as text, no negative zero."""
    r = F.round(x, 2)
    return F.format_string("%.2f", F.when(r == 0, 0.0).otherwise(r))


def compact(x: Column) -> Column:
    """A whole number where x is within 1e-9 of one, else four decimals without trailing zeros."""
    whole = F.round(x, 0)
    r = F.round(x, 4)
    text = F.regexp_replace(F.regexp_replace(F.format_string("%.4f", F.when(r == 0, 0.0).otherwise(r)), "0+$", ""), r"\.$", "")
    return F.when(F.abs(x - whole) < 1e-9, whole.cast("bigint").cast("string")).otherwise(text)


def rounded(p: Pt, name: str, digits: int = 6) -> list[Column]:
    """Two columns name_x, name_y; adding zero turns -0.0 into 0.0."""
    return [(F.round(p.x, digits) + 0.0).alias(f"{name}_x"), (F.round(p.y, digits) + 0.0).alias(f"{name}_y")]
