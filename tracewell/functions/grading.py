"""Grades of figures against the true places of their points, and canvas coordinates in units of a frame."""

from __future__ import annotations

from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions import text as tx
from tracewell.functions.figures import points_of

ATOL = 0.05
#: Groups above this are matched by augmenting paths instead of trying all orders; the number of hits is the same.
SMALL = 6
_GRADE = T.StructType([T.StructField("matched", T.IntegerType()), T.StructField("total", T.IntegerType()), T.StructField("ok", T.MapType(T.StringType(), T.BooleanType())), T.StructField("err", T.MapType(T.StringType(), T.DoubleType())), T.StructField("of", T.MapType(T.StringType(), T.StringType()))])


def _off(p: tuple | None, q: tuple) -> float | None:
    """The larger of the errors in x and y; None for a point that is missing or not a number."""
    if p is None or len(q) < 2 or any(v is None or v != v for v in (*p, *q)):
        return None
    return max(abs(p[0] - q[0]), abs(p[1] - q[1]))


def matched_group(group: list[str], found: dict[str, tuple], truth: dict[str, tuple], atol: float) -> dict[str, tuple[str, float | None]]:
    """name -> (name of a truth, error), each found point against the truth that the best assignment gives it; the first of equals."""
    off = [[_off(found.get(n), truth[m]) for m in group] for n in group]
    hit = [[e is not None and e <= atol for e in row] for row in off]
    if len(group) <= SMALL:
        best = max(permutations(range(len(group))), key=lambda p: sum(hit[i][j] for i, j in enumerate(p)))
        return {n: (group[best[i]], off[i][best[i]]) for i, n in enumerate(group)}
    taken: dict[int, int] = {}

    def place(i: int, seen: set[int]) -> bool:
        for j in (j for j, h in enumerate(hit[i]) if h and j not in seen):
            seen.add(j)
            if j not in taken or place(taken[j], seen):
                taken[j] = i
                return True
        return False

    for i in range(len(group)):
        place(i, set())
    of = {i: j for j, i in taken.items()}
    rest = iter(sorted(set(range(len(group))) - set(taken)))
    to = [of[i] if i in of else next(rest) for i in range(len(group))]
    return {n: (group[to[i]], off[i][to[i]]) for i, n in enumerate(group)}


def graded(found: dict[str, tuple], truth: dict[str, tuple], unordered: list[list[str]] | None, atol: float) -> dict:
    """matched, total, and by name whether it is right, how far off, and from the truth of which name."""
    errors = {n: (n, _off(found.get(n), q)) for n, q in truth.items()}
    for group in unordered or []:
        if group := [n for n in dict.fromkeys(group or ()) if n in truth]:
            errors.update(matched_group(group, found, truth, atol))
    ok = {n: e is not None and e <= atol for n, (_, e) in errors.items()}
    return {"matched": sum(ok.values()), "total": len(ok), "ok": list(ok.items()), "err": [(n, e) for n, (_, e) in errors.items()], "of": [(n, m) for n, (m, _) in errors.items()]}


@F.arrow_udf(_GRADE)
def grade_points(found: pa.Array, truth: pa.Array, unordered: pa.Array, atol: pa.Array) -> pa.Array:
    """Grades of found points (name -> struct of x, y) against true ones (name -> [x, y]), groups of `unordered` names
    being interchangeable. Null truths have no points."""
    out = []
    for f, t, u, a in zip(*(c.to_pylist() for c in (found, truth, unordered, atol))):
        out.append(graded({k: (v["x"], v["y"]) for k, v in f or ()}, {k: tuple(v or ()) for k, v in t or ()}, u, ATOL if a is None else a))
    kind = pa.struct([("matched", pa.int32()), ("total", pa.int32()), ("ok", pa.map_(pa.string(), pa.bool_())), ("err", pa.map_(pa.string(), pa.float64())), ("of", pa.map_(pa.string(), pa.string()))])
    return pa.array(out, kind)


_NO_GROUPS = "cast(array() as array<array<string>>)"


def grade(text: Column, truth: Column, unordered: Column | None = None, only: Column | None = None, atol: Column | float = ATOL, compiles: Column | None = None) -> Column:
    """The gate on a model's text: struct of figure_only, has_figure, compiles, matched, total, coord_accuracy,
    coords_all_correct, passed, and by name ok, err, of.

    truth: name -> [x, y]; only: the names that count; compiles: whether the figure was typeset, where a caller knows; else
    whether there is one. passed: only a figure, it compiles, and every point is within the tolerance, which counts as within.
    """
    truth = truth if only is None else F.map_filter(truth, lambda k, _: F.array_contains(only, k))
    block = tx.extract_block(text)
    g = grade_points(points_of(block), truth, F.expr(_NO_GROUPS) if unordered is None else unordered, atol if isinstance(atol, Column) else F.lit(float(atol)))
    alone, there = F.coalesce(tx.figure_only(text), F.lit(False)), block.isNotNull()
    built = there if compiles is None else F.coalesce(compiles, F.lit(False)) & there
    right = (g["total"] > 0) & (g["matched"] == g["total"])
    accuracy = F.when(g["total"] > 0, g["matched"] / g["total"]).otherwise(0.0)
    return F.struct(
        alone.alias("figure_only"), there.alias("has_figure"), built.alias("compiles"), g["matched"].alias("matched"), g["total"].alias("total"), accuracy.alias("coord_accuracy"),
        right.alias("coords_all_correct"), (alone & built & right).alias("passed"), g["ok"].alias("ok"), g["err"].alias("err"), g["of"].alias("of"),
    )


def frame_units(p: Column, frame: Column, least: float = 1e-6) -> Column:
    """A canvas point (struct x, y) in units of a frame (x1, y1, x2, y2, x3, y3): the axes run to the second point's x
    and the third one's y; null where the frame has no extent."""
    ux, uy = frame["x2"] - frame["x1"], frame["y3"] - frame["y1"]
    return F.when((F.abs(ux) >= least) & (F.abs(uy) >= least), F.struct(((p["x"] - frame["x1"]) / ux).alias("x"), ((p["y"] - frame["y1"]) / uy).alias("y")))


def canvas_log(log: Column) -> tuple[Column, Column]:
    """(frame, points) of a typesetter's log: the last whole `REF` line, and the last `NAME x y` or `NAME undef` of each
    name (null for undef). Numbers may have units; other lines are ignored."""
    number = lambda t: F.regexp_extract(t, r"-?\d+(?:\.\d+)?", 0).try_cast("double")
    lines = F.transform(F.split(F.coalesce(log, F.lit("")), "\n"), lambda x: F.split(F.trim(x), r"\s+"))
    whole = F.filter(lines, lambda x: (x[0] == "REF") & (F.size(x) >= 7) & F.forall(F.slice(x, 2, 6), lambda t: number(t).isNotNull()))
    last = F.try_element_at(whole, F.lit(-1))
    frame = F.when(last.isNotNull(), F.struct(*[number(last[k + 1]).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2", "x3", "y3"))]))
    named = F.filter(lines, lambda x: (x[0] != "REF") & (x[0] != "") & ((F.size(x) >= 3) | ((F.size(x) == 2) & (x[1] == "undef"))))
    point = lambda x: F.when((F.size(x) >= 3) & number(x[1]).isNotNull() & number(x[2]).isNotNull(), F.struct(number(x[1]).alias("x"), number(x[2]).alias("y")))
    kind = "map<string, struct<x: double, y: double>>"
    points = F.aggregate(named, F.expr(f"cast(map() as {kind})"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != x[0]), F.create_map(x[0], point(x))))
    return frame, points
