"""Columns over figure text: Arrow-batched where a parser is needed, native expressions elsewhere."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions.figure_calls import circles, constructions, segments
from tracewell.functions.figure_parser import expand_macros, named_points, scalar

NUMBER = r"-?\d+(?:\.\d+)?"
POINT_TYPE = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])


def _each_once(text: pa.Array, read: Callable[[list], pa.Array]) -> pa.Array:
    """What is read off each distinct text of a batch, dealt back to its rows."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    distinct = text.dictionary_encode(null_encoding="encode")
    return read(distinct.dictionary.to_pylist()).take(distinct.indices)


@F.arrow_udf(T.MapType(T.StringType(), POINT_TYPE))
def points_of(text: pa.Array) -> pa.Array:
    """Name -> (x, y) of the points of a figure."""

    def read(texts: list) -> pa.Array:
        found = [named_points(t) for t in texts]
        flat = [xy for p in found for xy in p.values()]
        x, y = (pa.array([float(p[k]) for p in flat], pa.float64()) for k in (0, 1))
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in found])]).astype(np.int32)
        return pa.MapArray.from_arrays(pa.array(offsets), pa.array([k for p in found for k in p], pa.string()), pa.StructArray.from_arrays([x, y], ["x", "y"]))

    return _each_once(text, read)


@F.arrow_udf(T.DoubleType())
def scalar_of(text: pa.Array) -> pa.Array:
    """The value of a scalar."""
    return _each_once(text, lambda ts: pa.array(list(map(scalar, ts)), pa.float64()))


@F.arrow_udf(T.StringType())
def macros_expanded(text: pa.Array) -> pa.Array:
    return _each_once(text, lambda ts: pa.array([None if t is None else expand_macros(t) for t in ts], pa.string()))


def literal_points(text: Column) -> Column:
    """[(name, x, y)] of points defined by two plain numbers."""
    x = rf"({NUMBER})\s*,\s*({NUMBER})\s*\)"
    macro, coordinate = rf"\\tkzDefPoint\(\s*{x}\{{([A-Za-z]\w*)\}}", rf"\\coordinate\s*\(\s*([A-Za-z]\w*)\s*\)\s*at\s*\(\s*{x}"
    parts = lambda rx, n, x, y: F.arrays_zip(*[F.regexp_extract_all(text, F.lit(rx), F.lit(k)).alias(a) for k, a in ((n, "name"), (x, "x"), (y, "y"))])
    return F.concat(parts(macro, 3, 1, 2), parts(coordinate, 1, 2, 3))


def point_names(text: Column) -> Column:
    """The distinct names of defined points, then of drawn and labelled ones, in order."""
    defs = (r"\\tkzDefPoint\([^)]*\)\{([A-Za-z]\w*)\}", r"\\tkzGetPoint\{([A-Za-z]\w*)\}", r"\\coordinate\s*\(\s*([A-Za-z]\w*)\s*\)", r"\\node(?:\[[^\]]*\])?\s*\(\s*([A-Za-z]\w*)\s*\)")
    lists = (r"\\tkzDrawPoints\(([^)]*)\)", r"\\tkzLabelPoints(?:\[[^\]]*\])?\(([^)]*)\)")
    found = [F.regexp_extract_all(text, F.lit(rx), F.lit(1)) for rx in defs]
    drawn = [F.filter(F.transform(F.flatten(F.transform(F.regexp_extract_all(text, F.lit(rx), F.lit(1)), lambda b: F.split(b, ","))), lambda n: F.trim(n)), lambda n: n.rlike(r"^[A-Za-z]\w*$")) for rx in lists]
    return F.array_distinct(F.concat(*found, *drawn))


_CONSTRUCTION = T.StructType([T.StructField("type", T.StringType()), T.StructField("parents", T.ArrayType(T.StringType())), T.StructField("angle", T.DoubleType()), T.StructField("t", T.DoubleType())])
_CIRCLE = T.StructType([T.StructField("center", T.StringType()), T.StructField("through", T.StringType()), T.StructField("cx", T.DoubleType()), T.StructField("cy", T.DoubleType()), T.StructField("r", T.DoubleType())])


@F.arrow_udf(T.MapType(T.StringType(), _CONSTRUCTION))
def constraints_of(text: pa.Array) -> pa.Array:
    """Name -> construction of the derived points of a figure."""
    kind = pa.map_(pa.string(), pa.struct([("type", pa.string()), ("parents", pa.list_(pa.string())), ("angle", pa.float64()), ("t", pa.float64())]))
    read = lambda t: [(k, {"type": c.kind, "parents": c.parents, "angle": c.angle, "t": c.t}) for k, c in constructions(t).items()]
    return _each_once(text, lambda ts: pa.array(list(map(read, ts)), kind))


@F.arrow_udf(T.ArrayType(T.StringType()))
def edges_of(text: pa.Array) -> pa.Array:
    """The drawn segments of a figure, as 'A-B'."""
    return _each_once(text, lambda ts: pa.array(list(map(segments, ts)), pa.list_(pa.string())))


@F.arrow_udf(T.ArrayType(_CIRCLE))
def circles_of(text: pa.Array) -> pa.Array:
    """The drawn circles of a figure."""
    kind = pa.list_(pa.struct([("center", pa.string()), ("through", pa.string()), ("cx", pa.float64()), ("cy", pa.float64()), ("r", pa.float64())]))
    return _each_once(text, lambda ts: pa.array([[asdict(c) for c in circles(t)] for t in ts], kind))


def paint_points_last(text: Column) -> Column:
    """Lines that draw point marks move to the end of the figure; doing it twice changes nothing."""
    mark = r"(?mi)^[ \t]*\\(?:(?:filldraw|fill)\b[^\n]*\bcircle\b[^\n]*|tkzDrawPoints\b[^\n]*)\n?"
    marks = F.array_join(F.regexp_extract_all(text, F.lit(mark), F.lit(0)), "")
    rest = F.regexp_replace(text, mark, "")
    at = F.instr(rest, F.lit("\\end{tikzpicture}"))
    return F.when((marks == "") | (at == 0), text).otherwise(F.concat(F.substr(rest, F.lit(1), at - 1), marks, F.substr(rest, at)))


def overlaid(text: Column) -> Column:
    """Named helper paths no longer widen the figure."""
    return F.replace(text, F.lit("\\path[name path="), F.lit("\\path[overlay,name path="))


def compass(dx: Column, dy: Column) -> Column:
    """One of eight directions; null for no direction."""
    names = F.array(*map(F.lit, ("right", "above right", "above", "above left", "left", "below left", "below", "below right")))
    slot = F.pmod(F.round(F.degrees(F.atan2(dy, dx)) / 45).cast("int"), F.lit(8))
    return F.when((dx != 0) | (dy != 0), F.element_at(names, slot + 1))


def image_scores(a: Column, b: Column) -> tuple[Column, Column]:
    """(mse, global ssim) of two arrays of equal length, population variances."""
    n = F.size(a)
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, x: s + x)
    ma, mb = total(a) / n, total(b) / n
    va = total(F.transform(a, lambda x: x * x)) / n - ma * ma
    vb = total(F.transform(b, lambda x: x * x)) / n - mb * mb
    cov = total(F.zip_with(a, b, lambda x, y: x * y)) / n - ma * mb
    mse = total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))) / n
    c1, c2 = 1e-4, 9e-4
    return mse, (2 * ma * mb + c1) * (2 * cov + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))
