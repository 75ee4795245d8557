"""Generated scenes: table-valued generation in Arrow batches, one seed a row, so any split of the rows gives the same
scenes. Degenerate steps are skipped, so a scene may have fewer steps than asked for."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STEPS = ("midpoint", "symmetry", "reflection", "rotation", "translation", "foot", "intersection")
AFFINE = STEPS[:5]
NEAR, FAR = 0.15, 13.0
_SCHEMA = "id long, tags array<string>, chain int, irregular boolean, names array<string>, xs array<double>, ys array<double>, description string"


def _foot(p, a, b):
    ux, uy = b[0] - a[0], b[1] - a[1]
    d = ux * ux + uy * uy
    if d < 0.5:
        return None
    t = ((p[0] - a[0]) * ux + (p[1] - a[1]) * uy) / d
    return a[0] + t * ux, a[1] + t * uy


def _meet(a, b, c, d):
    ux, uy, vx, vy = b[0] - a[0], b[1] - a[1], d[0] - c[0], d[1] - c[1]
    den = ux * vy - uy * vx
    if abs(den) < 1e-9:
        return None
    t = ((c[0] - a[0]) * vy - (c[1] - a[1]) * vx) / den
    return a[0] + t * ux, a[1] + t * uy


def _step(op: str, rng: random.Random, pts: list[tuple[float, float]]):
    """(parents, new point, words) of one step."""
    need = {"rotation": 2, "midpoint": 2, "symmetry": 2, "intersection": 4}.get(op, 3)
    if len(pts) < need:
        return None
    at = rng.sample(range(len(pts)), need)
    p = [pts[i] for i in at]
    if op == "midpoint":
        return at, ((p[0][0] + p[1][0]) / 2, (p[0][1] + p[1][1]) / 2), "the midpoint of {0} and {1}"
    if op == "symmetry":
        return at, (2 * p[1][0] - p[0][0], 2 * p[1][1] - p[0][1]), "the image of {0} through {1}"
    if op == "rotation":
        deg = rng.choice((30, 45, 60, 90, 120))
        c, s, (x, y) = math.cos(math.radians(deg)), math.sin(math.radians(deg)), (p[0][0] - p[1][0], p[0][1] - p[1][1])
        return at, (p[1][0] + x * c - y * s, p[1][1] + x * s + y * c), f"the image of {{0}} turned by {deg} degrees about {{1}}"
    if op == "translation":
        return at, (p[0][0] + p[2][0] - p[1][0], p[0][1] + p[2][1] - p[1][1]), "{0} moved along the arrow from {1} to {2}"
    if op == "intersection":
        return at, _meet(*p), "the point where lines {0}{1} and {2}{3} meet"
    f = _foot(*p)
    if op == "foot" or f is None:
        return at, f, "the foot of {0} on line {1}{2}"
    return at, (2 * f[0] - p[0][0], 2 * f[1] - p[0][1]), "the mirror image of {0} in line {1}{2}"


def scene(row: int, seed: int, chain: int, irregular: bool, ops: tuple[str, ...] = STEPS, last: tuple[str, ...] = ()) -> tuple:
    """One scene of three base points and up to `chain` derived ones; coordinates are rounded before they are used."""
    rng = random.Random(f"{seed}|{row}")
    grid = (lambda: round(rng.uniform(-5, 5), 2)) if irregular else (lambda: float(rng.randint(-5, 5)))
    while True:
        pts = [(grid(), grid()) for _ in range(3)]
        area2 = (pts[1][0] - pts[0][0]) * (pts[2][1] - pts[0][1]) - (pts[2][0] - pts[0][0]) * (pts[1][1] - pts[0][1])
        if abs(area2) >= 12 and min(math.dist(pts[i], pts[j]) for i, j in ((0, 1), (1, 2), (0, 2))) >= 3:
            break
    names, tags = ["P0", "P1", "P2"], []
    said = ["{} is ({:g}, {:g}).".format(n, *p) for n, p in zip(names, pts)]
    for k in range(chain):
        op = rng.choice(last if last and k == chain - 1 else ops)
        made = _step(op, rng, pts)
        if made is None or made[1] is None:
            continue
        p = (round(made[1][0], 2) + 0.0, round(made[1][1], 2) + 0.0)
        if max(map(abs, p)) > FAR or any(math.dist(p, q) < NEAR for q in pts):
            continue
        names.append(f"P{len(pts)}")
        said.append(f"{names[-1]} is {made[2].format(*(names[i] for i in made[0]))}.")
        pts.append(p)
        tags.append(op)
    return row, tags, len(tags), irregular, names, [p[0] for p in pts], [p[1] for p in pts], " ".join(said)


def _generated(rows: DataFrame, make) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _SCHEMA.split(", ")]
        types = [pa.int64(), pa.list_(pa.string()), pa.int32(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.string()]
        for batch in batches:
            made = [make(i) for i in batch.column(0).to_pylist()]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), types)], names)

    return rows.mapInArrow(run, _SCHEMA)


def scenes(spark: SparkSession, n: int, seed: int = 0, max_chain: int = 3) -> DataFrame:
    """n scenes; the chain is uniform in 1..max_chain, one half is irregular."""

    def make(i: int) -> tuple:
        rng = random.Random(f"{seed}|{i}|shape")
        return scene(i, seed, rng.randint(1, max_chain), rng.random() < 0.5)

    return _generated(spark.range(n), make)


def chains(spark: SparkSession, n: int, length: int, mixed: bool, seed: int = 0) -> DataFrame:
    """n scenes of affine steps; with `mixed` the last step is a foot or an intersection. Only whole chains stay."""
    made = _generated(spark.range(n), lambda i: scene(i, seed, length, False, AFFINE, ("foot", "intersection") if mixed else ()))
    return made.filter(F.col("chain") == length)
