"""Rates over live rows and their Wilson intervals, as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.96


def live_rate(hits: Column | str, n: Column | str) -> Column:
    """hits / n, and 0.0 for an empty group."""
    hits, n = (F.col(x) if isinstance(x, str) else x for x in (hits, n))
    return F.when(n == 0, 0.0).otherwise(F.try_divide(hits.cast("double"), n.cast("double")))


def wilson(hits: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval, within [0, 1]; (0, 1) where n is 0."""
    k, m = hits.cast("double"), F.nullif(n.cast("double"), F.lit(0.0))
    p, zz = k / m, z * z
    half = z * F.sqrt(p * (1 - p) / m + zz / (4 * m * m))
    low, high = ((p + zz / (2 * m) + s * half) / (1 + zz / m) for s in (-1, 1))
    return F.coalesce(F.greatest(F.lit(0.0), low), F.lit(0.0)), F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), high))
