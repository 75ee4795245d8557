"""Report operators: thresholds over ordered cells, and margins of a pivot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_failing_cell(cells: DataFrame, order: list[str], rate: str, threshold: float) -> DataFrame:
    """One row: the easiest cell of the longest tail of cells that are all below the threshold; none where the last
    cell is not below it. Without a window over all cells: the last cell at or above the threshold ends the search."""
    at = F.struct(*order)
    last = cells.agg(F.max(F.when(F.col(rate) >= threshold, at)).alias("last"))
    return cells.crossJoin(F.broadcast(last)).filter(F.col("last").isNull() | (at > F.col("last"))).agg(F.min(F.struct(*order, *[c for c in cells.columns if c not in order])).alias("c")).select("c.*").filter(F.col(order[0]).isNotNull())


def reliable_up_to(cells: DataFrame, key: list[str], step: str, rate: str, threshold: float, steps: int) -> DataFrame:
    """Per key the last step of the unbroken run 1..n of steps whose rate reaches the threshold (a missing step ends
    it; null where the first is missing or below), and the first step below one half."""
    ok = F.collect_set(F.when(F.col(rate) >= threshold, F.col(step)))
    run = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0), lambda acc, s: F.when((acc == s - 1) & F.array_contains(F.col("ok"), s), s).otherwise(acc))
    found = cells.groupBy(*key).agg(ok.alias("ok"), F.min(F.when(F.col(rate) < 0.5, F.col(step))).alias("breaks"))
    return found.select(*key, F.nullif(run, F.lit(0)).alias("reliable"), "breaks")


def with_margins(cells: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """A pivot of value with two more rows: MEAN (unweighted) and BEST over the rows; NaN counts as missing."""
    clean = cells.withColumn(value, F.when(~F.isnan(value), F.col(value)))
    body = clean.groupBy(row).pivot(column, columns).agg(F.round(F.first(value), 6))
    margin = lambda name, fn: clean.groupBy(F.lit(name).alias(row)).pivot(column, columns).agg(F.round(fn(value), 6))
    return body.unionByName(margin("MEAN", F.avg)).unionByName(margin("BEST", F.max))


def top_counts(df: DataFrame, what: Column, k: int, name: str) -> DataFrame:
    """The k most frequent values; ties by value."""
    return df.groupBy(what.alias(name)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name).limit(k)

