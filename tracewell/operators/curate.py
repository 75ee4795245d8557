"""Curation operators: latest per key, ordinals, quotas, seeded order, repetition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.session import stage


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key (descending `order`); give a tie-break as the last of it."""
    return first_k(df, keys, order, 1)


def first_k(df: DataFrame, keys: list[str], order: list[Column], k: int | Column) -> DataFrame:
    """The first k rows of each group. With a number, Spark limits each group before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def seeded(seed: int, *columns: str) -> Column:
    """A reproducible random order: md5 of the seed and the columns."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]).cast("binary"))


def ordinals(df: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """Numbers rows 0..n-1 in the given total order without bringing them to one task: ranges are numbered within
    themselves and offset by the rows before them."""
    ranged = stage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("n"))
    before = sizes.select("_part", (F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + within - 1).cast("bigint")).drop("_part", "_before")


def content_key(text: Column, length: int = 12) -> Column:
    """The first hex digits of the text's md5."""
    return F.substring(F.md5(text.cast("binary")), 1, length)


def repeated(df: DataFrame, times: Column | int) -> DataFrame:
    """Each row `times` times, at least once; copy counts them from 1."""
    n = times if isinstance(times, Column) else F.lit(times)
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest(n, F.lit(1)))))


def must_be_disjoint(a: DataFrame, b: DataFrame, on: list[str]) -> None:
    """Raises where two splits share a key."""
    if not a.select(*on).intersect(b.select(*on)).isEmpty():
        raise ValueError(f"the splits overlap on {on}")


def scaled(count: Column, scale: float) -> Column:
    """A quota scaled; halves go to the even number."""
    return F.bround(count * F.lit(scale), 0).cast("long")
