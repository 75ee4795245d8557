"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.session import stage, unstage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction step over edges (u > v): every node's neighbours are hung on the smallest node near it."""
    if large:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        hung = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        hung = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return hung.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, comp) for every node with an edge to another; comp is the component's smallest node.

    Null ends and self-loops are ignored; repeated edges count once; an empty table gives an empty one. Nothing but
    two numbers a round reaches the driver: each round is staged in the shared folder.
    """
    now = stage(
        edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "edges",
    )
    mark = None
    for _ in range(max_rounds):
        then = stage(_star(_star(now, large=True), large=False), "edges")
        seen = then.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        unstage(now)
        now = then
        if seen == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionAll(
                now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
            )
        mark = seen
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
