"""Queries of generators, sinks and streams, checked by rows or against SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewell.catalog import table
from tracewell.functions import grading
from tracewell.operators import families, generate
from tracewell.plans import CATALOG
from tracewell.session import shared_dir
from tracewell.sources import files
from tracewell.streaming import events as ev

add = CATALOG.add


def _rows(spark, sf) -> int:
    """As many as there are illustrations."""
    return table(spark, sf, "illustrations").count()


@add("gen_scenes")
def gen_scenes(spark, sf):
    return families.circle_scenes(spark, _rows(spark, sf), seed=5, max_chain=6, symbolic=True)


@add("gen_chains")
def gen_chains(spark, sf):
    return generate.chains(spark, _rows(spark, sf), 4, mixed=True, seed=5)


@add("gen_mixed_scenes")
def gen_mixed_scenes(spark, sf):
    return generate.scenes(spark, _rows(spark, sf), seed=5)


@add("gen_problems")
def gen_problems(spark, sf):
    return families.problems(spark, _rows(spark, sf), seed=5)


def _yields(made, tag: str):
    """Generated figures are read back and graded against their own points: sampled and kept per tag and in all."""
    g = made.select(F.col(tag).alias("tag"), grading.grade(F.col("tikz"), F.col("points"), F.col("unordered") if "unordered" in made.columns else None)["passed"].alias("passed"))
    return g.rollup("tag").agg(F.count("*").alias("sampled"), F.count_if("passed").alias("kept"), F.grouping("tag").cast("int").alias("total"))


_TAGS = "[" + ", ".join(f"'{t}'" for t in families.FAMILIES) + "]"


@add(
    "roundtrip_problems",
    f"WITH r AS (SELECT unnest(range((SELECT count(*) FROM illustrations))) AS id), t AS (SELECT {_TAGS}[(id % {len(families.FAMILIES)} + 1)::INT] AS tag FROM r) SELECT tag, count(*)::BIGINT AS sampled, count(*)::BIGINT AS kept, grouping(tag)::INT AS total FROM t GROUP BY ROLLUP (tag)",
)
def roundtrip_problems(spark, sf):
    """Every generated problem passes the gate on its own figure."""
    return _yields(families.problems(spark, _rows(spark, sf), seed=5), "tag")


@add("roundtrip_scenes", "SELECT NULL::VARCHAR AS tag, (SELECT count(*) FROM illustrations)::BIGINT AS sampled, (SELECT count(*) FROM illustrations)::BIGINT AS kept, 1 AS total")
def roundtrip_scenes(spark, sf):
    """Scenes of a forced last step, in numbers: each figure gives back its points."""
    made = families.circle_scenes(spark, _rows(spark, sf), seed=9, chain=5, irregular=True, force_op="foot_altitude")
    return _yields(made.withColumn("tag", F.lit("all")), "tag").filter("total = 1")


@add("roundtrip_symbolic")
def roundtrip_symbolic(spark, sf):
    """The same in constructions, by the last step's kind: points are stated rounded, so a few are not given back."""
    made = families.circle_scenes(spark, _rows(spark, sf), seed=9, chain=5, irregular=True, symbolic=True)
    return _yields(made.withColumn("tag", F.element_at("tags", -1)), "tag")


@add("jsonl_round_trip", "SELECT problem_id, num, title FROM problems WHERE title IS NOT NULL")
def jsonl_round_trip(spark, sf):
    """Written as JSON lines and read again."""
    path = f"{shared_dir(spark)}/tracewell/jsonl-{uuid.uuid4().hex}"
    files.write_jsonl(table(spark, sf, "problems").filter("title is not null").select("problem_id", "num", "title"), path)
    return files.read_jsonl(spark, path, "problem_id bigint, num int, title string")


@add("csv_round_trip", "SELECT gen_id, cell, chain FROM eval_detail WHERE cell IS NOT NULL")
def csv_round_trip(spark, sf):
    path = f"{shared_dir(spark)}/tracewell/csv-{uuid.uuid4().hex}"
    files.write_csv(table(spark, sf, "eval_detail").filter("cell is not null"), path, ["gen_id", "cell", "chain"])
    return spark.read.schema("gen_id bigint, cell string, chain int").csv(path, header=True)


@add("stream_windows", "SELECT date_trunc('day', ts)::VARCHAR AS start, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def stream_windows(spark, sf):
    """Daily counts per type from the stream of event files, in one run over what is there."""
    name = f"windows_{uuid.uuid4().hex}"
    schema = table(spark, sf, "events").schema
    counts = ev.windowed_counts(ev.event_stream(spark, f"{sf}/events.parquet", schema), late="2 days")
    ev.run_once(counts, name, f"{shared_dir(spark)}/tracewell/{name}")
    return spark.table(name).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@add(
    "sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, count(*)::BIGINT AS n, min(ts)::VARCHAR AS first FROM s GROUP BY user_id, k""",
)
def sessions(spark, sf):
    """Runs of a user's events with gaps of at most six hours."""
    e = table(spark, sf, "events").select("user_id", "ts")
    w = Window.partitionBy("user_id").orderBy("ts")
    new = F.when(F.col("ts") - F.lag("ts").over(w) <= F.expr("INTERVAL 6 HOUR"), 0).otherwise(1)
    s = e.withColumn("new", new).withColumn("k", F.sum("new").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    text = F.regexp_replace(F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss.SSSSSS"), r"\.?0+$", "")
    return s.groupBy("user_id", "k").agg(F.count("*").alias("n"), text.alias("first")).drop("k")
