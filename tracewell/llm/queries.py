"""Queries of the training-data operators, over the whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.catalog import Catalog, table
from tracewell.llm import encode, leak, neardup, overlap, pairs, sample, spans, truncation
from tracewell.session import stage

CATALOG = Catalog()


@CATALOG.add("p5_found")
def p5_found(spark, sf) -> DataFrame:
    return neardup.near_groups(table(spark, sf, "illustrations"), "illus_id", "description").select("group_id", "illus_id")


def _split_records(spark, sf) -> DataFrame:
    """Both tables' texts with train or not; rows of a null split are in no split, a blank one is a split besides train."""
    split = F.lower(F.regexp_replace("split", r"^\s+|\s+$", ""))
    one = lambda name, k, rec, text: table(spark, sf, name).select(
        F.lit(k).alias("tbl"), F.col(rec).alias("rec"), (split == "train").alias("train"), F.col(text).alias("text")
    )
    return one("illustrations", 0, "illus_id", "description").unionAll(one("problems", 1, "problem_id", "statement"))


def _tbl(*names: str):
    return F.element_at(F.array(*map(F.lit, names)), F.col("tbl") + 1).alias("tbl")


_SPLIT_TABLES = ("illustrations", "problems")


@CATALOG.add("p1_found")
def p1_found(spark, sf) -> DataFrame:
    found = overlap.split_overlaps(_split_records(spark, sf))
    return found.select(_tbl(*_SPLIT_TABLES), F.least("train_id", "held_id").alias("id_a"), F.greatest("train_id", "held_id").alias("id_b"))


@CATALOG.add("p6_ids")
def p6_ids(spark, sf) -> DataFrame:
    return encode.encode_texts(table(spark, sf, "documents"), "doc_id", "text")


@CATALOG.add("p7_found")
def p7_found(spark, sf) -> DataFrame:
    docs, items = table(spark, sf, "documents"), table(spark, sf, "test_items")
    return leak.leaked_items(docs, "doc_id", "text", items, "item_id", "text").select("doc_id", "item_id")


@CATALOG.add(
    "p8_found",
    """
WITH w AS (SELECT doc_id, hash(substr(text, i, 400)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 398)) AS i FROM documents WHERE length(text) >= 400)),
r AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1)
SELECT DISTINCT doc_id FROM w SEMI JOIN r USING (h)""",
)
def p8_found(spark, sf) -> DataFrame:
    return spans.shared_spans(table(spark, sf, "documents"), "doc_id", "text").select("doc_id").distinct()


@CATALOG.add(
    "p3_found",
    r"""
WITH p AS (SELECT DISTINCT problem_id, topic, source FROM problems WHERE statement IS NOT NULL),
l AS (SELECT problem_id, 'topic' AS field_name, topic AS c FROM p UNION ALL SELECT problem_id, 'source', source FROM p),
k AS (SELECT field_name, regexp_replace(lower(regexp_replace(c, '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g')), '[\s\x{00A0}-]', '_', 'g') AS category, count(DISTINCT problem_id) AS n FROM l GROUP BY ALL)
SELECT t.request_id, t.category FROM sample_targets t LEFT JOIN k USING (field_name, category)
WHERE coalesce(k.n, 0) < greatest(t.min_rows, ceil(t.target_pm * t.sample_rows / 1000.0))""",
)
def p3_found(spark, sf) -> DataFrame:
    return _samples(spark, sf)[1].filter("short").select("request_id", "category")


def _results(spark, sf) -> DataFrame:
    """Both tables of model answers as (tbl, rec, text)."""
    one = lambda name, k, rec: table(spark, sf, name).select(F.lit(k).alias("tbl"), F.col(rec).alias("rec"), "text")
    return one("gen_results", 0, "gen_id").unionAll(one("chat_results", 1, "call_id"))


@CATALOG.add("p4_found")
def p4_found(spark, sf) -> DataFrame:
    found = truncation.cut_texts(_results(spark, sf))
    return found.select(_tbl("gen_results", "chat_results"), F.col("rec").alias("row_id"))


@CATALOG.add("p2_found")
def p2_found(spark, sf) -> DataFrame:
    cut = truncation.cut_texts(_results(spark, sf)).filter("tbl = 0").select(F.col("rec").alias("gen_id"))
    answers = table(spark, sf, "gen_results").filter("error is null")
    return pairs.defective_pairs(table(spark, sf, "illustrations"), "illus_id", "description", answers, "gen_id", "text", cut)


@CATALOG.add("p1_report")
def p1_report(spark, sf) -> DataFrame:
    """Per table, split and source of the evaluation records: those with an overlap, their pairs, and the mean share of
    their words that lie in an interval shared with any training text."""
    found = overlap.coverage(stage(overlap.split_overlaps(_split_records(spark, sf)), "overlaps")).withColumn("covered", F.col("covered") / F.col("words"))
    of = lambda name, k, rec: table(spark, sf, name).select(F.lit(k).alias("tbl"), F.col(rec).alias("held_id"), F.lower(F.regexp_replace("split", r"^\s+|\s+$", "")).alias("split"), F.lower(F.trim("source")).alias("source"))
    held = of("illustrations", 0, "illus_id").unionAll(of("problems", 1, "problem_id")).groupBy("tbl", "held_id").agg(F.max(F.struct("split", "source")).alias("r")).select("tbl", "held_id", "r.split", "r.source")
    return found.join(held, ["tbl", "held_id"]).groupBy(_tbl(*_SPLIT_TABLES), "split", "source").agg(
        F.count("*").alias("records"), F.sum("pairs").alias("pairs"), F.round(F.avg("covered"), 6).alias("mean_covered")
    )


@CATALOG.add("p2_rates")
def p2_rates(spark, sf) -> DataFrame:
    """Defects per source of the answers."""
    source = table(spark, sf, "gen_results").select("gen_id", F.lower(F.trim("source")).alias("source")).dropDuplicates(["gen_id"])
    return p2_found(spark, sf).join(source, "gen_id").groupBy("source", "defect").agg(F.count("*").alias("n"))


def _samples(spark, sf) -> tuple[DataFrame, DataFrame]:
    return sample.proportional_samples(table(spark, sf, "problems"), table(spark, sf, "sample_targets"), "problem_id", "statement", ("topic", "source"), latest="loaded_at")


@CATALOG.add("p3_sample")
def p3_sample(spark, sf) -> DataFrame:
    return _samples(spark, sf)[0].withColumnRenamed("id", "problem_id")


@CATALOG.add(
    "p3_availability",
    r"""
WITH p AS (SELECT problem_id, topic, source FROM (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY loaded_at DESC) AS rn FROM problems WHERE statement IS NOT NULL) WHERE rn = 1),
l AS (SELECT problem_id, 'topic' AS field_name, topic AS c FROM p UNION ALL SELECT problem_id, 'source', source FROM p),
k AS (SELECT field_name, regexp_replace(lower(regexp_replace(c, '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g')), '[\s\x{00A0}-]', '_', 'g') AS category, count(*) AS n FROM l GROUP BY ALL)
SELECT t.request_id, t.field_name, t.category, coalesce(k.n, 0)::BIGINT AS available, greatest(t.min_rows, ceil(t.target_pm * t.sample_rows / 1000.0))::BIGINT AS needed FROM sample_targets t LEFT JOIN k USING (field_name, category)""",
)
def p3_availability(spark, sf) -> DataFrame:
    return _samples(spark, sf)[1].select("request_id", "field_name", "category", "available", "needed")


@CATALOG.add("p3_report")
def p3_report(spark, sf) -> DataFrame:
    return _samples(spark, sf)[1]


@CATALOG.add("p4_rates")
def p4_rates(spark, sf) -> DataFrame:
    """How often texts are cut, per table and per source or model."""
    one = lambda name, k, rec, who: table(spark, sf, name).select(F.lit(k).alias("tbl"), F.col(rec).alias("rec"), F.lower(F.trim(who)).alias("maker")).dropDuplicates(["rec"])
    rows = one("gen_results", 0, "gen_id", "source").unionAll(one("chat_results", 1, "call_id", "model"))
    cut = truncation.cut_texts(_results(spark, sf)).select("tbl", "rec", F.lit(1).alias("cut"))
    return rows.join(cut, ["tbl", "rec"], "left").groupBy("tbl", "maker").agg(F.count("*").alias("n"), F.count("cut").alias("cut"), F.round(F.count("cut") / F.count("*"), 6).alias("rate"))


@CATALOG.add("p4_by")
def p4_by(spark, sf) -> DataFrame:
    """Cut texts by how they end and what shows it: a longer copy, an opening left open, or the closing word."""
    return truncation.cut_texts(_results(spark, sf)).groupBy(_tbl("gen_results", "chat_results"), "ending", "by").agg(F.count("*").alias("n"))


@CATALOG.add("p5_sizes")
def p5_sizes(spark, sf) -> DataFrame:
    """Groups of near-duplicates by size."""
    groups = neardup.near_groups(table(spark, sf, "illustrations"), "illus_id", "description")
    return groups.groupBy("group_id").agg(F.count("*").alias("members")).groupBy("members").agg(F.count("*").alias("groups"))


@CATALOG.add("p7_items")
def p7_items(spark, sf) -> DataFrame:
    """Per leaked test item: the documents that hold some of it, and the most of its words in one document."""
    docs, items = table(spark, sf, "documents"), table(spark, sf, "test_items")
    found = leak.leaked_items(docs, "doc_id", "text", items, "item_id", "text")
    return found.groupBy("item_id").agg(F.count("*").alias("documents"), F.max("words").alias("most_words"))


@CATALOG.add("p8_shares")
def p8_shares(spark, sf) -> DataFrame:
    """Per document with shared spans: their number, their characters, and their share of the text."""
    docs = table(spark, sf, "documents")
    spans_ = spans.shared_spans(docs, "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("spans"), F.sum(F.col("end") - F.col("start")).alias("shared"))
    return spans_.join(docs.select("doc_id", F.length("text").alias("chars")), "doc_id").select("doc_id", "spans", "shared", F.round(F.col("shared") / F.col("chars"), 6).alias("share"))
