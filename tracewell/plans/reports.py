"""Pass-rate reports over graded answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.catalog import table
from tracewell.operators import report
from tracewell.operators.curate import ordinals
from tracewell.operators.rates import live_rate, wilson
from tracewell.plans import CATALOG
from tracewell.plans.curation import CHAT_SQL, GEN_SQL, ILLUS_SQL, PROB_SQL, chats, gens, illus, probs

add = CATALOG.add

_WILSON_SQL = """
CASE WHEN n = 0 THEN 0.0 ELSE round(greatest(0.0, (passed / n + 3.8416 / (2 * n) - 1.96 * sqrt((passed / n) * (1 - passed / n) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n)), 6) END AS low,
CASE WHEN n = 0 THEN 1.0 ELSE round(least(1.0, (passed / n + 3.8416 / (2 * n) + 1.96 * sqrt((passed / n) * (1 - passed / n) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n)), 6) END AS high"""


@add(
    "gate_by_cell",
    f"""
WITH g AS (
  SELECT cell, count(*) FILTER (NOT api_fail)::DOUBLE AS n, count(*) FILTER (api_fail) AS n_api_fail,
         count(*) FILTER (NOT api_fail AND passed)::DOUBLE AS passed,
         count(*) FILTER (NOT api_fail AND compiles)::DOUBLE AS compiled
  FROM eval_detail GROUP BY cell)
SELECT cell, n::BIGINT AS n, n_api_fail::BIGINT AS n_api_fail,
       CASE WHEN n = 0 THEN 0.0 ELSE round(passed / n, 6) END AS pass_rate,
       CASE WHEN n = 0 THEN 0.0 ELSE round(compiled / n, 6) END AS compile_rate, {_WILSON_SQL}
FROM g""",
)
def gate_by_cell(spark, sf) -> DataFrame:
    d = table(spark, sf, "eval_detail")
    live = ~F.col("api_fail")
    g = d.groupBy("cell").agg(
        F.count_if(live).alias("n"),
        F.count_if("api_fail").alias("n_api_fail"),
        F.count_if(live & F.col("passed")).alias("passed"),
        F.count_if(live & F.col("compiles")).alias("compiled"),
    )
    low, high = wilson(F.col("passed"), F.col("n"))
    return g.select(
        "cell", "n", "n_api_fail",
        F.round(live_rate("passed", "n"), 6).alias("pass_rate"), F.round(live_rate("compiled", "n"), 6).alias("compile_rate"),
        F.round(low, 6).alias("low"), F.round(high, 6).alias("high"),
    )


def _detail(spark, sf) -> DataFrame:
    """Graded answers with their model."""
    g = gens(spark, sf).select("gen_id", "run_id")
    return table(spark, sf, "eval_detail").join(g, "gen_id").join(table(spark, sf, "runs").select("run_id", "model"), "run_id")


_D = f"{GEN_SQL}, d AS (SELECT e.*, r.model FROM eval_detail e JOIN gen g USING (gen_id) JOIN runs r USING (run_id))"
_LIVE = "FILTER (NOT api_fail)"
_CELLS_SQL = f"{_D}, c AS (SELECT model, cell, min(chain) AS chain, bool_or(irregular) AS irregular, count(*) {_LIVE} AS n, count(*) FILTER (NOT api_fail AND passed) AS hits FROM d GROUP BY model, cell), r AS (SELECT *, CASE WHEN n = 0 THEN 0.0 ELSE hits::DOUBLE / n END AS rate FROM c)"


def _cells(spark, sf) -> DataFrame:
    live = ~F.col("api_fail")
    c = _detail(spark, sf).groupBy("model", "cell").agg(
        F.min("chain").alias("chain"), F.bool_or("irregular").alias("irregular"), F.count_if(live).alias("n"), F.count_if(live & F.col("passed")).alias("hits")
    )
    return c.withColumn("rate", live_rate("hits", "n"))


@add(
    "gate_summary",
    """SELECT count(*)::BIGINT AS n, round(coalesce(avg(figure_only::INT), 0), 6) AS figure_only_rate, round(coalesce(avg(compiles::INT), 0), 6) AS compile_rate, round(coalesce(avg(passed::INT), 0), 6) AS pass_rate,
    round(coalesce(avg(coords_all_correct::INT), 0), 6) AS correct_rate, round(coalesce(avg(CASE WHEN NOT isnan(coord_accuracy) THEN coord_accuracy END), 0), 6) AS coord_accuracy, round(avg(CASE WHEN NOT isnan(ssim) THEN ssim END), 6) AS ssim FROM eval_detail""",
)
def gate_summary(spark, sf):
    """All rows are in the denominator; an empty table gives 0 rows, rates 0 and null similarity."""
    d = table(spark, sf, "eval_detail")
    rate = lambda c, name: F.round(F.coalesce(F.avg(F.col(c).cast("int")), F.lit(0.0)), 6).alias(name)
    number = lambda c: F.avg(F.when(~F.isnan(c), F.col(c)))
    return d.agg(
        F.count("*").alias("n"), rate("figure_only", "figure_only_rate"), rate("compiles", "compile_rate"), rate("passed", "pass_rate"), rate("coords_all_correct", "correct_rate"),
        F.round(F.coalesce(number("coord_accuracy"), F.lit(0.0)), 6).alias("coord_accuracy"), F.round(number("ssim"), 6).alias("ssim"),
    )


@add("judge_means", "SELECT cell, round(avg(CASE WHEN NOT isnan(coord_accuracy) THEN coord_accuracy END), 6) AS accuracy, round(avg(CASE WHEN NOT isnan(ssim) THEN ssim END), 6) AS ssim, count(ssim) FILTER (NOT isnan(ssim))::BIGINT AS n_ssim FROM eval_detail WHERE NOT api_fail GROUP BY cell")
def judge_means(spark, sf):
    """Means per dimension over numeric, not skipped values."""
    d = table(spark, sf, "eval_detail").filter("not api_fail")
    number = lambda c: F.when(~F.isnan(c), F.col(c))
    return d.groupBy("cell").agg(F.round(F.avg(number("coord_accuracy")), 6).alias("accuracy"), F.round(F.avg(number("ssim")), 6).alias("ssim"), F.count(number("ssim")).alias("n_ssim"))


@add(
    "gate_rollup",
    f"WITH {_D} SELECT model, cell, count(*) {_LIVE}::BIGINT AS n, count(*) FILTER (NOT api_fail AND passed)::BIGINT AS hits, round(sum(CAST(round(latency_s * 1000) AS BIGINT)) FILTER (NOT api_fail AND latency_s > 0)::DOUBLE / count(*) FILTER (NOT api_fail AND latency_s > 0), 6) AS latency_ms FROM d GROUP BY ROLLUP (model, cell)",
)
def gate_rollup(spark, sf):
    live = ~F.col("api_fail")
    timed = F.when(live & (F.col("latency_s") > 0), F.round(F.col("latency_s") * 1000).cast("bigint"))
    return _detail(spark, sf).rollup("model", "cell").agg(
        F.count_if(live).alias("n"), F.count_if(live & F.col("passed")).alias("hits"), F.round(F.try_divide(F.sum(timed).cast("double"), F.count(timed).cast("double")), 6).alias("latency_ms")
    )


@add("by_chain", f"SELECT chain, count(*) {_LIVE}::BIGINT AS n, round(avg(passed::INT) {_LIVE}, 6) AS pass_rate FROM eval_detail WHERE chain IS NOT NULL GROUP BY chain")
def by_chain(spark, sf):
    live = F.when(~F.col("api_fail"), F.col("passed").cast("int"))
    return table(spark, sf, "eval_detail").filter("chain is not null").groupBy("chain").agg(F.count_if(~F.col("api_fail")).alias("n"), F.round(F.avg(live), 6).alias("pass_rate"))


@add(
    "by_op_overlap",
    "WITH o AS (SELECT unnest(list_filter([force_op, CASE WHEN irregular THEN 'irregular' END, CASE WHEN chain >= 4 THEN 'long' END], lambda x: x IS NOT NULL)) AS op, passed FROM eval_detail WHERE NOT api_fail) SELECT op, count(*)::BIGINT AS n, count(*) FILTER (passed)::BIGINT AS hits FROM o GROUP BY op",
)
def by_op_overlap(spark, sf):
    """Overlapping groups: a row counts in each of its marks."""
    marks = F.array_compact(F.array("force_op", F.when(F.col("irregular"), "irregular"), F.when(F.col("chain") >= 4, "long")))
    return table(spark, sf, "eval_detail").filter("not api_fail").select(F.explode(marks).alias("op"), "passed").groupBy("op").agg(F.count("*").alias("n"), F.count_if("passed").alias("hits"))


@add("pooled_rate", f"WITH {_CELLS_SQL} SELECT cell, sum(hits)::BIGINT AS hits, sum(n)::BIGINT AS n, round(CASE WHEN sum(n) = 0 THEN 0 ELSE sum(hits)::DOUBLE / sum(n) END, 6) AS rate FROM r GROUP BY cell")
def pooled_rate(spark, sf):
    p = _cells(spark, sf).groupBy("cell").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n"))
    return p.select("cell", "hits", "n", F.round(live_rate("hits", "n"), 6).alias("rate"))


@add("best_mean_cell", f"WITH {_CELLS_SQL} SELECT cell, round(max(rate), 6) AS best, round(avg(rate), 6) AS mean FROM r GROUP BY cell")
def best_mean_cell(spark, sf):
    """Over models, unweighted."""
    return _cells(spark, sf).groupBy("cell").agg(F.round(F.max("rate"), 6).alias("best"), F.round(F.avg("rate"), 6).alias("mean"))


@add("wilson_ci", f"WITH {_CELLS_SQL}, w AS (SELECT model, cell, n::DOUBLE AS n, hits::DOUBLE AS passed FROM r) SELECT model, cell, {_WILSON_SQL} FROM w")
def wilson_ci(spark, sf):
    low, high = wilson(F.col("hits"), F.col("n"))
    return _cells(spark, sf).select("model", "cell", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@add("pass_rates_long", f"WITH {_CELLS_SQL} SELECT model, cell, 'n' AS metric, n::DOUBLE AS value FROM r UNION ALL SELECT model, cell, 'pass_rate', round(rate, 6) FROM r WHERE n > 0")
def pass_rates_long(spark, sf):
    """Long form, missing cells left out."""
    return _cells(spark, sf).select("model", "cell", F.explode(F.create_map(F.lit("n"), F.col("n").cast("double"), F.lit("pass_rate"), F.when(F.col("n") > 0, F.round("rate", 6)))).alias("metric", "value")).filter("value is not null")


_GRID = [f"c{k}_{s}" for k in range(1, 7) for s in ("irr", "rnd")]
_PIVOT = ", ".join(f"round({{0}}(CASE WHEN cell = '{c}' THEN rate END), 6) AS {c}" for c in _GRID)


@add(
    "heatmap_pivot",
    f"WITH {_CELLS_SQL} SELECT model, {_PIVOT.format('max')} FROM r GROUP BY model UNION ALL SELECT 'MEAN', {_PIVOT.format('avg')} FROM r UNION ALL SELECT 'BEST', {_PIVOT.format('max')} FROM r",
)
def heatmap_pivot(spark, sf):
    return report.with_margins(_cells(spark, sf), "model", "cell", "rate", _GRID)


_POOL = f"{_CELLS_SQL}, p AS (SELECT cell, min(chain) AS chain, bool_or(irregular) AS irregular, round(CASE WHEN sum(n) = 0 THEN 0 ELSE sum(hits)::DOUBLE / sum(n) END, 6) AS rate FROM r GROUP BY cell)"


def _pooled(spark, sf) -> DataFrame:
    p = _cells(spark, sf).groupBy("cell").agg(F.min("chain").alias("chain"), F.bool_or("irregular").alias("irregular"), F.sum("hits").alias("hits"), F.sum("n").alias("n"))
    return p.select("cell", "chain", "irregular", F.round(live_rate("hits", "n"), 6).alias("rate"))


@add(
    "recommend_cell",
    f"WITH {_POOL}, o AS (SELECT *, row_number() OVER (ORDER BY chain, irregular, cell) AS k FROM p WHERE chain IS NOT NULL) SELECT cell, chain, irregular, rate FROM o WHERE k = 1 + (SELECT coalesce(max(k), 0) FROM o WHERE rate >= 0.3)",
)
def recommend_cell(spark, sf):
    return report.first_failing_cell(_pooled(spark, sf).filter("chain is not null"), ["chain", "irregular", "cell"], "rate", 0.3).select("cell", "chain", "irregular", "rate")


@add(
    "ceiling_prefix",
    f"""WITH {_CELLS_SQL}, m AS (SELECT model, chain, sum(hits)::DOUBLE / sum(n) AS rate FROM r WHERE chain IS NOT NULL GROUP BY 1, 2 HAVING sum(n) > 0),
    s AS (SELECT DISTINCT model, k FROM m, range(1, 9) t(k)), j AS (SELECT s.model, s.k, coalesce(m.rate >= 0.12, false) AS ok FROM s LEFT JOIN m ON m.model = s.model AND m.chain = s.k),
    q AS (SELECT *, bool_and(ok) OVER (PARTITION BY model ORDER BY k) AS run FROM j)
    SELECT q.model, max(CASE WHEN run THEN k END)::INT AS reliable, (SELECT min(chain) FROM m WHERE m.model = q.model AND rate < 0.5)::INT AS breaks FROM q GROUP BY q.model""",
)
def ceiling_prefix(spark, sf):
    m = _cells(spark, sf).filter("chain is not null").groupBy("model", "chain").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n")).filter("n > 0").withColumn("rate", live_rate("hits", "n"))
    return report.reliable_up_to(m, ["model"], "chain", "rate", 0.12, 8)


@add("worst_cell", f"WITH {_POOL} SELECT cell, rate FROM p ORDER BY rate, cell LIMIT 1")
def worst_cell(spark, sf):
    return _pooled(spark, sf).agg(F.min(F.struct("rate", "cell")).alias("w")).select("w.cell", "w.rate")


@add("rank_candidates", "SELECT gen_id, chain FROM eval_detail WHERE passed ORDER BY (force_op IS NOT NULL) DESC, chain DESC NULLS LAST, gen_id LIMIT 18")
def rank_candidates(spark, sf):
    return table(spark, sf, "eval_detail").filter("passed").orderBy(F.col("force_op").isNotNull().desc(), F.col("chain").desc_nulls_last(), "gen_id").limit(18).select("gen_id", "chain")


@add("ordered_cells", r"SELECT cell, row_number() OVER (ORDER BY NOT regexp_full_match(cell, 'c\d+_(rnd|irr)'), chain, irregular, cell)::INT AS place FROM (SELECT cell, min(chain) AS chain, bool_or(irregular) AS irregular FROM eval_detail WHERE cell IS NOT NULL GROUP BY cell)")
def ordered_cells(spark, sf):
    """The landscape by (chain, shape), then the cells of one operation. The cells are few by design."""
    c = table(spark, sf, "eval_detail").filter("cell is not null").groupBy("cell").agg(F.min("chain").alias("chain"), F.bool_or("irregular").alias("irregular"))
    return c.select("cell", F.row_number().over(Window.orderBy(~F.col("cell").rlike(r"^c\d+_(rnd|irr)$"), "chain", "irregular", "cell")).alias("place"))


@add("route_order", f"WITH {ILLUS_SQL} SELECT illus_id, route, row_number() OVER (ORDER BY route IS DISTINCT FROM 'specialist', illus_id) - 1 AS place FROM illus WHERE sp = 'eval'")
def route_order(spark, sf):
    """Those of the specialist first, then by id, numbered without one task for all."""
    d = illus(spark, sf).filter("sp = 'eval'").select("illus_id", "route", (~F.col("route").eqNullSafe("specialist")).alias("other"))
    return ordinals(d, ["other", "illus_id"], "place").select("illus_id", "route", "place")


@add("latency_stats", f"WITH {GEN_SQL} SELECT model, count(latency_s)::BIGINT AS n, round(avg(latency_s), 3) AS mean, round(median(latency_s), 3) AS median FROM gen JOIN runs USING (run_id) WHERE ok AND error IS NULL AND latency_s IS NOT NULL GROUP BY model")
def latency_stats(spark, sf):
    g = gens(spark, sf).filter("ok and error is null and latency_s is not null").select("run_id", "latency_s").join(table(spark, sf, "runs").select("run_id", "model"), "run_id")
    return g.groupBy("model").agg(F.count("*").alias("n"), F.round(F.avg("latency_s"), 3).alias("mean"), F.round(F.median("latency_s"), 3).alias("median"))


@add("reason_topk", f"WITH {ILLUS_SQL} SELECT coalesce(specialist.reason, 'missing') AS reason, count(*)::BIGINT AS n FROM illus GROUP BY 1 ORDER BY n DESC, reason LIMIT 8")
def reason_topk(spark, sf):
    return report.top_counts(illus(spark, sf), F.coalesce("specialist.reason", F.lit("missing")), 8, "reason")


@add(
    "funnel",
    f"""WITH {ILLUS_SQL}, f AS (SELECT count(*)::BIGINT AS a, count(*) FILTER (frontier IS NOT NULL)::BIGINT AS b, count(*) FILTER (frontier.compiles)::BIGINT AS c, count(*) FILTER (frontier.ok AND frontier.compiles)::BIGINT AS k FROM illus)
    SELECT unnest(['gathered', 'teacher', 'compiled', 'kept']) AS stage, unnest([a, b, c, k]) AS n, unnest([round(100.0 * a / a, 2), round(100.0 * b / a, 2), round(100.0 * c / a, 2), round(100.0 * k / a, 2)]::DOUBLE[]) AS pct FROM f""",
)
def funnel(spark, sf):
    """Yields of the stages, counted in one pass, each in percent of the first."""
    n = illus(spark, sf).agg(
        F.count("*").alias("gathered"), F.count("frontier").alias("teacher"), F.count_if("frontier.compiles").alias("compiled"), F.count_if(F.col("frontier.ok") & F.col("frontier.compiles")).alias("kept")
    )
    stages = ("gathered", "teacher", "compiled", "kept")
    return n.select("gathered", F.explode(F.create_map(*[x for s in stages for x in (F.lit(s), F.col(s))])).alias("stage", "n")).select("stage", "n", F.round(100.0 * F.col("n") / F.nullif("gathered", F.lit(0)), 2).alias("pct"))


@add("roundtrip_yield", f"WITH {ILLUS_SQL} SELECT tag, count(*)::BIGINT AS sampled, count(*) FILTER (specialist.ok AND specialist.compiles)::BIGINT AS kept, grouping(tag)::INT AS total FROM illus GROUP BY ROLLUP (tag)")
def roundtrip_yield(spark, sf):
    kept = F.count_if(F.col("specialist.ok") & F.col("specialist.compiles"))
    return illus(spark, sf).rollup("tag").agg(F.count("*").alias("sampled"), kept.alias("kept"), F.grouping("tag").cast("int").alias("total"))


@add("by_decade", "SELECT coalesce(CAST(year(o_orderdate) // 10 * 10 AS VARCHAR), 'unknown') AS decade, count(*) FILTER (o_orderstatus = 'F')::BIGINT AS F, count(*) FILTER (o_orderstatus = 'O')::BIGINT AS O, count(*) FILTER (o_orderstatus = 'P')::BIGINT AS P FROM orders GROUP BY 1")
def by_decade(spark, sf):
    decade = F.coalesce((F.floor(F.year("o_orderdate") / 10) * 10).cast("string"), F.lit("unknown"))
    return table(spark, sf, "orders").groupBy(decade.alias("decade")).pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)


@add("majority_mode", f"WITH {CHAT_SQL} SELECT model, CASE WHEN count(*) FILTER (params.token_param = 'max_tokens') >= count(*) FILTER (params.token_param <> 'max_tokens') THEN 'max_tokens' ELSE 'other' END AS mode FROM chat GROUP BY model")
def majority_mode(spark, sf):
    p = F.col("params.token_param")
    return chats(spark, sf).groupBy("model").agg(F.when(F.count_if(p == "max_tokens") >= F.count_if(p != "max_tokens"), "max_tokens").otherwise("other").alias("mode"))


_SRC = r"regexp_replace(lower(trim(source)), '[-\s]+', '_', 'g')"


@add("match_by_source", f"WITH {PROB_SQL} SELECT {_SRC} AS source, count(*)::BIGINT AS n, round(count(scalar_value)::DOUBLE / count(*), 3) AS rate FROM prob GROUP BY 1")
def match_by_source(spark, sf):
    source = F.regexp_replace(F.lower(F.trim("source")), r"[-\s]+", "_")
    return probs(spark, sf).groupBy(source.alias("source")).agg(F.count("*").alias("n"), F.round(F.count("scalar_value") / F.count("*"), 3).alias("rate"))


@add(
    "tag_variant_pivot",
    f"WITH {ILLUS_SQL} SELECT tag, " + ", ".join(f"concat(count(*) FILTER (sp = '{s}' AND specialist.ok), '/', count(*) FILTER (sp = '{s}')) AS {s}" for s in ("eval", "golden", "paraphrase_eval")) + " FROM illus WHERE tag IS NOT NULL GROUP BY tag",
)
def tag_variant_pivot(spark, sf):
    """Passed of total, per construction and variant."""
    cell = lambda s: F.concat(F.count_if((F.col("sp") == s) & F.col("specialist.ok")).cast("string"), F.lit("/"), F.count_if(F.col("sp") == s).cast("string")).alias(s)
    return illus(spark, sf).filter("tag is not null").groupBy("tag").agg(*[cell(s) for s in ("eval", "golden", "paraphrase_eval")])


@add("tag_doc_vs_total", f"WITH {PROB_SQL}, p AS (SELECT problem_id, unnest(list_concat(given, derived)) AS name FROM prob) SELECT name[1] AS letter, count(DISTINCT problem_id)::BIGINT AS docs, count(*)::BIGINT AS total FROM p GROUP BY 1")
def tag_doc_vs_total(spark, sf):
    """Records that have a mark, and all its occurrences."""
    names = F.transform(F.concat("given", "derived"), lambda n: F.substring(n, 1, 1))
    return probs(spark, sf).select(F.explode(names).alias("letter"), "problem_id").groupBy("letter", "problem_id").agg(F.count("*").alias("n")).groupBy("letter").agg(F.count("*").alias("docs"), F.sum("n").alias("total"))


#: Vocabulary terms and the patterns that show them.
VOCAB = {
    "triangle": "triangle|dreieck", "circle": "circle|kreis|cercle", "parallel": "parallel", "tangent": "tangent", "bisector": "bisect|winkelhalbierende",
    "midpoint": "midpoint|halfway|halves", "rotation": "rotat|spin|turn", "reflection": "reflect|mirror|flip|image of",
}
_VOC = ", ".join(f"('{k}', '{v}')" for k, v in VOCAB.items())


@add("vocab_docfreq", f"WITH {PROB_SQL}, v(term, rx) AS (VALUES {_VOC}) SELECT term, count(*)::BIGINT AS docs FROM prob, v WHERE regexp_matches(lower(statement), rx) GROUP BY term")
def vocab_docfreq(spark, sf):
    """Documents per term: one pass with a column per term, no cross join."""
    n = probs(spark, sf).select(F.lower("statement").alias("s")).agg(*[F.count_if(F.col("s").rlike(rx)).alias(t) for t, rx in VOCAB.items()])
    return n.select(F.explode(F.create_map(*[x for t in VOCAB for x in (F.lit(t), F.col(t))])).alias("term", "docs")).filter("docs > 0")


@add("vocab_by_corpus", f"WITH {PROB_SQL}, v(term, rx) AS (VALUES {_VOC}) SELECT sp, term, round(100.0 * count(*) FILTER (regexp_matches(lower(statement), rx)) / count(*), 2)::DOUBLE AS pct FROM prob, v WHERE sp IS NOT NULL GROUP BY sp, term")
def vocab_by_corpus(spark, sf):
    n = probs(spark, sf).filter("sp is not null").select("sp", F.lower("statement").alias("s")).groupBy("sp").agg(*[F.round(100.0 * F.count_if(F.col("s").rlike(rx)) / F.count("*"), 2).alias(t) for t, rx in VOCAB.items()])
    return n.select("sp", F.explode(F.create_map(*[x for t in VOCAB for x in (F.lit(t), F.col(t))])).alias("term", "pct"))


@add("single_op", "WITH m AS (SELECT gen_id, list_filter([force_op, CASE WHEN easy_only THEN 'easy' END, CASE WHEN irregular THEN 'irregular' END], lambda x: x IS NOT NULL) AS ops FROM eval_detail) SELECT gen_id, ops[1] AS op FROM m WHERE len(ops) = 1")
def single_op(spark, sf):
    """The one marker of a row that has exactly one."""
    ops = F.array_compact(F.array("force_op", F.when(F.col("easy_only"), "easy"), F.when(F.col("irregular"), "irregular")))
    return table(spark, sf, "eval_detail").select("gen_id", ops.alias("ops")).filter(F.size("ops") == 1).select("gen_id", F.col("ops")[0].alias("op"))
