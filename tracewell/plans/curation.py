"""Queries of scans, joins, set operations, deduplication, sampling and caching."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.catalog import table
from tracewell.functions import text as tx
from tracewell.operators import curate as cu
from tracewell.plans import CATALOG
from tracewell.sources import files

add = CATALOG.add
SPLIT_SQL = r"lower(regexp_replace(split, '^\s+|\s+$', '', 'g'))"
ILLUS_SQL = f"illus AS (SELECT * FROM (SELECT *, {SPLIT_SQL} AS sp, row_number() OVER (PARTITION BY illus_id ORDER BY loaded_at DESC) AS rn FROM illustrations) WHERE rn = 1)"
GEN_SQL = "gen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gen_id ORDER BY loaded_at DESC) AS rn FROM gen_results) WHERE rn = 1)"
CHAT_SQL = "chat AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY loaded_at DESC) AS rn FROM chat_results) WHERE rn = 1)"
PROB_SQL = f"prob AS (SELECT * FROM (SELECT *, {SPLIT_SQL} AS sp, row_number() OVER (PARTITION BY problem_id ORDER BY loaded_at DESC) AS rn FROM problems) WHERE rn = 1)"


def once(spark, sf, name: str, key: str) -> DataFrame:
    """A table whose rows may be delivered twice, its last delivery kept."""
    d = cu.latest(table(spark, sf, name), [key], [F.col("loaded_at").desc()])
    return d.withColumn("sp", F.lower(F.regexp_replace("split", r"^\s+|\s+$", ""))) if "split" in d.columns else d


def illus(spark, sf):
    return once(spark, sf, "illustrations", "illus_id")


def gens(spark, sf):
    return once(spark, sf, "gen_results", "gen_id")


def chats(spark, sf):
    return once(spark, sf, "chat_results", "call_id")


def probs(spark, sf):
    return once(spark, sf, "problems", "problem_id")


@add("scan_limit", "SELECT DISTINCT problem_id, num FROM problems ORDER BY problem_id LIMIT 100")
def scan_limit(spark, sf):
    return table(spark, sf, "problems").select("problem_id", "num").distinct().orderBy("problem_id").limit(100)


@add("scan_torn_jsonl", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 7 <> 0")
def scan_torn_jsonl(spark, sf):
    """Lines of JSON of which every seventh is torn: torn lines are skipped."""
    lines = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, F.substring("props", 1, 4)).otherwise(F.col("props")).alias("line"))
    return lines.select("event_id", F.from_json("line", "k bigint, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("j")).filter("j.k is not null and j._corrupt_record is null").select("event_id", "j.k")


@add("scan_defaults", "SELECT gen_id, coalesce(force_op, 'none') AS force_op, coalesce(easy_only, false) AS easy_only, coalesce(chain, 0) AS chain, 7 AS added FROM eval_detail")
def scan_defaults(spark, sf):
    d = table(spark, sf, "eval_detail").select("gen_id", "force_op", "easy_only", "chain")
    return files.with_defaults(d, {"force_op": "none", "easy_only": False, "chain": 0, "added": 7})


@add("lww_by_key", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def lww_by_key(spark, sf):
    return cu.latest(table(spark, sf, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


@add("reassign_ids", f"WITH {ILLUS_SQL} SELECT row_number() OVER (ORDER BY illus_id) - 1 AS id, illus_id, description FROM illus WHERE description IS NOT NULL")
def reassign_ids(spark, sf):
    d = illus(spark, sf).filter("description is not null").select("illus_id", "description")
    return cu.ordinals(d, ["illus_id"])


@add(
    "results_merge",
    f"""WITH {GEN_SQL}, m AS (SELECT g.gen_id, r.model, coalesce(e.passed, g.ok) AS passed, (e.gen_id IS NOT NULL) AS rescored FROM gen g JOIN runs r USING (run_id) LEFT JOIN eval_detail e USING (gen_id))
    SELECT model, count(*)::BIGINT AS n, count(*) FILTER (rescored)::BIGINT AS rescored, count(*) FILTER (passed)::BIGINT AS passed FROM m GROUP BY model""",
)
def results_merge(spark, sf):
    """Prior results are kept, those scored anew replace them."""
    prior = gens(spark, sf).join(table(spark, sf, "runs").select("run_id", "model"), "run_id").select("gen_id", "model", F.col("ok").alias("passed"), F.lit(False).alias("rescored"))
    scored = table(spark, sf, "eval_detail").select("gen_id", "passed")
    anew = prior.select("gen_id", "model", F.col("passed").alias("before")).join(scored, "gen_id").select("gen_id", "model", F.coalesce("passed", "before").alias("passed"), F.lit(True).alias("rescored"))
    return files.merged_results(prior, anew, ["gen_id"]).groupBy("model").agg(F.count("*").alias("n"), F.count_if("rescored").alias("rescored"), F.count_if("passed").alias("passed"))


@add("scaled_quotas", "SELECT cell, count(*)::BIGINT AS n, round_even(count(*) * 0.5, 0)::BIGINT AS half, round_even(count(*) * 1.25, 0)::BIGINT AS more FROM eval_detail WHERE cell IS NOT NULL GROUP BY cell")
def scaled_quotas(spark, sf):
    d = table(spark, sf, "eval_detail").filter("cell is not null").groupBy("cell").agg(F.count("*").alias("n"))
    return d.select("cell", "n", cu.scaled(F.col("n"), 0.5).alias("half"), cu.scaled(F.col("n"), 1.25).alias("more"))


@add(
    "grid_specs",
    """SELECT concat('c', c, '_', CASE WHEN i THEN 'irr' ELSE 'rnd' END) AS cell, c AS chain, i AS irregular, NULL::VARCHAR AS force_op FROM (VALUES (1),(2),(3),(4),(5),(6)) a(c), (VALUES (true),(false)) b(i)
    UNION ALL SELECT * FROM (VALUES ('easy_c3',3,false,NULL),('easy_c4',4,false,NULL),('easy_c5',5,false,NULL),('int_c3',3,false,'intersection'),('int_c4',4,false,'intersection'),('foot_c4_irr',4,true,'foot_altitude'),('foot_c5_irr',5,true,'foot_altitude'),('foot_c4_rnd',4,false,'foot_altitude'))""",
)
def grid_specs(spark, sf):
    """Every chain length with either shape, and eight cells of one operation."""
    chains = spark.range(1, 7).select(F.col("id").cast("int").alias("chain"))
    land = chains.withColumn("irregular", F.explode(F.array(F.lit(True), F.lit(False))))
    land = land.select(F.concat(F.lit("c"), "chain", F.when(F.col("irregular"), "_irr").otherwise("_rnd")).alias("cell"), "chain", "irregular", F.lit(None).cast("string").alias("force_op"))
    #: The cells of one operation.
    ops = [("easy_c3", 3, False, None), ("easy_c4", 4, False, None), ("easy_c5", 5, False, None), ("int_c3", 3, False, "intersection"), ("int_c4", 4, False, "intersection"), ("foot_c4_irr", 4, True, "foot_altitude"), ("foot_c5_irr", 5, True, "foot_altitude"), ("foot_c4_rnd", 4, False, "foot_altitude")]
    return land.unionByName(spark.createDataFrame(ops, "cell string, chain int, irregular boolean, force_op string"))


@add("spec_match", f"WITH {PROB_SQL} SELECT problem_id FROM prob WHERE len(given) + len(derived) = 5 AND (list_contains(derived, 'E') OR scalar_label IS NULL)")
def spec_match(spark, sf):
    d = probs(spark, sf)
    return d.filter((F.size("given") + F.size("derived") == 5) & (F.array_contains("derived", "E") | F.col("scalar_label").isNull())).select("problem_id")


_KW = ", ".join(f"'{k}'" for k in sorted(set(tx.GEOMETRY_WORDS)))


@add("keyword_filter", f"WITH {PROB_SQL} SELECT problem_id FROM prob WHERE len(list_filter([{_KW}], lambda k: contains(lower(statement), k))) > 0")
def keyword_filter(spark, sf):
    return probs(spark, sf).filter(tx.has_any(F.col("statement"), tx.GEOMETRY_WORDS)).select("problem_id")


@add(
    "regex_filter",
    f"WITH {PROB_SQL} SELECT problem_id, regexp_matches(statement, '(?i){tx.GEOMETRY_HINT}') AS hinted, regexp_matches(statement, '(?i){tx.GEOMETRY_STEMS}') AS stemmed FROM prob WHERE statement IS NOT NULL",
)
def regex_filter(spark, sf):
    """Two filters of different reach."""
    s = F.col("statement")
    return probs(spark, sf).filter("statement is not null").select("problem_id", s.rlike("(?i)" + tx.GEOMETRY_HINT).alias("hinted"), s.rlike("(?i)" + tx.GEOMETRY_STEMS).alias("stemmed"))


@add(
    "strip_blocks_minlen",
    rf"""WITH {GEN_SQL}, s AS (SELECT gen_id, trim(regexp_replace(text, '(?is)\\begin\{{tikzpicture\}}.*?\\end\{{tikzpicture\}}', ' ', 'g'), E' \n\t\r') AS prose FROM gen WHERE text IS NOT NULL)
    SELECT gen_id, length(prose)::INT AS n FROM s WHERE length(prose) >= 20""",
)
def strip_blocks_minlen(spark, sf):
    """Blocks are cut out of the text; what is left must be of some length."""
    s = gens(spark, sf).select("gen_id", tx.strip_blocks(F.col("text"), r"\\begin\{tikzpicture\}", r"\\end\{tikzpicture\}").alias("prose"))
    return s.filter(F.length("prose") >= 20).select("gen_id", F.length("prose").alias("n"))


@add(
    "degenerate_reason",
    "SELECT event_id, CASE WHEN value > 90 THEN 'oversized' WHEN value / 100 < 0.05 THEN 'blank' WHEN value / 100 > 0.5 THEN 'blob' ELSE 'ok' END AS reason FROM events",
)
def degenerate_reason(spark, sf):
    d = table(spark, sf, "events")
    return d.select("event_id", tx.degenerate(F.col("value") / 100, F.col("value") / 100, F.col("value"), least_ink=0.05, most_dark=0.5, most_page=90).alias("reason"))


@add(
    "win_lose_pairs",
    f"""WITH {GEN_SQL}, d AS (SELECT g.illus_id, r.model, e.passed, e.chain, g.gen_id FROM eval_detail e JOIN gen g USING (gen_id) JOIN runs r USING (run_id))
    SELECT a.gen_id AS win, b.gen_id AS lose FROM d a JOIN d b USING (illus_id) WHERE a.model = 'specialist' AND b.model <> 'specialist' AND a.passed AND NOT b.passed AND a.chain IN (3, 4, 5)""",
)
def win_lose_pairs(spark, sf):
    d = table(spark, sf, "eval_detail").join(gens(spark, sf).select("gen_id", "illus_id", "run_id"), "gen_id").join(table(spark, sf, "runs").select("run_id", "model"), "run_id")
    win = d.filter("model = 'specialist' and passed and chain in (3, 4, 5)").select("illus_id", F.col("gen_id").alias("win"))
    lose = d.filter("model <> 'specialist' and not passed").select("illus_id", F.col("gen_id").alias("lose"))
    return win.join(lose, "illus_id").select("win", "lose")


@add(
    "decontam_anti",
    f"WITH {ILLUS_SQL} SELECT illus_id FROM illus t WHERE sp = 'train' AND description IS NOT NULL AND NOT EXISTS (SELECT 1 FROM illus h WHERE h.sp IS NOT NULL AND h.sp <> 'train' AND h.description = t.description)",
)
def decontam_anti(spark, sf):
    d = illus(spark, sf)
    held = d.filter("sp <> 'train' and description is not null").select("description").distinct()
    return d.filter("sp = 'train' and description is not null").join(held, "description", "left_anti").select("illus_id")


@add("holdout_anti", f"WITH {GEN_SQL}, {ILLUS_SQL} SELECT gen_id FROM gen WHERE illus_id IS NOT NULL AND illus_id NOT IN (SELECT illus_id FROM illus WHERE sp = 'eval')")
def holdout_anti(spark, sf):
    held = illus(spark, sf).filter("sp = 'eval'").select("illus_id")
    return gens(spark, sf).filter("illus_id is not null").join(held, "illus_id", "left_anti").select("gen_id")


@add("cache_todo", f"WITH {ILLUS_SQL}, {CHAT_SQL} SELECT illus_id, substr(md5(description), 1, 12) AS h FROM illus WHERE description IS NOT NULL AND substr(md5(description), 1, 12) NOT IN (SELECT h FROM chat WHERE h IS NOT NULL AND ok)")
def cache_todo(spark, sf):
    done = chats(spark, sf).filter("ok and h is not null").select("h").distinct()
    d = illus(spark, sf).filter("description is not null").select("illus_id", cu.content_key(F.col("description")).alias("h"))
    return d.join(done, "h", "left_anti").select("illus_id", "h")


@add("cache_valid_hits", f"WITH {ILLUS_SQL}, {CHAT_SQL} SELECT call_id, c.illus_id FROM chat c JOIN illus i USING (illus_id) WHERE c.ok AND c.h = substr(md5(i.description), 1, 12)")
def cache_valid_hits(spark, sf):
    """A cached answer counts only while its key is still that of the record."""
    d = illus(spark, sf).select("illus_id", cu.content_key(F.col("description")).alias("h"))
    return chats(spark, sf).filter("ok").join(d, ["illus_id", "h"]).select("call_id", "illus_id")


@add("detail_left_grid", f"WITH {GEN_SQL} SELECT g.gen_id, coalesce(e.chain, len(g.source))::INT AS chain, e.cell FROM gen g LEFT JOIN eval_detail e USING (gen_id)")
def detail_left_grid(spark, sf):
    e = table(spark, sf, "eval_detail").select("gen_id", "chain", "cell")
    return gens(spark, sf).select("gen_id", "source").join(e, "gen_id", "left").select("gen_id", F.coalesce("chain", F.length("source")).alias("chain"), "cell")


@add("ordinal_join", "SELECT a.c_custkey, b.s_suppkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS o FROM customer) a JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS o FROM supplier) b USING (o)")
def ordinal_join(spark, sf):
    """Two lists aligned by explicit ordinals, never by partition order."""
    a = cu.ordinals(table(spark, sf, "customer").select("c_custkey"), ["c_custkey"], "o")
    b = cu.ordinals(table(spark, sf, "supplier").select("s_suppkey"), ["s_suppkey"], "o")
    return a.join(b, "o").select("c_custkey", "s_suppkey")


_SEP = "sqrt((a.v[1]-b.v[1])*(a.v[1]-b.v[1])+(a.v[2]-b.v[2])*(a.v[2]-b.v[2]))"


@add(
    "min_pair_sep",
    f"""WITH {PROB_SQL}, p AS (SELECT problem_id, unnest(map_keys(points)) AS k, unnest(map_values(points)) AS v FROM prob)
    SELECT a.problem_id, round(min({_SEP}), 6) AS sep FROM p a JOIN p b ON a.problem_id = b.problem_id AND a.k < b.k GROUP BY 1""",
)
def min_pair_sep(spark, sf):
    """The least distance of two points of a record, by higher-order functions within the row."""
    return probs(spark, sf).select("problem_id", F.round(tx.min_separation(F.map_values("points")), 6).alias("sep")).filter("sep is not null")


@add(
    "best_of_k",
    f"""WITH {PROB_SQL}, p AS (SELECT problem_id, topic, unnest(map_keys(points)) AS k, unnest(map_values(points)) AS v FROM prob WHERE topic IS NOT NULL),
    s AS (SELECT a.problem_id, a.topic, least(min({_SEP}), 50) AS sep FROM p a JOIN p b ON a.problem_id = b.problem_id AND a.k < b.k GROUP BY 1, 2),
    n AS (SELECT problem_id, count(*) AS n FROM p GROUP BY 1)
    SELECT topic, problem_id, round(sep, 6) AS sep FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, round(sep, 9) DESC, problem_id) AS rn FROM s JOIN n USING (problem_id)) WHERE rn = 1""",
)
def best_of_k(spark, sf):
    """The candidate of each topic with most points, then the widest spacing; the first wins ties."""
    d = probs(spark, sf).filter("topic is not null").select("topic", "problem_id", F.size("points").alias("n"), F.least(tx.min_separation(F.map_values("points")), F.lit(50.0)).alias("sep")).filter("sep is not null")
    best = d.groupBy("topic").agg(F.max(F.struct("n", F.round("sep", 9).alias("r"), (-F.col("problem_id")).alias("o"), "problem_id", "sep")).alias("b"))
    return best.select("topic", "b.problem_id", F.round("b.sep", 6).alias("sep"))


@add("cyclic_assign", f"WITH {PROB_SQL} SELECT problem_id, ['affine','metric','affine','mixed','affine','metric','mixed','affine'][((num - 1) % 8) + 1] AS recipe, (num % 2 = 0) AS even FROM prob WHERE num >= 1")
def cyclic_assign(spark, sf):
    recipe = F.array(*map(F.lit, ("affine", "metric", "affine", "mixed", "affine", "metric", "mixed", "affine")))
    return probs(spark, sf).filter("num >= 1").select("problem_id", F.element_at(recipe, (F.pmod(F.col("num") - 1, F.lit(8)) + 1).cast("int")).alias("recipe"), (F.col("num") % 2 == 0).alias("even"))


@add("union_mix", f"WITH {ILLUS_SQL}, {PROB_SQL} SELECT illus_id AS id, description AS text FROM illus WHERE sp = 'golden' UNION ALL SELECT problem_id + 1000000, statement FROM prob WHERE sp = 'golden'")
def union_mix(spark, sf):
    a = illus(spark, sf).filter("sp = 'golden'").select(F.col("illus_id").alias("id"), F.col("description").alias("text"))
    b = probs(spark, sf).filter("sp = 'golden'").select((F.col("problem_id") + 1000000).alias("id"), F.col("statement").alias("text"))
    return a.unionByName(b)


@add("split_overlap", f"WITH {ILLUS_SQL} SELECT count(*)::BIGINT AS shared FROM (SELECT description FROM illus WHERE sp = 'train' AND description IS NOT NULL INTERSECT SELECT description FROM illus WHERE sp <> 'train' AND description IS NOT NULL)")
def split_overlap(spark, sf):
    d = illus(spark, sf).filter("description is not null")
    return d.filter("sp = 'train'").select("description").intersect(d.filter("sp <> 'train'").select("description")).agg(F.count("*").alias("shared"))


@add(
    "coverage_sets",
    f"""WITH {ILLUS_SQL}, s AS (SELECT illus_id FROM illus WHERE specialist.ok), f AS (SELECT illus_id FROM illus WHERE frontier.ok)
    SELECT 'both' AS part, count(*)::BIGINT AS n FROM (SELECT * FROM s INTERSECT SELECT * FROM f) UNION ALL SELECT 'frontier_only', count(*) FROM (SELECT * FROM f EXCEPT SELECT * FROM s)
    UNION ALL SELECT 'union', count(*) FROM (SELECT * FROM s UNION SELECT * FROM f)""",
)
def coverage_sets(spark, sf):
    """Sets of covered ids: their intersection, difference and union, counted in one pass."""
    d = illus(spark, sf)
    s, f = F.coalesce("specialist.ok", F.lit(False)), F.coalesce("frontier.ok", F.lit(False))
    n = d.agg(F.count_if(s & f).alias("both"), F.count_if(f & ~s).alias("frontier_only"), F.count_if(s | f).alias("union"))
    return n.select(F.explode(F.create_map(*[x for k in ("both", "frontier_only", "union") for x in (F.lit(k), F.col(f"`{k}`"))])).alias("part", "n"))


@add("dedup_hash_first", "SELECT doc_id, substr(md5(text), 1, 12) AS h FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY source NULLS FIRST, doc_id) AS rn FROM documents WHERE text IS NOT NULL) WHERE rn = 1")
def dedup_hash_first(spark, sf):
    """Exact duplicates by content: the first by (source, id) stays. Hot texts are pre-aggregated, not sorted."""
    d = table(spark, sf, "documents").filter("text is not null").select(F.md5(F.col("text").cast("binary")).alias("h"), F.struct(F.coalesce("source", F.lit("")).alias("s"), "doc_id").alias("o"))
    return d.groupBy("h").agg(F.min("o").alias("o")).select("o.doc_id", F.substring("h", 1, 12).alias("h"))


@add("dedup_scope", "SELECT 'whole' AS scope, count(DISTINCT text)::BIGINT AS n FROM documents UNION ALL SELECT 'kind', count(*) FROM (SELECT DISTINCT kind, text FROM documents WHERE text IS NOT NULL)")
def dedup_scope(spark, sf):
    d = table(spark, sf, "documents").filter("text is not null").select("kind", F.md5(F.col("text").cast("binary")).alias("h"))
    whole = d.select("h").distinct().agg(F.count("*").alias("n")).select(F.lit("whole").alias("scope"), "n")
    return whole.unionByName(d.distinct().agg(F.count("*").alias("n")).select(F.lit("kind").alias("scope"), "n"))


_QUOTA = "q(source, quota) AS (VALUES ('board', 40), ('generator', 25), ('olympiad', 100000), ('paraphrase', 10))"


def _quotas(spark):
    return spark.createDataFrame([("board", 40), ("generator", 25), ("olympiad", 100000), ("paraphrase", 10)], "source string, quota int")


@add("quota_sample", f"WITH {ILLUS_SQL}, {_QUOTA} SELECT source, illus_id FROM (SELECT i.source, illus_id, quota, row_number() OVER (PARTITION BY i.source ORDER BY md5(concat('7|', illus_id::VARCHAR))) AS k FROM illus i JOIN q USING (source)) WHERE k <= quota")
def quota_sample(spark, sf):
    d = illus(spark, sf).select("source", "illus_id").join(F.broadcast(_quotas(spark)), "source").withColumn("o", cu.seeded(7, "illus_id"))
    return cu.first_k(d, ["source"], [F.col("o")], F.col("quota")).select("source", "illus_id")


@add("quota_shortfall", f"WITH {ILLUS_SQL}, {_QUOTA} SELECT q.source, q.quota, count(i.illus_id)::BIGINT AS n, greatest(q.quota - count(i.illus_id), 0)::BIGINT AS short FROM q LEFT JOIN illus i USING (source) GROUP BY 1, 2")
def quota_shortfall(spark, sf):
    n = illus(spark, sf).groupBy("source").agg(F.count("*").alias("n"))
    return _quotas(spark).join(n, "source", "left").select("source", "quota", F.coalesce("n", F.lit(0)).alias("n"), F.greatest(F.col("quota") - F.coalesce("n", F.lit(0)), F.lit(0)).cast("bigint").alias("short"))


@add("first_k_verified", f"WITH {GEN_SQL} SELECT cell, gen_id FROM (SELECT cell, gen_id, row_number() OVER (PARTITION BY cell ORDER BY gen_id) AS k FROM eval_detail JOIN gen USING (gen_id) WHERE passed AND compiles) WHERE k <= 5")
def first_k_verified(spark, sf):
    d = table(spark, sf, "eval_detail").filter("passed and compiles").join(gens(spark, sf).select("gen_id"), "gen_id")
    return cu.first_k(d, ["cell"], [F.col("gen_id")], 5).select("cell", "gen_id")


@add("seeded_sample", f"WITH {ILLUS_SQL} SELECT illus_id FROM (SELECT illus_id FROM illus ORDER BY md5(concat('20|', illus_id::VARCHAR)) LIMIT 150) ORDER BY illus_id")
def seeded_sample(spark, sf):
    return illus(spark, sf).select("illus_id").orderBy(cu.seeded(20, "illus_id")).limit(150).orderBy("illus_id")


@add("seeded_shuffle", f"WITH {PROB_SQL} SELECT problem_id, row_number() OVER (ORDER BY md5(concat('3|', problem_id::VARCHAR))) - 1 AS place FROM prob")
def seeded_shuffle(spark, sf):
    return cu.ordinals(probs(spark, sf).select("problem_id", cu.seeded(3, "problem_id").alias("o")), ["o"], "place").select("problem_id", "place")


@add("round_robin_pick", "SELECT chain, gen_id FROM (SELECT chain, gen_id, row_number() OVER (PARTITION BY chain ORDER BY gen_id) AS k FROM eval_detail WHERE chain IS NOT NULL) ORDER BY k, chain LIMIT 12")
def round_robin_pick(spark, sf):
    """The first of each chain, then the second of each, and so on."""
    d = table(spark, sf, "eval_detail").filter("chain is not null").select("chain", "gen_id")
    rank = F.row_number().over(Window.partitionBy("chain").orderBy("gen_id"))
    return d.withColumn("k", rank).filter("k <= 12").orderBy("k", "chain").limit(12).select("chain", "gen_id")


@add("upsample_repeat", f"WITH {ILLUS_SQL} SELECT illus_id, unnest(range(1, CASE WHEN tag IS NULL THEN 2 ELSE 4 END))::INT AS copy FROM illus WHERE sp = 'golden'")
def upsample_repeat(spark, sf):
    d = illus(spark, sf).filter("sp = 'golden'").select("illus_id", F.when(F.col("tag").isNull(), 0).otherwise(3).alias("n"))
    return cu.repeated(d, F.col("n")).select("illus_id", "copy")


@add("content_key", f"WITH {ILLUS_SQL} SELECT illus_id, substr(md5(description), 1, 12) AS h, substr(md5(description), 1, 16) AS long_h FROM illus WHERE description IS NOT NULL")
def content_key(spark, sf):
    return illus(spark, sf).filter("description is not null").select("illus_id", cu.content_key(F.col("description")).alias("h"), cu.content_key(F.col("description"), 16).alias("long_h"))


@add("example_store", f"WITH {ILLUS_SQL}, {PROB_SQL} SELECT DISTINCT trim(description) AS text FROM illus WHERE sp = 'eval' AND trim(description) <> '' AND trim(description) NOT IN (SELECT statement FROM prob WHERE statement IS NOT NULL)")
def example_store(spark, sf):
    """Saved examples as a set: blank, built-in and repeated ones are refused."""
    own = illus(spark, sf).filter("sp = 'eval'").select(F.trim("description").alias("text")).filter("text <> ''").distinct()
    return own.join(probs(spark, sf).filter("statement is not null").select(F.col("statement").alias("text")).distinct(), "text", "left_anti")
