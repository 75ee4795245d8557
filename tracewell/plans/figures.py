"""Queries over figure text: extraction, parsing, grading."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.catalog import table
from tracewell.functions import figures as fg
from tracewell.functions import grading as gr
from tracewell.functions import text as tx
from tracewell.plans import CATALOG
from tracewell.plans.curation import GEN_SQL, PROB_SQL, gens, probs
from tracewell.plans.geometry import _F as _FOOT
from tracewell.plans.geometry import _K, KEY, TRI_SQL
from tracewell.plans.geometry import triangles as _triangles
from tracewell.session import spread

add = CATALOG.add


def triangles(spark, sf) -> DataFrame:
    """Dealt out to all cores, as parsing is costly."""
    return spread(_triangles(spark, sf))


_NUM = r"(-?\d+(?:\.\d+)?)"
_NAME = r"([A-Za-z]\w*)"


@add(
    "extract_block",
    rf"WITH {GEN_SQL} SELECT gen_id, CASE WHEN strpos(text, '\begin{{tikzpicture}}') > 0 AND strpos(text, '\end{{tikzpicture}}') >= strpos(text, '\begin{{tikzpicture}}') THEN md5(substr(text, strpos(text, '\begin{{tikzpicture}}'), strpos(text, '\end{{tikzpicture}}') - strpos(text, '\begin{{tikzpicture}}') + 17)) END AS block FROM gen",
)
def extract_block(spark, sf):
    return gens(spark, sf).select("gen_id", F.md5(tx.extract_block(F.col("text")).cast("binary")).alias("block"))


@add(
    "figure_only",
    rf"WITH {GEN_SQL}, b AS (SELECT gen_id, regexp_replace(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '^```(?:latex|tex)?\s*|\s*```$', '', 'g'), '^\s+|\s+$', '', 'g') AS t FROM gen) SELECT gen_id, starts_with(t, '\begin{{tikzpicture}}') AND ends_with(t, '\end{{tikzpicture}}') AS figure_only FROM b",
)
def figure_only(spark, sf):
    return gens(spark, sf).select("gen_id", tx.figure_only(F.col("text")).alias("figure_only"))


@add("parse_scalar", f"WITH {TRI_SQL} SELECT {_K}, round(2*(ax+3) - by_/4 + sqrt(16)*cos(radians(60)) + (cx+1)**2 - floor((bx+7) / 2), 6) AS value FROM tri")
def parse_scalar(spark, sf):
    text = F.concat(F.lit("{2*("), "ax", F.lit("+3) - "), "by_", F.lit("/4 + sqrt(16)*cos(60) + ("), "cx", F.lit("+1)**2 - ("), "bx", F.lit("+7)//2}"))
    return triangles(spark, sf).select(*KEY, F.round(fg.scalar_of(text), 6).alias("value"))


@add("parse_macros", f"WITH {TRI_SQL} SELECT {_K}, round((ax+1)*cos(radians(30*by_)), 6) + 0.0 AS x, round((ax+1)*sin(radians(30*by_)), 6) + 0.0 AS y FROM tri")
def parse_macros(spark, sf):
    text = F.concat(F.lit(r"\def\r{"), "ax", F.lit(r"+1}\newcommand{\turn}{30*"), "by_", F.lit(r"}\begin{tikzpicture}\coordinate (P) at (\turn:\r);\end{tikzpicture}"))
    d = triangles(spark, sf).select(*KEY, fg.points_of(text)["P"].alias("p"))
    return d.select(*KEY, *[(F.round(f"p.{c}", 6) + 0.0).alias(c) for c in "xy"])


def _figure() -> F.Column:
    xy = lambda a, b: F.concat(F.lit("("), a, F.lit(","), b, F.lit(")"))
    return F.concat(
        F.lit("\\begin{tikzpicture}\n\\coordinate (M) at ($(A)!0.5!(B)$);\n\\coordinate (A) at "), xy("ax", "ay"), F.lit(";\n\\coordinate (B) at "), xy("bx", "by_"), F.lit(";\n\\coordinate (C) at "), xy("cx", "cy"),
        F.lit(";\n\\coordinate (H) at ($(B)!(A)!(C)$);\n\\coordinate (V) at ($(A)+(B)-(C)$);\n\\coordinate (R) at (A |- B);\n\\draw (A) -- (B) -- (C) -- cycle;\n\\node at (M) {$N$};\n\\end{tikzpicture}"),
    )


_PARSED = {"m": ("(ax+bx)/2", "(ay+by_)/2"), "h": (f"bx + {_FOOT}*(cx-bx)", f"by_ + {_FOOT}*(cy-by_)"), "v": ("ax+bx-cx", "ay+by_-cy"), "r": ("ax", "by_"), "n": ("(ax+bx)/2", "(ay+by_)/2")}


@add("parse_points", f"WITH {TRI_SQL} SELECT {_K}, " + ", ".join(f"round({v}, 6) + 0.0 AS {k}_{c}" for k, xy in _PARSED.items() for c, v in zip("xy", xy)) + " FROM tri")
def parse_points(spark, sf):
    """Calculated, projected, summed, relative and labelled points of a figure, whatever their order."""
    d = triangles(spark, sf).select(*KEY, fg.points_of(_figure()).alias("p"))
    return d.select(*KEY, *[(F.round(F.col("p")[k.upper()][c], 6) + 0.0).alias(f"{k}_{c}") for k in _PARSED for c in "xy"])


@add(
    "grade_full",
    f"WITH {TRI_SQL}, e AS (SELECT *, greatest(abs((ax+bx)/2 - floor((ax+bx)/2)), abs((ay+by_)/2 - floor((ay+by_)/2))) AS em FROM tri) SELECT {_K}, true AS figure_only, CASE WHEN em <= 0.05 THEN 1.0 ELSE 0.75 END::DOUBLE AS accuracy, (em <= 0.05) AS passed FROM e",
)
def grade_full(spark, sf):
    """The gate on a figure: figure only, and every named point within the tolerance of its truth."""
    half = lambda a, b: F.floor((F.col(a) + F.col(b)) / 2).cast("double")
    truth = F.create_map(F.lit("A"), F.array("ax", "ay"), F.lit("B"), F.array("bx", "by_"), F.lit("C"), F.array("cx", "cy"), F.lit("M"), F.array(half("ax", "bx"), half("ay", "by_")))
    g = gr.grade(_figure(), truth)
    d = triangles(spark, sf).select(*KEY, g.alias("g"))
    return d.select(*KEY, "g.figure_only", F.col("g.coord_accuracy").alias("accuracy"), "g.passed")


@add(
    "grade_unordered",
    f"WITH {TRI_SQL} SELECT {_K}, (CASE WHEN l_linenumber % 2 = 0 THEN 3 ELSE 2 END)::INT AS matched, 3::INT AS total, (l_linenumber % 2 = 0) AS passed FROM tri",
)
def grade_unordered(spark, sf):
    """A group of three interchangeable points under other names, one of them displaced in every other row."""
    off = F.col("cx") + 0.06 * (F.col("l_linenumber") % 2)
    truth = F.create_map(F.lit("A"), F.array("bx", "by_"), F.lit("B"), F.array(off, F.col("cy")), F.lit("C"), F.array("ax", "ay"))
    d = triangles(spark, sf).select(*KEY, gr.grade(_figure(), truth, unordered=F.array(F.array(*map(F.lit, "ABC")))).alias("g"))
    return d.select(*KEY, "g.matched", "g.total", "g.passed")


_LIT_SQL = rf"""l AS (SELECT problem_id, unnest(regexp_extract_all(tikz, '\\tkzDefPoint\(\s*{_NUM}\s*,\s*{_NUM}\s*\)\{{{_NAME}\}}', 3)) AS name, unnest(regexp_extract_all(tikz, '\\tkzDefPoint\(\s*{_NUM}\s*,\s*{_NUM}\s*\)\{{{_NAME}\}}', 1))::DOUBLE AS x, unnest(regexp_extract_all(tikz, '\\tkzDefPoint\(\s*{_NUM}\s*,\s*{_NUM}\s*\)\{{{_NAME}\}}', 2))::DOUBLE AS y FROM prob
  UNION ALL SELECT problem_id, unnest(regexp_extract_all(tikz, '\\coordinate\s*\(\s*{_NAME}\s*\)\s*at\s*\(\s*{_NUM}\s*,\s*{_NUM}\s*\)', 1)), unnest(regexp_extract_all(tikz, '\\coordinate\s*\(\s*{_NAME}\s*\)\s*at\s*\(\s*{_NUM}\s*,\s*{_NUM}\s*\)', 2))::DOUBLE, unnest(regexp_extract_all(tikz, '\\coordinate\s*\(\s*{_NAME}\s*\)\s*at\s*\(\s*{_NUM}\s*,\s*{_NUM}\s*\)', 3))::DOUBLE FROM prob)"""


def _literals(spark, sf) -> DataFrame:
    d = probs(spark, sf).select("problem_id", F.explode(fg.literal_points(F.col("tikz"))).alias("l"))
    return d.select("problem_id", "l.name", F.col("l.x").cast("double").alias("x"), F.col("l.y").cast("double").alias("y"))


@add("literal_coords", f"WITH {PROB_SQL}, {_LIT_SQL} SELECT problem_id, name, x, y FROM l")
def literal_coords(spark, sf):
    return _literals(spark, sf)


_GT_SQL = "t AS (SELECT problem_id, unnest(map_keys(points)) AS name, unnest(map_values(points)) AS v, grade_atol FROM prob)"
_PP_SQL = "pp AS (SELECT problem_id, name, max(x) AS x, max(y) AS y FROM l GROUP BY 1, 2)"


def _graded(spark, sf) -> DataFrame:
    """Every true point with its error (null where the figure lacks it) and whether it is within the tolerance."""
    truth = probs(spark, sf).select("problem_id", (F.coalesce("grade_atol", F.lit(0.05)) * 100).alias("tol"), F.explode("points").alias("name", "v"))
    said = _literals(spark, sf).groupBy("problem_id", "name").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    e = truth.join(said, ["problem_id", "name"], "left").withColumn("err", F.greatest(F.abs(F.col("x") - F.col("v")[0]), F.abs(F.col("y") - F.col("v")[1])))
    e = e.withColumn("err", F.when(F.col("x").isNotNull(), F.col("err")))
    return e.withColumn("ok", F.coalesce(F.col("err") <= F.col("tol"), F.lit(False)))


_GRADED_SQL = f"{PROB_SQL}, {_LIT_SQL}, {_GT_SQL}, {_PP_SQL}, e AS (SELECT t.problem_id, t.name, CASE WHEN pp.x IS NOT NULL THEN greatest(abs(pp.x - v[1]), abs(pp.y - v[2])) END AS err, coalesce(grade_atol, 0.05) * 100 AS tol FROM t LEFT JOIN pp USING (problem_id, name)), o AS (SELECT *, coalesce(err <= tol, false) AS ok FROM e)"


@add("coord_match", f"WITH {_GRADED_SQL} SELECT problem_id, count(*) FILTER (ok)::BIGINT AS matched, count(*)::BIGINT AS total, round(count(*) FILTER (ok)::DOUBLE / count(*), 6) AS accuracy, bool_and(ok) AS all_correct FROM o GROUP BY problem_id")
def coord_match(spark, sf):
    """Chebyshev errors within the tolerance, which counts as within; a missing point fails."""
    return _graded(spark, sf).groupBy("problem_id").agg(
        F.count_if("ok").alias("matched"), F.count("*").alias("total"), F.round(F.count_if("ok") / F.count("*"), 6).alias("accuracy"), F.bool_and("ok").alias("all_correct")
    )


@add("worst_point", f"WITH {_GRADED_SQL} SELECT problem_id, name FROM (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY (err IS NULL) DESC, err DESC, name) AS rn FROM o) WHERE rn = 1")
def worst_point(spark, sf):
    """The first missing point, else the one farthest off."""
    w = F.min(F.struct((-F.col("err").isNull().cast("int")).alias("m"), (-F.coalesce("err", F.lit(0.0))).alias("e"), "name"))
    return _graded(spark, sf).groupBy("problem_id").agg(w.alias("w")).select("problem_id", "w.name")


@add("grade_only", f"WITH {PROB_SQL}, {_GT_SQL} SELECT problem_id, name FROM t JOIN prob USING (problem_id) WHERE list_contains(given, name)")
def grade_only(spark, sf):
    """The truth restricted to listed names."""
    keep = F.map_filter("points", lambda k, v: F.array_contains("given", k))
    return probs(spark, sf).select("problem_id", F.explode(F.map_keys(keep)).alias("name"))


_SW = {k: f"(greatest(abs({a}x-{b}x), abs({a}y{'_' if a == 'b' else ''}-{b}y{'_' if b == 'b' else ''})) <= 3)::INT" for k, (a, b) in {"ab": ("a", "b"), "bc": ("b", "c"), "ac": ("a", "c"), "bb": ("b", "b")}.items()}


@add("unordered_match", f"WITH {TRI_SQL} SELECT {_K}, greatest({_SW['ab']} + {_SW['bc']}, {_SW['ac']} + 1)::INT AS hits, ({_SW['ab']} + {_SW['bc']} >= {_SW['ac']} + 1) AS straight FROM tri")
def unordered_match(spark, sf):
    """Two interchangeable points (A, B) against truths (B, C): the better assignment, the first of equals."""
    at = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    found = F.create_map(F.lit("S"), at("ax", "ay"), F.lit("T"), at("bx", "by_"))
    truth = F.create_map(F.lit("S"), F.array("bx", "by_"), F.lit("T"), F.array("cx", "cy"))
    g = gr.grade_points(found, truth, F.array(F.array(F.lit("S"), F.lit("T"))), F.lit(3.0))
    return triangles(spark, sf).select(*KEY, g.alias("g")).select(*KEY, F.col("g.matched").alias("hits"), (F.element_at("g.of", "S") == "S").alias("straight"))


@add("ref_normalize", f"WITH {TRI_SQL} SELECT {_K}, round((cx-ax)/nullif(bx-ax, 0), 6) + 0.0 AS x, round((cy-ay)/nullif(cy-ay, 0), 6) + 0.0 AS y FROM tri WHERE abs(bx-ax) >= 1e-6 AND abs(cy-ay) >= 1e-6")
def ref_normalize(spark, sf):
    """Canvas points in units of a reference frame, read off a typesetter's log; frames without extent are dropped."""
    say = lambda *c: F.concat_ws(" ", *[x if isinstance(x, str) is False else F.lit(x) if not x.islower() else F.format_string("%.1fpt", F.col(x)) for x in c])
    log = F.concat_ws("\n", F.lit("some noise"), say("REF", "ax", "ay", "bx", "by_", "bx", "cy"), F.lit("U undef"), say("P", "cx", "cy"))
    frame, points = gr.canvas_log(log)
    d = triangles(spark, sf).select(*KEY, frame.alias("frame"), points.alias("points"))
    d = d.select(*KEY, gr.frame_units(F.element_at("points", "P"), F.col("frame")).alias("p"), F.map_contains_key("points", "U").alias("u")).filter("u and p is not null")
    return d.select(*KEY, *[(F.round(f"p.{c}", 6) + 0.0).alias(c) for c in "xy"])


@add("coord_free_rate", rf"WITH {PROB_SQL} SELECT count(*)::BIGINT AS n, count(*) FILTER (regexp_matches(tikz, '\\tkz|\$\([^)]*\)\s*!|!\s*\(|name intersections|\|-|-\||\(\s*-?\d+(\.\d+)?\s*:'))::BIGINT AS built FROM prob WHERE tikz IS NOT NULL")
def coord_free_rate(spark, sf):
    built = F.col("tikz").rlike(r"\\tkz|\$\([^)]*\)\s*!|!\s*\(|name intersections|\|-|-\||\(\s*-?\d+(\.\d+)?\s*:")
    return probs(spark, sf).filter("tikz is not null").agg(F.count("*").alias("n"), F.count_if(built).alias("built"))


_MARK = r"(?mi)^[ \t]*\\(?:(?:filldraw|fill)\b[^\n]*\bcircle\b[^\n]*|tkzDrawPoints\b[^\n]*)\n?"


@add(
    "paint_points_last",
    rf"""WITH {PROB_SQL}, r AS (SELECT problem_id, tikz, array_to_string(regexp_extract_all(tikz, '{_MARK}'), '') AS marks, regexp_replace(tikz, '{_MARK}', '', 'g') AS rest FROM prob WHERE tikz IS NOT NULL)
    SELECT problem_id, md5(CASE WHEN marks = '' OR strpos(rest, '\end{{tikzpicture}}') = 0 THEN tikz ELSE concat(substr(rest, 1, strpos(rest, '\end{{tikzpicture}}') - 1), marks, substr(rest, strpos(rest, '\end{{tikzpicture}}'))) END) AS text FROM r""",
)
def paint_points_last(spark, sf):
    return probs(spark, sf).filter("tikz is not null").select("problem_id", F.md5(fg.paint_points_last(F.col("tikz")).cast("binary")).alias("text"))


@add(
    "compass_bin",
    f"WITH {TRI_SQL} SELECT {_K}, CASE WHEN bx <> ax OR by_ <> ay THEN ['right','above right','above','above left','left','below left','below','below right'][((round(degrees(atan2(by_-ay, bx-ax)) / 45)::INT + 8) % 8) + 1] END AS slot FROM tri",
)
def compass_bin(spark, sf):
    return triangles(spark, sf).select(*KEY, fg.compass(F.col("bx") - F.col("ax"), F.col("by_") - F.col("ay")).alias("slot"))


@add("overlay_rewrite", rf"WITH {PROB_SQL} SELECT problem_id, md5(replace(concat('\path[name path=u] (0,0) -- (1,1);', tikz), '\path[name path=', '\path[overlay,name path=')) AS text FROM prob WHERE tikz IS NOT NULL")
def overlay_rewrite(spark, sf):
    figure = F.concat(F.lit("\\path[name path=u] (0,0) -- (1,1);"), "tikz")
    return probs(spark, sf).filter("tikz is not null").select("problem_id", F.md5(fg.overlaid(figure).cast("binary")).alias("text"))


@add(
    "point_names",
    rf"""WITH {PROB_SQL}, n AS (SELECT problem_id, unnest(list_concat(regexp_extract_all(tikz, '\\tkzDefPoint\([^)]*\)\{{{_NAME}\}}', 1), regexp_extract_all(tikz, '\\tkzGetPoint\{{{_NAME}\}}', 1), regexp_extract_all(tikz, '\\coordinate\s*\(\s*{_NAME}\s*\)', 1), regexp_extract_all(tikz, '\\node(?:\[[^\]]*\])?\s*\(\s*{_NAME}\s*\)', 1))) AS name FROM prob WHERE tikz IS NOT NULL)
    SELECT DISTINCT problem_id, name FROM n""",
)
def point_names(spark, sf):
    return probs(spark, sf).filter("tikz is not null").select("problem_id", F.explode(fg.point_names(F.col("tikz"))).alias("name"))


_CALC = rf"\\coordinate\s*\(\s*{_NAME}\s*\)\s*at\s*\(\s*\$\s*\(\s*{_NAME}\s*\)\s*!\s*([^!]+?)\s*!\s*\(\s*{_NAME}\s*\)\s*\$\s*\)"


@add(
    "constraint_types",
    rf"""WITH {PROB_SQL}, c AS (SELECT problem_id, unnest(regexp_extract_all(tikz, '{_CALC}', 1)) AS name, unnest(regexp_extract_all(tikz, '{_CALC}', 2)) AS a, unnest(regexp_extract_all(tikz, '{_CALC}', 3)) AS mid, unnest(regexp_extract_all(tikz, '{_CALC}', 4)) AS b, unnest(range(len(regexp_extract_all(tikz, '{_CALC}', 1)))) AS k FROM prob WHERE tikz IS NOT NULL),
    f AS (SELECT *, row_number() OVER (PARTITION BY problem_id, name ORDER BY k) AS rn FROM c)
    SELECT problem_id, name, CASE WHEN mid IN ('0.5', '1/2') THEN 'midpoint' WHEN regexp_full_match(mid, '-?[\d.]+') THEN 'partway' ELSE 'foot' END AS type, CASE WHEN regexp_full_match(mid, '-?[\d.]+|1/2') THEN concat(a, ',', b) ELSE concat(mid, ',', a, ',', b) END AS parents FROM f WHERE rn = 1""",
)
def constraint_types(spark, sf):
    d = probs(spark, sf).filter("tikz is not null").select("problem_id", F.explode(fg.constraints_of("tikz")).alias("name", "c"))
    return d.select("problem_id", "name", "c.type", F.array_join("c.parents", ",").alias("parents"))


@add(
    "figure_circles",
    rf"""WITH {PROB_SQL} SELECT problem_id, count(*)::BIGINT AS circles, round(sum(r), 6) AS radii FROM (SELECT problem_id, unnest(regexp_extract_all(tikz, '\\draw(?:\[[^\]]*\])?\s*\({_NAME}\)\s*circle\s*\(\s*([\d.]+)\s*\)', 2))::DOUBLE AS r FROM prob) GROUP BY problem_id""",
)
def figure_circles(spark, sf):
    d = probs(spark, sf).select("problem_id", F.explode(fg.circles_of("tikz")).alias("c")).filter("c.center is not null and c.r is not null")
    return d.groupBy("problem_id").agg(F.count("*").alias("circles"), F.round(F.sum("c.r"), 6).alias("radii"))


_DASH, _SEG = rf"\\draw(?:\[[^\]]*\])?\s*\({_NAME}\) -- \({_NAME}\);", rf"\\tkzDrawSegment\({_NAME},{_NAME}\)"


@add(
    "figure_edges",
    rf"""WITH {PROB_SQL}, s AS (SELECT problem_id, unnest(list_concat(regexp_extract_all(tikz, '{_DASH}', 1), regexp_extract_all(tikz, '{_SEG}', 1))) AS a, unnest(list_concat(regexp_extract_all(tikz, '{_DASH}', 2), regexp_extract_all(tikz, '{_SEG}', 2))) AS b FROM prob WHERE tikz IS NOT NULL)
    SELECT DISTINCT problem_id, concat(least(a, b), '-', greatest(a, b)) AS edge FROM s WHERE a <> b""",
)
def figure_edges(spark, sf):
    return probs(spark, sf).filter("tikz is not null").select("problem_id", F.explode(fg.edges_of("tikz")).alias("edge"))


@add(
    "ssim_mse",
    """WITH p AS (SELECT a.vec_id, unnest(a.embedding)::DOUBLE AS x, unnest(b.embedding)::DOUBLE AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
    m AS (SELECT vec_id, avg(x) AS ma, avg(y) AS mb, avg(x*x) - avg(x)*avg(x) AS va, avg(y*y) - avg(y)*avg(y) AS vb, avg(x*y) - avg(x)*avg(y) AS c, avg((x-y)*(x-y)) AS mse FROM p GROUP BY vec_id)
    SELECT vec_id, round(mse, 6) AS mse, round((2*ma*mb + 1e-4::DOUBLE) * (2*c + 9e-4::DOUBLE) / ((ma*ma + mb*mb + 1e-4::DOUBLE) * (va + vb + 9e-4::DOUBLE)), 6) AS ssim FROM m""",
)
def ssim_mse(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    mse, ssim = fg.image_scores(F.col("a"), F.col("b"))
    return e.join(b, "vec_id").select("vec_id", F.round(mse, 6).alias("mse"), F.round(ssim, 6).alias("ssim"))
