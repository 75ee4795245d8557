"""Queries of text classification, reply parsing and shaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.catalog import table
from tracewell.functions import classify as cl
from tracewell.functions import text as tx
from tracewell.plans import CATALOG
from tracewell.plans.curation import CHAT_SQL, GEN_SQL, ILLUS_SQL, PROB_SQL, chats, gens, illus, probs

add = CATALOG.add
_TRIM = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
_IN = lambda x, words: f"regexp_matches({x}, '\\b(?:{words})\\b')"



@add("transient_class", f"WITH {GEN_SQL} SELECT gen_id, len(list_filter([{', '.join(repr(x) for x in tx.TRANSIENT)}], lambda k: contains(lower(error), k))) > 0 AS transient FROM gen WHERE error IS NOT NULL")
def transient_class(spark, sf):
    return gens(spark, sf).filter("error is not null").select("gen_id", cl.transient(F.col("error")).alias("transient"))


@add("route_priority", f"WITH {ILLUS_SQL} SELECT illus_id, CASE WHEN specialist.ok THEN 'specialist' WHEN frontier.ok THEN 'frontier' ELSE 'none' END AS chosen FROM illus")
def route_priority(spark, sf):
    return illus(spark, sf).select("illus_id", F.when(F.col("specialist.ok"), "specialist").when(F.col("frontier.ok"), "frontier").otherwise("none").alias("chosen"))


_SHAPE = _IN("low", cl.SHAPES)
_INTENT_SQL = f"""CASE WHEN regexp_matches(m, '=\\s*\\(-?[0-9]') OR ({_IN('low', 'output|produce|construct|generate')} AND (contains(low, 'tikz') OR contains(low, 'figure') OR {_SHAPE}))
  OR regexp_matches(m, '\\b(?:{cl.CORNERED})\\s+[A-Z][A-Z]') OR regexp_matches(low, '\\bcircle\\b.{{0,40}}\\b(?:center|centre|centered|radius|diameter)\\b') OR regexp_matches(low, '\\bregular\\s+(?:pentagon|hexagon|heptagon|octagon|polygon|[a-z0-9_]+gon)\\b') THEN 'scene'
  WHEN regexp_matches(low, '^\\s*(?:{cl.EDIT_STARTS})\\b') OR ({_IN('low', cl.EDIT_VERBS)} AND {_IN('low', cl.EDIT_TARGETS)}) OR ({_IN('low', cl.EDIT_TARGETS)} AND NOT {_SHAPE}) THEN 'edit' ELSE 'scene' END"""


@add("intent", f"WITH {ILLUS_SQL}, s AS (SELECT illus_id, {_TRIM('description')} AS m, lower({_TRIM('description')}) AS low FROM illus WHERE description IS NOT NULL) SELECT illus_id, {_INTENT_SQL} AS intent FROM s")
def intent(spark, sf):
    return illus(spark, sf).filter("description is not null").select("illus_id", cl.intent(F.col("description")).alias("intent"))


_NAMES = lambda rx: f"regexp_extract_all(description, '{rx}', 1)"
_DERIVED = (
    f"len(list_filter(list_distinct(list_concat({_NAMES(r'\b([A-Z][0-9]?)\s+(?:be|the)\b')}, {_NAMES(r'\b[Ll][Ee][Tt]\s+([A-Z][0-9]?)\b')}, list_concat({_NAMES(r'\b([A-Z][0-9]?)\s*,\s*[A-Z]')}, "
    f"regexp_extract_all(regexp_replace(description, '\\b([A-Z][0-9]?)\\s*,\\s*([A-Z])', '\\2', 'g'), '\\b([A-Z][0-9]?)\\s*,\\s*[A-Z]', 1)))), lambda n: NOT list_contains({_NAMES(r'\b([A-Z][0-9]?)\s*(?:=|\bat\b)\s*\(')}, n)))"
)
_OPS = f"len(list_distinct(regexp_extract_all(lower(description), '\\b({cl.CONSTRUCTIONS})\\b', 1)))"


@add("derived_count", f"WITH {ILLUS_SQL} SELECT illus_id, (CASE WHEN {_DERIVED} > 0 THEN {_DERIVED} ELSE {_OPS} END)::INT AS derived FROM illus WHERE description IS NOT NULL")
def derived_count(spark, sf):
    return illus(spark, sf).filter("description is not null").select("illus_id", cl.derived_count(F.col("description")).alias("derived"))


_MANY = "(" + _IN("low", cl.BIG_POLYGONS) + "".join(f" OR len(list_filter(regexp_extract_all(low, '{rx}', 1), lambda n: n::DOUBLE > {cl.MOST_CORNERS})) > 0" for rx in cl.CORNERS) + ")"


@add(
    "many_corners",
    f"WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, lower(CASE l_linenumber % 4 WHEN 0 THEN concat('Draw a regular ', l_partkey % 12, '-gon.') WHEN 1 THEN concat('A ', l_partkey % 12, ' sided figure') WHEN 2 THEN concat('A regular polygon that has ', l_partkey % 12, ' sides.') ELSE 'Draw an Octagon' END) AS low FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_MANY} AS many FROM s",
)
def many_corners(spark, sf):
    n, k = (F.col("l_partkey") % 12).cast("string"), F.col("l_linenumber") % 4
    said = F.when(k == 0, F.concat(F.lit("Draw a regular "), n, F.lit("-gon."))).when(k == 1, F.concat(F.lit("A "), n, F.lit(" sided figure"))).when(k == 2, F.concat(F.lit("A regular polygon that has "), n, F.lit(" sides."))).otherwise("Draw an Octagon")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cl.many_corners(F.lower(said)).alias("many"))


@add(
    "route_vocab",
    f"""WITH {ILLUS_SQL}, s AS (SELECT *, lower(description) AS low FROM illus WHERE description IS NOT NULL) SELECT illus_id, CASE WHEN {_IN('low', cl.OUT_OF_VOCABULARY)} THEN 'out of vocabulary'
    WHEN regexp_matches(low, '\\btransformations?\\b') AND NOT {_IN('low', cl.KNOWN_TRANSFORMS)} THEN 'generic transform' WHEN {_MANY} THEN 'big polygon'
    WHEN (CASE WHEN {_DERIVED} > 0 THEN {_DERIVED} ELSE {_OPS} END) > 5 THEN 'many points' ELSE 'specialist' END AS route FROM s""",
)
def route_vocab(spark, sf):
    return illus(spark, sf).filter("description is not null").select("illus_id", cl.route(F.col("description")).alias("route"))


_PHRASES = " OR ".join(f"contains(lower(d), '{x}')" for x in cl.TEMPLATE_PHRASES)


@add(
    "looks_templated",
    f"WITH {ILLUS_SQL}, s AS (SELECT illus_id, concat(description, CASE WHEN illus_id % 2 = 0 THEN ' A=(1,2). Define them at their correct positions.' ELSE '' END) AS d FROM illus WHERE description IS NOT NULL) SELECT illus_id, regexp_matches(d, '{cl.PLACE}') AND ({_PHRASES}) AS templated FROM s",
)
def looks_templated(spark, sf):
    """Every other description is given a template's ending, so that both answers occur."""
    d = F.concat("description", F.when(F.col("illus_id") % 2 == 0, " A=(1,2). Define them at their correct positions.").otherwise(""))
    return illus(spark, sf).filter("description is not null").select("illus_id", cl.looks_templated(d).alias("templated"))


@add(
    "clarify_parse",
    rf"""WITH {GEN_SQL}, s AS (SELECT gen_id, {_TRIM('text')} AS t FROM gen), c AS (SELECT gen_id, strpos(upper(t), 'CLARIFY:') AS pos, t FROM s WHERE NOT (strpos(t, '\begin{{tikzpicture}}') > 0 AND strpos(t, '\end{{tikzpicture}}') >= strpos(t, '\begin{{tikzpicture}}')))
    SELECT gen_id, coalesce(nullif({_TRIM(f"split_part({_TRIM('regexp_replace(' + _TRIM('substr(t, pos + 8)') + r""", '^"+|"+$', '', 'g')""")}, chr(10), 1)")}, ''), 'please say more') AS question FROM c WHERE pos > 0""",
)
def clarify_parse(spark, sf):
    return gens(spark, sf).select("gen_id", cl.clarification(F.col("text")).alias("question")).filter("question is not null")


@add(
    "verdict_parse",
    rf"""WITH {CHAT_SQL}, b AS (SELECT call_id, text, regexp_extract(text, '(?s)\{{.*\}}') AS body FROM chat WHERE text IS NOT NULL), r AS (SELECT *, body <> '' AND json_valid(body) AND coalesce(json_extract_string(CASE WHEN json_valid(body) THEN body END, '$.approved'), '') IN ('true', 'false') AS read FROM b)
    SELECT call_id, CASE WHEN read THEN json_extract_string(CASE WHEN json_valid(body) THEN body END, '$.approved') = 'true' WHEN starts_with(lower({_TRIM('text')}), 'yes') THEN true WHEN starts_with(lower({_TRIM('text')}), 'no') THEN false END AS approved,
    substr(CASE WHEN read THEN coalesce(json_extract_string(CASE WHEN json_valid(body) THEN body END, '$.reason'), '') ELSE text END, 1, 220) AS reason FROM r""",
)
def verdict_parse(spark, sf):
    approved, reason = cl.verdict(F.col("text"))
    return chats(spark, sf).filter("text is not null").select("call_id", approved.alias("approved"), reason.alias("reason"))


_LIST_SQL = rf"""b AS (SELECT call_id, regexp_extract(regexp_replace(regexp_replace({_TRIM('text')}, '^```[a-zA-Z]*\n?', ''), '\n?```$', ''), '(?s)\[.*\]') AS body FROM chat WHERE starts_with(text, '[')),
i AS (SELECT call_id, unnest(CASE WHEN body <> '' AND json_valid(body) THEN from_json(body, '["VARCHAR"]') ELSE [] END) AS item FROM b)"""


@add("json_list_parse", f"WITH {CHAT_SQL}, {_LIST_SQL} SELECT call_id, item FROM i WHERE trim(item) <> ''")
def json_list_parse(spark, sf):
    d = chats(spark, sf).filter(F.startswith("text", F.lit("[")))
    return d.select("call_id", F.explode(cl.json_strings(F.col("text"))).alias("item"))


#: A controlled vocabulary, in order.
TERMS = ("circumcenter", "incenter", "orthocenter", "centroid", "bisector", "foot", "median", "tangent", "midpoint", "square", "rotation", "reflection", "polygon", "intersection", "antipode")
_TERMS = "[" + ", ".join(f"'{t}'" for t in TERMS) + "]"


@add(
    "vocab_canon",
    f"""WITH {CHAT_SQL}, {_LIST_SQL}, k AS (SELECT call_id, lower({_TRIM('item')}) AS key FROM i WHERE trim(item) <> ''),
    c AS (SELECT call_id, CASE WHEN list_contains({_TERMS}, key) THEN key ELSE list_filter({_TERMS}, lambda t: contains(key, t) OR contains(t, key))[1] END AS term FROM k)
    SELECT DISTINCT call_id, term FROM c WHERE term IS NOT NULL""",
)
def vocab_canon(spark, sf):
    d = chats(spark, sf).filter(F.startswith("text", F.lit("[")))
    return d.select("call_id", F.explode(cl.canonical(cl.json_strings(F.col("text")), TERMS)).alias("term"))


_SYSTEM = "Draw the scene as one figure."


@add("chat_format", f"WITH {ILLUS_SQL} SELECT illus_id, unnest(['system', 'user', 'assistant']) AS role, unnest(['{_SYSTEM}', concat('Scene:', chr(10), description), tikz]) AS content FROM illus WHERE description IS NOT NULL AND tikz IS NOT NULL")
def chat_format(spark, sf):
    d = illus(spark, sf).filter("description is not null and tikz is not null")
    return d.select("illus_id", F.inline(cl.chat(_SYSTEM, F.concat(F.lit("Scene:\n"), "description"), F.col("tikz")))).select("illus_id", "role", "content")


@add("chat_unshape", f"WITH {ILLUS_SQL} SELECT illus_id, description, tikz FROM illus WHERE description IS NOT NULL AND tikz IS NOT NULL")
def chat_unshape(spark, sf):
    """Shaping undone: the first content of each role, the template cut off."""
    d = illus(spark, sf).filter("description is not null and tikz is not null")
    m = d.select("illus_id", cl.chat(_SYSTEM, F.concat(F.lit("Scene:\n"), "description"), F.col("tikz")).alias("m"))
    return m.select("illus_id", F.regexp_replace(cl.first_content(F.col("m"), "user"), "^Scene:\n", "").alias("description"), cl.first_content(F.col("m"), "assistant").alias("tikz"))


#: The frame of a request, and the endings that mark a template.
SCENE_PREFIX, SCENE_SUFFIX = "Scene:\n", "\n\nReturn the TikZ figure."
SYNTHETIC_MARKS = ("at their correct positions.", "at its correct position.", "at their exact locations.", "at their true coordinates.")


@add(
    "chat_synthetic",
    f"""WITH {PROB_SQL} SELECT problem_id, concat(statement, ' Define them at their correct positions.') AS inner_text, array_to_string(given, ',') AS names FROM (SELECT problem_id, statement, list_sort(given) AS given FROM prob WHERE problem_id % 2 = 0 AND statement IS NOT NULL AND given IS NOT NULL)""",
)
def chat_synthetic(spark, sf):
    """Examples made from a template are told from others; their request and the names in their labels."""
    d = probs(spark, sf).filter("statement is not null and given is not null")
    said = F.when(F.col("problem_id") % 2 == 0, F.concat("statement", F.lit(" Define them at their correct positions."))).otherwise(F.concat("statement", F.lit(" Sketch it.")))
    answer = F.concat(F.lit("\\tkzLabelPoints[above]("), F.array_join(F.sort_array("given"), ", "), F.lit(")"))
    m = d.select("problem_id", cl.chat(_SYSTEM, F.concat(F.lit(SCENE_PREFIX), said, F.lit(SCENE_SUFFIX)), answer).alias("m"))
    s = m.select("problem_id", cl.synthetic(F.col("m"), SCENE_PREFIX, SCENE_SUFFIX, SYNTHETIC_MARKS).alias("s")).filter("s is not null")
    return s.select("problem_id", F.col("s.inner").alias("inner_text"), F.array_join(F.sort_array("s.names"), ",").alias("names"))


@add("safe_name", "SELECT DISTINCT source, replace(replace(source, '/', '__'), ':', '_') AS safe, split_part(source, '-', -1) AS short FROM documents WHERE source IS NOT NULL")
def safe_name(spark, sf):
    d = table(spark, sf, "documents").filter("source is not null").select("source").distinct()
    return d.select("source", tx.replaced(F.col("source"), [("/", "__"), (":", "_")]).alias("safe"), F.element_at(F.split("source", "-"), -1).alias("short"))


@add("title_by_priority", f"WITH {PROB_SQL} SELECT problem_id, CASE WHEN list_contains(derived, 'E') THEN 'Foot' WHEN list_contains(derived, 'D') THEN 'Intersection' WHEN list_contains(derived, 'C') THEN 'Midpoint' ELSE 'Construction' END AS label FROM prob")
def title_by_priority(spark, sf):
    has = lambda n: F.array_contains("derived", n)
    return probs(spark, sf).select("problem_id", F.when(has("E"), "Foot").when(has("D"), "Intersection").when(has("C"), "Midpoint").otherwise("Construction").alias("label"))


@add("statement_cut", f"WITH {PROB_SQL} SELECT problem_id, split_part(statement, ' Find ', 1) AS scene FROM prob WHERE statement IS NOT NULL")
def statement_cut(spark, sf):
    return probs(spark, sf).filter("statement is not null").select("problem_id", F.substring_index("statement", " Find ", 1).alias("scene"))


@add("escape_text", f"WITH {PROB_SQL} SELECT problem_id, replace(replace(replace(replace(replace(question, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '_', '\\_'), '%', '\\%') AS text FROM prob WHERE question IS NOT NULL")
def escape_text(spark, sf):
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("_", "\\_"), ("%", "\\%")]
    return probs(spark, sf).filter("question is not null").select("problem_id", tx.replaced(F.col("question"), pairs).alias("text"))


_NUMS = lambda x: rf"regexp_extract_all(replace({x}, '−', '-'), '(-?[0-9]+(?:\.[0-9]+)?)', 1)"


@add(
    "paraphrase_valid",
    f"""WITH {PROB_SQL}, p AS (SELECT problem_id, title AS o, concat(statement, ' Draw it.') AS w, given FROM prob WHERE statement IS NOT NULL AND title IS NOT NULL)
    SELECT problem_id, length({_TRIM('w')}) >= 20 AND len(list_filter({_NUMS('o')}, lambda x: len(list_filter({_NUMS('w')}, lambda y: y = x)) < len(list_filter({_NUMS('o')}, lambda y: y = x)))) = 0
    AND len(list_filter(given, lambda n: NOT CASE WHEN length(n) = 1 THEN contains(concat(' ', regexp_replace(w, '[^A-Za-z0-9]', ' ', 'g'), ' '), concat(' ', n, ' ')) ELSE contains(w, n) END)) = 0 AS valid FROM p""",
)
def paraphrase_valid(spark, sf):
    d = probs(spark, sf).filter("statement is not null and title is not null")
    return d.select("problem_id", cl.paraphrase_ok(F.col("title"), F.concat("statement", F.lit(" Draw it.")), F.col("given")).alias("valid"))
