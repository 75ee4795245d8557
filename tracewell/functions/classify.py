"""Small rule classifiers and reply parsers as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions.text import TRANSIENT, blank_trim, extract_block, has_any

#: The words of the request rules.
EDIT_STARTS = (
    "make|add|remove|delete|move|shift|change|rename|relabel|recolou?r|colou?r|scale|resize|enlarge|shrink|rotate|flip|fix|adjust|increase|decrease|highlight|"
    "erase|swap|replace|update|tweak|thicken|bold|redraw"
)
EDIT_VERBS = EDIT_STARTS + "|put|set|turn|hide|show"
EDIT_TARGETS = (
    "it|its|them|the label|the labels|the point|the points|the line|the lines|the circle|the triangle|the square|the polygon|the figure|this figure|current|bigger|smaller|larger|thicker|thinner"
)
SHAPES = "triangle|quadrilateral|square|rectangle|parallelogram|rhombus|trapezoid|trapezium|pentagon|hexagon|heptagon|octagon|polygon|circle|ellipse|segment"
CORNERED = "triangle|quadrilateral|square|rectangle|parallelogram|rhombus|trapezoid|pentagon|hexagon|heptagon|octagon|polygon"
OUT_OF_VOCABULARY = (
    "cube|sphere|pyramid|tetrahedron|prism|cylinder|cone|dihedral|octahedron|3d|three[- ]dimensional|locus|loci|trajectory|envelope|region|ellipse|parabola|hyperbola|conic|"
    "spiral|fractal|tessellation|lattice|vector field|radical axis|inversion|shear|glide|homothet|dilation|dilate|graph of|plot of|plot|inequalit|function"
)
KNOWN_TRANSFORMS = r"reflect\w*|rotat\w*|translat\w*|point[- ]reflection"
BIG_POLYGONS = "heptagon|septagon|octagon|nonagon|enneagon|decagon|hendecagon|undecagon|dodecagon"
CONSTRUCTIONS = (
    "circumcenter|circumcircle|incenter|incircle|orthocenter|centroid|median|bisector|altitude|tangent|midpoint|midsegment|medial|orthic|nine[- ]?point|euler line|reflection|reflect|rotation|rotate|"
    "translation|translate|perpendicular|intersection|diagonal|antipode|diameter|contact|foot|angle"
)


def _word(words: str) -> str:
    return rf"\b(?:{words})\b"


def transient(error: Column) -> Column:
    """Whether an error message says that the call may be tried again."""
    return has_any(error, TRANSIENT)


def intent(message: Column) -> Column:
    """'scene' or 'edit'; what no rule decides is a scene."""
    # The patterns of the rules.
    m = blank_trim(F.coalesce(message, F.lit("")))
    low = F.lower(m)
    shape = low.rlike(_word(SHAPES))
    scene = (
        m.rlike(r"=\s*\(-?[0-9]")
        | (low.rlike(_word("output|produce|construct|generate")) & (F.contains(low, F.lit("tikz")) | F.contains(low, F.lit("figure")) | shape))
        | m.rlike(rf"\b(?:{CORNERED})\s+[A-Z][A-Z]")
        | low.rlike(r"\bcircle\b.{0,40}\b(?:center|centre|centered|radius|diameter)\b")
        | low.rlike(r"\bregular\s+(?:pentagon|hexagon|heptagon|octagon|polygon|[a-z0-9_]+gon)\b")
    )
    edit = low.rlike(rf"^\s*(?:{EDIT_STARTS})\b") | (low.rlike(_word(EDIT_VERBS)) & low.rlike(_word(EDIT_TARGETS))) | (low.rlike(_word(EDIT_TARGETS)) & ~shape)
    return F.when(scene, "scene").when(edit, "edit").otherwise("scene")


def derived_count(description: Column) -> Column:
    """Distinct names introduced by a construction, less those with coordinates; else the distinct constructions."""
    # The patterns by which names are introduced and placed.
    d = F.coalesce(description, F.lit(""))
    names = lambda rx: F.regexp_extract_all(d, F.lit(rx), F.lit(1))
    introduced = F.concat(names(r"\b([A-Z][0-9]?)\s+(?:be|the)\b"), names(r"\b[Ll][Ee][Tt]\s+([A-Z][0-9]?)\b"), names(r"\b([A-Z][0-9]?)\s*,\s*(?=[A-Z])"))
    derived = F.size(F.array_except(F.array_distinct(introduced), names(r"\b([A-Z][0-9]?)\s*(?:=|\bat\b)\s*\(")))
    ops = F.size(F.array_distinct(F.regexp_extract_all(F.lower(d), F.lit(rf"\b({CONSTRUCTIONS})\b"), F.lit(1))))
    return F.when(derived > 0, derived).otherwise(ops)


def route(description: Column, most_derived: int = 5) -> Column:
    """Who should draw: 'specialist', or the first reason against it."""
    low = F.lower(F.coalesce(description, F.lit("")))
    return (
        F.when(low.rlike(_word(OUT_OF_VOCABULARY)), "out of vocabulary")
        .when(low.rlike(r"\btransformations?\b") & ~low.rlike(_word(KNOWN_TRANSFORMS)), "generic transform")
        .when(many_corners(low), "big polygon")
        .when(derived_count(description) > most_derived, "many points")
        .otherwise("specialist")
    )


#: How a request counts the corners of a polygon, and the most that are within reach.
CORNERS = (r"(\d+)\s*[- ]?gon\b", r"(\d+)\s*[- ]?sided\b", r"regular\s+polygon[^.]*?\b(\d+)\s+sides")
MOST_CORNERS = 6
#: A place in numbers, and what templates say.
PLACE, TEMPLATE_PHRASES = r"=\s*\(-?\d", ("output a single tikz figure", "at their correct positions")


def many_corners(low: Column, most: int = MOST_CORNERS) -> Column:
    """Whether a text in lower case names a polygon of more corners, in words or in numbers."""
    counts = F.concat(*[F.regexp_extract_all(low, F.lit(rx), F.lit(1)) for rx in CORNERS])
    return low.rlike(_word(BIG_POLYGONS)) | F.exists(counts, lambda n: n.try_cast("double") > most)


def looks_templated(description: Column) -> Column:
    """Whether a request states places in numbers and asks in a template's words."""
    d = F.coalesce(description, F.lit(""))
    return d.rlike(PLACE) & has_any(d, TEMPLATE_PHRASES)


def synthetic(messages: Column, prefix: str, suffix: str, marks: tuple[str, ...]) -> Column:
    """struct(inner, names) of a training example made from a template, else null: the request between prefix and the
    last suffix, and the distinct names that the answer's labels show, in order."""
    user, answer = F.coalesce(first_content(messages, "user"), F.lit("")), F.coalesce(first_content(messages, "assistant"), F.lit(""))
    rest = F.substr(user, F.lit(len(prefix) + 1))
    parts = F.split(rest, F.lit("\\Q" + suffix + "\\E"), -1)
    inner = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), suffix)).otherwise(rest)
    shown = F.flatten(F.transform(F.regexp_extract_all(answer, F.lit(r"\\tkzLabelPoints(?:\[[^\]]*\])?\(([^()]*)\)"), F.lit(1)), lambda g: F.split(g, ",")))
    names = F.array_distinct(F.filter(F.transform(shown, lambda n: F.trim(n)), lambda n: n != ""))
    marked = F.exists(F.array(*map(F.lit, marks)), lambda m: F.contains(user, m))
    return F.when(F.startswith(user, F.lit(prefix)) & marked, F.struct(inner.alias("inner"), names.alias("names")))


def clarification(text: Column) -> Column:
    """The question after the first CLARIFY: up to the line's end; null where there is a figure or no such mark."""
    t = blank_trim(F.coalesce(text, F.lit("")))
    at = F.instr(F.upper(t), F.lit("CLARIFY:"))
    line = F.split(blank_trim(F.regexp_replace(blank_trim(F.substr(t, at + 8)), '^"+|"+$', "")), "\n")[0]
    return F.when(extract_block(t).isNull() & (at > 0), F.coalesce(F.nullif(blank_trim(line), F.lit("")), F.lit("please say more")))


def verdict(text: Column) -> tuple[Column, Column]:
    """(approved, reason): from the outermost JSON object; else from a reply that begins with yes or no; else null."""
    body = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    j = F.from_json(body, "approved boolean, reason string, bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"})
    read = j["bad"].isNull() & j["approved"].isNotNull() & (body != "")
    low = F.lower(blank_trim(text))
    approved = F.when(read, j["approved"]).when(F.startswith(low, F.lit("yes")), True).when(F.startswith(low, F.lit("no")), False)
    return approved, F.substring(F.when(read, F.coalesce(j["reason"], F.lit(""))).otherwise(text), 1, 220)


def json_strings(text: Column) -> Column:
    """The non-blank strings of the outermost JSON array; empty where there is none that can be read."""
    bare = F.regexp_replace(F.regexp_replace(blank_trim(text), r"^```[a-zA-Z]*\n?", ""), r"\n?```$", "")
    items = F.from_json(F.regexp_extract(bare, r"(?s)\[.*\]", 0), "array<string>", {"mode": "PERMISSIVE"})
    return F.coalesce(F.filter(items, lambda s: s.isNotNull() & (blank_trim(s) != "")), F.array().cast("array<string>"))


def canonical(items: Column, vocabulary: tuple[str, ...]) -> Column:
    """Sorted distinct terms: an item's exact term, else the first that holds it or is held by it."""
    terms = F.array(*map(F.lit, vocabulary))

    def one(item: Column) -> Column:
        key = F.lower(blank_trim(item))
        close = F.filter(terms, lambda t: F.contains(key, t) | F.contains(t, key))
        return F.when(F.array_contains(terms, key), key).otherwise(F.get(close, F.lit(0)))

    return F.array_sort(F.array_distinct(F.array_compact(F.transform(items, one))))


def chat(system: str, user: Column, assistant: Column) -> Column:
    """[(role, content)] of one training example."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(turn("system", F.lit(system)), turn("user", user), turn("assistant", assistant))


def first_content(messages: Column, role: str) -> Column:
    return F.get(F.filter(messages, lambda m: m["role"] == role), F.lit(0))["content"]


def paraphrase_ok(original: Column, rewrite: Column, names: Column, least: int = 20) -> Column:
    """Whether a rewrite is long enough, keeps every number as often (U+2212 is a minus), every name, and asks for a
    drawing. One-letter names must stand alone."""
    numbers = lambda t: F.regexp_extract_all(F.replace(F.coalesce(t, F.lit("")), F.lit("−"), F.lit("-")), F.lit(r"(-?[0-9]+(?:\.[0-9]+)?)"), F.lit(1))
    need, have = numbers(original), numbers(rewrite)
    count = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    kept = F.forall(F.array_distinct(need), lambda x: count(have, x) >= count(need, x))
    padded = F.concat(F.lit(" "), F.regexp_replace(rewrite, "[^A-Za-z0-9]", " "), F.lit(" "))
    named = F.forall(names, lambda n: F.when(F.length(n) == 1, F.contains(padded, F.concat(F.lit(" "), n, F.lit(" ")))).otherwise(F.contains(rewrite, n)))
    asks = has_any(rewrite, ("tikz", "figure", "draw", "construct", "sketch", "plot"))
    return F.coalesce((F.length(blank_trim(rewrite)) >= least) & kept & named & asks, F.lit(False))


