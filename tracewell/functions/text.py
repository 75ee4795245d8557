"""Text columns: filters, block extraction, small classifiers and shapes, all as native expressions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BEGIN, END = "\\begin{tikzpicture}", "\\end{tikzpicture}"

#: Words that mark a text as geometry (substrings of the lower-case text; "arc " ends in a blank).
GEOMETRY_WORDS = (
    "triangle", "circle", "angle", "tangent", "perpendicular", "polygon", "square",
    "rectangle", "circumscrib", "inscrib", "radius", "diameter", "chord", "vertex",
    "vertices", "parallel", "hexagon", "pentagon", "octagon", "rhombus", "trapezoid",
    "quadrilateral", "sphere", "cylinder", "cone", "isosceles", "equilateral",
    "midpoint", "bisector", "centroid", "incircle", "circumcircle", "altitude",
    "hypotenuse", "collinear", "concurrent", "cevian", "orthocenter", "circumcenter",
    "incenter", "coordinate", "segment", "arc ", "semicircle",
)

#: Two patterns that mark a text as geometry, whatever the case.
GEOMETRY_HINT = (
    r"triangl|\bcircle|\bcircular|square|rectangl|quadrilateral|polygon|pentagon|hexagon|octagon|\bangle|perpendicular|parallel|\bvertex|vertices|\bpoint\b|"
    r"coordinate|diagonal|tangent|radius|radii|diameter|\bchord|\barc\b|sphere|cylinder|\bcone\b|\bprism\b|centroid|bisect"
)
GEOMETRY_STEMS = r"triangl|circle|square|rectangl|quadrilateral|polygon|angle|perpendicular|parallel|vert(ex|ices)|tangent|radius|radii|diameter|chord|centroid|bisect"

#: Parts of error messages after which a call may be tried again.
TRANSIENT = (
    "rate limit", "rate_limit", "429", "overloaded", "capacity",
    "timeout", "timed out", "temporarily", "502", "503", "504",
    "connection", "reset by peer", "econnreset", "server_error",
    "internal server error", "service unavailable",
)


def has_any(text: Column, parts: Iterable[str]) -> Column:
    """Whether the lower-case text holds any of the parts."""
    low = F.lower(text)
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(p)) for p in dict.fromkeys(parts)))


def blank_trim(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def strip_blocks(text: Column, begin: str, end: str) -> Column:
    """The text with every shortest begin..end block replaced by a blank, trimmed."""
    return blank_trim(F.regexp_replace(text, f"(?is){begin}.*?{end}", " "))


def extract_block(text: Column) -> Column:
    """From the first begin mark to the first end mark anywhere; null if either is missing or the end comes first."""
    i, j = F.instr(text, F.lit(BEGIN)), F.instr(text, F.lit(END))
    return F.when((i > 0) & (j >= i), F.substring(text, i, j - i + len(END)))


def figure_only(text: Column) -> Column:
    """Only a figure, but for blanks, one opening fence (bare, latex or tex) and one closing fence."""
    bare = blank_trim(F.regexp_replace(blank_trim(text), r"^```(?:latex|tex)?\s*|\s*```$", ""))
    return F.startswith(bare, F.lit(BEGIN)) & F.endswith(bare, F.lit(END))


def degenerate(ink: Column, dark: Column, page: Column, least_ink: float = 0.0015, most_dark: float = 0.5, most_page: float = 2200) -> Column:
    return F.when(page > most_page, "oversized").when(ink < least_ink, "blank").when(dark > most_dark, "blob").otherwise("ok")


def min_separation(points: Column) -> Column:
    """The least distance between two of the points (arrays of x, y); null for fewer than two."""
    n = F.size(points)

    def near(p: Column, i: Column) -> Column:
        rest = F.slice(points, i + 2, F.greatest(n - i - 1, F.lit(0)))
        return F.array_min(F.transform(rest, lambda q: F.sqrt(F.pow(p[0] - q[0], 2) + F.pow(p[1] - q[1], 2))))

    return F.array_min(F.filter(F.transform(points, near), lambda d: d.isNotNull()))


def replaced(text: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    """Plain replacements, one after another."""
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)
