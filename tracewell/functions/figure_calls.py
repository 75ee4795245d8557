"""Figure code as a stream of calls, and what is read off it: constructions, drawn segments and circles.

A call is a macro with the bracketed groups that follow it and the rest of its statement. The stream is made in one pass
with a table of matching brackets, so it is linear in the text whatever its nesting.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

_MACRO = re.compile(r"\\([A-Za-z]+)")
_BRACKET = re.compile(r"[()\[\]{}]")
_BLANK = re.compile(r"\s*")
PLAIN = re.compile(r"[A-Za-z]\w*\Z")
_DECIMAL = re.compile(r"-?[\d.]+\Z")


@dataclass(slots=True)
class Call:
    """macro: its name; options, args, braces: the square, round and curly groups right behind it; start, end: its
    place with those groups; rest: what follows, up to the end of the statement."""

    macro: str
    options: str | None
    args: list[str]
    braces: list[str]
    start: int
    end: int
    rest: str


def matching(text: str) -> dict[int, int]:
    """The place of each opening bracket -> that of the bracket of its kind that closes it."""
    stacks = {"(": (r := []), ")": r, "[": (s := []), "]": s, "{": (c := []), "}": c}
    found: dict[int, int] = {}
    for m in _BRACKET.finditer(text):
        b = m[0]
        stack = stacks[b]
        if b in "([{":
            stack.append(m.start())
        elif stack:
            found[stack.pop()] = m.start()
    return found


def calls(text: str, statements: tuple[str, ...] = ("draw", "coordinate"), others: bool = True) -> Iterator[Call]:
    """The calls of a text in order; the rest of the statement only for the named macros, with or without all others."""
    closed = matching(text)
    stop = -1
    for m in _MACRO.finditer(text):
        ends = m[1] in statements
        if not ends and not others:
            continue
        at = end = m.end()
        options, args, braces = None, [], []
        while True:
            last = closed.get(at)
            if last is None and (last := closed.get(at := _BLANK.match(text, at).end())) is None:
                break
            inside = text[at + 1 : last]
            if text[at] == "(":
                args.append(inside)
            elif text[at] == "{":
                braces.append(inside)
            elif options is None and not args and not braces:
                options = inside
            else:
                break
            at = end = last + 1
        if ends and stop < end:
            stop = text.find(";", end)
            stop = len(text) if stop < 0 else stop
        yield Call(m[1], options, args, braces, m.start(), end, text[end:stop] if ends else "")


def names_in(inside: str, n: int | None = None) -> list[str] | None:
    """The point names of a list with commas; None if one is no name or there are not n."""
    names = [x.strip() for x in inside.split(",")]
    return names if all(map(PLAIN.match, names)) and n in (None, len(names)) else None


@dataclass(slots=True)
class Construction:
    """A derived point: its kind, the points it depends on in order, and its angle or its place between them."""

    kind: str
    parents: list[str]
    angle: float | None = None
    t: float | None = None


#: Kinds in the order in which they claim a name; within a kind the first in the text counts.
KINDS = (
    "triangle center", "circumcenter", "incenter", "orthocenter", "centroid", "gravity center", "midpoint", "foot", "reflection",
    "point_reflection", "rotation", "translation", "bisector_ray", "intersection", "calculated",
)
_RANK = {k: i for i, k in enumerate(KINDS)}
#: Names of centres in options and macros.
_CENTRES = {"circum": "circumcenter", "in": "incenter", "ortho": "orthocenter", "centroid": "centroid", "gravity": "centroid"}
_CENTRES |= {v: v for v in ("circumcenter", "incenter", "orthocenter")}
_CENTRE_MACROS = {"CircumCenter": "circumcenter", "InCenter": "incenter", "OrthoCenter": "orthocenter", "Centroid": "centroid", "GravityCenter": "gravity center"}
_NAME = r"\s*([A-Za-z]\w*)\s*"
#: What the options of a point by a transformation say: kind, and how its parents follow from the options' and the source.
_BY: dict[str, tuple[str, re.Pattern, Callable[[list[str], str], list[str]]]] = {
    "projection": ("foot", re.compile(rf"onto\s{_NAME}--{_NAME}\Z"), lambda got, p: [p, *got]),
    "reflection": ("reflection", re.compile(rf"over\s{_NAME}--{_NAME}\Z"), lambda got, p: [p, *got]),
    "symmetry": ("point_reflection", re.compile(rf"center\s{_NAME}\Z"), lambda got, p: [p, *got]),
    "rotation": ("rotation", re.compile(rf"center\s{_NAME}(?<=\s)angle\s+(-?[\d.]+)\s*\Z"), lambda got, p: [p, *got]),
    "translation": ("translation", re.compile(rf"from\s{_NAME}(?<=\s)to\s{_NAME}\Z"), lambda got, p: [p, *got]),
}


def _centre(call: Call) -> tuple[str, Construction] | None:
    kind = _CENTRES.get((call.options or "").strip().lower())
    own = names_in(call.args[0], 3) if kind and len(call.args) == 1 else None
    return ("triangle center", Construction(kind, own)) if own else None


def _named_centre(call: Call) -> tuple[str, Construction] | None:
    rank = _CENTRE_MACROS[call.macro[len("tkzDef") :]]
    own = names_in(call.args[0], 3) if call.options is None and len(call.args) == 1 else None
    return (rank, Construction("centroid" if rank == "gravity center" else rank, own)) if own else None


def _middle(call: Call) -> tuple[str, Construction] | None:
    own = names_in(call.args[0], 2) if call.options is None and len(call.args) == 1 else None
    return ("midpoint", Construction("midpoint", own)) if own else None


def _transformed(call: Call) -> tuple[str, Construction] | None:
    how, _, what = (call.options or "").partition("=")
    if how.strip() not in _BY or len(call.args) != 1 or not (source := names_in(call.args[0], 1)):
        return None
    kind, rx, parents = _BY[how.strip()]
    if not (m := rx.match(what.strip())):
        return None
    got = [*m.groups()]
    angle = None
    if kind == "rotation" and (angle := _number(got.pop())) is None:
        return None
    return kind, Construction(kind, parents(got, source[0]), angle)


def _line(call: Call) -> tuple[str, Construction] | None:
    if (call.options or "").strip() != "bisector" or len(call.args) != 1 or not (own := names_in(call.args[0], 3)):
        return None
    return "bisector_ray", Construction("bisector_ray", own)


def _crossing(call: Call) -> tuple[str, Construction] | None:
    if call.options is not None or len(call.args) != 2:
        return None
    first, second = (names_in(a, 2) for a in call.args)
    return ("intersection", Construction("intersection", [*first, *second])) if first and second else None


_GETTERS: dict[str, Callable[[Call], tuple[str, Construction] | None]] = {
    "tkzDefTriangleCenter": _centre, "tkzDefMidPoint": _middle, "tkzDefPointBy": _transformed, "tkzDefLine": _line, "tkzInterLL": _crossing,
    **{f"tkzDef{k}": _named_centre for k in _CENTRE_MACROS},
}


def _number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def _calculated(call: Call) -> tuple[str, Construction] | None:
    """`(N) at ($(A)!x!(B)$)`: x is a share, or a point to project."""
    rest = call.rest.lstrip()
    if call.options is not None or len(call.args) != 1 or not rest.startswith("at"):
        return None
    rest = rest[2:].lstrip()
    last = matching(rest).get(0) if rest.startswith("(") else None
    inside = rest[1:last].strip() if last else ""
    if len(inside) < 2 or inside[0] != "$" or inside[-1] != "$" or inside.count("!") != 2:
        return None
    left, middle, right = (x.strip() for x in inside[1:-1].split("!"))
    ends = [x[1:-1].strip() for x in (left, right) if x.startswith("(") and x.endswith(")")]
    if len(ends) < 2 or not all(map(PLAIN.match, ends)):
        return None
    middle = middle.strip("() \t")
    if middle in ("0.5", "1/2"):
        return "calculated", Construction("midpoint", ends)
    if _DECIMAL.match(middle):
        return ("calculated", Construction("partway", ends, t=t)) if (t := _number(middle)) is not None else None
    return ("calculated", Construction("foot", [middle, *ends])) if PLAIN.match(middle) else None


def _meets_bisector(c: Construction, rays: dict[str, Construction]) -> Construction:
    """A line through the apex and the ray of a bisector that meets a side is one construction of its own."""
    for line, side in ((c.parents[:2], c.parents[2:]), (c.parents[2:], c.parents[:2])):
        # The line's second point is looked at first; only where it is no ray can the first be one.
        ray, apex = line[::-1] if line[1] in rays else line
        if ray in rays and rays[ray].parents[1] == apex:
            return Construction("bisector_meet", [*rays[ray].parents, *side])
    return c


def constructions(text: str | None) -> dict[str, Construction]:
    """Name -> construction of the derived points. Of several for a name the first by KINDS counts, then by place; rays
    of bisectors only help to read other points and keep their names to themselves."""
    found: list[tuple[int, int, str, Construction]] = []
    waiting: tuple[Call, tuple[str, Construction]] | None = None
    for call in calls(text or ""):
        if call.macro == "tkzGetPoint":
            name = call.braces[0] if call.braces else ""
            if waiting and not (text[waiting[0].end : call.start]).strip() and PLAIN.match(name):
                found.append((_RANK[waiting[1][0]], call.start, name, waiting[1][1]))
            waiting = None
        elif call.macro == "coordinate":
            made = _calculated(call)
            if made and PLAIN.match(name := call.args[0].strip()):
                found.append((_RANK[made[0]], call.start, name, made[1]))
        else:
            read = _GETTERS.get(call.macro)
            made = read(call) if read else None
            waiting = (call, made) if made else None
    out: dict[str, Construction] = {}
    for _, _, name, c in sorted(found, key=lambda f: f[:2]):
        out.setdefault(name, c)
    rays = {name: c for name, c in out.items() if c.kind == "bisector_ray"}
    return {name: _meets_bisector(c, rays) if c.kind == "intersection" else c for name, c in out.items() if name not in rays}


def _chain(body: str) -> list[str | None]:
    """For each part between `--` the first bracket that is a plain name."""
    out = []
    for part in body.split("--"):
        spots = (part[a + 1 : b].strip() for a, b in sorted(matching(part).items()) if part[a] == "(")
        out.append(next(filter(PLAIN.match, spots), None))
    return out


def segments(text: str | None) -> list[str]:
    """The drawn segments as 'A-B', names in order, in the text's order, each once whatever its direction; polygons and
    cycles close."""
    found: dict[str, None] = {}

    def join(*names: str | None) -> None:
        for a, b in zip(names, names[1:]):
            if a and b and a != b:
                found.setdefault("-".join(sorted((a, b))))

    for call in calls(text or ""):
        if call.macro == "draw":
            body = " ".join(f"({a})" for a in call.args) + call.rest
            path = _chain(body)
            join(*path)
            named = list(filter(None, path))
            if "cycle" in body and len(named) > 1:
                join(named[-1], named[0])
        elif call.options is None and call.args:
            own = [x.strip() for x in call.args[0].split(",")]
            if call.macro == "tkzDrawPolygon":
                own = list(filter(None, own))
                join(*own, *own[:1])
            elif call.macro == "tkzDrawLine" and len(own) == 2:
                join(*own)
            elif call.macro in ("tkzDrawSegment", "tkzDrawSegments"):
                for pair in call.args[0].split():
                    if len(ends := pair.split(",")) == 2:
                        join(*ends)
    return list(found)


@dataclass(slots=True)
class Circle:
    """By a named centre or a place, through a point or with a radius."""

    center: str | None = None
    through: str | None = None
    cx: float | None = None
    cy: float | None = None
    r: float | None = None


def circles(text: str | None) -> list[Circle]:
    """The drawn circles in the text's order: all of a statement."""
    out: list[Circle] = []
    for call in calls(text or ""):
        if call.macro == "tkzDrawCircle" and call.args and (own := names_in(call.args[0], 2)):
            out.append(Circle(*own))
        elif call.macro == "draw":
            body = " ".join(f"({a})" for a in call.args) + call.rest
            closed = matching(body)
            opened = {b: a for a, b in closed.items()}
            for m in re.finditer(r"\)\s*circle\s*\(", body):
                a, b = opened.get(m.start()), closed.get(m.end() - 1)
                r = _number(body[m.end() : b].strip()) if a is not None and b else None
                if r is None or r < 0:
                    continue
                at = [x.strip() for x in body[a + 1 : m.start()].split(",")]
                if len(at) == 1 and PLAIN.match(at[0]):
                    out.append(Circle(center=at[0], r=r))
                elif len(at) == 2 and None not in (xy := [_number(v) for v in at]):
                    out.append(Circle(cx=xy[0], cy=xy[1], r=r))
    return out
