"""Sections over the parts of a document: which part's leading content continues what sections, and the sections merged.

Every part has a tree of its own, with section 0 as its root.  A document has one root, made of the parts' roots; the
other sections follow in the order of parts.  A part that opens with content without a heading continues the sections
left open before it, so the parts are folded in their order, with the path of open sections as the state:

* a part with its root alone gives all of the root's content to the deepest open section;
* a root that opens with section 1, without a heading, gives that section away; if it opens with section 2 it wraps it,
  and so on: each wrapper continues the open section at its own depth, what the last one holds the deepest;
* a root that opens with content and has a section behind it gives away the run up to the first section or heading.

Sections above the one that takes content take its spans, as their spans are the extent of all they hold.

Helpers of a task that holds one document's parts, as the merged result does.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pagefold.functions import jsontext
from pagefold.operators import ordering

# Roles of headings; members whose items an element pointer to content names.
HEADINGS = ('"title"', '"sectionHeading"')
LEAVES = ("paragraphs", "tables", "figures", "keyValuePairs")
POINTER = re.compile(r"/([^/]+)/(0|[1-9][0-9]{0,17})")


class Refused(Exception):
    """A violation; `part` is the number of the part that shows it, None where no one part does."""

    def __init__(self, code: str, part: int | None = None):
        super().__init__(code)
        self.code, self.part = code, part


def spelled(raw: str, code: str) -> dict[str, str]:
    """The members of an object as they are spelled; refused where it is none, or names are escaped or repeated."""
    try:
        found = jsontext.members(raw)
    except ValueError:
        raise Refused(code) from None
    out = {name: value for name, _, _, value in found}
    if len(out) < len(found) or any("\\" in name for name in out):
        raise Refused(code)
    return out


def items_of(raw: str) -> list[str]:
    """The items of a spelled array, as they are spelled."""
    return [raw[a:b] for path, _, a, b, _ in jsontext.values(raw) if len(path) == 1] if raw.lstrip(" \t\r\n").startswith("[") else []


def strict_spans(raw: str) -> list[tuple[int, int]]:
    """(offset, length) of spans that have these two members once each, both canonical; V24 where they are not so."""
    out: list[dict[str, int]] = []
    for path, kind, a, b, n in jsontext.values(raw):
        if not path:
            if kind != "Array" or n != len(out):
                raise Refused("V24")
        elif len(path) == 1:
            if kind != "Object" or n != 2 or len(out) != path[0] + 1:
                raise Refused("V24")
        else:
            name = "V24" if len(path) > 2 or not isinstance(path[1], str) else path[1]
            name = jsontext.plain(f'"{name}"')
            if path[0] == len(out):
                out.append({})
            value = jsontext.canonical(raw[a:b]) if kind == "Number" else None
            if name not in ("offset", "length") or name in out[-1] or value is None:
                raise Refused("V24")
            out[-1][name] = value
    return [(s["offset"], s["length"]) for s in out]


def pointer(spelling: str) -> tuple[str, int] | None:
    """(member, index) of an element pointer's text."""
    m = POINTER.fullmatch(spelling)
    return (m[1], int(m[2])) if m else None


def texts_of(raw: str) -> list[str]:
    """The texts of an array of strings; V31 where it is none."""
    try:
        found = json.loads(raw)
    except ValueError:
        found = None
    if not isinstance(found, list) or not all(isinstance(x, str) for x in found):
        raise Refused("V31")
    return found


def section_at(text: str) -> int | None:
    told = pointer(text)
    return told[1] if told and told[0] == "sections" else None


@dataclass
class Given:
    """What a section takes of a part: the spelled items of an elements array, or none, and spans in the part's offsets."""

    part: Part
    elements: str | None
    spans: list[tuple[int, int]]


@dataclass
class Part:
    """A part of a document with what its sections need: its place among all parts, length, shift and spelled arrays."""

    at: int
    length: int
    shift: int
    arrays: dict[str, str]
    rewrite: object = None  # rewrite(spelled, path): renumbered by the part
    sections: list[str] = field(default_factory=list)
    root: dict[str, str] = field(default_factory=dict)
    root_spans: list[tuple[int, int]] = field(default_factory=list)
    root_elements: list[str] = field(default_factory=list)
    headings: set[int] = field(default_factory=set)
    #: Sections folded away from 1 on, elements dropped from the root's beginning, all of the root's content given away.
    folded: int = 0
    dropped: int = 0
    moved: bool = False

    def read(self) -> None:
        """The root and what it needs, or V23 to V25."""
        self.sections = items_of(self.arrays["sections"])
        self.root = spelled(self.sections[0], "V23")
        self.root_spans = strict_spans(self.root["spans"]) if "spans" in self.root else []
        if not self.root_spans and self.length > 0 or any(a + n > self.length for a, n in self.root_spans):
            raise Refused("V25")
        for path, kind, a, b, _ in jsontext.values(self.arrays.get("paragraphs", "[]")):
            if len(path) == 2 and path[1] == "role" and kind == "String" and self.arrays["paragraphs"][a:b] in HEADINGS:
                self.headings.add(path[0])

    def read_elements(self) -> None:
        self.root_elements = texts_of(self.root["elements"]) if "elements" in self.root else []

    def heading(self, text: str) -> bool:
        told = pointer(text)
        return told is not None and told[0] == "paragraphs" and told[1] in self.headings

    def section(self, i: int) -> tuple[list[str], str, str] | None:
        """(elements, their spelling, spelled spans) of a section that can be extended, else None."""
        s = spelled(self.sections[i], "V23")
        return (texts_of(s["elements"]), s["elements"], s["spans"]) if "elements" in s and "spans" in s else None

    def within(self, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
        if any(a + n > self.length for a, n in spans):
            raise Refused("V26")
        return spans

    def extent(self, texts: list[str]) -> tuple[int, int] | None:
        """Where the items that these pointers name begin and end; V27 where one names no item."""
        wanted: dict[str, set[int]] = {}
        for text in texts:
            told = pointer(text)
            if told is None or told[0] not in LEAVES or told[0] not in self.arrays:
                raise Refused("V27")
            wanted.setdefault(told[0], set()).add(told[1])
        spans = []
        for name, at in wanted.items():
            items = items_of(self.arrays[name])
            if max(at) >= len(items):
                raise Refused("V27")
            for i in at:
                own = spelled(items[i], "V23")
                spans += strict_spans(own["spans"]) if "spans" in own else []
        return (min(a for a, _ in spans), max(a + n for a, n in spans)) if spans else None

    def open_path(self) -> list[int]:
        """The sections that the tree ends in, from the root down; none where one on the way cannot be extended."""
        path, elements = [], self.root_elements
        while elements:
            i = section_at(elements[-1])
            if i is None or not 1 <= i < len(self.sections) or i in path:
                break
            if (found := self.section(i)) is None:
                return []
            path.append(i)
            elements = found[0]
        return path


def inner(array: str) -> str:
    """What stands between an array's brackets."""
    return array.strip(" \t\r\n")[1:-1]


def tail(array: str, n: int) -> str:
    return "[" + ",".join(items_of(array)[n:]) + "]"


@dataclass
class Lead:
    """What the open sections take of a part, by their depth, and the depth that each of its folded sections went to."""

    given: list[Given | None]
    into: list[int] = field(default_factory=list)

    def content(self, given: Given, above: int) -> None:
        """Content goes to the deepest section; those from depth `above` on down to it take its spans."""
        for j in range(above, len(self.given) - 1):
            self.given[j] = Given(given.part, None, given.spans)
        self.given[-1] = given


def leading(part: Part, depth: int) -> Lead | None:
    """How a part's leading content continues `depth` open sections; None where it is no continuation."""
    lead, first = Lead([None] * depth), part.root_elements[0]
    if len(part.sections) == 1:
        if any(section_at(e) is not None for e in part.root_elements):
            return None
        part.moved = True
        lead.content(Given(part, part.root["elements"], part.root_spans), 0)
        return lead
    if section_at(first) is None:
        return leading_run(part, lead)
    return leading_chain(part, lead, depth) if section_at(first) == 1 else None


def leading_run(part: Part, lead: Lead) -> Lead | None:
    n = next((i for i, e in enumerate(part.root_elements) if section_at(e) is not None or part.heading(e)), len(part.root_elements))
    if all(section_at(e) is None for e in part.root_elements[n:]) or (found := part.extent(part.root_elements[:n])) is None:
        return None
    clipped = [(max(a, found[0]), min(a + m, found[1])) for a, m in part.root_spans]
    if not (spans := [(a, b - a) for a, b in clipped if a < b]):
        return None
    part.dropped = n
    lead.content(Given(part, "[" + ",".join(items_of(part.root["elements"])[:n]) + "]", spans), 0)
    return lead


def leading_chain(part: Part, lead: Lead, depth: int) -> Lead | None:
    chain: list[tuple[str, list[tuple[int, int]], bool]] = []
    for i in range(1, len(part.sections) + 1):
        if i == len(part.sections) or (found := part.section(i)) is None or not found[0]:
            return None
        texts, elements, spans = found
        if part.heading(texts[0]):
            if not chain:
                return None
            break  # it stays a section, inside what the last wrapper continues
        if i > depth:
            return None
        wraps = section_at(texts[0])
        chain.append((elements, part.within(strict_spans(spans)), wraps is not None))
        if wraps is None:
            break
        if wraps != i + 1:
            return None
    for i, (elements, spans, wraps) in enumerate(chain):
        given = Given(part, tail(elements, 1) if i < len(chain) - 1 else elements, spans)
        if wraps:
            lead.given[i] = given
            lead.into.append(i + 1)
        else:
            lead.content(given, i)
            lead.into.append(depth)
    part.folded, part.dropped = len(chain), 1
    return lead


def folded(parts: list[Part]) -> dict[tuple[int, int], list[Given]]:
    """What each (part, section) takes of later parts; parts are marked with what they give away."""
    open_: list[tuple[int, int]] = []
    folds: dict[tuple[int, int], list[Given]] = {}
    for p in parts:
        try:
            p.read_elements()
            lead = None
            if open_ and p.at > 0 and p.root_elements and not p.heading(p.root_elements[0]):
                lead = leading(p, len(open_))
            for place, given in zip(open_, lead.given if lead else [], strict=False):
                if given:
                    folds.setdefault(place, []).append(given)
            if p.moved:
                continue
            path = p.open_path()
        except Refused as e:
            raise Refused(e.code, p.at) from None
        if path:
            # A section that was folded away stands for the open one that took it, and for those above.
            reached: list[tuple[int, int]] = []
            for i in path:
                reached = open_[: lead.into[i - 1]] if lead and i <= len(lead.into) else [*reached, (p.at, i)]
            open_ = reached
        elif len(p.root_elements) > p.dropped:
            open_ = []
    return folds


def joined_spans(found: list[tuple[Part, list[tuple[int, int]]]], every: list[Part]) -> str:
    """Spans of parts, shifted; two are one where nothing but the separator of adjacent parts lies between them."""
    out: list[list[int]] = []
    for p, spans in found:
        for a, n in spans:
            a += p.shift
            before = every[p.at - 1] if p.at else None
            if out and before and a == p.shift and sum(out[-1]) == before.shift + before.length:
                out[-1][1] = a + n - out[-1][0]
            else:
                out.append([a, n])
    return "[" + ",".join(f'{{"offset":{a},"length":{n}}}' for a, n in out) + "]"


def joined_elements(found: list[tuple[Part, str | None]]) -> str:
    texts = (inner(p.rewrite(e, ("sections", 0, "elements"))) for p, e in found if e is not None)
    return "[" + ",".join(t for t in texts if t.strip(" \t\r\n")) + "]"


def merged(parts: list[Part], every: list[Part], folds: dict) -> tuple[str, int]:
    """(sections, number of them) of the parts that have sections, once their rewrite() knows where sections go."""
    if not parts:
        return "[]", 0
    order = ordering.union([list(p.root) for p in parts])
    if order is None:
        raise Refused("V28")
    root = []
    for name in order:
        if name == "elements":
            kept = ((p, tail(p.root[name], p.dropped) if p.dropped else p.root[name]) for p in parts if name in p.root and not p.moved)
            value = joined_elements(list(kept))
        elif name == "spans":
            value = joined_spans([(p, p.root_spans) for p in parts], every)
        else:
            first = next(p for p in parts if name in p.root)
            value = first.rewrite(first.root[name], ("sections", 0, name))
        root.append(f'"{name}":{value}')
    out = ["{" + ",".join(root) + "}"]
    for p in parts:
        try:
            for i in range(1 + p.folded, len(p.sections)):
                out.append(extended(p, i, folds.get((p.at, i), []), every))
        except Refused as e:
            raise Refused(e.code, p.at if e.part is None else e.part) from None
    return "[" + ",".join(out) + "]", len(out)


def extended(p: Part, i: int, given: list[Given], every: list[Part]) -> str:
    """A section with what it takes of later parts, renumbered."""
    if not given:
        return p.rewrite(p.sections[i], ("sections", i))
    out = []
    for name, value in spelled(p.sections[i], "V23").items():
        if name == "spans":
            value = joined_spans([(p, p.within(strict_spans(value))), *((g.part, g.spans) for g in given)], every)
        elif name == "elements":
            value = joined_elements([(p, value), *((g.part, g.elements) for g in given)])
        else:
            value = p.rewrite(value, ("sections", i, name))
        out.append(f'"{name}":{value}')
    return "{" + ",".join(out) + "}"
