"""Cutting whole results into their parts: the inverse of the merge, for results whose items refer to one another.

A part has the text of its pages' spans, the items that are on its pages, and the sections that hold any of them;
offsets, page numbers, pointers and figure ids are the part's own.  A result is checked as a whole before it is cut:
what cannot be followed is a problem, told by its path.  What had to be judged is a note.

Helpers of a task that holds one result, as the cut's rows do.
"""

from __future__ import annotations

import re

from pagefold.functions import jsontext, jsontree
from pagefold.functions.jsontree import Node, array, scalar
from pagefold.functions.unitindex import EscapedText, NotOnUnit
from pagefold.operators.sections import LEAVES, pointer

# The members that are cut item by item, and the mark between pages of a markdown text.
CUT_MEMBERS = ("pages", *LEAVES, "sections", "styles")
PAGE_BREAK = re.compile(r"\n(\n*<!-- PageBreak -->\n*)\Z")
#: Problems of a result that are spelled out; the others are counted.
MOST_PROBLEMS = 8
FIGURE = re.compile(r"([1-9][0-9]{0,8})\.([1-9][0-9]{0,8})")


class Malformed(ValueError):
    """A result that cannot be cut; `problems` says why."""

    def __init__(self, problems: list[str]):
        super().__init__("; ".join(problems))
        self.problems = problems[:MOST_PROBLEMS] + ([f"and {len(problems) - MOST_PROBLEMS} more"] if len(problems) > MOST_PROBLEMS else [])


def place(path: tuple) -> str:
    return "".join(f"[{p}]" if isinstance(p, int) else f".{p}" for p in path).lstrip(".") or "the result"


def told(node: Node | None) -> str:
    return "(absent)" if node is None else jsontree.shown(jsontree.spell(node))


def number(node: Node | None, key: str) -> int | None:
    """A member that is a canonical number."""
    at = node.get(key) if node is not None and node.kind == "Object" else None
    return jsontext.canonical(at.raw) if at is not None and at.kind == "Number" else None


def text_of(node: Node | None) -> str | None:
    return jsontext.plain(node.raw) if node is not None and node.kind == "String" else None


def items(node: Node | None, key: str) -> list[Node]:
    found = node.get(key) if node is not None and node.kind == "Object" else None
    return found.items if found is not None and found.kind == "Array" else []


def span_of(node: Node) -> tuple[int, int]:
    return number(node, "offset"), number(node, "length")


def first_page(item: Node) -> int | None:
    regions = items(item, "boundingRegions")
    return number(regions[0], "pageNumber") if regions else None


def is_offset(path: tuple) -> bool:
    return path[-1] == "offset" and (path[-2] == "span" or len(path) > 2 and isinstance(path[-2], int) and path[-3] == "spans")


def is_page_number(path: tuple) -> bool:
    return path[-1] == "pageNumber" and len(path) > 2 and isinstance(path[-2], int) and (len(path) == 3 and path[0] == "pages" or path[-3] == "boundingRegions")


def clipped(spans: list[Node], a: int, b: int) -> Node:
    """The spans that meet [a, b), cut to it; an empty one stays where it lies in [a, b]."""
    out = []
    for span in spans:
        at, n = span_of(span)
        low, high = max(at, a), min(at + n, b)
        if n == 0 and a <= at <= b:
            out.append(span)
        elif low < high:
            new = Node("Object", "", list(span.keys), list(span.items))
            new.put("offset", scalar(low))
            new.put("length", scalar(high - low))
            out.append(new)
    return array(out)


class Cut:
    """One result, checked and placed, whose parts can be taken."""

    def __init__(self, result: str | None, plan: list[list[int]], unit: str, clusters: list[int] | None = None):
        try:
            root = jsontree.parse(result or "")
        except ValueError as e:
            raise Malformed([f"not well-formed: {e}"]) from None
        inner = root.get("analyzeResult") if root.kind == "Object" else None
        self.root, self.plan, self.notes = inner or root, plan, []
        if self.root.kind != "Object":
            raise Malformed([f"the result is {told(self.root)}, not an object"])
        named = self.root.get("stringIndexType")
        if named is not None and text_of(named) != unit:
            raise Malformed([f"stringIndexType {told(named)} is not the unit that the cut counts in"])
        if text_of(content := self.root.get("content")) is None:
            raise Malformed([f"content {told(content)} is no text"])
        self.markdown = text_of(self.root.get("contentFormat")) == "markdown"
        try:
            self.text = EscapedText(content.raw, unit, clusters)
        except NotOnUnit as e:
            raise Malformed([f"content: {e}"]) from None
        if problems := list(self.problems()):
            raise Malformed(problems)
        self.part_of = {p: k for k, pages in enumerate(plan) for p in pages}
        self.local = {p: i for pages in plan for i, p in enumerate(pages, 1)}
        self.ranges = self.texts()
        self.placed = {name: self.leaves(name) for name in LEAVES}
        self.held = self.sections_held()
        kept = ([i for i in range(1, len(self.held)) if k in self.held[i]] for k in range(len(plan)))
        self.section_local = [{0: 0} | {i: n for n, i in enumerate(found, 1)} for found in kept]

    # What is checked before anything is followed.

    def problems(self):
        for name in CUT_MEMBERS:
            found = self.root.get(name)
            if found is None:
                if name == "pages":
                    yield "the result has no pages"
            elif found.kind != "Array":
                yield f"{name} is {told(found)}, not an array"
            else:
                yield from (f"{name}[{i}] is {told(x)}, not an object" for i, x in enumerate(found.items) if x.kind != "Object")
        self.page_at: dict[int, int] = {}
        for i, page in enumerate(items(self.root, "pages")):
            n = number(page, "pageNumber")
            if not n:
                yield f"pages[{i}].pageNumber {told(page.get('pageNumber') if page.kind == 'Object' else None)} is not a page number"
            elif n in self.page_at:
                yield f"pages[{self.page_at[n]}] and pages[{i}] are both page {n}"
            else:
                self.page_at[n] = i
        yield from self.plan_problems()
        for path, node in jsontree.walk(self.root):
            if node.kind == "Object":
                yield from (f'{place(path)}: member "{k}" appears twice' for i, k in enumerate(node.keys) if node.keys.index(k) < i)
            if not path or not isinstance(path[-1], str):
                continue
            if path[-1] == "span":
                yield from self.span_problem(path, node)
            elif path[-1] in ("spans", "boundingRegions", "elements"):
                if node.kind != "Array":
                    yield f"{place(path)} is {told(node)}, not an array"
                    continue
                check = {"spans": self.span_problem, "boundingRegions": self.region_problem, "elements": self.pointer_problem}[path[-1]]
                for i, item in enumerate(node.items):
                    yield from check((*path, i), item)
        for i, figure in enumerate(items(self.root, "figures")):
            yield from self.figure_problem(i, figure)

    def plan_problems(self):
        if not self.plan:
            yield "the plan has no parts"
        seen: dict[int, int] = {}
        for k, pages in enumerate(self.plan):
            if not pages:
                yield f"part {k} of the plan has no pages"
            for n in pages:
                if n not in self.page_at:
                    yield f"part {k}: page {n} is not in the result"
                if n in seen:
                    yield f"page {n} is planned in part {seen[n]} and again in part {k}"
                seen[n] = k

    def span_problem(self, path, span):
        at, n = span_of(span)
        if at is None or n is None:
            yield f"{place(path)} {told(span)} is not an {{offset, length}} span"
            return
        try:
            self.text.char(at), self.text.char(at + n)
        except NotOnUnit as e:
            yield f"{place(path)} {{offset {at}, length {n}}}: {e}"

    def region_problem(self, path, region):
        if number(region, "pageNumber") not in self.page_at:
            yield f"{place(path)}.pageNumber {told(region.get('pageNumber') if region.kind == 'Object' else None)} is not a page of the result"

    def pointer_problem(self, path, element):
        found = pointer(text_of(element) or "")
        if found is None:
            yield f"{place(path)} {told(element)} is not a pointer /<member>/<index>"
        elif found[0] != "sections" and found[0] not in LEAVES:
            yield f"{place(path)} {told(element)} points into {found[0]}, which the cut does not renumber"
        elif found[1] >= len(items(self.root, found[0])):
            yield f"{place(path)} {told(element)} points past the result's {len(items(self.root, found[0]))} {found[0]}"

    def figure_problem(self, i, figure):
        if figure.kind != "Object" or (named := figure.get("id")) is None:
            return
        m = FIGURE.fullmatch(text_of(named) or "")
        if not m:
            yield f"figures[{i}].id {told(named)} is not <page>.<n>"
        elif int(m[1]) not in self.page_at:
            yield f"figures[{i}].id {told(named)} names page {m[1]}, which is not in the result"
        elif first_page(figure) not in (None, int(m[1])):
            yield f"figures[{i}].id {told(named)} names page {m[1]}, but its first bounding region is on page {first_page(figure)}"

    # Where everything goes.

    def texts(self) -> list[tuple[int, int]]:
        """Each part's range of the content, in units."""
        out, pages = [], items(self.root, "pages")
        for k, planned in enumerate(self.plan):
            spans = [span_of(s) for n in planned for s in items(pages[self.page_at[n]], "spans")]
            if not spans:
                raise Malformed([f"part {k}: pages {planned} have no spans"])
            a, b = min(at for at, _ in spans), max(at + n for at, n in spans)
            if self.markdown and planned[-1] < max(self.page_at):
                if not (m := PAGE_BREAK.search(self.text.part(a, b))):
                    raise Malformed([f"part {k}: the text of its pages does not end with a page break"])
                b = self.unit_at(k, self.text.char(a) + m.start(1))
                self.notes.append(f"part {k}: the page break at its end is left out")
            out.append((a, b))
        for k in range(1, len(out)):
            if out[k - 1][1] > out[k][0]:
                raise Malformed([f"the text of part {k - 1} reaches into that of part {k}"])
            if not self.markdown and self.text.part(out[k - 1][1], out[k][0]) != "\n":
                self.notes.append(f"between part {k - 1} and {k} the content has more or less than one line end")
        return out

    def unit_at(self, k: int, char: int) -> int:
        try:
            return self.text.unit_at(char)
        except NotOnUnit as e:
            raise Malformed([f"part {k}: {e}"]) from None

    def leaves(self, name: str) -> list[tuple[int, int]]:
        """(part, index in it) of each item: by its first region's page, else by its first span; (-1, -1) where no part has it."""
        out, counts = [], [0] * len(self.plan)
        for i, item in enumerate(items(self.root, name)):
            page = first_page(item)
            if page is not None and page not in self.part_of:
                out.append((-1, -1))
                continue
            k = self.part_of.get(page)
            if k is None and (spans := items(item, "spans")):
                at = span_of(spans[0])[0]
                k = next((j for j in reversed(range(len(self.plan))) if self.ranges[j][0] <= at <= self.ranges[j][1]), None)
            if k is None:
                self.notes.append(f"{name}[{i}] has neither a page nor a span in any part: it is put in part 0")
                k = 0
            a, b = self.ranges[k]
            if any(self.part_of.get(number(r, "pageNumber")) != k for r in items(item, "boundingRegions")) or any(at < a or at + n > b for at, n in map(span_of, items(item, "spans"))):
                self.notes.append(f"{name}[{i}] reaches beyond part {k}")
            out.append((k, counts[k]))
            counts[k] += 1
        return out

    def sections_held(self) -> list[set[int]]:
        """The parts that each section holds something of, its sub-sections' included; trees that loop are safe."""
        own, below = [], []
        for section in items(self.root, "sections"):
            found = [pointer(text_of(e)) for e in items(section, "elements")]
            own.append({self.placed[m][j][0] for m, j in found if m != "sections"} - {-1})
            below.append([j for m, j in found if m == "sections"])
        # Parts go up from each section to those that hold it, until nothing new does.
        above: list[list[int]] = [[] for _ in own]
        for i, found in enumerate(below):
            for j in found:
                above[j].append(i)
        waits = list(range(len(own)))
        while waits:
            i = waits.pop()
            for j in above[i]:
                if not own[i] <= own[j]:
                    own[j] |= own[i]
                    waits.append(j)
        for i, parts in enumerate(own):
            if i and len(parts) > 1:
                self.notes.append(f"sections[{i}] holds items of parts {sorted(parts)}: each has a copy of its own")
        return own

    # The parts.

    def part(self, k: int) -> str:
        a, b = self.ranges[k]
        out = Node("Object")
        for name, value in zip(self.root.keys, self.root.items, strict=True):
            if name == "content":
                value = Node("String", f'"{self.text.raw(a, b)}"')
            elif name == "pages":
                mine = [p for p in value.items if self.part_of.get(number(p, "pageNumber")) == k]
                value = array([self.own(self.with_spans(p, a, b) if self.markdown else p, k, name) for p in mine])
            elif name in LEAVES:
                value = array([self.own(x, k, name) for x, (part, _) in zip(value.items, self.placed[name], strict=True) if part == k])
                if not value.items and name == "figures":
                    continue  # a result without figures has no such member
            elif name == "styles":
                cut = (self.with_spans(s, a, b) for s in value.items)
                value = array([self.own(s, k, name) for s in cut if items(s, "spans")])
            elif name == "sections":
                value = self.sections(k)
            elif value.kind == "Array" and value.items:
                self.notes.append(f"{name} ({len(value.items)} items) is copied to every part")
            out.put(name, value)
        return jsontree.spell(out)

    def with_spans(self, node: Node, a: int, b: int) -> Node:
        out = Node("Object", "", list(node.keys), list(node.items))
        if out.get("spans") is not None:
            out.put("spans", clipped(items(node, "spans"), a, b))
        return out

    def sections(self, k: int) -> Node:
        """The root with what the part has of its elements, and the sections that hold something of the part."""
        if not any(k in parts for parts in self.held):
            self.notes.append(f"part {k} has nothing that a section holds: its sections are empty")
            return array([])
        out = []
        for i, section in enumerate(items(self.root, "sections")):
            if i and k not in self.held[i]:
                continue
            cut = self.with_spans(section, *self.ranges[k])
            if cut.get("elements") is not None:
                cut.put("elements", array([e for e in items(section, "elements") if self.has(k, *pointer(text_of(e)))]))
            out.append(self.own(cut, k, "sections"))
        return array(out)

    def has(self, k: int, name: str, i: int) -> bool:
        return k in self.held[i] if name == "sections" else self.placed[name][i][0] == k

    def own(self, node: Node, k: int, name: str) -> Node:
        """An item renumbered for part k."""

        def visit(path: tuple, value: Node) -> Node | None:
            if isinstance(path[-1], int):
                return self.pointer_in(k, value) if path[-2] == "elements" else None
            if is_offset(path):
                return scalar(str(jsontext.canonical(value.raw) - self.ranges[k][0]))
            if is_page_number(path):
                page = jsontext.canonical(value.raw)
                if self.part_of.get(page) != k:
                    self.notes.append(f"part {k}: an item's page {page} is in another part")
                return scalar(self.local.get(page, 0))
            if path[-1] == "id" and len(path) == 3 and name == "figures":
                page, _, rest = jsontext.plain(value.raw).partition(".")
                if self.part_of.get(int(page)) != k:
                    raise Malformed([f"part {k}: figure id {value.raw} names page {page}, which is not one of the part's"])
                return Node("String", f'"{self.local[int(page)]}.{rest}"')
            return None

        return jsontree.copied(node, visit, (name, 0))

    def pointer_in(self, k: int, value: Node) -> Node:
        name, i = pointer(text_of(value))
        local = self.section_local[k].get(i) if name == "sections" else self.placed[name][i][1]
        if local is None or name != "sections" and self.placed[name][i][0] != k:
            self.notes.append(f"part {k}: {value.raw} points to what another part has")
        return value if local is None else Node("String", f'"/{name}/{local}"')


def parts(result: str | None, plan: list[list[int]], unit: str, clusters: list[int] | None = None) -> tuple[list[str | None], list[str], list[str]]:
    """(the parts' results, notes, problems): results are null where there are problems."""
    try:
        cut = Cut(result, plan, unit, clusters)
        out = [cut.part(k) for k in range(len(plan))]
        return out, cut.notes, []
    except Malformed as e:
        return [None] * len(plan), [], e.problems
