"""JSON documents as ordered trees that keep every scalar's spelling, and how two of them differ.

Small helpers of Arrow tasks, for what needs a document as a whole: comparing, cutting.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pagefold.functions import jsontext


@dataclass(slots=True)
class Node:
    """A value: `raw` of a scalar, `keys` of an object (as they are spelled), `items` of an object or array."""

    kind: str
    raw: str = ""
    keys: list[str] = field(default_factory=list)
    items: list[Node] = field(default_factory=list)

    def get(self, key: str) -> Node | None:
        """The first member of that name."""
        return self.items[self.keys.index(key)] if key in self.keys else None

    def put(self, key: str, value: Node) -> None:
        if key in self.keys:
            self.items[self.keys.index(key)] = value
        else:
            self.keys.append(key)
            self.items.append(value)


def scalar(raw: str | int) -> Node:
    return Node("Number" if isinstance(raw, int) else "String", str(raw))


def array(items: list[Node]) -> Node:
    return Node("Array", items=items)


#: What a scalar has below it; never written to.
NOTHING: list = []


def node_of(value) -> Node:
    """The node of what the decoder tells; strings are told as they are spelled."""
    if type(value) is str:
        return Node("String", f'"{value}"', NOTHING, NOTHING)
    if type(value) is list:
        return Node("Array", "", [], [node_of(v) for v in value])
    if value is None:
        return Node("Null", "null", NOTHING, NOTHING)
    return value if type(value) is Node else Node("Bool", "true" if value else "false", NOTHING, NOTHING)


def object_of(pairs: list) -> Node:
    return Node("Object", "", [jsontext.checked_name(k) for k, _ in pairs], [node_of(v) for _, v in pairs])


def number_of(raw: str) -> Node:
    return Node("Number", jsontext.checked_number(raw), NOTHING, NOTHING)


DECODER = jsontext.Decoder(object_of, number_of)


def parse(text: str) -> Node:
    """The tree of a JSON text; jsontext.Malformed where it is none.  Strings of any length are of kind String."""
    try:
        return node_of(DECODER.decode(jsontext.twice_escaped(text)))
    except (ValueError, RecursionError):
        pass  # what is refused, and why, is told below
    waiting: dict[int, list[tuple[object, Node]]] = {}
    node = Node("Null")
    for path, kind, begin, end, items in jsontext.values(text):
        if items < 0:
            node = Node("String" if kind == "LongString" else kind, text[begin:end])
        else:
            below = waiting.pop(len(path) + 1, [])
            node = Node(kind, "", [k for k, _ in below] if kind == "Object" else [], [n for _, n in below])
        waiting.setdefault(len(path), []).append((path[-1] if path else None, node))
    return node


def spell(node: Node) -> str:
    """The tree without white space between its tokens."""
    if node.kind == "Object":
        return "{" + ",".join(f'"{k}":{spell(v)}' for k, v in zip(node.keys, node.items, strict=True)) + "}"
    return "[" + ",".join(map(spell, node.items)) + "]" if node.kind == "Array" else node.raw


def walk(node: Node, path: tuple = ()) -> Iterator[tuple[tuple, Node]]:
    """(path, node) of every value, containers before what they hold."""
    waits = [(path, node)]
    while waits:
        path, node = waits.pop()
        yield path, node
        if node.items:
            keys = node.keys if node.kind == "Object" else range(len(node.items))
            waits += [((*path, k), below) for k, below in zip(reversed(keys), reversed(node.items), strict=True)]


def copied(node: Node, visit: Callable, path: tuple = ()) -> Node:
    """A copy whose scalars are what visit(path, node) gives, the same where that is None."""
    if node.kind in ("Object", "Array"):
        keys = node.keys if node.kind == "Object" else range(len(node.items))
        return Node(node.kind, "", list(node.keys), [copied(v, visit, (*path, k)) for k, v in zip(keys, node.items, strict=True)])
    return visit(path, node) or node


#: Characters of a value that a difference shows.
SHOWN = 160


def shown(text: str) -> str:
    return text if len(text) <= SHOWN else text[:SHOWN] + "…"


def differences(whole: Node | None, split: Node | None, path: str = "") -> Iterator[tuple[str, str | None, str | None]]:
    """(path, whole, split) of where two trees are spelled differently, in document order; None is what one lacks.

    Names in another order are told at their object, lengths at their array, and what both have is compared all the same.
    """
    if whole is None or split is None or whole.kind != split.kind:
        if whole is not split:
            yield path, None if whole is None else shown(spell(whole)), None if split is None else shown(spell(split))
    elif whole.kind == "Object":
        if whole.keys != split.keys:
            yield f"{path} (member order)", shown(",".join(whole.keys)), shown(",".join(split.keys))
        for key, value in zip(whole.keys, whole.items, strict=True):
            if (other := split.get(key)) is not None:
                yield from differences(value, other, f"{path}.{key}")
    elif whole.kind == "Array":
        if len(whole.items) != len(split.items):
            yield f"{path} (length)", str(len(whole.items)), str(len(split.items))
        for i, (a, b) in enumerate(zip(whole.items, split.items, strict=False)):
            yield from differences(a, b, f"{path}[{i}]")
    elif whole.raw != split.raw:
        yield path, shown(whole.raw), shown(split.raw)


def parsed(text: str | None) -> Node | None:
    """The tree, or None of what is no JSON text."""
    try:
        return parse(text or "")
    except ValueError:
        return None


def report(whole: Node | None, split: Node | None) -> Iterator[tuple[str, bool, list]]:
    """(member, identical, differences) of the members of two objects, those of the second alone last.

    Where a side is no object, one row stands for the result.
    """
    if whole is None or split is None or whole.kind != "Object" or split.kind != "Object":
        same = whole is not None and split is not None and spell(whole) == spell(split)
        yield "(result)", same, [] if same else [("(result)", whole and shown(spell(whole)), split and shown(spell(split)))]
        return
    for key, value in zip(whole.keys, whole.items, strict=True):
        if (other := split.get(key)) is None:
            yield key, False, [(key, "present", "absent")]
        else:
            found = [] if spell(value) == spell(other) else list(differences(value, other, key))
            yield key, not found, found
    for key in split.keys:
        if key not in whole.keys:
            yield key, False, [(key, "absent", "present")]
