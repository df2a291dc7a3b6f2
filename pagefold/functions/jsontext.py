"""JSON text as it is spelled: one pass over the values of a document, rewriting of scalars, splicing of arrays.

Small helpers for Arrow tasks.  Every text is validated as it is read; what is not rewritten is copied byte for byte.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

# Limits of a scalar's, a name's and a document's spelling.
MOST_STRING, MOST_NUMBER, MOST_NAME, MOST_DEPTH = 4096, 4096, 4096, 10_000

_PLAIN = r'[^"\\\x00-\x1f]*+'
_STRING = rf'"{_PLAIN}(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{{4}}){_PLAIN})*+"'
_NUMBER = r"-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?"
_BLANK = r"[ \t\r\n]*+"
#: A value's beginning: an opened container, a scalar with the mark behind it, if there is one, or the end of an empty array.
VALUE = re.compile(rf"{_BLANK}(?:([{{\[])|(?:({_STRING})|({_NUMBER})|(true|false|null)){_BLANK}([,\]}}])?|(\]))")
NAME = re.compile(rf"{_BLANK}({_STRING}){_BLANK}:")
MARK = re.compile(rf"{_BLANK}([,\]}}])")
BLANK, BLANKS = re.compile(r"[ \t\r\n]*"), frozenset(" \t\r\n")
SCALARS = frozenset(("String", "LongString", "Number", "Bool", "Null"))
CANONICAL = re.compile(r"0|[1-9][0-9]{0,17}")


class Malformed(ValueError):
    """The text is no JSON value, has more behind it, or is beyond a limit."""


def canonical(raw: str) -> int | None:
    """A non-negative integer in its one spelling."""
    return int(raw) if CANONICAL.fullmatch(raw) else None


def plain(raw: str) -> str:
    """The text of a spelled string; half a surrogate pair becomes U+FFFD, as no UTF-8 can hold it."""
    text = json.loads(raw)
    return text if text.isascii() else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def bytes_beyond(string: str, most: int) -> bool:
    """Whether a spelled string has more than `most` bytes between its quotation marks."""
    n = len(string) - 2
    return n > most or n * 4 > most and not string.isascii() and len(string.encode()) - 2 > most


def checked_name(name: str) -> str:
    """A name without escapes, if it is within its limit."""
    if len(name) * 4 > MOST_NAME and len(name.encode()) > MOST_NAME:
        raise Malformed("a name is too long")
    return name


def checked_number(raw: str) -> str:
    if len(raw) > MOST_NUMBER:
        raise Malformed("a number is too long")
    return raw


def refused(word: str):
    raise Malformed(f"{word} is no JSON")


ESCAPE = re.compile(r'\\(["\\/bfnrt]|u[0-9a-fA-F]{4})')
TWICE = {'"': '\\"', "\\": "\\\\"}


def twice_escaped(text: str) -> str:
    """A JSON text whose strings are read as they are spelled in the given one; what is malformed stays so."""
    return ESCAPE.sub(lambda m: "\\\\" + TWICE.get(m[1], m[1]), text) if "\\" in text else text


class Decoder(json.JSONDecoder):
    """The standard library's decoder with hooks, which can be shipped to tasks."""

    def __init__(self, objects: Callable | None, numbers: Callable | None):
        self.hooks = objects, numbers
        super().__init__(object_pairs_hook=objects, parse_int=numbers, parse_float=numbers, parse_constant=refused)

    def __reduce__(self):
        return Decoder, self.hooks


class Number(str):
    """A number as it is spelled."""


class Pairs(list):
    """An object's members (name, value), which may repeat."""


def pairs_of(pairs: list) -> Pairs:
    for name, _ in pairs:
        checked_name(name)
    return Pairs(pairs)


def number_of(raw: str) -> Number:
    return Number(checked_number(raw))


DECODER = Decoder(pairs_of, number_of)
#: Checks the grammar alone; for texts in which no name or number can be beyond its limit.
GRAMMAR = Decoder(None, None)


def grammar_of(text: str) -> Callable:
    """What finds the end of a value in text, within the limits of names and numbers."""
    small = len(text) * (1 if text.isascii() else 4) <= min(MOST_NAME, MOST_NUMBER)
    return (GRAMMAR if small else DECODER).raw_decode


def blank_end(text: str, at: int) -> int:
    return BLANK.match(text, at).end() if text[at : at + 1] in BLANKS else at


def members_at(text: str, at: int, decode: Callable) -> tuple[list, int]:
    """([(spelled name, start, end)], end) of the members of the object that opens at `at`."""
    out, at = [], blank_end(text, at + 1)
    if text[at : at + 1] == "}":
        return out, at + 1
    mark = ","
    while mark == ",":
        if not (m := NAME.match(text, at)):
            raise Malformed(f"no name at {at}")
        begin = blank_end(text, m.end())
        end = decode(text, begin)[1]
        out.append((checked_name(m[1][1:-1]), begin, end))
        if not (m := MARK.match(text, end)) or (mark := m[1]) == "]":
            raise Malformed(f"no comma at {end}")
        at = m.end()
    return out, at


def object_members(text: str) -> list[tuple[str, int, int]] | None:
    """(spelled name, start, end) of an object's members; None where the standard library does not read it."""
    try:
        at = blank_end(text, 0)
        out, at = members_at(text, at, grammar_of(text)) if text[at : at + 1] == "{" else (None, 0)
    except (ValueError, RecursionError):
        return None
    return out if out is not None and BLANK.fullmatch(text, at) else None


def array_members(text: str) -> list[tuple[int, int, list | None]] | None:
    """(start, end, members_at()) of an array's items; None where the standard library does not read it.

    The members of an item that is no object are None.  None for the array says nothing of the text: what is malformed
    is told by `values`.
    """
    decode, out = grammar_of(text), []
    try:
        at = blank_end(text, 0)
        if text[at : at + 1] != "[":
            return None
        at = blank_end(text, at + 1)
        mark = "," if text[at : at + 1] != "]" else "]"
        at += mark == "]"
        while mark == ",":
            begin = blank_end(text, at)
            members, end = members_at(text, begin, decode) if text[begin : begin + 1] == "{" else (None, decode(text, begin)[1])
            out.append((begin, end, members))
            if not (m := MARK.match(text, end)) or (mark := m[1]) == "}":
                return None
            at = m.end()
    except (ValueError, RecursionError):
        return None
    return out if BLANK.fullmatch(text, at) else None


def decoded_members(text: str) -> list[tuple] | None:
    """(spelled name, value, raw) of an object's members; None where the standard library does not read it.

    Values have strings as they are spelled, numbers as Number and objects as Pairs.  None says nothing of the text:
    what is malformed is told by `values`.
    """
    out = []
    try:
        at = BLANK.match(text).end()
        if text[at : at + 1] != "{":
            return None
        at = BLANK.match(text, at + 1).end()
        more = text[at : at + 1] != "}"
        at += not more
        while more:
            if not (m := NAME.match(text, at)):
                return None
            name, begin = checked_name(m[1][1:-1]), BLANK.match(text, m.end()).end()
            value, end = DECODER.raw_decode(text, begin)
            raw = text[begin:end]
            if "\\" in raw:
                value = DECODER.decode(twice_escaped(raw))
            if not (m := MARK.match(text, end)) or m[1] == "]":
                return None
            out.append((name, value, raw))
            at, more = m.end(), m[1] == ","
    except (ValueError, RecursionError):
        return None
    return out if BLANK.fullmatch(text, at) else None


def kind_of(value) -> str:
    """String, Number, Array, Object, Null or Bool."""
    return {Number: "Number", Pairs: "Object", str: "String", list: "Array", bool: "Bool"}.get(type(value), "Null")


def values(text: str) -> Iterator[tuple[tuple, str, int, int, int]]:
    """(path, kind, start, end, items) of every value, containers when they end; items is -1 for a scalar.

    A path is a tuple of spelled names (without quotes) and indexes.
    """
    # Of each open container: kind, start, its path, items; key: the name or index of the value that comes next.
    stack: list[list] = []
    at, path, key, empty = 0, (), None, False
    value_at, name_at, mark_at = VALUE.match, NAME.match, MARK.match

    def name(at: int) -> tuple[str, int]:
        if not (m := name_at(text, at)):
            raise Malformed(f"no name at {at}")
        if bytes_beyond(m[1], MOST_NAME):
            raise Malformed("a name is too long")
        return m[1][1:-1], m.end()

    while True:
        if not (m := value_at(text, at)):
            raise Malformed(f"no value at {at}")
        opened, string, number, word, mark, closed = m.groups()
        at = m.end()
        if opened:
            if len(stack) >= MOST_DEPTH:
                raise Malformed("too deep")
            path = (*path, key) if stack else ()
            if opened == "[":
                stack.append(["Array", at - 1, path, 0])
                key, empty = 0, True
                continue
            stack.append(["Object", at - 1, path, 0])
            if not ((m := mark_at(text, at)) and m[1] == "}"):
                key, at = name(at)
                empty = False
                continue
            mark, at = "}", m.end()
        elif closed:
            if not empty:
                raise Malformed(f"] at {at - 1}")
            mark = "]"
        else:
            own = (*path, key) if stack else ()
            if string:
                yield own, "LongString" if bytes_beyond(string, MOST_STRING) else "String", m.start(2), m.end(2), -1
            elif number:
                if len(number) > MOST_NUMBER:
                    raise Malformed("a number is too long")
                yield own, "Number", m.start(3), m.end(3), -1
            else:
                yield own, "Null" if word == "null" else "Bool", m.start(4), m.end(4), -1
            if not stack:
                if mark:
                    raise Malformed("more behind the value")
                break
            stack[-1][3] += 1
        empty = False
        # Behind a value, or at a container's end: the next value, or the end of what holds it.
        while True:
            if mark is None:
                if not (m := mark_at(text, at)):
                    raise Malformed(f"no comma at {at}")
                mark, at = m[1], m.end()
            top = stack[-1]
            if mark == ",":
                if top[0] == "Object":
                    key, at = name(at)
                else:
                    key = top[3]
                break
            if mark != ("}" if top[0] == "Object" else "]"):
                raise Malformed(f"{mark} at {at - 1}")
            stack.pop()
            yield top[2], top[0], top[1], at, top[3]
            if not stack:
                break
            stack[-1][3] += 1
            path, mark = stack[-1][2], None
        if not stack:
            break
    if BLANK.fullmatch(text, at) is None:
        raise Malformed("more behind the value")


def rewrite(text: str, visit: Callable, prefix: tuple = ()) -> str:
    """text with scalars replaced where visit(path, kind, raw) gives a new spelling; all else is copied as it is."""
    out, done = [], 0
    for path, kind, begin, end, _ in values(text):
        if kind in SCALARS and (new := visit(prefix + path, kind, text[begin:end])) is not None:
            out += [text[done:begin], new]
            done = end
    return "".join([*out, text[done:]])


def array_items(text: str, visit: Callable, name: str) -> tuple[str, int]:
    """(items without their brackets, number of them) of an array member, its scalars rewritten, in one pass."""
    out, done, items, prefix = [], 0, -1, (name,)
    for path, kind, begin, end, n in values(text):
        if kind in SCALARS:
            if (new := visit(prefix + path, kind, text[begin:end])) is not None:
                out += [text[done:begin], new]
                done = end
        elif not path and kind == "Array":
            items = n
    if items < 0:
        raise Malformed("no array")
    return "".join([*out, text[done:]]).strip(" \t\r\n")[1:-1], items


def renumbered(text: str, key: str, number: Callable) -> tuple[str, int] | None:
    """array_items() where only the numbers and other scalars under `key` of each item are rewritten; None where array_members is."""
    items = array_members(text)
    if items is None:
        return None
    out, done = [], 0
    for *_, found in items:
        for name, begin, end in found or ():
            if name == key and text[begin] not in "{[":
                kind = "Number" if text[begin] in "-0123456789" else "String" if text[begin] == '"' else "Bool"
                out += [text[done:begin], number(kind, text[begin:end])]
                done = end
    return "".join([*out, text[done:]]).strip(" \t\r\n")[1:-1], len(items)


def members(text: str) -> list[tuple[str, str, int, str]]:
    """(spelled name, kind, items, raw value) of an object's members, in order; names may repeat."""
    out = []
    for path, kind, begin, end, items in values(text):
        if len(path) == 1 and isinstance(path[0], str):
            out.append((path[0], kind, items, text[begin:end]))
        elif not path and kind != "Object":
            raise Malformed("no object")
    return out
