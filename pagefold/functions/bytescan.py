"""Where the members of a JSON object begin and end, told from chunks of bytes: memory does not grow with the document.

A helper of tasks that read files.  Strings and brackets are followed, values are not checked otherwise: who needs that
reads the range that it wants with jsontext.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from pagefold.functions.jsontext import MOST_DEPTH, MOST_NAME, Malformed

MARK = re.compile(rb'["{}\[\],:]')
QUOTE = re.compile(rb'[\\"]')
BLANKS = b" \t\r\n"


class Scanner:
    """Fed with chunks, yields (name, start, end) of each member as it ends; done() tells what is missing at the end.

    The name is as it is spelled; start and end are byte offsets of the value.  The state is a few numbers, a name, and a
    byte for each open container.
    """

    def __init__(self):
        self.base = 0  # bytes before the chunk
        self.open = bytearray()
        self.string = self.escaped = self.ended = False
        self.name: bytearray | None = None  # of the string that is read as a name
        self.key: str | None = None  # of the member whose value is read
        self.wants = "{"
        self.start, self.last = -1, 0  # of the value, and behind the last byte that is no blank

    def feed(self, chunk: bytes) -> Iterator[tuple[str, int, int]]:
        at = 0
        while at < len(chunk):
            if self.string:
                at = self.inside(chunk, at)
                continue
            m = MARK.search(chunk, at)
            stop = m.start() if m else len(chunk)
            self.plain(chunk, at, stop)
            if not m:
                break
            at = stop + 1
            if (found := self.mark(chunk[stop], self.base + stop)) is not None:
                yield found
        self.base += len(chunk)

    def plain(self, chunk: bytes, at: int, stop: int) -> None:
        """Bytes between marks: scalars other than strings, and blanks."""
        own = chunk[at:stop]
        if not (seen := own.strip(BLANKS)):
            return
        begin = self.base + at + len(own) - len(own.lstrip(BLANKS))
        if self.wants != "value" and not (self.key is not None and self.start >= 0):
            raise Malformed(f"{seen[:10]!r} at {begin}")
        self.begin(begin)
        self.last = begin + len(seen)

    def begin(self, at: int) -> None:
        if self.wants == "value":
            self.start, self.wants = at, ", or }"

    def inside(self, chunk: bytes, at: int) -> int:
        """The bytes of a string, to its end or the chunk's."""
        if self.escaped:
            self.escaped, stop = False, at + 1
        else:
            m = QUOTE.search(chunk, at)
            stop = m.end() if m else len(chunk)
            if m and m[0] == b"\\":
                self.escaped = True
            elif m:
                self.string = False
        if self.name is not None:
            self.name += chunk[at : stop - (not self.string)]
            if len(self.name) > MOST_NAME:
                raise Malformed("a name is too long")
            if not self.string:
                self.key, self.name, self.wants = self.name.decode(), None, ":"
        self.last = self.base + stop
        return stop

    def mark(self, mark: int, at: int) -> tuple[str, int, int] | None:
        if mark == 0x22:
            if len(self.open) == 1 and self.wants in ("name", "name or }"):
                self.name = bytearray()
            elif self.wants == "value" or len(self.open) > 1:
                self.begin(at)
            else:
                raise Malformed(f"a string at {at}")
            self.string, self.last = True, at + 1
        elif mark in b"{[":
            if not self.open:
                if mark != 0x7B or self.wants != "{":
                    raise Malformed("no object")
                self.wants = "name or }"
            elif len(self.open) == 1 and self.wants != "value":
                raise Malformed(f"a container at {at}")
            else:
                self.begin(at)
            if len(self.open) >= MOST_DEPTH:
                raise Malformed("too deep")
            self.open.append(mark)
        elif mark in b"}]":
            if not self.open or self.open[-1] != mark - 2:
                raise Malformed(f"{chr(mark)} at {at}")
            found = None
            if len(self.open) == 1:
                if self.wants not in ("name or }", ", or }"):
                    raise Malformed(f"no member before {at}")
                found, self.ended, self.wants = self.member(), True, "end"
            self.open.pop()
            self.last = at + 1
            return found
        elif len(self.open) == 1:
            if mark == 0x3A and self.wants == ":":
                self.wants = "value"
            elif mark == 0x2C and self.wants == ", or }":
                found, self.wants = self.member(), "name"
                return found
            else:
                raise Malformed(f"{chr(mark)} at {at}")
        elif not self.open:
            raise Malformed(f"{chr(mark)} at {at}")
        else:
            self.last = at + 1
        return None

    def member(self) -> tuple[str, int, int] | None:
        if self.key is None:
            return None
        found = self.key, self.start, self.last
        self.key, self.start = None, -1
        return found

    def done(self) -> None:
        if not self.ended or self.string:
            raise Malformed("the text ends early")


def member_ranges(chunks: Iterable[bytes], most_bytes: int | None = None) -> Iterator[tuple[str, int, int]]:
    """(spelled name, start, end) of the members of an object that comes in chunks; Malformed beyond most_bytes."""
    scanner = Scanner()
    for chunk in chunks:
        if most_bytes is not None and scanner.base + len(chunk) > most_bytes:
            raise Malformed(f"more than {most_bytes} bytes")
        yield from scanner.feed(chunk)
    scanner.done()
