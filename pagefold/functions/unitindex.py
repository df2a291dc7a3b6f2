"""Where the units of a text stand in its escaped JSON spelling: slices that keep the spelling's bytes.

A helper of Arrow tasks.  Positions are kept as two arrays of numbers, from units to characters and from characters to
places in the spelling; where nothing is escaped, or units are characters, an array is not needed.
"""

from __future__ import annotations

import re

import numpy as np

from pagefold.functions import jsontext, units

#: One character as it is spelled: a surrogate pair, another escape, or itself.
SPELLED = re.compile(r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\.|[^\\]", re.DOTALL)


class NotOnUnit(ValueError):
    """An offset beyond the text, or inside a unit."""


class EscapedText:
    """A spelled JSON string with its text; offsets are in `unit`.

    Graphemes are told by `clusters`, their lengths in characters, so that one counter decides everywhere.
    """

    def __init__(self, spelled: str, unit: str, clusters: list[int] | None = None):
        self.spelled, self.text = spelled, jsontext.plain(spelled)
        self.raw_at = self.char_at = None
        if "\\" in spelled:
            lengths = [len(m) for m in SPELLED.findall(spelled[1:-1])]
            if len(lengths) != len(self.text):
                raise NotOnUnit("the spelling and the text have different numbers of characters")
            self.raw_at = np.cumsum([1, *lengths])
        if unit == units.UTF16:
            wide = np.array([ord(c) > 0xFFFF for c in self.text], bool) if not self.text.isascii() else np.zeros(0, bool)
            if wide.any():
                # The second half of a wide character is inside it, as -1 says.
                self.char_at = np.full(len(self.text) + int(wide.sum()) + 1, -1)
                self.char_at[np.arange(len(self.text) + 1) + np.r_[0, np.cumsum(wide)]] = np.arange(len(self.text) + 1)
        elif unit == units.GRAPHEMES and clusters is not None:
            if sum(clusters) != len(self.text):
                raise NotOnUnit("the clusters are not those of the text")
            if len(clusters) != len(self.text):
                self.char_at = np.cumsum([0, *clusters])

    def __len__(self) -> int:
        return len(self.text if self.char_at is None else self.char_at) - (self.char_at is not None)

    def char(self, offset: int) -> int:
        """The character that a unit begins at."""
        if not 0 <= offset <= len(self):
            raise NotOnUnit(f"{offset} is beyond the {len(self)} units")
        at = offset if self.char_at is None else int(self.char_at[offset])
        if at < 0:
            raise NotOnUnit(f"{offset} is inside a character")
        return at

    def part(self, a: int, b: int) -> str:
        """The text of the units from a to b."""
        return self.text[self.char(a) : self.char(b)]

    def raw(self, a: int, b: int) -> str:
        """The spelling of the units from a to b, without quotation marks."""
        a, b = self.char(a), self.char(b)
        return self.spelled[a + 1 : b + 1] if self.raw_at is None else self.spelled[self.raw_at[a] : self.raw_at[b]]

    def unit_at(self, char: int) -> int:
        """The unit that begins at a character."""
        if self.char_at is None:
            return char
        at = np.flatnonzero(self.char_at == char)
        if not len(at):
            raise NotOnUnit(f"character {char} begins no unit")
        return int(at[0])
