"""Text units: grapheme clusters (the default), code points and UTF-16 code units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAPHEMES, CODE_POINTS, UTF16 = "textElements", "unicodeCodePoint", "utf16CodeUnit"


def parse_unit(spec: Column) -> Column:
    """The unit that a request names; absent or empty is graphemes, an unknown name null.  Names match exactly."""
    return F.when(F.coalesce(spec, F.lit("")).isin("", GRAPHEMES), F.lit(GRAPHEMES)).when(spec.isin(CODE_POINTS, UTF16), spec)


def unit_length(text: Column, unit: str) -> Column:
    """Length of text in a unit.  A code point above U+FFFF is two UTF-16 units."""
    length = {
        CODE_POINTS: F.length(text),
        UTF16: F.octet_length(F.encode(text, "UTF-16BE")) / 2,
        GRAPHEMES: F.regexp_count(text, F.lit(r"\X")),
    }[unit]
    return length.cast("bigint")


def unit_slice(text: Column, offset: Column, length: Column, unit: str) -> Column:
    """text[offset, offset + length) in a unit; null beyond the text's end, or where it would split a character."""
    if unit == CODE_POINTS:
        return F.when(offset + length <= F.length(text), F.substring(text, offset + 1, length))
    if unit == GRAPHEMES:
        clusters = F.regexp_extract_all(text, F.lit(r"\X"), F.lit(0))
        return F.when(offset + length <= F.size(clusters), F.array_join(F.slice(clusters, offset + 1, length), ""))
    # A unit is two bytes.  A character above U+FFFF is two units, of which the second is DC00 to DFFF: no slice begins or ends there.
    spelled, begin, end = F.encode(text, "UTF-16BE"), offset.cast("int"), (offset + length).cast("int")
    whole = lambda at: ~F.hex(F.substring(spelled, 2 * at + 1, F.lit(1))).rlike("^D[C-F]")
    inside = (begin >= 0) & (begin <= end) & (2 * end <= F.octet_length(spelled))
    return F.when(inside & whole(begin) & whole(end), F.decode(F.substring(spelled, 2 * begin + 1, 2 * (end - begin)), "UTF-16BE"))


def canonical_integer(text: Column, digits: int = 18) -> Column:
    """A non-negative integer in its one spelling, of so many digits at most; else null."""
    return F.when(text.rlike(rf"^(0|[1-9][0-9]{{0,{digits - 1}}})\z"), text.try_cast("bigint"))
