"""Pointers, figure ids, masks, bounded renderings and URL redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The members that an element pointer may name.
POINTER_MEMBERS = ("paragraphs", "tables", "figures", "sections", "keyValuePairs")
GUID = r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
#: A value that is a timestamp as a whole: what stands between date and time, the fraction, the zone.
MOMENT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([Tt ])[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})?\z"


def pointer(text: Column, members=POINTER_MEMBERS) -> Column:
    """struct<member, index> of `/member/index`; null where it is malformed or names another member."""
    member, index = F.regexp_extract(text, r"^/([^/]+)/(0|[1-9][0-9]{0,17})\z", 1), F.regexp_extract(text, r"^/([^/]+)/(0|[1-9][0-9]{0,17})\z", 2)
    return F.when(member.isin(*members), F.struct(member.alias("member"), index.try_cast("bigint").alias("index")))


def figure_id(text: Column) -> Column:
    """struct<page, rest> of `<page>.<n>`; the text behind the page stays as it is spelled."""
    ok = text.rlike(r"^[1-9][0-9]{0,8}\.[0-9]+\z")
    return F.when(ok, F.struct(F.substring_index(text, ".", 1).try_cast("int").alias("page"), F.substring_index(text, ".", -1).alias("rest")))


def mask(text: Column, base: Column | None = None) -> Column:
    """Volatile parts of a value replaced: the base address, GUIDs, and a value that is a timestamp as a whole."""
    plain = text if base is None else F.when(base == "", text).otherwise(F.replace(text, base, F.lit("<base>")))
    plain = F.regexp_replace(plain, GUID, "<guid>")
    between, fraction, zone = (F.regexp_extract(plain, MOMENT, i) for i in (1, 2, 3))
    digits = F.when(fraction == "", "").otherwise(F.concat(F.lit("."), F.repeat(F.lit("0"), F.length(fraction) - 1)))
    layout = F.concat(F.lit("<datetime:2006-01-02"), between, F.lit("15:04:05"), digits, F.when(zone.isin("", "Z", "z"), zone).otherwise("-07:00"), F.lit(">"))
    return F.when(plain.rlike(MOMENT), layout).otherwise(plain)


def bounded(text: Column, most: int = 80) -> Column:
    """At most so many characters, and an ellipsis where some are left out; `(absent)` for null."""
    return F.when(text.isNull(), F.lit("(absent)")).when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("…"))).otherwise(text)


def rendered(raw: Column, most: int = 80) -> Column:
    """A spelled JSON value, at most so many bytes of it and an ellipsis; `(absent)` for null."""
    cut = F.make_valid_utf8(F.substring(F.encode(raw, "UTF-8"), 1, most).cast("string"))
    return F.when(raw.isNull(), F.lit("(absent)")).when(F.octet_length(raw) > most, F.concat(cut, F.lit("…"))).otherwise(raw)


def redact_url(url: Column) -> Column:
    """The password of a URL's user part removed."""
    return F.regexp_replace(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/:@]*):[^/@]*@", "$1:xxxxx@")


def level_of(keys: Column) -> Column:
    """`page` or `document`: the level at which a path of member names lies."""
    first = F.get(keys, F.lit(0))
    page = first.isin("pages", "readResults", "figures") | F.array_contains(keys, "boundingRegions") | ((first == "tables") & F.array_contains(keys, "cells"))
    return F.when(F.coalesce(page, F.lit(False)), F.lit("page")).otherwise(F.lit("document"))
