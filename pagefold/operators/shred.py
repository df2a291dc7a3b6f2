"""Shredding of JSON documents to rows of values and members; what follows is relational."""

from __future__ import annotations

import hashlib
import itertools
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from pagefold.functions import arrowrows, jsontext, jsontree, text

MALFORMED = "Malformed"
PLAIN_NAME = re.compile(r'[^.\[\]"\\]+')


def spelled_path(path: tuple, index: str = "[{}]") -> str:
    """`.name[0]` of a path; a name that could be read as more than a name is quoted, so that no two paths look alike."""
    return "".join(index.format(p) if isinstance(p, int) else f".{p}" if PLAIN_NAME.fullmatch(p) else f'."{p}"' for p in path)


def scalars(document: str, containers: bool = False):
    """(path, pattern, parent, top, kind, raw) of every scalar and empty container, in document order; names may repeat.

    With containers, of every container too; its raw value is then its number of items.
    """
    out = []
    for path, kind, begin, end, items in jsontext.values(document):
        if items > 0 and not containers:
            continue
        raw = document[begin:end]
        if kind in ("String", "LongString"):
            kind, raw = "String", jsontext.plain(raw)
        elif items >= 0:
            raw = str(items) if containers else raw[0] + raw[-1]
        names = tuple(jsontext.plain(f'"{p}"') if isinstance(p, str) and "\\" in p else p for p in path)
        top = next((p for p in names if isinstance(p, str)), "")
        out.append((begin, spelled_path(names), spelled_path(names, "[*]"), spelled_path(names[:-1]), top, kind, raw))
    for begin, *row in sorted(out):
        yield row


FIELDS = ("path", "pattern", "parent", "top", "kind", "raw")


def shred(docs: DataFrame, doc: str, text: str, under: tuple[str, ...] = (), containers: bool = False) -> DataFrame:
    """(doc, ord, path, pattern, parent, top, kind, raw): a row for each scalar of each document.

    `under` keeps the values of some top-level members only; the others never leave the task.  A text that is no JSON
    value, or has more behind it, is one row of kind Malformed; a null text is malformed too.  Half surrogates become
    U+FFFD.  With containers, objects and arrays are rows too.
    """
    rows = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"))

    def run(batches):
        for b in arrowrows.slices(batches):
            out = []
            for i, t in enumerate(b.column(1).to_pylist()):
                try:
                    out += [(i, n, *s) for n, s in enumerate(scalars(t or "", containers)) if not under or s[3] in under]
                except ValueError:
                    out.append((i, 0, "", "", "", "", MALFORMED, None))
            at, n, *columns = zip(*out, strict=True) if out else [()] * 8
            told = [pa.array(n, pa.int64()), *(pa.array(c, pa.string()) for c in columns)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *told], ["doc", "ord", *FIELDS])

    schema = f"doc {rows.schema['doc'].dataType.simpleString()}, ord bigint, {', '.join(f'{f} string' for f in FIELDS)}"
    return rows.mapInArrow(run, schema).withColumnRenamed("doc", doc)


def members(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, ord, name, escaped, kind, items, raw): the top-level members of each document, as they are spelled.

    items is -1 for what is no array or object; a text that is no object is one row of kind Malformed.
    """
    rows = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"))

    def run(batches):
        for b in arrowrows.slices(batches):
            out = []
            for i, t in enumerate(b.column(1).to_pylist()):
                try:
                    out += [(i, n, name, "\\" in name, *rest) for n, (name, *rest) in enumerate(jsontext.members(t or ""))]
                except ValueError:
                    out.append((i, 0, "", False, MALFORMED, -1, None))
            at, *columns = zip(*out, strict=True) if out else [()] * 7
            kinds = (pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc", "ord", "name", "escaped", "kind", "items", "raw"])

    schema = f"doc {rows.schema['doc'].dataType.simpleString()}, ord bigint, name string, escaped boolean, kind string, items bigint, raw string"
    return rows.mapInArrow(run, schema).withColumnRenamed("doc", doc)


def rewritten(docs: DataFrame, text_col: str, visit) -> DataFrame:
    """docs with each JSON text's scalars replaced where visit(path, kind, raw) gives a new spelling.

    A text that is no JSON value becomes null; a null stays null.  All other bytes are copied.
    """
    at = docs.columns.index(text_col)

    def run(batches):
        for b in arrowrows.slices(batches):
            new = []
            for t in b.column(at).to_pylist():
                try:
                    new.append(None if t is None else jsontext.rewrite(t, visit))
                except ValueError:
                    new.append(None)
            yield b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


MOMENT = re.compile(text.MOMENT.replace(r"\z", r"\Z"))
GUID = re.compile(text.GUID)


def masked_string(value: str, base: str = "") -> str:
    """text.mask for one value in a task."""
    value = GUID.sub("<guid>", value.replace(base, "<base>") if base else value)
    if not (m := MOMENT.match(value)):
        return value
    zone = m[3] or ""
    return f"<datetime:2006-01-02{m[1]}15:04:05{'.' + '0' * (len(m[2]) - 1) if m[2] else ''}{zone if zone in ('', 'Z', 'z') else '-07:00'}>"


def masked(docs: DataFrame, text_col: str, base: str = "") -> DataFrame:
    """docs with every string value of each JSON text masked; order and numbers stay as they are spelled."""

    def visit(path, kind, raw):
        if kind in ("String", "LongString"):
            new = masked_string(value := jsontext.plain(raw), base)
            return None if new == value else json.dumps(new, ensure_ascii=False)

    return rewritten(docs, text_col, visit)


#: Ids whose values are one block of a digest.
DIGEST_BLOCK = 8192


def digests(rows: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """(keys, n, name): the number of rows of each group, and the MD5 of their values, joined by commas in order.

    A null value is left out of the text, as array_join leaves it out, and is counted.  Blocks of neighbouring ids
    (integers, not null) are joined first, in parallel; a group's digest then runs over its sorted blocks, of which a
    task holds one at a time.  Keys are strings.
    """
    value_of = lambda r: r["v"]
    found = F.filter(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), value_of), lambda v: v.isNotNull())
    at = F.floor(F.col(order) / DIGEST_BLOCK).alias("block")
    blocks = rows.groupBy(*keys, at).agg(F.count("*").alias("n"), F.when(F.size(found) > 0, F.array_join(found, ",")).alias("text"))
    ordered = blocks.select(*keys, "block", "n", "text").repartition(*keys).sortWithinPartitions(*keys, "block")
    names = [*keys, "n", name]

    def run(batches):
        now = n = None
        told, begun = hashlib.md5(usedforsecurity=False), False

        def row():
            return pa.RecordBatch.from_arrays([*(pa.array([k], pa.string()) for k in now), pa.array([n], pa.int64()), pa.array([told.hexdigest()], pa.string())], names)

        for b in batches:
            for i in range(b.num_rows):
                *key, _, more, text = (c[i].as_py() for c in b.columns)
                if key != now:
                    if now is not None:
                        yield row()
                    now, n, told, begun = key, 0, hashlib.md5(usedforsecurity=False), False
                n += more
                if text is not None:
                    told.update(("," + text if begun else text).encode())
                    begun = True
        if now is not None:
            yield row()

    return ordered.mapInArrow(run, f"{', '.join(f'{k} string' for k in keys)}, n bigint, {name} string")


def duplicates(shredded: DataFrame, doc: str) -> DataFrame:
    """(doc, path, n): members that a document names more than once."""
    return shredded.where(F.col("kind") != MALFORMED).groupBy(doc, "path").agg(F.count("*").alias("n")).where("n > 1")


def json_differences(whole: DataFrame, split: DataFrame, doc: str) -> DataFrame:
    """(doc, path, pattern, kind, whole, split) of two relations shredded with containers; order of members is not compared.

    Numbers are compared by value.  An array whose lengths differ is one row, and its common items are compared; what
    only one side has is one row at its top, as is a value of another kind.  kind: changed, type, length, missing, added.
    Repeated names meet in their order.
    """
    nth = F.row_number().over(Window.partitionBy(doc, "path").orderBy("ord"))
    number = F.col("raw").cast("double")
    value = F.when((F.col("kind") == "Number") & number.isNotNull(), number.cast("string")).otherwise(F.col("raw"))
    side = lambda d, n: d.select(doc, "path", nth.alias("nth"), F.struct("kind", value.alias("value"), "pattern", "parent", "raw").alias(n))
    both = side(whole, "w").join(side(split, "s"), [doc, "path", "nth"], "full")
    kind = (
        F.when(F.col("s").isNull(), "missing").when(F.col("w").isNull(), "added").when(F.col("w.kind") != F.col("s.kind"), "type")
        .when((F.col("w.kind") == "Array") & (F.col("w.value") != F.col("s.value")), "length")
        .when(~F.col("w.kind").isin("Array", "Object") & ~F.col("w.value").eqNullSafe(F.col("s.value")), "changed")
    )
    both = both.withColumn("kind", kind).withColumn("parent", F.coalesce("w.parent", "s.parent")).withColumn("pattern", F.coalesce("w.pattern", "s.pattern"))
    objects = both.where((F.col("w.kind") == "Object") & (F.col("s.kind") == "Object")).select(doc, F.col("path").alias("parent")).distinct()
    lone = both.where(F.col("kind").isin("missing", "added"))
    tops = lone.where(F.col("path") != "").join(objects, [doc, "parent"], "left_semi").select(both.columns).unionByName(lone.where(F.col("path") == ""))
    found = both.where(F.col("kind").isin("type", "length", "changed")).unionByName(tops)
    shown = lambda c: F.when(F.col(f"{c}.kind").isin("Array", "Object"), F.concat(F.col(f"{c}.raw"), F.lit(" items"))).otherwise(F.col(f"{c}.raw"))
    return found.select(doc, "path", "pattern", "kind", shown("w").alias("whole"), shown("s").alias("split"))


#: Members, at a path's top or anywhere in it, that a page's own analysis decides.
PAGE_TOPS, PAGE_PARTS = frozenset(("pages", "readResults", "figures")), "boundingRegions"


def level_of(path: tuple) -> str:
    """Whether a page decides a value by itself (`page-level`) or the document as a whole does (`document-level`)."""
    names = [p for p in path if isinstance(p, str)]
    page = names and (names[0] in PAGE_TOPS or PAGE_PARTS in names or names[0] == "tables" and "cells" in names)
    return "page-level" if page else "document-level"


def as_number(raw: str):
    value = float(raw)
    return raw if value in (float("inf"), float("-inf")) else value


def value_differences(whole: jsontree.Node | None, split: jsontree.Node | None, path: tuple = ()):
    """(path, kind, whole, split) of two trees, as json_differences tells them; a missing tree is a malformed text."""
    show = lambda n: n and (f"{len(n.items)} items" if n.kind in ("Object", "Array") else jsontext.plain(n.raw) if n.kind == "String" else n.raw)
    if whole is None or split is None or whole.kind != split.kind:
        if whole is not split:
            yield path, "type", show(whole), show(split)
    elif whole.kind == "Object":
        mine, other = members_of(whole), members_of(split)
        for key, value in mine.items():
            if key in other:
                yield from value_differences(value, other[key], (*path, key[0]))
            else:
                yield (*path, key[0]), "missing", show(value), None
        yield from (((*path, key[0]), "added", None, show(value)) for key, value in other.items() if key not in mine)
    elif whole.kind == "Array":
        if len(whole.items) != len(split.items):
            yield path, "length", show(whole), show(split)
        for i, (a, b) in enumerate(zip(whole.items, split.items, strict=False)):
            yield from value_differences(a, b, (*path, i))
    elif show(whole) != show(split) and not (whole.kind == "Number" and as_number(whole.raw) == as_number(split.raw)):
        yield path, "changed", show(whole), show(split)


def members_of(node: jsontree.Node) -> dict:
    """An object's members by name and by how often the name came before."""
    seen, out = {}, {}
    for key, value in zip(node.keys, node.items, strict=True):
        key = jsontext.plain(f'"{key}"') if "\\" in key else key
        seen[key] = seen.get(key, 0) + 1
        out[key, seen[key]] = value
    return out


def compared(docs: DataFrame, doc: str, whole: str, split: str, told, schema: str, told_equal: bool = False) -> DataFrame:
    """(doc, *schema): the rows that told(whole tree, split tree) gives for the two texts of each row.

    Both sides of a document are compared in one task, so that nothing but differences leaves it.  A null or malformed
    text is None; two of them are alike, as equal texts are.  told_equal: whether equal texts have rows all the same.
    """
    rows = docs.select(F.col(doc).alias("doc"), F.col(whole).alias("whole"), F.col(split).alias("split"))
    names = [c.split(" ")[0] for c in schema.split(", ")]
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for b in arrowrows.slices(batches):
            out = [(i, *row) for i, (w, s) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)) if told_equal or w != s for row in told(jsontree.parsed(w), jsontree.parsed(s))]
            at, *columns = zip(*out, strict=True) if out else [()] * (1 + len(names))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(list(c), f.type) for c, f in zip(columns, target, strict=True))], ["doc", *names])

    return rows.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, {schema}").withColumnRenamed("doc", doc)


def document_differences(docs: DataFrame, doc: str, whole: str, split: str) -> DataFrame:
    """(doc, path, pattern, level, kind, whole, split) of the two texts of each row: json_differences without a shuffle."""

    def told(w, s):
        for path, *rest in value_differences(w, s):
            yield spelled_path(path), spelled_path(path, "[*]"), level_of(path), *rest

    return compared(docs, doc, whole, split, told, "path string, pattern string, level string, kind string, whole string, split string")


def exact_differences(docs: DataFrame, doc: str, whole: str, split: str, limit: int = 20) -> DataFrame:
    """(doc, path, whole, split): where the two texts of each row are spelled differently, the first `limit` of a document.

    The order of members counts, white space between tokens does not.
    """
    return compared(docs, doc, whole, split, lambda w, s: itertools.islice(jsontree.differences(w, s), limit), "path string, whole string, split string")


def member_report(docs: DataFrame, doc: str, whole: str, split: str, most: int = 12) -> DataFrame:
    """(doc, member, identical, n, paths): each top-level member of the two texts of a row, with its first differing paths."""

    def told(w, s):
        for member, identical, found in jsontree.report(w, s):
            yield member, identical, len(found), [p for p, *_ in found[:most]]

    return compared(docs, doc, whole, split, told, "member string, identical boolean, n bigint, paths array<string>", told_equal=True)


def verdict(whole_ok: Column, split_ok: Column, n_differences: Column) -> Column:
    """`equal`, `different`, or `inconclusive` where either side gave no result."""
    return F.when(whole_ok & split_ok, F.when(n_differences == 0, "equal").otherwise("different")).otherwise("inconclusive")
