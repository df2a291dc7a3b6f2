"""What a whole result guarantees beyond its schema, as one relation of findings (rule, path).

Every rule concerns one document, so all of them are expressions over its parsed row: no rule shuffles, and nothing is
exploded but the findings.  Texts are cut to blocks of equal numbers of units once, so that the slice of a span costs
its own length and not the content's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagefold.functions import text, units

BLOCK = 256
ASTRAL = r"[\x{10000}-\x{10FFFF}]"
FILL = "￿"

SPANS = "spans: array<struct<offset: bigint, length: bigint>>"
SPAN = "span: struct<offset: bigint, length: bigint>"
REGIONS = "boundingRegions: array<struct<pageNumber: bigint, polygon: array<double>>>"
CAPTION = f"caption: struct<{SPANS}, {REGIONS}, elements: array<string>>"
PAGE = f"""pageNumber: bigint, {SPANS}, words: array<struct<content: string, {SPAN}, polygon: array<double>>>, lines: array<struct<content: string, {SPANS}>>,
    selectionMarks: array<struct<{SPAN}>>, barcodes: array<string>, formulas: array<string>"""
CELL = f"content: string, {SPANS}, {REGIONS}, elements: array<string>, rowIndex: bigint, columnIndex: bigint"
RESULT = f"""apiVersion string, modelId string, stringIndexType string, contentFormat string, content string, pages array<struct<{PAGE}>>,
    paragraphs array<struct<content: string, {SPANS}, {REGIONS}>>, figures array<struct<id: string, {SPANS}, {REGIONS}, elements: array<string>, {CAPTION}>>,
    tables array<struct<rowCount: bigint, columnCount: bigint, {SPANS}, {REGIONS}, {CAPTION}, cells: array<struct<{CELL}>>>>,
    sections array<struct<{SPANS}, elements: array<string>>>, keyValuePairs array<string>, formulas array<string>, broken string"""
LINE = "text: string, boundingBox: array<double>, appearance: string, words: array<struct<text: string, boundingBox: array<double>, confidence: double>>"
READ_RESULT = f"version string, modelVersion string, readResults array<struct<page: bigint, unit: string, lines: array<struct<{LINE}>>>>, broken string"
FINDINGS = "array<struct<rule:string,path:string>>"

# Members every result has, and the readable version.
PRESENT = ("apiVersion", "modelId", "stringIndexType", "content", "pages", "contentFormat")
READ_PRESENT, READ_VERSION = ("version", "modelVersion", "readResults"), "3.2.0"


def finding(rule: str, *path) -> Column:
    return F.struct(F.lit(rule).alias("rule"), F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in path)).alias("path"))


def when(condition: Column, rule: str, *path) -> Column:
    """An array of one finding where the condition holds, else an empty one."""
    return F.when(F.coalesce(condition, F.lit(False)), F.array(finding(rule, *path))).otherwise(F.array().cast(FINDINGS))


def each(items: Column, found) -> Column:
    """The findings of all items of an array that may be null."""
    return F.coalesce(F.flatten(F.transform(items, found)), F.array().cast(FINDINGS))


def let(value: Column, body) -> Column:
    """body(value), the value worked out once though the body names it in loops."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parsed(results: DataFrame, doc: str, raw: str, schema: str, wanted: str | None = None) -> DataFrame:
    """(doc, wanted, keys, r): the members' names in order, and the result; keys is null where the text is no object."""
    options = {"maxStringLen": str(2**31 - 1), "columnNameOfCorruptRecord": "broken"}
    want = F.lit(None) if wanted is None else F.col(wanted)
    return results.select(F.col(doc).alias("doc"), want.cast("array<bigint>").alias("wanted"), F.json_object_keys(raw).alias("keys"), F.from_json(raw, schema, options).alias("r"))


def told(rows: DataFrame, doc: str, *found: Column) -> DataFrame:
    broken = when(F.col("keys").isNull() | F.col("r.broken").isNotNull(), "malformed", "/")
    return rows.select(F.col("doc").alias(doc), F.inline(F.concat(broken, *found)))


def sized(items: Column) -> Column:
    """Number of items; a null array has none."""
    return F.greatest(F.coalesce(F.size(items), F.lit(0)), F.lit(0))


def expected(name: str, want: str | None) -> Column:
    return when(F.coalesce(F.col(f"r.{name}"), F.lit("")) != F.lit(want), "consistent", f"/{name}") if want else F.array().cast(FINDINGS)


def numbered(items: str, key: str, path: str) -> Column:
    """The pages are numbered as `wanted` says, or 1, 2, 3 where that is null."""
    numbers = F.coalesce(F.transform(items, lambda p: F.coalesce(p[key], F.lit(0).cast("bigint"))), F.array().cast("array<bigint>"))
    want = F.coalesce("wanted", F.transform(numbers, lambda _, i: (i + 1).cast("bigint")))
    return when(numbers != want, "page-numbers", path)


def piece(offset: Column, length: Column) -> Column:
    """The content's slice of a span that lies within it; null where it splits a character."""

    def plain(o: Column, n: Column) -> Column:
        first = F.floor(o / BLOCK)
        joined = F.array_join(F.slice("blocks", (first + 1).cast("int"), F.greatest(F.lit(0), F.floor((o + n - 1) / BLOCK) - first + 1).cast("int")), "")
        at, n = (o % BLOCK + 1).cast("int"), n.cast("int")
        clusters = lambda t: F.regexp_extract_all(t, F.lit(r"\X"), F.lit(0))
        return let(joined, lambda t: F.when(F.col("unit") == units.GRAPHEMES, F.array_join(F.slice(clusters(t), at, n), "")).otherwise(F.substring(t, at, n)))

    def unfilled(got: Column) -> Column:
        begins = (offset > 0) & plain(F.greatest(offset - 1, F.lit(0)), F.lit(1)).rlike(ASTRAL)
        whole = F.regexp_replace(got, F.lit(f"({ASTRAL}){FILL}"), F.lit("$1"))
        return F.when(F.col("unit") != units.UTF16, got).when((length == 0) | ~(begins | got.rlike(ASTRAL + r"\z")), whole)

    return let(plain(offset, length), unfilled)


def sound(span: Column) -> Column:
    return F.coalesce((span["offset"] >= 0) & (span["length"] >= 0) & (span["offset"] + span["length"] <= F.col("n")), F.lit(False))


def pieces(spans: Column) -> Column:
    return F.transform(F.coalesce(spans, F.array().cast("array<struct<offset:bigint,length:bigint>>")), lambda s: piece(s["offset"], s["length"]))


def spans_found(spans: Column, *path) -> Column:
    """The first span that is unsound or splits a character."""
    return F.slice(each(spans, lambda s, j: when(~sound(s) | piece(s["offset"], s["length"]).isNull(), "span", *path, "/spans/", j)), 1, 1)


def content_found(rule: str, item: Column, joints: tuple[str, ...], *path) -> Column:
    """The item's content is what its spans hold, joined in one of these ways; unsound spans are told instead."""
    same = lambda got: F.coalesce(item["content"], F.lit("")).isin(*(F.array_join(got, j) for j in joints))
    other = let(pieces(item["spans"]), lambda got: when(~same(got), rule, *path))
    return let(spans_found(item["spans"], *path), lambda bad: F.when(F.size(bad) > 0, bad).otherwise(other))


def regions_found(item: Column, *path) -> Column:
    def one(b, k):
        at = (*path, "/boundingRegions/", k)
        known = F.array_contains(F.col("numbers"), F.coalesce(b["pageNumber"], F.lit(0).cast("bigint")))
        return F.concat(when(~known, "region-page", *at), when(sized(b["polygon"]) != 8, "polygon", *at))

    return each(item["boundingRegions"], one)


def elements_found(item: Column, *path) -> Column:
    def one(e, k):
        name, at = F.regexp_extract(e, r"^/([A-Za-z]+)/([0-9]+)\z", 1), F.regexp_extract(e, r"^/([A-Za-z]+)/([0-9]+)\z", 2)
        known = F.aggregate(F.col("counts"), F.lit(False), lambda got, c: got | ((c["name"] == name) & (at.try_cast("bigint") < c["n"])))
        return when(~F.coalesce(known, F.lit(False)), "pointer", *path, "/elements/", k)

    return each(item["elements"], one)


def marked(item: Column, *path) -> Column:
    return F.concat(spans_found(item["spans"], *path), regions_found(item, *path), elements_found(item, *path))


def captioned(item: Column, *path) -> Column:
    return F.when(item["caption"].isNotNull(), marked(item["caption"], *path, "/caption")).otherwise(F.array().cast(FINDINGS))


def page_found(p: Column, i: Column) -> Column:
    at = ("/pages/", i)
    good = F.filter(F.coalesce(p["spans"], F.array().cast("array<struct<offset:bigint,length:bigint>>")), sound)
    lo = F.coalesce(F.array_min(F.transform(good, lambda s: s["offset"])), F.lit(-1).cast("bigint"))
    hi = F.coalesce(F.array_max(F.transform(good, lambda s: s["offset"] + s["length"])), F.lit(-1).cast("bigint"))
    ends = F.struct(lo.alias("lo"), hi.alias("hi"))

    def word(w, j, page):
        here, s = (*at, "/words/", j), w["span"]
        outside = (s["offset"] < page["lo"]) | (s["offset"] + s["length"] > page["hi"])
        good_word = F.concat(
            when(~F.coalesce(piece(s["offset"], s["length"]) == F.coalesce(w["content"], F.lit("")), F.lit(False)), "word-content", *here),
            when(outside, "word-page", *here),
            when(sized(w["polygon"]) != 8, "polygon", *here),
        )
        return F.when(sound(s), good_word).otherwise(when(F.lit(True), "span", *here, "/span"))

    placed = F.filter(F.transform(p["words"], lambda w, j: F.struct(j.alias("j"), w["span"].alias("span"))), lambda w: sound(w["span"]))

    def late(w, j, words):
        before = F.get(words, j - 1)["span"]
        return when((j > 0) & (w["span"]["offset"] < before["offset"] + before["length"]), "order", *at, "/words/", w["j"])

    def selected(m, j):
        here, s = (*at, "/selectionMarks/", j), m["span"]
        return F.when(sound(s), when(~F.coalesce(piece(s["offset"], s["length"]).isin(":selected:", ":unselected:"), F.lit(False)), "selection-mark", *here)).otherwise(when(F.lit(True), "span", *here, "/span"))

    return F.concat(
        each(p["spans"], lambda s, j: when(~sound(s), "span", *at, "/spans/", j)),
        when(sized(p["spans"]) != 1, "page-span", *at),
        when((sized(p["words"]) == 0) & (hi > lo), "page-words", *at),
        let(ends, lambda page: each(p["words"], lambda w, j: word(w, j, page))), let(placed, lambda words: each(words, lambda w, j: late(w, j, words))),
        each(p["lines"], lambda x, j: content_found("line-content", x, ("",), *at, "/lines/", j)),
        *(when(F.size(p[m]) == 0, "presence", *at, f"/{m}") for m in ("selectionMarks", "barcodes", "formulas")),
        each(p["selectionMarks"], selected),
    )


def joins_found() -> Column:
    """Pages of one sound span follow one another with one line feed between, from 0."""
    single = F.filter(F.transform("r.pages", lambda p, i: F.struct(i.alias("i"), F.size(p["spans"]).alias("spans"), F.get(p["spans"], F.lit(0)).alias("s"))), lambda p: (p["spans"] == 1) & sound(p["s"]))

    def one(p, k, pages):
        before = F.get(pages, k - 1)["s"]
        end = before["offset"] + before["length"]
        off = F.when(k == 0, p["s"]["offset"] != 0).otherwise((p["s"]["offset"] != end + 1) | ~F.coalesce(piece(end, F.lit(1)) == "\n", F.lit(False)))
        return when(off, "page-join", "/pages/", p["i"])

    return F.when(F.col("markdown"), F.array().cast(FINDINGS)).otherwise(let(single, lambda pages: each(pages, lambda p, k: one(p, k, pages))))


def ascending(name: str) -> Column:
    places = F.filter(F.transform(f"r.{name}", lambda x, i: F.struct(i.alias("i"), F.size(x["spans"]).alias("spans"), F.coalesce(F.get(x["spans"], F.lit(0))["offset"], F.lit(0).cast("bigint")).alias("at"))), lambda x: x["spans"] > 0)
    return let(places, lambda ps: each(ps, lambda x, k: when((k > 0) & (x["at"] < F.get(ps, k - 1)["at"]), "order", f"/{name}/", x["i"])))


def figures_found() -> Column:
    ids = F.transform("r.figures", lambda f: F.coalesce(f["id"], F.lit("")))
    number = lambda f, group: F.regexp_extract(F.coalesce(f["id"], F.lit("")), r"^([+-]?[0-9]+)\.([+-]?[0-9]+)\z", group).try_cast("bigint")

    def one(f, i, ids):
        at, first = ("/figures/", i), F.get(f["boundingRegions"], F.lit(0))
        wrong = number(f, 1).isNull() | ((sized(f["boundingRegions"]) > 0) & (F.coalesce(first["pageNumber"], F.lit(0)) != number(f, 1)))
        return F.concat(marked(f, *at), captioned(f, *at), when(F.array_position(ids, F.coalesce(f["id"], F.lit(""))) < i + 1, "figure-id", *at), when(wrong, "figure-id", *at))

    listed = F.array_sort(F.filter(F.transform("r.figures", lambda f, i: F.struct(number(f, 1).alias("page"), i.alias("i"), number(f, 2).alias("n"))), lambda f: f["page"].isNotNull()))

    def skips(f, k, figures):
        before = F.get(figures, k - 1)
        return f["n"] != F.when((k > 0) & (before["page"] == f["page"]), before["n"] + 1).otherwise(1)

    pages = F.array_distinct(F.transform(let(listed, lambda figures: F.filter(figures, lambda f, k: skips(f, k, figures))), lambda f: f["page"]))
    return F.concat(let(ids, lambda names: each(F.col("r.figures"), lambda f, i: one(f, i, names))), each(pages, lambda _: when(F.lit(True), "figure-id", "/figures")))


def table_found(t: Column, i: Column) -> Column:
    at = ("/tables/", i)

    def cell(c, j):
        here = (*at, "/cells/", j)
        row, column = (F.coalesce(c[x], F.lit(0)) for x in ("rowIndex", "columnIndex"))
        out = (row < 0) | (row >= F.coalesce(t["rowCount"], F.lit(0))) | (column < 0) | (column >= F.coalesce(t["columnCount"], F.lit(0)))
        said = F.when(F.col("markdown"), spans_found(c["spans"], *here)).otherwise(content_found("cell-content", c, ("\n", "", " "), *here))
        return F.concat(said, regions_found(c, *here), elements_found(c, *here), when(out, "cell-index", *here))

    return F.concat(spans_found(t["spans"], *at), regions_found(t, *at), each(t["cells"], cell), captioned(t, *at))


def sections_found() -> Column:
    named = lambda items: F.coalesce(F.flatten(F.transform(items, lambda x: F.coalesce(x["elements"], F.array().cast("array<string>")))), F.array().cast("array<string>"))
    captions = lambda items: named(F.transform(items, lambda x: x["caption"]))
    pointers = F.concat(named(F.col("r.sections")), named(F.col("r.figures")), captions(F.col("r.figures")), captions(F.col("r.tables")), named(F.flatten(F.array_compact(F.transform("r.tables", lambda t: t["cells"])))))
    to = F.filter(F.transform(pointers, lambda e: F.regexp_extract(e, r"^/sections/(0|[1-9][0-9]*)\z", 1).try_cast("bigint")), lambda i: i.isNotNull())
    n = sized(F.col("r.sections")).cast("bigint")
    tree = lambda to: F.filter(F.array_sort(to), lambda i: i < n) != F.when(n > 1, F.sequence(F.lit(1).cast("bigint"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    held = lambda to, i: F.size(F.filter(to, lambda p: p == i))
    # Which sections they are is told only where the tree as a whole is wrong.
    wrong = lambda to: each(F.col("r.sections"), lambda _, i: when(F.when(i == 0, held(to, i) > 0).otherwise(held(to, i) != 1), "section-tree", "/sections/", i))
    end = lambda s: F.coalesce(s["offset"], F.lit(0)) + F.coalesce(s["length"], F.lit(0))

    def one(s, i):
        rising = each(s["spans"], lambda sp, j: when((j > 0) & (F.coalesce(sp["offset"], F.lit(0)) <= end(F.get(s["spans"], j - 1))), "section-spans", "/sections/", i, "/spans/", j))
        return F.concat(spans_found(s["spans"], "/sections/", i), elements_found(s, "/sections/", i), rising)

    return F.concat(each(F.col("r.sections"), one), let(to, lambda at: F.when((n > 0) & tree(at), wrong(at)).otherwise(F.array().cast(FINDINGS))))


def result_findings(results: DataFrame, doc: str = "doc_id", raw: str = "result", wanted: str | None = None, expect: dict[str, str] | None = None) -> DataFrame:
    """(doc, rule, path): what is wrong with results that have pages, paragraphs, tables, figures and sections.

    `wanted` names a column of page numbers (array; null: 1, 2, 3 ...), `expect` the values that members must have.  A
    text that is no object, is null, or holds values of other types is a finding `malformed` beside those of the rest.
    A result of an unknown unit has no findings of its spans.  Rows that repeat are told as often as they come.
    """
    rows = parsed(results, doc, raw, RESULT, wanted)
    unit = units.parse_unit(F.col("r.stringIndexType"))
    whole = F.coalesce("r.content", F.lit(""))
    rows = rows.withColumn("unit", unit).withColumn("filled", F.when(F.col("unit") == units.UTF16, F.regexp_replace(whole, F.lit(f"({ASTRAL})"), F.lit("$1" + FILL))).otherwise(whole))
    graphemes = F.col("unit") == units.GRAPHEMES
    cut = lambda pattern: F.regexp_extract_all("filled", F.lit(pattern), F.lit(0))
    rows = rows.withColumn("blocks", F.when(graphemes, cut(rf"\X{{1,{BLOCK}}}+")).otherwise(cut(f"(?s).{{1,{BLOCK}}}+")))
    rows = rows.withColumn("n", F.when(graphemes, F.regexp_count("filled", F.lit(r"\X"))).otherwise(F.length("filled")).cast("bigint"))
    counted = F.array(*(F.struct(F.lit(m).alias("name"), sized(F.col(f"r.{m}")).alias("n")) for m in ("pages", *text.POINTER_MEMBERS, "formulas")))
    rows = rows.withColumn("counts", counted).withColumn("numbers", F.transform("r.pages", lambda p: F.coalesce(p["pageNumber"], F.lit(0).cast("bigint"))))
    rows = rows.withColumn("markdown", F.coalesce(F.col("r.contentFormat") == "markdown", F.lit(False)))

    has = lambda name: F.array_contains("keys", name)
    ends = F.transform("r.pages", lambda p: F.array_max(F.transform(F.filter(p["spans"], sound), lambda s: s["offset"] + s["length"])))
    last = F.array_max(ends)
    paragraph = lambda p, i: F.concat(F.when(F.col("markdown"), spans_found(p["spans"], "/paragraphs/", i)).otherwise(content_found("paragraph-content", p, ("\n", "", " "), "/paragraphs/", i)), regions_found(p, "/paragraphs/", i))
    whole_rules = [
        *(when(~has(k), "present", f"/{k}") for k in PRESENT), *(expected(k, v) for k, v in (expect or {}).items()),
        when(~has("styles"), "presence", "/styles"), when(has("figures") & (sized(F.col("r.figures")) == 0), "presence", "/figures"),
        when(F.col("unit").isNull(), "unit", "/stringIndexType"),
    ]
    span_rules = [
        numbered("r.pages", "pageNumber", "/pages"), each(F.col("r.pages"), page_found), joins_found(),
        when((sized(F.col("r.pages")) > 0) & (F.coalesce(last, F.lit(-1)) != F.col("n")), "page-end", "/pages"),
        each(F.col("r.paragraphs"), paragraph), each(F.col("r.tables"), table_found), figures_found(), sections_found(),
        *(ascending(m) for m in ("paragraphs", "tables", "figures")),
    ]
    known = F.col("unit").isNotNull()
    return told(rows, doc, *whole_rules, F.when(known, F.concat(*span_rules)).otherwise(F.array().cast(FINDINGS)))


def read_findings(results: DataFrame, doc: str = "doc_id", raw: str = "result", wanted: str | None = None, model: str | None = None, unit: str | None = None) -> DataFrame:
    """(doc, rule, path) of results of lines alone; `line-words` is a warning.  Nulls and broken texts as above."""
    rows = parsed(results, doc, raw, READ_RESULT, wanted)

    def line(x, *at):
        def word(w, k):
            here = (*at, "/words/", k)
            return F.concat(when(sized(w["boundingBox"]) != 8, "bbox", *here), when(~F.coalesce(w["confidence"].between(0, 1), F.lit(False)), "confidence", *here))

        said = F.coalesce(x["text"], F.lit(""))
        joined = F.coalesce(F.array_join(F.transform(x["words"], lambda w: F.coalesce(w["text"], F.lit(""))), " "), F.lit(""))
        return F.concat(
            when(sized(x["boundingBox"]) != 8, "bbox", *at), when(said == "", "text", *at), when(x["appearance"].isNull(), "appearance", *at),
            each(x["words"], word), when(joined != said, "line-words", *at),
        )

    def page(p, i):
        other = when(F.coalesce(p["unit"], F.lit("")) != F.lit(unit), "unit", "/readResults/", i, "/unit") if unit else F.array().cast(FINDINGS)
        return F.concat(other, each(p["lines"], lambda x, j: line(x, "/readResults/", i, "/lines/", j)))

    return told(
        rows, doc, *(when(~F.array_contains("keys", k), "present", f"/{k}") for k in READ_PRESENT),
        when(F.coalesce("r.version", F.lit("")) != READ_VERSION, "version", "/version"), expected("modelVersion", model),
        numbered("r.readResults", "page", "/readResults"), each(F.col("r.readResults"), page),
    )


def envelope_findings(bodies: DataFrame, doc: str = "doc_id", raw: str = "body", has_error: bool = True) -> DataFrame:
    """(doc, rule, path) of operation envelopes: status first and the times behind it, a result if and only if the
    operation succeeded, an error member only on a failed one, and on none where has_error is false."""
    order = F.array(*map(F.lit, ("status", "createdDateTime", "lastUpdatedDateTime")))
    rows = parsed(bodies, doc, raw, "status string, broken string")
    got = F.filter("keys", lambda k: F.array_contains(order, k))
    status, has = F.coalesce("r.status", F.lit("")), lambda name: F.coalesce(F.array_contains("keys", name), F.lit(False))
    late = ~F.coalesce(F.get("keys", F.lit(0)) == "status", F.lit(False)) | (got != F.slice(order, F.lit(1), F.size(got)))
    result = (status == "succeeded") != has("analyzeResult")
    return told(
        rows, doc, when(F.col("keys").isNotNull() & late, "key-order", "/"), when(F.col("keys").isNotNull() & result, "result", "/analyzeResult"),
        when(has("error") & (F.lit(not has_error) | (status != "failed")), "error-member", "/error"),
    )
