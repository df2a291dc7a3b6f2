"""Queries of JSON merging, rewriting, comparing and of the decisions around them, with their oracle SQL.

Results of parts are made of the driver's tables: a conversation is a document and each of its turns the result of a
part of one page; an order's distinct line numbers are the pages of a result without cross-references.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pagefold.catalog import ATTEMPTS, JOBS, NOW, P, attempt_log, job_rows, order_pages, query, read, spread
from pagefold.functions import pages, policy, text, units
from pagefold.operators import attempts, diffing, invariants, jobs, metrics, planning, schema, shred
from pagefold.plans import assembly, cutting
from pagefold.sources import generated


def quoted(column):
    """A JSON string of a text."""
    return F.expr(f"substring(to_json(struct({column} as s)), 6, length(to_json(struct({column} as s))) - 6)")


#: One part's result, for Spark and DuckDB alike: {q} is the text as a JSON string, {n} its length.
PART = """concat('{{"apiVersion":"v1","modelId":"m","stringIndexType":"unicodeCodePoint","content":', {q}, ',"pages":[{{"pageNumber":1,"unit":"inch","spans":[{{"offset":0,"length":', {n}, '}}]}}],"paragraphs":[{{"spans":[{{"offset":0,"length":', {n}, '}}],"boundingRegions":[{{"pageNumber":1}}],"score":1.50}}],"figures":[{{"id":"1.7","elements":["/paragraphs/0"]}}]}}')"""


def conversation_parts(spark, sf_dir):
    """(doc_id, k, planned, raw, text): every turn as the result of the page behind its number."""
    turns = spread(read(spark, sf_dir, "conversations"), "conv_id", 5_000).select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.withColumn("q", quoted("text"))
    return turns.select("doc_id", "k", F.array((F.col("k") + 1).cast("int")).alias("planned"), F.expr(PART.format(q="q", n="length(text)")).alias("raw"), "text")


MERGED = """WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations),
    s AS (SELECT *, length(text) AS n, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM c),
    m AS (SELECT conv_id AS doc_id, count(*) AS pages, '{"apiVersion":"v1","modelId":"m","stringIndexType":"unicodeCodePoint","content":' || to_json(string_agg(text, chr(10) ORDER BY turn))::VARCHAR || ',"pages":['
        || string_agg('{"pageNumber":' || (turn + 1) || ',"unit":"inch","spans":[{"offset":' || o || ',"length":' || n || '}]}', ',' ORDER BY turn) || '],"paragraphs":['
        || string_agg('{"spans":[{"offset":' || o || ',"length":' || n || '}],"boundingRegions":[{"pageNumber":' || (turn + 1) || '}],"score":1.50}', ',' ORDER BY turn) || '],"figures":['
        || string_agg('{"id":"' || (turn + 1) || '.7","elements":["/paragraphs/' || i || '"]}', ',' ORDER BY turn) || ']}' AS result FROM s GROUP BY conv_id)"""


@query(MERGED + " SELECT doc_id, pages, md5(result) AS result_md5, CAST(octet_length(encode(result)) AS BIGINT) AS bytes FROM m")
def merged_results(spark, sf_dir):
    """Every conversation's parts merged, byte for byte."""
    out, _, _ = assembly.merged(conversation_parts(spark, sf_dir), unit=units.CODE_POINTS)
    return out.select("doc_id", "pages", F.md5("result").alias("result_md5"), "bytes")


@query(MERGED + " SELECT doc_id, name, pages AS items FROM m, (SELECT unnest(['pages', 'paragraphs', 'figures']) AS name)")
def merged_counts(spark, sf_dir):
    return assembly.merged(conversation_parts(spark, sf_dir), unit=units.CODE_POINTS)[1].select("doc_id", "name", F.col("items").cast("bigint").alias("items"))


#: Spelled sections of a turn's part: every third turn opens a section of its own, the others have a root alone.
TREES = """case when {k} % 3 = 0 then concat(',"sections":[{{"spans":[{{"offset":0,"length":', {n}, '}}],"elements":["/sections/1"]}},{{"spans":[{{"offset":0,"length":', {n}, '}}],"elements":["/paragraphs/0","/paragraphs/1"]}}]}}')
    else concat(',"sections":[{{"spans":[{{"offset":0,"length":', {n}, '}}],"elements":["/paragraphs/0"]}}]}}') end"""


def sectioned_parts(spark, sf_dir):
    """(doc_id, k, planned, raw): every turn as a result with sections; the turns of a section are a heading's and those behind it."""
    parts = conversation_parts(spark, sf_dir).withColumn("n", F.length("text"))
    parts = parts.withColumn("raw", F.replace("raw", F.lit('"id":"1.7"'), F.lit('"id":"1.7","boundingRegions":[{"pageNumber":1}]')))
    heading = F.replace("raw", F.lit('"paragraphs":['), F.lit('"paragraphs":[{"role":"sectionHeading","spans":[],"boundingRegions":[{"pageNumber":1}]},'))
    raw = F.expr(f"concat(substring(raw, 1, length(raw) - 1), {TREES.format(k='k', n='n')})")
    return parts.withColumn("raw", F.when(F.col("k") % 3 == 0, heading).otherwise(F.col("raw"))).select("doc_id", "k", "planned", raw.alias("raw"))


@query("""WITH s AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n, coalesce(sum(length(coalesce(text, '')) + 1) OVER w, 0)::BIGINT AS o,
        coalesce(sum(CASE WHEN turn % 3 = 0 THEN 2 ELSE 1 END) OVER w, 0)::BIGINT AS base, turn // 3 AS g FROM conversations
        WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    g AS (SELECT conv_id, g, min(o) AS a, max(o + n) AS b, string_agg('"/paragraphs/' || base || '"' || CASE WHEN turn % 3 = 0 THEN ',"/paragraphs/' || (base + 1) || '"' ELSE '' END, ',' ORDER BY turn) AS e FROM s GROUP BY conv_id, g),
    d AS (SELECT conv_id, '[{"spans":[{"offset":0,"length":' || max(b) || '}],"elements":[' || string_agg('"/sections/' || (g + 1) || '"', ',' ORDER BY g) || ']},'
        || string_agg('{"spans":[{"offset":' || a || ',"length":' || (b - a) || '}],"elements":[' || e || ']}', ',' ORDER BY g) || ']' AS tree, count(*) + 1 AS items FROM g GROUP BY conv_id)
    SELECT conv_id AS doc_id, md5(tree) AS sections_md5, items FROM d""")
def merged_sections(spark, sf_dir):
    """Turns without a heading continue the section that an earlier turn left open; one section for three turns."""
    found = assembly.documents(sectioned_parts(spark, sf_dir), unit=units.CODE_POINTS)
    tree = F.substring_index("result", '"sections":', -1)
    n = F.filter("counts", lambda c: c["name"] == "sections")
    return found.where(F.size("codes") == 0).select("doc_id", F.md5(F.left(tree, F.length(tree) - 1)).alias("sections_md5"), F.get(n, F.lit(0))["items"].alias("items"))


@query("SELECT conv_id AS doc_id, count(*) AS pages, ceil(count(*) / 2.0)::BIGINT AS parts, true AS same FROM conversations GROUP BY conv_id")
def layout_round_trip(spark, sf_dir):
    """Whole results with sections, figures and pointers, cut into parts of two pages and merged again, equal in every byte."""
    whole = assembly.merged(sectioned_parts(spark, sf_dir), unit=units.CODE_POINTS)[0].select("doc_id", "result", "pages")
    # Both uses of the whole results read all of this exchange, so they are merged once.
    whole = whole.where("doc_id is not null").repartition("doc_id")
    numbers = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("pages") - 1) / 2))
    planned = lambda k: F.sequence(2 * k + 1, F.least(2 * k + 2, F.col("pages")))
    parts = whole.withColumn("plans", F.transform(numbers, lambda k: F.struct(k.alias("k"), planned(k).alias("planned"))))
    again = assembly.documents(cutting.cut(parts.select("doc_id", "result", "plans"), None, units.CODE_POINTS), unit=units.CODE_POINTS)
    sides = whole.select("doc_id", "pages", F.size(numbers).cast("bigint").alias("parts"), F.md5("result").alias("a"))
    return sides.join(again.select("doc_id", F.md5("result").alias("b")).hint("merge"), "doc_id").select("doc_id", "pages", "parts", (F.col("a") == F.col("b")).alias("same"))


#: Faults that are put in the whole results of the documents doc_id % 8 = n: what is replaced, by what, and the first problem.
CUT_FAULTS = (
    (1, '"id":"1.7"', '"id":"1"', 'figures[0].id "1" is not <page>.<n>'), (2, '"figures":[', '"figures":[{"elements":["/pages/0"]},', 'figures[0].elements[0] "/pages/0" points into pages, which the cut does not renumber'),
    (3, '"pageNumber":1,"unit"', '"pageNumber":0,"unit"', "pages[0].pageNumber 0 is not a page number"), (4, '"content":', '"contents":', "content (absent) is no text"),
    (5, '"stringIndexType":"unicodeCodePoint"', '"stringIndexType":"words"', 'stringIndexType "words" is not the unit that the cut counts in'), (6, '"figures":[', '"styles":0,"figures":[', "styles is 0, not an array"),
)


@query("WITH f(n, problem) AS (VALUES " + ", ".join(f"({n}, '{problem}')" for n, _, _, problem in CUT_FAULTS) + """)
    SELECT conv_id AS doc_id, problem FROM (SELECT DISTINCT conv_id FROM conversations) JOIN f ON conv_id % 8 = n""")
def cut_problems(spark, sf_dir):
    """The first problem of each whole result that cannot be cut; bad results are rows and end nothing."""
    whole = assembly.merged(sectioned_parts(spark, sf_dir), unit=units.CODE_POINTS)[0]
    raw = F
    for n, was, now, _ in CUT_FAULTS:
        raw = raw.when(F.col("doc_id") % 8 == n, F.replace(F.col("result"), F.lit(was), F.lit(now)))
    plan = whole.select("doc_id", F.lit(0).alias("k"), F.sequence(F.lit(1).cast("bigint"), F.col("pages")).alias("planned"))
    cut = cutting.cut(whole.select("doc_id", raw.otherwise(F.col("result")).alias("result")), plan, units.CODE_POINTS)
    return cut.where(F.size("problems") > 0).select("doc_id", F.get("problems", F.lit(0)).alias("problem"))


@query("SELECT conv_id AS doc_id, 2 * count(*) AS pages, 2 * count(*) AS figures, true AS numbered FROM conversations GROUP BY conv_id")
def composed_results(spark, sf_dir):
    """Each document's whole result twice, as one of twice the pages; its figures' ids name their own pages."""
    whole = assembly.merged(conversation_parts(spark, sf_dir), unit=units.CODE_POINTS)[0]
    twice = whole.select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"), F.col("result").alias("raw"))
    found, _ = cutting.compose(twice, units.CODE_POINTS)
    told = cutting.figures(F.col("result"))
    numbered = F.transform(told, lambda f: f["page"]) == F.sequence(F.lit(1).cast("bigint"), F.size(told).cast("bigint"))
    return found.select("doc_id", F.size(F.from_json("result", "pages array<struct<pageNumber: bigint>>")["pages"]).cast("bigint").alias("pages"), F.size(told).cast("bigint").alias("figures"), numbered.alias("numbered"))


#: Faults that are put in the second part of the documents doc_id % 8 = n: what is replaced, by what, and the violation's code.
SECTION_FAULTS = (
    (1, '"sections":[{', '"sections":[],"sectiones":[{', "V22"), (2, '"sections":[{"spans"', '"sections":[{"spans":[],"spans"', "V23"), (3, '"sections":[{"spans":[{"offset":0,', '"sections":[{"spans":[{"offset":0.0,', "V24"),
    (4, '"sections":[{"spans":[{"offset":0,"length":', '"sections":[{"spans":[{"offset":0,"length":9', "V25"), (5, '"elements":["/paragraphs/0"]}]}', '"elements":["/sections/1"]},{"spans":[{"offset":99999,"length":1}],"elements":["/paragraphs/0"]}]}', "V26"),
    (6, '"elements":["/paragraphs/0"]}]}', '"elements":["/paragraphs/9","/sections/1"]},{"spans":[],"elements":[]}]}', "V27"), (7, '"sections":[{', '"sections":[{"elements":[],"z":0,"zz":1},{', "V25"),
)


@query("WITH f(n, code) AS (VALUES " + ", ".join(f"({n}, '{code}')" for n, _, _, code in SECTION_FAULTS) + """)
    SELECT conv_id AS doc_id, CAST(turn AS BIGINT) AS k, code FROM conversations JOIN f ON conv_id % 8 = n WHERE turn = 1 AND length(text) > 0""")
def section_violations(spark, sf_dir):
    """The violations of documents whose second part has a planted fault in its sections; the others have none."""
    raw = F
    for n, was, now, _ in SECTION_FAULTS:
        raw = raw.when((F.col("doc_id") % 8 == n) & (F.col("k") == 1) & ~F.contains("raw", F.lit('"content":""')), F.replace("raw", F.lit(was), F.lit(now)))
    parts = sectioned_parts(spark, sf_dir).withColumn("raw", raw.otherwise(F.col("raw")))
    return assembly.merged(parts, unit=units.CODE_POINTS)[2].select("doc_id", F.col("k").cast("bigint").alias("k"), "code")


def spoilt(column, faults):
    """The text with what is replaced in documents doc_id % 16 = n; faults are (n, was, now) of distinct n."""
    out = F
    for n, was, now in faults:
        out = out.when(F.col("doc_id") % 16 == n, F.replace(F.col(column), F.lit(was), F.lit(now)))
    return out.otherwise(F.col(column))


#: Faults that are put in part 0 of the documents doc_id % 16 = n: what is replaced, by what, and the violation's code.
FAULTS = (
    (1, '"content"', '"contents"', "V09"), (2, '"pageNumber":1,', '"pageNumber":7,', "V17"), (3, '"unit":"inch","spans"', '"unit":"inch","span"', "V21"), (4, '"pages":[', '"pages":[{},', "V07"),
    (5, '"modelId":"m"', '"modelId":"n"', "V11"), (6, '"score":1.50}', '"score":1.50', "V03"), (7, '"modelId":"m"', '"modelId":"m","modelId":"m"', "V05"), (8, '"id":"1.7"', '"id":"1"', "V32"),
    (9, "/paragraphs/0", "/paragraphs/1", "V31"), (10, '"figures":[', '"tables":[{"span":{"offset":0.5}}],"figures":[', "V29"), (11, '"boundingRegions":[{"pageNumber":1}]', '"boundingRegions":[{"pageNumber":9}]', "V30"),
    (12, '"apiVersion"', '"\\u0061piVersion"', "V04"), (13, '"pageNumber":1,', '"pageNumber":1.0,', "V08"), (14, '"stringIndexType":"unicodeCodePoint"', '"stringIndexType":"words"', "V18"), (15, '"figures":[', '"figures":{"a":[', "V03"),
)


@query("WITH f(n, code) AS (VALUES " + ", ".join(f"({n}, '{code}')" for n, _, _, code in FAULTS) + """)
    SELECT conv_id AS doc_id, code FROM conversations JOIN f ON conv_id % 16 = n WHERE turn = 0
    UNION SELECT conv_id, 'V11' FROM conversations WHERE turn = 1 AND conv_id % 16 = 14""")
def merge_violations(spark, sf_dir):
    """The violations of documents whose first part has a planted fault; the others have none."""
    raw = F.when(F.col("k") == 0, spoilt("raw", [fault[:3] for fault in FAULTS])).otherwise(F.col("raw"))
    parts = conversation_parts(spark, sf_dir).select("doc_id", "k", "planned", raw.alias("raw"))
    return assembly.merged(parts, unit=units.CODE_POINTS)[2].select("doc_id", "code").distinct()


BOX = '"polygon":[0,0,1,0,1,1,0,1]'
#: Faults that are put in the merged results of the documents doc_id % 16 = n: what is replaced, by what, and (rule, path) of the finding.
BREACHES = (
    (1, '"styles":[]', '"style":[]', "presence", "/styles"), (2, '"modelId":', '"modelID":', "present", "/modelId"), (3, '"stringIndexType":"unicodeCodePoint"', '"stringIndexType":"words"', "unit", "/stringIndexType"),
    (4, '"figures":[', '"figures":[{"id":"x"},', "figure-id", "/figures/0"), (6, '"paragraphs":[', '"paragraphs":[{"spans":[{"offset":0,"length":99999999}]},', "span", "/paragraphs/0/spans/0"),
    (8, '"pages":[', '"pages":[{"pageNumber":0},', "page-numbers", "/pages"), (8, "", "", "page-span", "/pages/0"), (9, '"figures":[{', '"figures":[{"caption":{"elements":["/pages"]},', "pointer", "/figures/0/caption/elements/0"),
)
#: The same for faults that every page has.
PAGE_BREACHES = (
    (5, '"/paragraphs/', '"/paragraphs/9999', "pointer", "/figures/", "/elements/0"), (7, '"unit":"inch",', '"unit":"inch","barcodes":[],', "presence", "/pages/", "/barcodes"),
    (10, BOX + ',"score"', '"polygon":[0],"score"', "polygon", "/pages/", "/words/0"), (11, '"page said":', '"content":"?","page said":', "line-content", "/pages/", "/lines/0"),
)


@query("WITH f(n, rule, path) AS (VALUES " + ", ".join(f"({n}, '{rule}', '{path}')" for n, _, _, rule, path in BREACHES) + "), g(n, rule, a, b) AS (VALUES "
    + ", ".join(f"({n}, '{rule}', '{a}', '{b}')" for n, _, _, rule, a, b in PAGE_BREACHES) + """), c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)
    SELECT conv_id AS doc_id, rule, path FROM c JOIN f ON conv_id % 16 = n WHERE i = 0 UNION ALL SELECT conv_id, rule, a || i || b FROM c JOIN g ON conv_id % 16 = n""")
def result_findings(spark, sf_dir):
    """Merged results with words, lines and regions against the invariants; only planted faults are told."""
    parts = conversation_parts(spark, sf_dir).withColumn("q", quoted("text"))
    span = F.concat(F.lit('{"offset":0,"length":'), F.length("text"), F.lit("}"))
    words = F.concat(F.lit('"unit":"inch","words":[{"content":'), F.col("q"), F.lit(f',{BOX},"score":1,"span":'), span, F.lit('}],"lines":[{"content":'), F.col("q"), F.lit(',"page said":1,"spans":['), span, F.lit("]}],"))
    swaps = (
        ('"modelId":"m",', F.lit('"modelId":"m","contentFormat":"text","styles":[],')), ('"unit":"inch",', words), ('"score":1.50', F.concat(F.lit('"content":'), F.col("q"))),
        ('[{"pageNumber":1}]', F.lit('[{"pageNumber":1,' + BOX + "}]")), ('"id":"1.7"', F.lit('"id":"1.1"')),
    )
    raw = F.col("raw")
    for was, now in swaps:
        raw = F.replace(raw, F.lit(was), now)
    out, _, _ = assembly.merged(parts.select("doc_id", "k", "planned", raw.alias("raw")), unit=units.CODE_POINTS)
    result = spoilt("result", [(n, was, now) for n, was, now, *_ in (*BREACHES, *PAGE_BREACHES) if was])
    return invariants.result_findings(out.select("doc_id", result.alias("result")))


#: A description of the documents that orders are made to, and faults that orders o_orderkey % 16 = n have: what is replaced, by what, and the finding.
ORDER_SCHEMA = """{"definitions": {
    "Base": {"type": "object", "required": ["id"], "properties": {"id": {"type": "integer", "format": "int32", "minimum": 1}}},
    "State": {"type": "string", "enum": ["O", "F", "P"]}, "Level": {"type": "string", "enum": ["HIGH"], "x-ms-enum": {"modelAsString": true}},
    "Order": {"allOf": [{"$ref": "#/definitions/Base"}], "required": ["state", "items"], "properties": {
        "state": {"$ref": "#/definitions/State"}, "level": {"$ref": "#/definitions/Level"}, "at": {"type": "string", "format": "date-time"}, "total": {"type": "number", "minimum": 0},
        "clerk": {"type": "string", "pattern": "^Clerk#[0-9]+$", "maxLength": 15}, "note": {"type": "string", "x-nullable": true},
        "items": {"type": "array", "minItems": 1, "items": {"$ref": "#/definitions/Item"}}}},
    "Item": {"type": "object", "properties": {"n": {"type": "integer"}, "parts": {"type": "array", "items": {"$ref": "#/definitions/Item"}}}}}}"""
SCHEMA_FAULTS = (
    (1, '"state":"', '"state":"X', "error", "enum", "/state"), (2, '"level":"HIGH"', '"level":"LOW"', "warning", "enum-open", "/level"), (3, "T00:00:00Z", " 00:00", "error", "format", "/at"),
    (4, '"total":', '"total":-', "error", "minimum", "/total"), (5, "Clerk#", "clerk ", "error", "pattern", "/clerk"), (6, '"note":null', '"note":3', "error", "type", "/note"), (7, '"items":[{"n":1', '"items":[{"n":1.0', "error", "type", "/items/0/n"),
    (8, '"parts":[{', '"parts":[{"parts":[{"x":0}],', "error", "unknown-property", "/items/0/parts/0/parts/0/x"), (9, '"id":', '"ids":', "error", "required", "/"), (10, '"items":[', '"items":[],"_":[', "error", "minItems", "/items"),
    (11, '"level":"HIGH"', '"level":null', "error", "null", "/level"), (12, '{"id"', '["id"', "error", "malformed", "/"), (13, "Clerk#", "Clerk#1234567", "error", "maxLength", "/clerk"),
)


@query("WITH f(n, severity, rule, path) AS (VALUES " + ", ".join(f"({n}, '{severity}', '{rule}', '{path}')" for n, _, _, severity, rule, path in SCHEMA_FAULTS) + """, (9, 'error', 'unknown-property', '/ids'), (10, 'error', 'unknown-property', '/_'))
    SELECT o_orderkey AS doc_id, severity, rule, path FROM orders JOIN f ON o_orderkey % 16 = n""")
def schema_findings(spark, sf_dir):
    """Orders as documents against a description; only planted faults are told."""
    doc = F.concat(
        F.lit('{"id":'), F.col("o_orderkey") + 1, F.lit(',"state":"'), F.col("o_orderstatus"), F.lit('","level":"HIGH","at":"'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('T00:00:00Z","total":'), F.abs(F.round(F.col("o_totalprice"))).cast("bigint") + 1,
        F.lit(',"clerk":"Clerk#'), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 9, "0"), F.lit('","note":null,"items":[{"n":1,"parts":[{"n":2}]}]}'),
    )
    text = F
    for n, was, now, *_ in SCHEMA_FAULTS:
        text = text.when(F.col("o_orderkey") % 16 == n, F.replace(doc, F.lit(was), F.lit(now)))
    orders = spread(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate", "o_totalprice"), "o_orderkey")
    return schema.schema_findings(orders.select(F.col("o_orderkey").alias("doc_id"), text.otherwise(doc).alias("text")), "doc_id", "text", ORDER_SCHEMA, "Order")


@query("""SELECT o_orderkey AS doc_id, CASE o_orderkey % 8 WHEN 1 THEN 'result' WHEN 2 THEN 'result' WHEN 3 THEN 'error-member' ELSE 'key-order' END AS rule,
    CASE o_orderkey % 8 WHEN 1 THEN '/analyzeResult' WHEN 2 THEN '/analyzeResult' WHEN 3 THEN '/error' ELSE '/' END AS path FROM orders WHERE o_orderkey % 8 BETWEEN 1 AND 4""")
def envelope_findings(spark, sf_dir):
    """Envelopes of orders: finished ones have results; some have none, one too early, an error, or times before the status."""
    n, at = F.col("o_orderkey") % 8, F.concat(F.lit('"createdDateTime":"'), F.col("o_orderdate").cast("string"), F.lit('"'))
    status = F.when(n.isin(0, 1, 5), F.lit('"status":"succeeded"')).otherwise(F.lit('"status":"running"'))
    head = F.when(n == 4, F.concat(at, F.lit(","), status)).otherwise(F.concat(status, F.lit(","), at))
    tail = F.when(n.isin(0, 2, 5), F.lit(',"analyzeResult":{}')).when(n == 3, F.lit(',"error":{}')).otherwise(F.lit(""))
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("{"), head, tail, F.lit("}")).alias("body"))
    return invariants.envelope_findings(orders)


@query(P + """, r AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY page) - 1 AS i FROM p), n AS (SELECT doc_id, bool_and(page = i + 1) AS plain FROM r GROUP BY doc_id)
    SELECT doc_id, 'page-numbers' AS rule, '/readResults' AS path FROM n WHERE NOT plain
    UNION ALL SELECT doc_id, 'bbox', '/readResults/' || i || '/lines/0' FROM r WHERE page % 4 = 1
    UNION ALL SELECT doc_id, 'line-words', '/readResults/' || i || '/lines/0' FROM r WHERE page % 4 = 2
    UNION ALL SELECT doc_id, 'confidence', '/readResults/' || i || '/lines/0/words/0' FROM r WHERE page % 4 = 3""")
def line_result_findings(spark, sf_dir):
    """Results of lines, a page for each of an order's line numbers, with a fault that the page's number decides."""
    box = "[0,0,1,0,1,1,0,1]"
    n = F.col("page") % 4
    line = F.concat(
        F.lit('{"page":'), F.col("page"), F.lit(',"unit":"inch","lines":[{"text":"a'), F.when(n == 2, " b").otherwise(""), F.lit('","appearance":{},"boundingBox":'), F.when(n == 1, "[0]").otherwise(box),
        F.lit(',"words":[{"text":"a","boundingBox":' + box + ',"confidence":'), F.when(n == 3, "1.5").otherwise("0.5"), F.lit("}]}]}"),
    )
    pages_ = F.transform(F.array_sort(F.collect_list(F.struct("page", line.alias("v")))), lambda p: p["v"])
    whole = F.concat(F.lit('{"version":"3.2.0","modelVersion":"m","readResults":['), F.array_join(pages_, ","), F.lit("]}"))
    return invariants.read_findings(order_pages(spark, sf_dir).groupBy("doc_id").agg(whole.alias("result")), model="m", unit="inch")


@query(P + """ SELECT doc_id, count(*) AS pages, md5('{"version":"3.2","modelVersion":"m","readResults":[' || string_agg('{ "page":' || page || ', "lines":[{"text":"' || doc_id || '-' || page || '"}]}', ',' ORDER BY page) || ']}') AS result_md5 FROM p GROUP BY doc_id""")
def read_round_trip(spark, sf_dir):
    """Results without cross-references: cut by a balanced plan, merged again, equal in every byte."""
    page = F.concat(F.lit('{ "page":'), F.col("page"), F.lit(', "lines":[{"text":"'), F.col("doc_id"), F.lit("-"), F.col("page"), F.lit('"}]}'))
    rows = order_pages(spark, sf_dir)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("page", page.alias("v")))), lambda p: p["v"])
    whole = rows.groupBy("doc_id").agg(F.concat(F.lit('{"version":"3.2","modelVersion":"m","readResults":['), F.array_join(texts, ","), F.lit("]}")).alias("result"))
    plan = planning.balanced_plan(rows, 3).groupBy("doc_id", F.col("part").alias("k")).agg(F.array_sort(F.collect_list("page")).alias("planned"))
    out, _, _ = assembly.merged(assembly.cut(whole, plan), assembly.READ)
    return out.select("doc_id", "pages", F.md5("result").alias("result_md5"))


def event_documents(spark, sf_dir):
    """(event_id, doc): a JSON document for each event."""
    doc = F.concat(F.lit('{ "id":'), F.col("event_id"), F.lit(', "kind" : "'), F.col("event_type"), F.lit('", "n":1.50, "tags":["a", "b\\u00e9" , '), F.col("user_id"), F.lit('], "none":{}, "deep":{"x.y":[[true],null]} }'))
    return spread(read(spark, sf_dir, "events").select("event_id", "event_type", "user_id"), "event_id").select("event_id", doc.alias("doc"))


@query("""SELECT event_id, '{ "id":' || (event_id + 1) || ', "kind" : "<kind>", "n":1.50, "tags":["a", "b\\u00e9" , ' || user_id || '], "none":{}, "deep":{"x.y":[[false],null]} }' AS doc FROM events""")
def json_rewritten(spark, sf_dir):
    """Some scalars replaced; all other bytes stay."""

    def visit(path, kind, raw):
        if path == ("id",):
            return str(int(raw) + 1)
        return '"<kind>"' if path == ("kind",) else "false" if kind == "Bool" else None

    return shred.rewritten(event_documents(spark, sf_dir), "doc", visit)


@query("""WITH m(ord, name, kind, items) AS (VALUES (0, 'id', 'Number', -1), (1, 'kind', 'String', -1), (2, 'n', 'Number', -1), (3, 'tags', 'Array', 3), (4, 'none', 'Object', 0), (5, 'deep', 'Object', 1))
    SELECT event_id, CAST(ord AS BIGINT) AS ord, name, kind, CAST(items AS BIGINT) AS items,
        CASE ord WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN '"' || event_type || '"' WHEN 2 THEN '1.50' WHEN 3 THEN '["a", "b\\u00e9" , ' || user_id || ']' WHEN 4 THEN '{}' ELSE '{"x.y":[[true],null]}' END AS raw FROM events, m""")
def member_listing(spark, sf_dir):
    return shred.members(event_documents(spark, sf_dir), "event_id", "doc").select("event_id", "ord", "name", "kind", "items", "raw")


@query("""WITH m(path, pattern, kind) AS (VALUES ('.id', '.id', 'Number'), ('.kind', '.kind', 'String'), ('.n', '.n', 'Number'), ('.tags[0]', '.tags[*]', 'String'), ('.tags[1]', '.tags[*]', 'String'), ('.tags[2]', '.tags[*]', 'Number'),
        ('.none', '.none', 'Object'), ('.deep."x.y"[0][0]', '.deep."x.y"[*][*]', 'Bool'), ('.deep."x.y"[1]', '.deep."x.y"[*]', 'Null'))
    SELECT path, pattern, kind, count(*) AS n, md5(string_agg(CASE path WHEN '.id' THEN CAST(event_id AS VARCHAR) WHEN '.kind' THEN event_type WHEN '.n' THEN '1.50' WHEN '.tags[0]' THEN 'a' WHEN '.tags[1]' THEN 'bé'
        WHEN '.tags[2]' THEN CAST(user_id AS VARCHAR) WHEN '.none' THEN '{}' WHEN '.deep."x.y"[1]' THEN 'null' ELSE 'true' END, ',' ORDER BY event_id)) AS raw_md5 FROM events, m GROUP BY ALL""")
def shredded_values(spark, sf_dir):
    rows = shred.shred(event_documents(spark, sf_dir), "event_id", "doc")
    return shred.digests(rows, ["path", "pattern", "kind"], "event_id", "raw", "raw_md5")


def changed_documents(spark, sf_dir):
    """(event_id, doc, copy): documents with a text beyond 4 KiB, and copies of which some are changed, cut, extended or respelled."""
    docs = event_documents(spark, sf_dir).withColumn("doc", F.replace("doc", F.lit('"none":{}'), F.concat(F.lit('"long":"'), F.repeat(F.lit("0123456789"), F.when(F.col("event_id") % 8 == 5, 410).otherwise(1)), F.col("event_id"), F.lit('", "none":{}'))))
    part = F.col("event_id") % 8
    copy = (
        F.when(part == 0, F.replace("doc", F.lit("1.50"), F.lit("15e-1"))).when(part == 1, F.regexp_replace("doc", '"kind" : "[a-z]+"', '"kind":"other"'))
        .when(part == 2, F.regexp_replace("doc", " , [0-9]+\\]", "]")).when(part == 3, F.regexp_replace("doc", ', "deep":.*', "}"))
        .when(part == 4, F.replace("doc", F.lit('"none":{}'), F.lit('"new":[{"a":1}], "none":null'))).when(part == 5, F.replace("doc", F.lit('", "none"'), F.lit('x", "none"')))
        .when(part == 6, F.regexp_replace("doc", '^\\{ "id":([0-9]+), "kind" : ("[a-z]+")', '{ "kind":$2, "id":$1')).otherwise(F.col("doc"))
    )
    return docs.withColumn("copy", copy)


LONG = "repeat('0123456789', 410) || event_id"


@query(f"""WITH d AS (SELECT event_id, CASE event_id % 8 WHEN 1 THEN [('.kind', '.kind', 'changed', event_type, 'other')] WHEN 2 THEN [('.tags', '.tags', 'length', '3 items', '2 items')] WHEN 3 THEN [('.deep', '.deep', 'missing', '1 items', NULL)]
        WHEN 4 THEN [('.none', '.none', 'type', '0 items', 'null'), ('.new', '.new', 'added', NULL, '1 items')] WHEN 5 THEN [('.long', '.long', 'changed', {LONG}, {LONG} || 'x')] ELSE [] END AS found FROM events), u AS (SELECT event_id, unnest(found) AS f FROM d)
    SELECT event_id, f[1] AS path, 'document-level' AS level, f[3] AS kind, f[4] AS whole, f[5] AS split FROM u""")
def json_diff(spark, sf_dir):
    return shred.document_differences(changed_documents(spark, sf_dir), "event_id", "doc", "copy").drop("pattern")


@query(f"""WITH d AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN [('.n', '1.50', '15e-1')] WHEN 1 THEN [('.kind', '"' || event_type || '"', '"other"')] WHEN 2 THEN [('.tags (length)', '3', '2')]
        WHEN 3 THEN [(' (member order)', 'id,kind,n,tags,long,none,deep', 'id,kind,n,tags,long,none')] WHEN 4 THEN [(' (member order)', 'id,kind,n,tags,long,none,deep', 'id,kind,n,tags,long,new,none,deep'), ('.none', '{{}}', 'null')]
        WHEN 5 THEN [('.long', left('"' || {LONG}, 160) || '…', left('"' || {LONG}, 160) || '…')] WHEN 6 THEN [(' (member order)', 'id,kind,n,tags,long,none,deep', 'kind,id,n,tags,long,none,deep')] ELSE [] END AS found FROM events),
    u AS (SELECT event_id, unnest(found) AS f FROM d) SELECT event_id, f[1] AS path, f[2] AS whole, f[3] AS split FROM u""")
def exact_diff(spark, sf_dir):
    """Where documents and their copies are spelled differently, the order of members included."""
    return shred.exact_differences(changed_documents(spark, sf_dir), "event_id", "doc", "copy")


@query("""WITH m(name, n) AS (VALUES ('id', 9), ('kind', 1), ('n', 0), ('tags', 2), ('long', 5), ('none', 4), ('deep', 3))
    SELECT event_id, name AS member, event_id % 8 <> m.n AS identical, CAST(CASE WHEN event_id % 8 = m.n THEN 1 ELSE 0 END AS BIGINT) AS n, CASE WHEN event_id % 8 = m.n THEN name || CASE WHEN name = 'tags' THEN ' (length)' ELSE '' END ELSE '' END AS paths FROM events, m
    UNION ALL SELECT event_id, 'new', false, 1, 'new' FROM events WHERE event_id % 8 = 4""")
def member_comparison(spark, sf_dir):
    """Documents and their copies compared member by member."""
    found = shred.member_report(changed_documents(spark, sf_dir), "event_id", "doc", "copy")
    return found.withColumn("paths", F.array_join("paths", ","))


@query("""SELECT page_id, '{"url":"<base>/x","id":"<guid>", "at" : "<datetime:2006-01-02T15:04:05.00Z>","n":1e-07,"seen":["at 2024-05-06T07:08:09Z"]}' AS doc FROM pages""")
def masked_documents(spark, sf_dir):
    md = F.md5("html")
    ident = F.concat_ws("-", *(F.substring(md, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    doc = F.concat(F.lit('{"url":"http://h:8/x","id":"'), ident, F.lit('", "at" : "2024-01-0'), F.col("page_id") % 9 + 1, F.lit('T10:20:30.25Z","n":1e-07,"seen":["at 2024-05-06T07:08:09Z"]}'))
    return shred.masked(read(spark, sf_dir, "pages").select("page_id", doc.alias("doc")), "doc", "http://h:8")


REQUESTS = """CASE event_id % 8 WHEN 0 THEN '1-3,7' WHEN 1 THEN '2' WHEN 2 THEN '' WHEN 3 THEN '4-2' WHEN 4 THEN '1-20' WHEN 5 THEN '9,1' ELSE NULL END"""


def requests(spark, sf_dir):
    """(event_id, params, count): requests about documents of 10 pages."""
    spec = F.expr(REQUESTS)
    unit = F.expr("case event_id % 5 when 0 then 'utf16CodeUnit' when 1 then 'words' else null end")
    entry = lambda name, v: F.when(v.isNotNull(), F.struct(F.lit(name).alias("key"), F.array(v).alias("value")))
    twice = F.when(F.col("event_id") % 11 == 0, F.struct(F.lit("PAGES").alias("key"), F.array(F.lit("1")).alias("value")))
    odd = F.expr("case event_id % 13 when 0 then named_struct('key', 'Output', 'value', array('json, PDF')) when 1 then named_struct('key', 'outputContentFormat', 'value', array('TEXT')) when 2 then named_struct('key', 'FEATURES', 'value', array('', 'x')) when 3 then named_struct('key', 'queryFields', 'value', array('')) end")
    params = F.map_from_entries(F.array_compact(F.array(entry("Pages", spec), entry("stringIndexType", unit), twice, odd)))
    return read(spark, sf_dir, "events").select("event_id", params.alias("params"), F.lit(10).alias("count"))


@query(f"""WITH r AS (SELECT event_id, {REQUESTS} AS spec, event_id % 11 = 0 AS twice FROM events),
    s AS (SELECT event_id, CASE WHEN spec IS NULL AND NOT twice THEN '1,2,3,4,5,6,7,8,9,10' WHEN spec IS NOT NULL AND twice THEN NULL WHEN spec IS NULL THEN '1' WHEN spec = '1-3,7' THEN '1,2,3,7' WHEN spec = '2' THEN '2' WHEN spec = '9,1' THEN '1,9' END AS pages FROM r)
    SELECT event_id, pages, CASE event_id % 5 WHEN 0 THEN 'utf16CodeUnit' WHEN 1 THEN NULL ELSE 'textElements' END AS unit,
        CASE event_id % 13 WHEN 0 THEN 'output' WHEN 2 THEN 'features' WHEN 3 THEN 'queryFields' END AS refused,
        CASE WHEN event_id % 9 = 0 THEN 'whole:-' WHEN event_id % 7 = 0 THEN 'whole:encrypted' WHEN pages IS NULL THEN 'whole:pages_param' WHEN len(string_split(pages, ',')) <= 3 THEN 'whole:-' WHEN event_id % 5 = 1 THEN 'whole:string_index_type' ELSE 'split:-' END AS decision FROM s""")
def request_decisions(spark, sf_dir):
    rows = requests(spark, sf_dir).withColumn("selected", policy.page_selection(F.col("params"), F.col("count"))).withColumn("unit", policy.unit_choice(F.col("params"), F.lit("di")))
    failure = F.when(F.col("event_id") % 7 == 0, "encrypted")
    told = policy.split_decision(F.lit(3), F.col("event_id") % 9 != 0, failure, F.col("selected"), F.col("unit"))
    rows = rows.withColumn("d", told)
    return rows.select("event_id", F.array_join("selected", ",").alias("pages"), "unit", policy.refused_parameter(F.col("params")).alias("refused"), F.concat_ws(":", "d.mode", F.coalesce("d.fallback", F.lit("-"))).alias("decision"))


BODIES = """CASE event_id % 8 WHEN 0 THEN '{"error":{"code":"Conflict","message":"m","innererror":{"code":"In","message":"im"}}}' WHEN 1 THEN '{"code":"Flat","message":"f","requestId":"r"}' WHEN 2 THEN '{"status":"Failed"}' WHEN 3 THEN '<html>' WHEN 4 THEN ''
    WHEN 5 THEN '{"status":"succeeded","analyzeResult":{"pages":[]}}' WHEN 6 THEN '{"pages":[1]}' ELSE '{"status":"running"}' END"""


@query(f"""WITH b AS (SELECT event_id, event_id % 8 AS b, [400, 404, 415, 500, 503, 409, 429, 200][event_id % 7 + 1] AS status FROM events)
    SELECT event_id, CASE b WHEN 0 THEN 'Conflict:m:In:im:-' WHEN 1 THEN 'Flat:f:-:-:r' WHEN 2 THEN 'InternalServerError:The upstream container reported the analysis as failed without detail.:-:-:-' END AS error,
        CASE status WHEN 404 THEN 'NotFound' WHEN 409 THEN 'Conflict' WHEN 415 THEN 'UnsupportedMediaType' WHEN 503 THEN 'ServiceUnavailable' WHEN 500 THEN 'InternalServerError' ELSE 'InvalidRequest' END AS di_code,
        CASE status WHEN 415 THEN 'UnsupportedMediaType' WHEN 500 THEN 'InternalServerError' WHEN 503 THEN 'InternalServerError' ELSE 'BadArgument' END AS read_code, status IN (429, 500, 503) AS retriable,
        CASE b WHEN 2 THEN 'Failed:false:false:true' WHEN 5 THEN 'succeeded:true:false:false' WHEN 7 THEN 'running:false:false:false' WHEN 3 THEN ':false:false:false' WHEN 4 THEN ':false:false:false' ELSE 'succeeded:true:true:false' END AS envelope,
        CASE b WHEN 5 THEN '{{"pages":[]}}' WHEN 6 THEN '{{"pages":[1]}}' WHEN 0 THEN '{{"error":{{"code":"Conflict","message":"m","innererror":{{"code":"In","message":"im"}}}}}}' WHEN 1 THEN '{{"code":"Flat","message":"f","requestId":"r"}}' END AS result,
        CASE WHEN status = 404 THEN 'CANNOT RUN' ELSE 'INCONCLUSIVE' END AS verdict FROM b""")
def answers_read(spark, sf_dir):
    status = F.expr("element_at(array(400, 404, 415, 500, 503, 409, 429, 200), cast(event_id % 7 as int) + 1)")
    rows = read(spark, sf_dir, "events").select("event_id", F.expr(BODIES).alias("body"), status.alias("status"))
    e = policy.parsed_error(F.col("body"))
    rows = rows.withColumn("e", e).withColumn("v", policy.envelope(F.col("body")))
    dash = lambda c: F.coalesce(F.col(c), F.lit("-"))
    error = F.when(F.col("e").isNotNull(), F.concat_ws(":", "e.code", "e.message", dash("e.inner_code"), dash("e.inner_message"), dash("e.request_id")))
    return rows.select(
        "event_id", error.alias("error"), policy.code_of_status(F.lit("di"), F.col("status")).alias("di_code"), policy.code_of_status(F.lit("read"), F.col("status")).alias("read_code"), policy.retriable(F.col("status")).alias("retriable"),
        F.concat_ws(":", "v.status", F.col("v.has_result").cast("string"), F.col("v.bare").cast("string"), F.col("v.failed").cast("string")).alias("envelope"), policy.result_of(F.col("body")).alias("result"),
        policy.sync_verdict(F.col("status"), F.lit(False), F.col("body")).alias("verdict"),
    )


@query("""WITH v AS (SELECT event_id, event_id % 6 AS m, user_id FROM events)
    SELECT event_id, CASE m WHEN 0 THEN '3f2504e0-4f89-11d3-9a0c-0305e82c3301' END AS guid, m = 1 AS model, m = 2 AS digits, CASE m WHEN 2 THEN CASE WHEN user_id BETWEEN 1 AND 1000 THEN user_id ELSE 50 END ELSE 50 END AS page_limit,
        CASE m WHEN 2 THEN CASE WHEN user_id > 0 THEN least(user_id, 10) ELSE 1 END ELSE 1 END AS poll, CASE m WHEN 3 THEN 'lower' WHEN 4 THEN 'raw' END AS style,
        CASE m WHEN 5 THEN 'image/tiff' ELSE 'application/octet-stream' END AS media, CASE m WHEN 4 THEN 'a < b' WHEN 3 THEN 'x\\u003cy' WHEN 5 THEN '/f/scan.TIF' WHEN 1 THEN 'prebuilt-layout' WHEN 0 THEN '3F2504E0-4F89-11D3-9A0C-0305E82C3301' ELSE CAST(user_id AS VARCHAR) END AS squashed FROM v""")
def scalar_rules(spark, sf_dir):
    value = F.expr("""case event_id % 6 when 0 then '3F2504E0-4F89-11D3-9A0C-0305E82C3301' when 1 then 'prebuilt-layout' when 2 then cast(user_id as string) when 3 then 'x' || chr(92) || 'u003cy' when 4 then 'a  <  b ' else '/f/scan.TIF' end""")
    rows = read(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 6).alias("m"), value.alias("v"))
    v = F.col("v")
    return rows.select(
        "event_id", policy.guid(v).alias("guid"), ((F.col("m") == 1) & policy.is_model_id(v)).alias("model"), policy.is_digits(v).alias("digits"), policy.page_limit(v).alias("page_limit"), policy.poll_wait(v).alias("poll"),
        policy.angle_style(v).alias("style"), policy.content_type(v, v.cast("binary")).alias("media"), policy.squashed(v).alias("squashed"),
    )


@query(ATTEMPTS + """, n AS (SELECT user_id % 100 AS job, event_id % 4 + 1 AS size, outcome, row_number() OVER (PARTITION BY user_id % 100, event_id % 4 + 1 ORDER BY ts, event_id) AS n FROM o),
    e AS (SELECT job, size, min(CASE WHEN outcome NOT IN ('retry', 'retry_once') OR n >= 3 THEN n END) AS stop, max(n) AS last FROM n GROUP BY job, size)
    SELECT e.job, e.size, CAST(n.n AS BIGINT) AS attempts, n.outcome AS last_outcome, CASE n.outcome WHEN 'success' THEN 'done' WHEN 'cancelled' THEN 'cancelled' WHEN 'route_missing' THEN 'failed' WHEN 'analysis_failed' THEN 'recheck' WHEN 'terminal' THEN 'recheck'
        ELSE CASE WHEN stop IS NULL THEN 'more' WHEN e.size < 2 THEN 'recheck' ELSE 'halve' END END AS next FROM e JOIN n ON n.job = e.job AND n.size = e.size AND n.n = coalesce(stop, last)""")
def part_loops(spark, sf_dir):
    log = attempt_log(spark, sf_dir).withColumn("job", F.col("user_id") % 100).withColumn("size", F.col("event_id") % 4 + 1).withColumn("pages", F.col("size"))
    return attempts.part_loop(log, ["job", "size"], "pages", ["ts", "event_id"], "outcome")


@query(ATTEMPTS + """ SELECT user_id, count(*) AS attempts, count(*) FILTER (outcome IN ('retry', 'retry_once')) AS retries, CAST(sum(event_id % 1000) AS BIGINT) AS took_ms,
        CAST(arg_max(status, (ts, event_id)) FILTER (outcome NOT IN ('success', 'cancelled') AND status IS NOT NULL) AS INTEGER) AS failed_status FROM o GROUP BY user_id""")
def attempt_counters(spark, sf_dir):
    log = attempt_log(spark, sf_dir).withColumn("ms", F.col("event_id") % 1000)
    return attempts.counters(log, "user_id", ["ts", "event_id"], "outcome", "status", "ms")


@query(ATTEMPTS + ", r AS (SELECT user_id, event_id // 2 AS attempt, arg_min(event_id, (outcome <> 'success', ts, event_id)) AS winner, count(*) AS calls FROM o GROUP BY ALL) SELECT * FROM r")
def hedge_race(spark, sf_dir):
    log = attempt_log(spark, sf_dir).withColumn("attempt", F.expr("event_id div 2"))
    return attempts.race(log, ["user_id", "attempt"], "ts", "outcome", "event_id")


@query(P + """, n AS (SELECT DISTINCT count(*) AS n FROM p GROUP BY doc_id), l AS (SELECT n, unnest(range(0, CAST(ceil(log2(n)) AS BIGINT) + 1)) AS i FROM n)
    SELECT n, string_agg(CAST(CAST(ceil(n / pow(2, i)) AS BIGINT) AS VARCHAR) || 'x3', ' ' ORDER BY i) || ' 1x2' AS ladder FROM l GROUP BY n""")
def halving_ladders(spark, sf_dir):
    sizes = order_pages(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n")).select("n").distinct()
    return sizes.select("n", F.array_join(F.transform(pages.ladder(F.col("n")), lambda s: F.concat_ws("x", s["size"], s["attempts"])), " ").alias("ladder"))


@query(JOBS + f""" SELECT id, CASE WHEN expires_at < {NOW} AND (status IN ('succeeded', 'notStarted') OR lease_until < {NOW}) THEN 'expire'
        WHEN ((status = 'notStarted' AND created_at < {NOW - 240}) OR status = 'running') AND lease_until < {NOW} AND expires_at >= {NOW} THEN 'recover' ELSE 'keep' END AS action FROM j""")
def sweep_actions(spark, sf_dir):
    return jobs.sweep(job_rows(spark, sf_dir), F.lit(NOW), F.lit(NOW - 240))


@query(JOBS + f" SELECT id, updated_at FROM j WHERE updated_at < {NOW - 3600} AND NOT (status = 'running' AND lease_until >= {NOW})")
def stale_work_folders(spark, sf_dir):
    rows = job_rows(spark, sf_dir)
    claimed = rows.where((F.col("status") == "running") & (F.col("lease_until") >= NOW))
    return jobs.stale_work(rows.select("id", F.col("updated_at").alias("modified")), claimed, F.lit(NOW - 3600)).withColumnRenamed("modified", "updated_at")


@query(JOBS + f" SELECT surface, count(*) AS left_over FROM j WHERE NOT (expires_at < {NOW} AND (status IN ('succeeded', 'notStarted') OR lease_until < {NOW})) GROUP BY surface")
def jobs_left_over(spark, sf_dir):
    rows = job_rows(spark, sf_dir)
    return jobs.remaining(rows, jobs.expired(rows, F.lit(NOW))).groupBy("surface").agg(F.count("*").alias("left_over"))


@query(JOBS + """ SELECT id, '{"status":"' || status || '","createdDateTime":"' || strftime(to_timestamp(created_at) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') || '","lastUpdatedDateTime":"' || strftime(to_timestamp(updated_at) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') || '"'
        || CASE WHEN status = 'succeeded' THEN ',"analyzeResult":{"id":' || id || '}' ELSE '' END || '}' AS envelope FROM j""")
def poll_envelopes(spark, sf_dir):
    result = F.concat(F.lit('{"id":'), F.col("id"), F.lit("}"))
    return job_rows(spark, sf_dir).select("id", jobs.envelope(F.col("status"), F.col("created_at"), F.col("updated_at"), result, F.lit("{}")).alias("envelope"))


@query("SELECT 'jobs_total{surface=\"' || o_orderpriority || '\",status=\"' || o_orderstatus || '\"} ' || count(*) AS line FROM orders GROUP BY o_orderpriority, o_orderstatus")
def metrics_lines(spark, sf_dir):
    counts = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("surface"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    return metrics.exposition(counts, "jobs_total", ["surface", "status"], "n")


@query(JOBS + " SELECT surface, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'notStarted') AS waiting, CAST(600 AS BIGINT) AS capacity, count(*) FILTER (status IN ('running', 'notStarted')) >= 600 AS \"full\" FROM j GROUP BY surface")
def capacity_view(spark, sf_dir):
    return metrics.capacity(job_rows(spark, sf_dir), "surface", 100, 500)


@query("""SELECT count(*) AS documents, count(*) FILTER (doc_id % 50 = 0) AS failed, count(*) FILTER (doc_id % 7 = 0) AS page_level, count(*) FILTER (doc_id % 7 = 1) AS document_level, false AS passes FROM documents""")
def comparison_report(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id")
    level = text.level_of(F.when(F.col("doc_id") % 7 == 0, F.array(F.lit("pages"), F.lit("words"))).otherwise(F.array(F.lit("styles"))))
    found = docs.where("doc_id % 7 < 2").select("doc_id", level.alias("level"))
    return diffing.corpus_report(found, docs.withColumn("ok", F.col("doc_id") % 50 != 0), "doc_id")


@query("""WITH d AS (SELECT doc_id, left(text, 400) AS t FROM documents) SELECT doc_id, CASE WHEN length(t) >= 7 THEN substr(t, 3, 5) END AS cut FROM d""")
def unit_slices(spark, sf_dir):
    """Characters 2 to 7 of each text, by UTF-16 units; the texts have none of two units."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.left("text", F.lit(400)).alias("t"))
    return rows.select("doc_id", units.unit_slice(F.col("t"), F.lit(2), F.lit(5), units.UTF16).alias("cut"))


@query("SELECT event_id, md5(props) AS props_md5, true AS one_value FROM events")
def json_copied(spark, sf_dir):
    """The rewriter without any rule copies every byte; what it refuses would be null."""
    rows = shred.rewritten(read(spark, sf_dir, "events").select("event_id", "props"), "props", lambda path, kind, raw: None)
    return rows.select("event_id", F.md5("props").alias("props_md5"), F.col("props").isNotNull().alias("one_value"))



def sql_values(table: dict) -> str:
    return ", ".join(f"('{k}', '{str(v).replace(chr(39), chr(39) * 2)}')" for k, v in table.items())


@query(ATTEMPTS + f""", m(code, message) AS (VALUES {sql_values(policy.MESSAGES)}), s(code, back) AS (VALUES {sql_values(policy.STATUS_OF_CODE)}),
    c AS (SELECT event_id, status, CASE WHEN status IN (401, 403, 404, 405, 409, 415, 503) THEN CASE status WHEN 404 THEN 'NotFound' WHEN 405 THEN 'MethodNotAllowed' WHEN 503 THEN 'ServiceUnavailable' END
        WHEN status BETWEEN 400 AND 499 THEN 'InvalidRequest' ELSE 'InternalServerError' END AS code FROM a WHERE status >= 400)
    SELECT c.status, code, message, CAST(back AS INT) AS back, count(*) AS n FROM c JOIN m USING (code) JOIN s USING (code) GROUP BY ALL""")
def error_messages(spark, sf_dir):
    """The failed calls of the log by status, with the error that is made of each: code, message, and the code's own status."""
    failed = attempt_log(spark, sf_dir).where("status >= 400").withColumn("code", policy.code_of_status(F.lit("di"), F.col("status")))
    return failed.select("status", "code", policy.message_of_code(F.col("code")).alias("message"), policy.status_of_code(F.col("code")).alias("back")).groupBy("status", "code", "message", "back").agg(F.count("*").alias("n"))


ROLES = "CASE event_id % 5 WHEN 0 THEN 'title' WHEN 1 THEN 'sectionHeading' WHEN 2 THEN NULL ELSE event_type END"


@query(f"""SELECT event_id, coalesce({ROLES} IN ('title', 'sectionHeading'), false) AS heading, CASE WHEN value > 10 THEN (value - value / 4) / value END AS usage,
    CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN event_type || ': ' || user_id ELSE CAST(user_id AS VARCHAR) END AS summary,
    CASE WHEN event_id % 4 = 0 THEN 'whole' WHEN event_id % 3 > 0 THEN 'whole_after_merge' ELSE 'merged' END AS fallback, 'part-' || (event_id % 90 + 1) || '-' || (event_id % 90 + 1 + event_id % 7) || '.json' AS label,
    CASE WHEN value <= 0.25 THEN 0.25::DOUBLE WHEN value <= 0.5 THEN 0.5 WHEN value <= 1 THEN 1 WHEN value <= 2 THEN 2 WHEN value <= 5 THEN 5 WHEN value <= 10 THEN 10 WHEN value <= 30 THEN 30 WHEN value <= 60 THEN 60 WHEN value <= 120 THEN 120 WHEN value <= 300 THEN 300 END AS bucket FROM events""")
def small_rules(spark, sf_dir):
    """Headings, the used share of a volume, status lines, fallbacks, part names and histogram buckets of the events' values."""
    n, value = F.col("event_id"), F.col("value")
    role = F.when(n % 5 == 0, "title").when(n % 5 == 1, "sectionHeading").when(n % 5 != 2, F.col("event_type"))
    status, message = F.when(n % 3 == 2, "").otherwise(F.col("event_type")), F.when(n % 3 == 0, "").otherwise(F.col("user_id").cast("string"))
    numbers = F.sequence(n % 90 + 1, n % 90 + 1 + n % 7)
    return read(spark, sf_dir, "events").select(
        "event_id", policy.heading(role).alias("heading"), policy.usage(F.when(value > 10, value).otherwise(0.0), value / 4).alias("usage"), policy.summary(status, message).alias("summary"),
        attempts.fallback(F.when(n % 4 == 0, "whole").otherwise("split"), n % 3).alias("fallback"), pages.label(numbers, "part", ".json").alias("label"), metrics.bucket(value).alias("bucket"),
    )


@query("SELECT c_custkey AS doc_id, 1 + c_custkey % 7 AS pages, 1 + (c_custkey % 7) // 3 AS sections, true AS same FROM customer")
def generated_round_trip(spark, sf_dir):
    """A result of some pages made for each customer, cut by pages of two, merged again: equal in every byte, with its sections."""
    documents = spread(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), (1 + F.col("c_custkey") % 7).alias("pages")), "doc_id", 2_000)
    whole = generated.layout_results(documents)
    k = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("pages") - 1) / 2))
    plan = documents.select("doc_id", "pages", F.explode(k).alias("k")).select("doc_id", "k", F.sequence(2 * F.col("k") + 1, F.least(2 * F.col("k") + 2, F.col("pages"))).alias("planned"))
    again = assembly.documents(cutting.cut(whole, plan, units.CODE_POINTS), unit=units.CODE_POINTS)
    n = F.get(F.filter("counts", lambda c: c["name"] == "sections"), F.lit(0))["items"] - 1
    # Both sides hold every result, so they are merged: a broadcast would take all of one side through the driver.
    both = whole.join(again.select("doc_id", n.alias("sections"), F.col("result").alias("merged")).hint("merge"), "doc_id")
    return both.select("doc_id", "pages", "sections", (F.col("result") == F.col("merged")).alias("same"))
