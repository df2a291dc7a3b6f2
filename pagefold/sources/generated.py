"""Results made by rule, of any number of documents and pages: input for the merge, the cut and the invariants at any size.

A document's pages are rows of a plan; offsets are running sums over them.  Every page has a body; every `every`-th page,
the first one included, opens with a heading, whose section holds the bodies up to the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BOX = '"polygon":[0,0,1,0,1,1,0,1]'


def joined(*pieces) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in pieces))


def page_rows(documents: DataFrame, every: int) -> DataFrame:
    """(doc_id, page, heading, body, text, offset, first): the pages of (doc_id, pages), with the index of their first paragraph."""
    rows = documents.where("pages >= 1").select("doc_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("pages").cast("bigint"))).alias("page"))
    heading = F.when((F.col("page") - 1) % every == 0, joined("Part ", F.floor((F.col("page") - 1) / every) + 1))
    rows = rows.withColumns({"heading": heading, "body": joined("Text of page ", F.col("page"), " of document ", F.col("doc_id"))})
    rows = rows.withColumn("text", F.concat_ws("\n", "heading", "body"))
    before = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda value: F.coalesce(F.sum(value).over(before), F.lit(0)).cast("bigint")
    return rows.withColumns({"offset": total(F.length("text") + 1), "first": total(F.when(F.col("heading").isNull(), 1).otherwise(2))})


def in_order(value: Column) -> Column:
    """The values of a document's pages, joined by commas."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", value.alias("v")))), lambda p: p["v"]), ",")


def layout_results(documents: DataFrame, every: int = 3) -> DataFrame:
    """(doc_id, pages, result): a layout result, offsets in code points, for each (doc_id, pages) of a page or more."""
    rows = page_rows(documents, every)
    span = lambda at, n: joined('{"offset":', at, ',"length":', n, "}")
    paragraph = lambda text, at, role: joined('{"spans":[', span(at, F.length(text)), '],"boundingRegions":[{"pageNumber":', F.col("page"), f",{BOX}}}]{role},\"content\":\"", text, '"}')
    titled = F.col("heading").isNotNull()
    below = F.col("offset") + F.when(titled, F.length("heading") + 1).otherwise(0)
    lines = lambda text, at: joined('{"content":"', text, '","spans":[', span(at, F.length(text)), "]}")
    words = F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")
    at = lambda i: F.col("offset") + F.when(i > 0, F.length(F.array_join(F.slice(words, 1, i), " ")) + 1).otherwise(0)
    told = F.array_join(F.transform(words, lambda w, i: joined('{"content":"', w, f'",{BOX},"span":', span(at(i), F.length(w)), "}")), ",")
    page = joined('{"pageNumber":', F.col("page"), ',"spans":[', span(F.col("offset"), F.length("text")), '],"words":[', told, '],"lines":[', F.when(titled, joined(lines(F.col("heading"), F.col("offset")), ",")).otherwise(""), lines(F.col("body"), below), "]}")
    paragraphs = joined(F.when(titled, joined(paragraph(F.col("heading"), F.col("offset"), ',"role":"sectionHeading"'), ",")).otherwise(""), paragraph(F.col("body"), below, ""))
    pointers = joined(F.when(titled, joined('"/paragraphs/', F.col("first"), '",')).otherwise(""), '"/paragraphs/', F.col("first") + F.when(titled, 1).otherwise(0), '"')
    rows = rows.withColumns({"part": F.floor((F.col("page") - 1) / every) + 1, "page_json": page, "paragraph_json": paragraphs, "pointers": pointers})
    parts = rows.groupBy("doc_id", "part").agg(
        F.min("page").alias("page"), F.max("page").alias("last"), in_order(F.col("page_json")).alias("pages_json"), in_order(F.col("paragraph_json")).alias("paragraphs_json"), in_order(F.col("pointers")).alias("elements"),
        F.min("offset").alias("begin"), F.max(F.col("offset") + F.length("text")).alias("end"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n").alias("text"),
    )
    section = joined('{"spans":[', span(F.col("begin"), F.col("end") - F.col("begin")), '],"elements":[', F.col("elements"), "]}")
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n")
    content = F.replace(texts, F.lit("\n"), F.lit("\\n"))
    whole = joined(
        '{"apiVersion":"v","modelId":"m","stringIndexType":"unicodeCodePoint","content":"', content, '","pages":[', in_order(F.col("pages_json")), '],"paragraphs":[', in_order(F.col("paragraphs_json")),
        '],"styles":[],"contentFormat":"text","sections":[{"spans":[', span(F.lit(0), F.max("end")), '],"elements":[', in_order(joined('"/sections/', F.col("part"), '"')), "]},", in_order(section), "]}",
    )
    return parts.groupBy("doc_id").agg(F.max("last").alias("pages"), whole.alias("result"))


def read_results(documents: DataFrame) -> DataFrame:
    """(doc_id, pages, result): a result of lines for each (doc_id, pages) of a page or more."""
    box = "[0,0,1,0,1,1,0,1]"
    line = lambda text: joined('{"boundingBox":', box, ',"text":"', text, '","appearance":{},"words":[', F.array_join(F.transform(F.split(text, " "), lambda w: joined('{"text":"', w, f'","boundingBox":{box},"confidence":0.9}}')), ","), "]}")
    rows = page_rows(documents, 1)
    page = joined('{"page":', F.col("page"), ',"unit":"inch","lines":[', line(F.col("heading")), ",", line(F.col("body")), "]}")
    whole = joined('{"version":"3.2.0","modelVersion":"m","readResults":[', in_order(page), "]}")
    return rows.groupBy("doc_id").agg(F.max("page").alias("pages"), whole.alias("result"))
