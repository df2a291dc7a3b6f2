"""Findings of results: a sound one has none, and every planted fault is told by its rule and path."""

import json

import pytest

from pagefold.operators import invariants

BOX = [0, 0, 1, 0, 1, 1, 0, 1]


def spans(*pairs):
    return [{"offset": o, "length": n} for o, n in pairs]


def sound():
    word = lambda t, o: {"content": t, "polygon": BOX, "span": {"offset": o, "length": len(t)}}
    region = [{"pageNumber": 1, "polygon": BOX}]
    return {
        "apiVersion": "v", "modelId": "m", "stringIndexType": "unicodeCodePoint", "content": "ab cd\nef :selected:", "contentFormat": "text", "styles": [],
        "pages": [
            {"pageNumber": 1, "spans": spans((0, 5)), "words": [word("ab", 0), word("cd", 3)], "lines": [{"content": "ab cd", "spans": spans((0, 5))}]},
            {"pageNumber": 2, "spans": spans((6, 13)), "words": [word("ef", 6)], "selectionMarks": [{"span": {"offset": 9, "length": 10}}]},
        ],
        "paragraphs": [{"content": "ab cd", "spans": spans((0, 5)), "boundingRegions": region}, {"content": "ef", "spans": spans((6, 2)), "boundingRegions": [{"pageNumber": 2, "polygon": BOX}]}],
        "tables": [{"rowCount": 1, "columnCount": 1, "spans": spans((0, 2)), "boundingRegions": region, "cells": [{"content": "ab", "spans": spans((0, 2)), "rowIndex": 0, "columnIndex": 0, "elements": ["/paragraphs/0"]}]}],
        "figures": [{"id": "1.1", "spans": spans((0, 2)), "boundingRegions": region, "elements": []}, {"id": "1.2", "spans": spans((3, 2)), "boundingRegions": region, "caption": {"spans": spans((3, 2)), "elements": ["/paragraphs/1"]}}],
        "sections": [{"spans": spans((0, 19)), "elements": ["/sections/1", "/paragraphs/0"]}, {"spans": spans((0, 2), (6, 2)), "elements": ["/paragraphs/1"]}],
    }


def without(d, k):
    del d[k]


# What is done to the sound result, and the (rule, path) that must be told.
FAULTS = [
    (lambda d: None, []),
    (lambda d: without(d, "modelId"), [("present", "/modelId")]),
    (lambda d: without(d, "styles"), [("presence", "/styles")]),
    (lambda d: d.update(figures=[]), [("presence", "/figures")]),
    (lambda d: d.update(stringIndexType="words"), [("unit", "/stringIndexType")]),
    (lambda d: d["pages"][1].update(pageNumber=3), [("page-numbers", "/pages"), ("region-page", "/paragraphs/1/boundingRegions/0")]),
    (lambda d: d["pages"][0]["spans"].append({"offset": 0, "length": 1}), [("page-span", "/pages/0"), ("page-join", "/pages/1")]),
    (lambda d: d["pages"][1]["spans"][0].update(offset=5, length=14), [("page-join", "/pages/1")]),
    (lambda d: d.update(content="ab cd ef :selected:"), [("page-join", "/pages/1")]),
    (lambda d: d["pages"][0].update(words=[]), [("page-words", "/pages/0")]),
    (lambda d: d["pages"][0]["words"].reverse(), [("order", "/pages/0/words/1")]),
    (lambda d: d["pages"][0]["words"][0].update(content="ax"), [("word-content", "/pages/0/words/0")]),
    (lambda d: d["pages"][1]["words"][0].update(content="cd", span={"offset": 3, "length": 2}), [("word-page", "/pages/1/words/0")]),
    (lambda d: d["pages"][0]["words"][1].update(span={"offset": 18, "length": 2}), [("span", "/pages/0/words/1/span")]),
    (lambda d: d["pages"][0]["words"][0].update(polygon=[1]), [("polygon", "/pages/0/words/0")]),
    (lambda d: d["pages"][0]["lines"][0].update(content="ab"), [("line-content", "/pages/0/lines/0")]),
    (lambda d: d["pages"][0].update(barcodes=[]), [("presence", "/pages/0/barcodes")]),
    (lambda d: d["pages"][1]["selectionMarks"][0]["span"].update(length=9), [("selection-mark", "/pages/1/selectionMarks/0")]),
    (lambda d: d["pages"][1]["spans"][0].update(length=12), [("page-end", "/pages")]),
    (lambda d: d["paragraphs"][0].update(content="ab  cd"), [("paragraph-content", "/paragraphs/0")]),
    (lambda d: d["paragraphs"].reverse(), [("order", "/paragraphs/1")]),
    (lambda d: d["tables"][0]["cells"][0].update(rowIndex=1), [("cell-index", "/tables/0/cells/0")]),
    (lambda d: d["tables"][0]["cells"][0].update(elements=["/paragraphs/2"]), [("pointer", "/tables/0/cells/0/elements/0")]),
    (lambda d: d["tables"][0]["cells"][0].update(elements=["/words/0"]), [("pointer", "/tables/0/cells/0/elements/0")]),
    (lambda d: d["figures"][1].update(id="1.1"), [("figure-id", "/figures/1"), ("figure-id", "/figures")]),
    (lambda d: d["figures"][0].update(id="x"), [("figure-id", "/figures/0"), ("figure-id", "/figures")]),
    (lambda d: d["figures"][1].update(id="2.1"), [("figure-id", "/figures/1")]),
    (lambda d: d["figures"][1]["caption"].update(elements=["/tables/1"]), [("pointer", "/figures/1/caption/elements/0")]),
    (lambda d: d["sections"][0].update(elements=[]), [("section-tree", "/sections/1")]),
    (lambda d: d["sections"][1].update(elements=["/sections/0"]), [("section-tree", "/sections/0")]),
    (lambda d: d["sections"][1].update(spans=spans((6, 2), (0, 2))), [("section-spans", "/sections/1/spans/1")]),
    (lambda d: d["sections"][1].update(spans=spans((0, 2), (6, 99))), [("span", "/sections/1/spans/1")]),
    (lambda d: without(d["pages"][1], "spans"), [("page-span", "/pages/1"), ("word-page", "/pages/1/words/0"), ("page-end", "/pages")]),
    (lambda d: without(d["tables"][0], "cells"), []),
    (lambda d: d["paragraphs"][0]["spans"][0].update(offset=None), [("span", "/paragraphs/0/spans/0")]),
]


def test_every_fault_is_told(spark):
    rows = []
    for i, (spoil, _) in enumerate(FAULTS):
        d = sound()
        spoil(d)
        rows.append((i, json.dumps(d), "other column"))
    found = invariants.result_findings(spark.createDataFrame(rows, "doc_id int, result string, rule string")).collect()
    for i, (_, wanted) in enumerate(FAULTS):
        assert sorted((r.rule, r.path) for r in found if r.doc_id == i) == sorted(wanted), i


@pytest.mark.parametrize("unit", ["textElements", "unicodeCodePoint", "utf16CodeUnit"])
def test_spans_are_of_the_results_own_unit_beyond_one_block(spark, unit):
    words = ["éa", "\U0001f600", "b", "\U0001f468‍\U0001f469"] * 300
    if unit != "textElements":
        words += ["\U0001f600￿", "￿"]
    size = {"unicodeCodePoint": len, "utf16CodeUnit": lambda w: len(w.encode("utf-16-be")) // 2, "textElements": lambda w: {3: 2 if w[-1] == "a" else 1}.get(len(w), 1)}[unit]
    at, told = 0, []
    for w in words:
        told.append({"content": w, "polygon": BOX, "span": {"offset": at, "length": size(w)}})
        at += size(w) + 1
    d = {"apiVersion": "v", "modelId": "m", "stringIndexType": unit, "contentFormat": "text", "content": " ".join(words), "styles": [], "pages": [{"pageNumber": 1, "spans": spans((0, at - 1)), "words": told}]}
    rows = [(1, json.dumps(d), [1]), (2, json.dumps(d), [7])]
    if unit == "utf16CodeUnit":
        at = told[1]["span"]["offset"]
        d["paragraphs"] = [{"content": "x", "spans": spans((at + 1, 1))}, {"content": "x", "spans": spans((at, 1))}]
        rows.append((3, json.dumps(d), None))
    found = invariants.result_findings(spark.createDataFrame(rows, "doc_id int, result string, pages array<int>"), wanted="pages", expect={"modelId": "m"}).collect()
    split = [(3, "span", "/paragraphs/0/spans/0"), (3, "order", "/paragraphs/1"), (3, "span", "/paragraphs/1/spans/0")] if unit == "utf16CodeUnit" else []
    assert sorted(map(tuple, found)) == sorted([(2, "page-numbers", "/pages"), *split])


def test_expected_members_broken_texts_nulls_and_empty_tables(spark):
    kind = "doc_id int, result string"
    rows = [(1, json.dumps(sound())), (2, None), (3, "{"), (4, "[]"), (5, json.dumps(sound() | {"pages": 5}))]
    found = invariants.result_findings(spark.createDataFrame(rows, kind), expect={"modelId": "other", "contentFormat": "text"}).collect()
    assert [(r.rule, r.path) for r in found if r.doc_id == 1] == [("consistent", "/modelId")]
    assert all(("malformed", "/") in [(r.rule, r.path) for r in found if r.doc_id == i] for i in (2, 3, 4, 5))
    for check in (invariants.result_findings, invariants.read_findings):
        assert check(spark.createDataFrame([], kind)).collect() == []


def test_results_of_lines(spark):
    line = lambda **kw: {"text": "a b", "boundingBox": BOX, "appearance": {"style": {}}, "words": [{"text": t, "boundingBox": BOX, "confidence": 0.5} for t in "ab"]} | kw
    result = lambda **kw: {"version": "3.2.0", "modelVersion": "m", "readResults": [{"page": 1, "unit": "inch", "lines": [line(**kw)]}]}
    at = "/readResults/0/lines/0"
    faults = [
        (result(), []), (result() | {"version": "3"}, [("version", "/version")]), (result() | {"modelVersion": "n"}, [("consistent", "/modelVersion")]),
        (result(boundingBox=[1]), [("bbox", at)]), (result(text=""), [("line-words", at), ("text", at)]), (result(appearance=None), [("appearance", at)]),
        (result(words=[{"text": "a b", "boundingBox": [], "confidence": 1.5}]), [("bbox", at + "/words/0"), ("confidence", at + "/words/0")]),
        ({"version": "3.2.0", "modelVersion": "m"}, [("present", "/readResults")]),
        (result() | {"readResults": [{"page": 2, "unit": "pixel"}]}, [("page-numbers", "/readResults"), ("unit", "/readResults/0/unit")]),
    ]
    rows = [(i, json.dumps(r)) for i, (r, _) in enumerate(faults)]
    found = invariants.read_findings(spark.createDataFrame(rows, "doc_id int, result string"), model="m", unit="inch").collect()
    for i, (_, wanted) in enumerate(faults):
        assert sorted((r.rule, r.path) for r in found if r.doc_id == i) == sorted(wanted), i


def test_envelopes(spark):
    head = '{"status":"%s","createdDateTime":"c","lastUpdatedDateTime":"l"'
    faults = [
        (head % "succeeded" + ',"analyzeResult":{}}', []), (head % "running" + "}", []), (head % "failed" + ',"error":{}}', []),
        (head % "succeeded" + "}", [("result", "/analyzeResult")]), (head % "running" + ',"analyzeResult":{}}', [("result", "/analyzeResult")]),
        (head % "running" + ',"error":{}}', [("error-member", "/error")]), ('{"createdDateTime":"c","status":"running"}', [("key-order", "/")]),
        ('{"status":"running","lastUpdatedDateTime":"c"}', [("key-order", "/")]), ("x", [("malformed", "/")]), (None, [("malformed", "/")]),
    ]
    found = invariants.envelope_findings(spark.createDataFrame([(i, b) for i, (b, _) in enumerate(faults)], "doc_id int, body string")).collect()
    for i, (_, wanted) in enumerate(faults):
        assert [(r.rule, r.path) for r in found if r.doc_id == i] == wanted, i
    none = spark.createDataFrame([(1, head % "failed" + ',"error":{}}')], "doc_id int, body string")
    assert [r.rule for r in invariants.envelope_findings(none, has_error=False).collect()] == ["error-member"]
