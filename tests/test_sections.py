"""Sections over parts: what continues what, spans and pointers of the merged tree, and what is refused."""

import json

import pytest

from pagefold.functions import units
from pagefold.operators import sections
from pagefold.plans import assembly

KIND = "doc_id int, k int, planned array<int>, raw string"


def tree(*given):
    """Spelled sections of (offset, length or list of spans, elements)."""
    out = []
    for spans, elements in given:
        spans = spans if isinstance(spans, list) else [spans]
        out.append({"spans": [{"offset": a, "length": n} for a, n in spans], "elements": [f"/{'sections' if e[0] == 's' else 'paragraphs'}/{e[1:]}" for e in elements.split()]})
    return json.dumps(out, separators=(",", ":"))


def result(texts, roles, made):
    """A part of pages whose lines are paragraphs; roles name the headings by paragraph."""
    content, pages, paragraphs, at = "\n".join(texts), [], [], 0
    for i, text in enumerate(texts, 1):
        pages.append(f'{{"pageNumber":{i},"spans":[{{"offset":{at},"length":{len(text)}}}]}}')
        for line in text.split("\n") if text else []:
            role = f',"role":"{roles[len(paragraphs)]}"' if len(paragraphs) in roles else ""
            paragraphs.append(f'{{"spans":[{{"offset":{at},"length":{len(line)}}}]{role},"boundingRegions":[{{"pageNumber":{i}}}]}}')
            at += len(line) + 1
        at += not text
    sections_ = "" if made is None else f',"sections":{made}'
    return f'{{"apiVersion":"v","modelId":"m","stringIndexType":"unicodeCodePoint","content":{json.dumps(content)},"pages":[{",".join(pages)}],"paragraphs":[{",".join(paragraphs)}]{sections_}}}'


H = "sectionHeading"
OPEN = ("Part\nChapter\nBody one", {0: H, 1: H}, tree(((0, 21), "s1"), ((0, 21), "p0 s2"), ((5, 16), "p1 p2")))
INTRO = ("Intro\nBody one", {0: H}, tree(((0, 14), "s1"), ((0, 14), "p0 p1")))
CONTINUED = tree(((0, 35), "s1"), ((0, 35), "p0 s2"), ((5, 30), "p1 p2 p3 p4"))
NEXT = ("Body two\nMore\nNext\nText", {2: H})
SUB = ("Body two\nSub\nText", {1: H}, tree(((0, 17), "s1"), ((0, 17), "p0 s2"), ((9, 8), "p1 p2")))
BODY = ("Body two\nMore", {})
#: First part, later parts (a list of pages where there are several), and the sections of the whole.
CASES = {
    "a run that stops at a title": (INTRO, [("Body two\nPart Two\nChapter\nText", {1: "title", 2: H}, tree(((0, 30), "p0 p1 s1"), ((18, 12), "p2 p3")))], tree(((0, 45), "s1 p3 s2"), ((0, 23), "p0 p1 p2"), ((33, 12), "p4 p5"))),
    "a run over a blank page": (INTRO, [(["Body two", "", "Tail\nChapter\nText"], {2: H}, tree(([(0, 8), (10, 17)], "p0 p1 s1"), ((15, 12), "p2 p3")))],
        tree(([(0, 23), (25, 17)], "s1 s2"), ([(0, 23), (25, 4)], "p0 p1 p2 p3"), ((30, 12), "p4 p5"))),
    "an untitled section": (OPEN, [(*BODY, tree(((0, 13), "s1"), ((0, 13), "p0 p1")))], CONTINUED),
    "a root alone": (OPEN, [(*BODY, tree(((0, 13), "p0 p1")))], CONTINUED),
    "a run in the root": (OPEN, [(*NEXT, tree(((0, 23), "p0 p1 s1"), ((14, 9), "p2 p3")))], tree(((0, 45), "s1 s3"), ((0, 35), "p0 s2"), ((5, 30), "p1 p2 p3 p4"), ((36, 9), "p5 p6"))),
    "an untitled section with one of its own": (OPEN, [SUB], tree(((0, 39), "s1"), ((0, 39), "p0 s2"), ((5, 34), "p1 p2 p3 s3"), ((31, 8), "p4 p5"))),
    "a root alone behind a folded section": (OPEN, [SUB, ("Tail", {}, tree(((0, 4), "p0")))], tree(((0, 44), "s1"), ((0, 44), "p0 s2"), ((5, 39), "p1 p2 p3 s3"), ((31, 13), "p4 p5 p6"))),
    "a chain of untitled sections": (OPEN, [(*BODY, tree(((0, 13), "s1"), ((0, 13), "s2"), ((0, 13), "p0 p1")))], CONTINUED),
    "a wrapper around a heading": (OPEN, [("Next\nText", {0: H}, tree(((0, 9), "s1"), ((0, 9), "s2"), ((0, 9), "p0 p1")))], tree(((0, 31), "s1"), ((0, 31), "p0 s2 s3"), ((5, 16), "p1 p2"), ((22, 9), "p3 p4"))),
    "a chain deeper than what is open": (OPEN, [(*BODY, tree(((0, 13), "s1"), ((0, 13), "s2"), ((0, 13), "s3"), ((0, 13), "p0 p1")))],
        tree(((0, 35), "s1 s3"), ((0, 21), "p0 s2"), ((5, 16), "p1 p2"), ((22, 13), "s4"), ((22, 13), "s5"), ((22, 13), "p3 p4"))),
    "a wrapper around another than the next": (OPEN, [(*NEXT, tree(((0, 23), "s1"), ((0, 23), "s3 s2"), ((14, 9), "p2 p3"), ((0, 13), "p0 p1")))],
        tree(((0, 45), "s1 s3"), ((0, 21), "p0 s2"), ((5, 16), "p1 p2"), ((22, 23), "s5 s4"), ((36, 9), "p5 p6"), ((22, 13), "p3 p4"))),
    "a tree that loops back": ((*OPEN[:2], tree(((0, 21), "s1"), ((0, 21), "p0 s2"), ((5, 16), "p1 p2 s1"))), [(*BODY, tree(((0, 13), "p0 p1")))],
        tree(((0, 35), "s1"), ((0, 35), "p0 s2"), ((5, 30), "p1 p2 s1 p3 p4"))),
    "a heading continues nothing": (INTRO, [("Two\nText", {0: H}, tree(((0, 8), "s1"), ((0, 8), "p0 p1")))], tree(((0, 23), "s1 s2"), ((0, 14), "p0 p1"), ((15, 8), "p2 p3"))),
    "a part that ends in its root closes all": (("One", {0: "title"}, tree(((0, 3), "p0"))), [(*BODY, tree(((0, 13), "p0 p1")))], tree(((0, 17), "p0 p1 p2"))),
    "a blank part without sections": (INTRO, [("", {}, "[]"), (*BODY, tree(((0, 13), "p0 p1")))], tree(([(0, 14), (16, 13)], "s1"), ([(0, 14), (16, 13)], "p0 p1 p2 p3"))),
}


def rows_of(doc_id, parts):
    out, page = [], 1
    for k, (texts, roles, made) in enumerate(parts):
        texts = texts if isinstance(texts, list) else [texts]
        out.append((doc_id, k, list(range(page, page + len(texts))), result(texts, roles, made)))
        page += len(texts)
    return out


def test_continuations(spark):
    rows = [r for i, (first, later, _) in enumerate(CASES.values()) for r in rows_of(i, [first, *later])]
    out, counts, bad = assembly.merged(spark.createDataFrame(rows, KIND).repartition(7), unit=units.CODE_POINTS)
    assert bad.collect() == []
    found = {r.doc_id: r.result for r in out.collect()}
    n = {r.doc_id: r["items"] for r in counts.where("name = 'sections'").collect()}
    for i, (name, (_, _, want)) in enumerate(CASES.items()):
        assert found[i].partition('"sections":')[2][:-1] == want, name
        assert n[i] == len(json.loads(want)), name


def test_whole_document_and_pointers_to_sections_elsewhere(spark):
    parts = rows_of(1, [OPEN, SUB])
    spelled = parts[1][3].replace('"sections":[', '"sections": [ ').replace('"paragraphs":[', '"figures":[{"id":"1.1","elements":["/sections/2"]}],"paragraphs":[')
    first = parts[0][3].replace('"paragraphs":[', '"figures":[],"paragraphs":[')
    out, _, bad = assembly.merged(spark.createDataFrame([(*parts[0][:3], first), (*parts[1][:3], spelled)], KIND), unit=units.CODE_POINTS)
    assert bad.collect() == [] and '"figures":[{"id":"2.1","elements":["/sections/3"]}]' in out.first().result
    folded = spelled.replace("/sections/2", "/sections/1", 1)
    _, _, bad = assembly.merged(spark.createDataFrame([(*parts[0][:3], first), (*parts[1][:3], folded)], KIND), unit=units.CODE_POINTS)
    assert [(r.k, r.code) for r in bad.collect()] == [(1, "V31")]


def test_root_members_come_from_the_first_root_that_has_them(spark):
    one, two = rows_of(1, [INTRO, ("Two\nText", {0: H}, tree(((0, 8), "s1"), ((0, 8), "p0 p1")))])
    one = (*one[:3], one[3].replace('"elements":["/sections/1"]}', '"x":{"span":{"offset":1}},"elements":["/sections/1"]}'))
    two = (*two[:3], two[3].replace('[{"spans":[{"offset":0,"length":8}],"elements"', '[{"spans":[{"offset":0,"length":8}],"y":[ {"span":{"offset":1}}],"x":3,"elements"'))
    out, _, bad = assembly.merged(spark.createDataFrame([one, two], KIND), unit=units.CODE_POINTS)
    assert bad.collect() == []
    assert out.first().result.partition('"sections":')[2].startswith('[{"spans":[{"offset":0,"length":23}],"y":[ {"span":{"offset":16}}],"x":{"span":{"offset":1}},"elements":["/sections/1","/sections/2"]}')


@pytest.mark.parametrize("spans", ['{"offset":0}', '[{"offset":0}]', '[{"offset":0,"length":1,"length":1}]', '[{"offset":0,"length":1.0}]', '[{"offset":-1,"length":1}]', "[[0,1]]", "[3]", '[{"offset":0,"length":{"a":1}}]', '[{"offset":"0","length":1}]', "[{}]"])
def test_loose_spans_are_refused(spans):
    with pytest.raises(sections.Refused, match="V24"):
        sections.strict_spans(spans)


def test_strict_spans():
    assert sections.strict_spans(' [ {"length" : 2,"offset":1}, {"offset":0,"length":0}] ') == [(1, 2), (0, 0)] and sections.strict_spans("[]") == []
