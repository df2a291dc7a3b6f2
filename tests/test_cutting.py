"""Cutting: slices of escaped text by unit, cut then merge, problems by their paths, compose."""

import json
import random
import sys

import pytest

from pagefold.functions import jsontree, units
from pagefold.functions.unitindex import EscapedText, NotOnUnit
from pagefold.operators import cutting
from pagefold.plans import assembly, cutting as plan_cutting

sys.path.insert(0, __file__.rpartition("/")[0])
from test_sections import BODY, CASES, H, INTRO, NEXT, OPEN, rows_of, tree  # noqa: E402

PIECES = ["a", "é", "\\u00e9", "\\n", '\\"', "\\\\", "\\/", "😀", "\\ud83d\\ude00", "\\uD83D\\uDE00", "日", "é", "\\u0065\\u0301", " ", "\\t"]
CLUSTERS = {"é": 2, "\\u0065\\u0301": 2}


@pytest.mark.parametrize("unit", [units.CODE_POINTS, units.UTF16, units.GRAPHEMES])
def test_raw_slices_equal_decode_slice_and_encode(unit):
    rng = random.Random(7)
    for _ in range(200):
        chosen = [rng.choice(PIECES) for _ in range(rng.randint(0, 12))]
        spelled = '"' + "".join(chosen) + '"'
        whole = json.loads(spelled)
        clusters = [CLUSTERS.get(p, 1) for p in chosen]
        text = EscapedText(spelled, unit, clusters)
        # Unit boundaries, by plain Python: (unit offset, character offset).
        if unit == units.GRAPHEMES:
            bounds = {i: sum(clusters[:i]) for i in range(len(clusters) + 1)}
        else:
            width = lambda c: 2 if unit == units.UTF16 and ord(c) > 0xFFFF else 1  # noqa: E731, B023
            bounds = {sum(map(width, whole[:i])): i for i in range(len(whole) + 1)}
        assert len(text) == max(bounds)
        for a in range(len(text) + 1):
            if a not in bounds:
                with pytest.raises(NotOnUnit):
                    text.char(a)
                continue
            assert text.unit_at(bounds[a]) == a
            for b in range(a, len(text) + 1):
                if b in bounds:
                    assert json.loads(f'"{text.raw(a, b)}"') == whole[bounds[a] : bounds[b]] == text.part(a, b)
                    assert text.raw(0, a) + text.raw(a, b) + text.raw(b, len(text)) == spelled[1:-1]
        with pytest.raises(NotOnUnit):
            text.char(len(text) + 1)


def test_trees_keep_spelling():
    text = '{"a":[1.50,"\\u00e9",{}],"a":null,"b":{"c":[[]]}}'
    root = jsontree.parse(text)
    assert jsontree.spell(root) == text and root.get("a").items[0].raw == "1.50" and root.get("z") is None
    assert [p for p, _ in jsontree.walk(root)][:3] == [(), ("a",), ("a", 0)]


def wholes(spark, unit=units.CODE_POINTS):
    """Merged results of the section cases, with the plan that they came of."""
    rows = [r for i, (first, later, _) in enumerate(CASES.values()) for r in rows_of(i, [first, *later])]
    rows = [(*r[:3], r[3].replace('"unicodeCodePoint"', f'"{unit}"')) for r in rows]
    parts = spark.createDataFrame(rows, "doc_id int, k int, planned array<int>, raw string")
    return parts, assembly.merged(parts, unit=unit)[0]


@pytest.mark.parametrize("unit", [units.CODE_POINTS, units.UTF16, units.GRAPHEMES])
def test_cut_then_merge_is_the_same_in_every_byte(spark, unit):
    parts, whole = wholes(spark, unit)
    before = {r.doc_id: r.result for r in whole.collect()}
    # By the plan of the parts, and page by page.
    pages = parts.selectExpr("doc_id", "explode(planned) as page").selectExpr("doc_id", "page - 1 as k", "array(page) as planned")
    # These trees are no cuts of a whole's: a section that wraps another than its next is not folded back.
    odd = {i for i, name in enumerate(CASES) if name in ("a chain deeper than what is open", "a wrapper around another than the next", "a tree that loops back", "a part that ends in its root closes all")}
    for plan in (parts.select("doc_id", "k", "planned"), pages):
        cut = plan_cutting.cut(whole, plan, unit)
        assert cut.where("size(problems) > 0").collect() == []
        out, _, bad = assembly.merged(cut, unit=unit)
        assert [r for r in bad.collect() if r.doc_id not in odd] == []
        after = {r.doc_id: r.result for r in out.collect()}
        assert {i: after.get(i) for i in before if i not in odd} == {i: before[i] for i in before if i not in odd}


def test_parts_of_the_merge_come_back(spark):
    names = list(CASES)
    same = [i for i, name in enumerate(names) if name in ("a root alone", "a heading continues nothing", "an untitled section")]
    parts, whole = wholes(spark)
    cut = {(r.doc_id, r.k): json.loads(r.raw) for r in plan_cutting.cut(whole, parts.select("doc_id", "k", "planned"), units.CODE_POINTS).collect()}
    for r in parts.collect():
        own = json.loads(r.raw)
        assert {k: v for k, v in own.items() if k != "sections"} == {k: v for k, v in cut[r.doc_id, r.k].items() if k != "sections"}
        if r.doc_id in same and r.k == 0:
            assert own["sections"] == cut[r.doc_id, r.k]["sections"]


WHOLE = {
    "apiVersion": "v", "stringIndexType": "unicodeCodePoint", "content": "a😀\nbc", "pages": [{"pageNumber": 4, "spans": [{"offset": 0, "length": 2}]}, {"pageNumber": 6, "spans": [{"offset": 3, "length": 2}]}],
    "paragraphs": [{"spans": [{"offset": 0, "length": 2}], "boundingRegions": [{"pageNumber": 4}]}, {"spans": [{"offset": 3, "length": 2}]}],
    "figures": [{"id": "6.2", "boundingRegions": [{"pageNumber": 6}], "elements": ["/paragraphs/1"], "caption": {"span": {"offset": 3, "length": 1}}}],
    "styles": [{"spans": [{"offset": 1, "length": 3}]}, {"spans": [{"offset": 4, "length": 0}]}], "extra": [1],
}


def cut_of(whole, plan=((4,), (6,)), unit=units.CODE_POINTS):
    texts, notes, problems = cutting.parts(whole if isinstance(whole, str) or whole is None else json.dumps(whole, ensure_ascii=False), [list(p) for p in plan], unit)
    return [t and json.loads(t) for t in texts], notes, problems


def test_items_styles_figures_and_spans_are_placed():
    (one, two), notes, problems = cut_of({"status": "x", "analyzeResult": WHOLE})
    assert not problems and any("extra" in n for n in notes)
    assert one["content"] == "a😀" and two["content"] == "bc" and "figures" not in one
    assert one["styles"] == [{"spans": [{"offset": 1, "length": 1}]}]
    assert two["styles"] == [{"spans": [{"offset": 0, "length": 1}]}, {"spans": [{"offset": 1, "length": 0}]}]
    assert two["figures"] == [{"id": "1.2", "boundingRegions": [{"pageNumber": 1}], "elements": ["/paragraphs/0"], "caption": {"span": {"offset": 0, "length": 1}}}]
    assert two["paragraphs"] == [{"spans": [{"offset": 0, "length": 2}]}] and two["pages"] == [{"pageNumber": 1, "spans": [{"offset": 0, "length": 2}]}]


def changed(change, **kw):
    whole = json.loads(json.dumps(WHOLE))
    change(whole)
    return cut_of(whole, **kw)


PROBLEMS = {
    "figures[0].elements[0] \"/paragraphs/9\" points past the result's 2 paragraphs": lambda w: w["figures"][0].update(elements=["/paragraphs/9"]),
    'figures[0].elements[0] "/pages/0" points into pages, which the cut does not renumber': lambda w: w["figures"][0].update(elements=["/pages/0"]),
    "figures[0].elements[0] 7 is not a pointer /<member>/<index>": lambda w: w["figures"][0].update(elements=[7]),
    'figures[0].id "6" is not <page>.<n>': lambda w: w["figures"][0].update(id="6"),
    'figures[0].id "9.1" names page 9, which is not in the result': lambda w: w["figures"][0].update(id="9.1"),
    'figures[0].id "4.1" names page 4, but its first bounding region is on page 6': lambda w: w["figures"][0].update(id="4.1"),
    "figures[0].caption.span {offset 3, length 9}: 12 is beyond the 5 units": lambda w: w["figures"][0]["caption"]["span"].update(length=9),
    'styles[0].spans[0] {"offset":-1,"length":3} is not an {offset, length} span': lambda w: w["styles"][0]["spans"][0].update(offset=-1),
    "paragraphs[0].boundingRegions[0].pageNumber 5 is not a page of the result": lambda w: w["paragraphs"][0].update(boundingRegions=[{"pageNumber": 5}]),
    "pages[0] and pages[1] are both page 6": lambda w: w["pages"][0].update(pageNumber=6),
    "pages[0].pageNumber 0 is not a page number": lambda w: w["pages"][0].update(pageNumber=0),
    "styles is 3, not an array": lambda w: w.update(styles=3),
    "tables[1] is [], not an object": lambda w: w.update(tables=[{}, []]),
    "figures[0].elements is {}, not an array": lambda w: w["figures"][0].update(elements={}),
    "the result has no pages": lambda w: w.pop("pages"),
    "content (absent) is no text": lambda w: w.pop("content"),
    'stringIndexType "words" is not the unit that the cut counts in': lambda w: w.update(stringIndexType="words"),
    "part 1: pages [6] have no spans": lambda w: w["pages"][1].pop("spans"),
}


@pytest.mark.parametrize("problem", PROBLEMS)
def test_each_problem_is_told_by_its_path(problem):
    texts, _, problems = changed(PROBLEMS[problem])
    assert problem in problems and texts == [None, None]


def test_problems_of_plans_and_texts():
    assert cut_of(WHOLE, plan=((4,), (5, 4), ()))[2] == ["part 1: page 5 is not in the result", "page 4 is planned in part 0 and again in part 1", "part 2 of the plan has no pages"]
    assert cut_of(WHOLE, plan=((6,), (4,)))[2] == ["the text of part 0 reaches into that of part 1"]
    assert cut_of(None)[2][0].startswith("not well-formed") and cut_of("[1]")[2] == ["the result is [1], not an object"]
    assert cut_of('{"content":"","pages":[],"pages":[]}', plan=())[2] == ["the plan has no parts", 'the result: member "pages" appears twice']
    _, _, many = changed(lambda w: w.update(tables=[1] * 20))
    assert len(many) == 9 and many[-1] == "and 12 more"
    utf16 = changed(lambda w: w.update(stringIndexType="utf16CodeUnit", figures=[], styles=[{"spans": [{"offset": 2, "length": 1}]}]), unit=units.UTF16)[2]
    assert "styles[0].spans[0] {offset 2, length 1}: 2 is inside a character" in utf16 and len(utf16) == 3


def test_markdown_page_breaks_are_left_out_and_come_back(spark):
    content = "# A\n\ntext\n\n<!-- PageBreak -->\nmore\n"
    at = content.index("more")
    whole = {"apiVersion": "v", "modelId": "m", "stringIndexType": "unicodeCodePoint", "content": content, "contentFormat": "markdown",
        "pages": [{"pageNumber": 1, "spans": [{"offset": 0, "length": at}]}, {"pageNumber": 2, "spans": [{"offset": at, "length": 5}]}]}
    (one, two), notes, problems = cut_of(whole, plan=((1,), (2,)))
    assert not problems and notes == ["part 0: the page break at its end is left out"] and (one["content"], two["content"]) == ("# A\n\ntext\n", "more\n")
    frame = spark.createDataFrame([(1, json.dumps(whole, separators=(",", ":")))], "doc_id int, result string")
    plan = spark.createDataFrame([(1, 0, [1]), (1, 1, [2])], "doc_id int, k int, planned array<int>")
    merged = assembly.merged(plan_cutting.cut(frame, plan, units.CODE_POINTS), unit=units.CODE_POINTS)[0].first()
    assert json.loads(merged.result)["content"] == content
    whole["content"] = content.replace("PageBreak", "PageBroke")
    assert cut_of(whole, plan=((1,), (2,)))[2] == ["part 0: the text of its pages does not end with a page break"]


def test_bad_documents_end_nothing(spark):
    good = json.dumps(WHOLE)
    rows = [(1, good), (2, None), (3, "{"), (4, good.replace("/paragraphs/1", "/paragraphs/7"))]
    plan = [(i, k, [p]) for i in (1, 2, 3, 4, 9) for k, p in enumerate((4, 6))]
    cut = plan_cutting.cut(spark.createDataFrame(rows, "doc_id int, result string"), spark.createDataFrame(plan, "doc_id int, k int, planned array<int>"), units.CODE_POINTS)
    found = {(r.doc_id, r.k): (r.raw is None, len(r.problems)) for r in cut.collect()}
    assert found == {(i, k): (i != 1, int(i != 1)) for i in (1, 2, 3, 4) for k in (0, 1)}
    read = assembly.cut(spark.createDataFrame([(1, '{"readResults":[{"page":1}]}'), (2, "{"), (3, None)], "doc_id int, result string"), spark.createDataFrame([(1, 0, [1]), (1, 1, [2]), (2, 0, [1]), (3, 0, [1])], "doc_id int, k int, planned array<int>"))
    assert {(r.doc_id, r.raw is None, len(r.problems)) for r in read.collect()} == {(1, True, 1), (2, True, 1), (3, True, 1)}


def test_compose(spark):
    one = {k: v for k, v in WHOLE.items() if k not in ("extra", "styles")} | {"modelId": "m"}
    one["pages"] = [p | {"pageNumber": i} for i, p in enumerate(one["pages"], 1)]
    one["paragraphs"] = [one["paragraphs"][0] | {"boundingRegions": [{"pageNumber": 1}]}, one["paragraphs"][1]]
    one["figures"] = [one["figures"][0] | {"id": "2.2", "boundingRegions": [{"pageNumber": 2}]}]
    text = json.dumps(one, separators=(",", ":"))
    rows = [(1, 0, json.dumps({"status": "succeeded", "analyzeResult": one})), (1, 1, text), (2, 0, text), (2, 1, '{"pages":[]}'), (3, 0, text.replace("2.2", "1.2")), (3, 1, text)]
    whole, plan = plan_cutting.compose(spark.createDataFrame(rows, "doc_id int, k int, raw string"), units.CODE_POINTS)
    found = {r.doc_id: r for r in whole.collect()}
    assert found[1].codes == [] and [f["id"] for f in json.loads(found[1].result)["figures"]] == ["2.2", "4.2"]
    assert "pages" in found[2].codes and found[2].result is None and found[3].codes == []
    assert sorted((r.doc_id, r.k, r.planned) for r in plan.where("doc_id = 1").collect()) == [(1, 0, [1, 2]), (1, 1, [3, 4])]
    back = plan_cutting.cut(whole.where("doc_id = 1"), plan, units.CODE_POINTS).orderBy("k").collect()
    assert [json.loads(r.raw) for r in back] == [one, one]


def test_layout_round_trip_merges_the_whole_results_once(spark):
    from pagefold import merge_catalog

    found = merge_catalog.layout_round_trip(spark, "/root/testdata/sf0.001")
    assert found.where("not same").count() == 0
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # Two merges, each a measuring and a joining step, and the cut between them.
    assert plan.count("MapInArrow") == 5 and "ReusedExchange" in plan


def test_plans_may_come_with_the_results(spark):
    from pagefold import merge_catalog

    whole = assembly.merged(merge_catalog.sectioned_parts(spark, "/root/testdata/sf0.001"), unit=units.CODE_POINTS)[0].select("doc_id", "result", "pages")
    whole = spark.createDataFrame(whole.collect(), whole.schema)
    plan = whole.selectExpr("doc_id", "explode(sequence(1, pages)) planned").selectExpr("doc_id", "planned - 1 as k", "array(planned) planned")
    own = whole.selectExpr("doc_id", "result", "transform(sequence(1, pages), p -> struct(p - 1 as k, array(p) as planned)) plans")
    told = lambda rows: sorted((r.doc_id, r.k, r.planned, r.raw, r.problems) for r in rows.collect())
    assert told(plan_cutting.cut(own, None, units.CODE_POINTS)) == told(plan_cutting.cut(whole, plan, units.CODE_POINTS))
