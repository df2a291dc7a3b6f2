import json

import pytest

from pagefold.functions import jsontext, units
from pagefold.plans import assembly

KIND = "doc_id int, k int, planned array<int>, raw string"


def part(numbers, text="ab", extra="", **members):
    base = {"apiVersion": '"v"', "modelId": '"m"', "stringIndexType": '"unicodeCodePoint"', "content": json.dumps(text)}
    n = len(text)
    base["pages"] = "[" + ",".join(f'{{"pageNumber":{p}, "spans":[{{"offset":0,"length":{n}}}]}}' for p in numbers) + "]"
    base["paragraphs"] = f'[ {{"spans":[{{"offset":0,"length":{n}}}],"boundingRegions":[{{"pageNumber":{numbers[0]}}}],"x":1.50}} ]'
    base["figures"] = f'[{{"id":"{numbers[0]}.07","elements":["/paragraphs/0"],"caption":{{"span":{{"offset":1}}}}}}]'
    base |= members
    return "{" + ",".join(f'"{k}":{v}' for k, v in base.items() if v is not None) + extra + "}"


def run(spark, rows, **kw):
    kw = {"unit": units.CODE_POINTS} | kw
    out, counts, bad = assembly.merged(spark.createDataFrame(rows, KIND), **kw)
    return {r.doc_id: r.result for r in out.collect()}, sorted((r.doc_id, r.code) for r in bad.collect()), counts


def test_offsets_pages_pointers_and_figures_are_renumbered(spark):
    got, bad, counts = run(spark, [(1, 0, [3], part([1], "aé\"")), (1, 1, [5, 6], part([1, 2], "bc")), (1, 2, [9], part([9], "d"))])
    assert not bad
    assert got[1] == (
        '{"apiVersion":"v","modelId":"m","stringIndexType":"unicodeCodePoint","content":"a\\u00e9\\"\\nbc\\nd","pages":['
        '{"pageNumber":3, "spans":[{"offset":0,"length":3}]},{"pageNumber":5, "spans":[{"offset":4,"length":2}]},{"pageNumber":6, "spans":[{"offset":4,"length":2}]},'
        '{"pageNumber":9, "spans":[{"offset":7,"length":1}]}],"paragraphs":['
        ' {"spans":[{"offset":0,"length":3}],"boundingRegions":[{"pageNumber":3}],"x":1.50} , {"spans":[{"offset":4,"length":2}],"boundingRegions":[{"pageNumber":5}],"x":1.50} ,'
        ' {"spans":[{"offset":7,"length":1}],"boundingRegions":[{"pageNumber":9}],"x":1.50} ],"figures":['
        '{"id":"3.07","elements":["/paragraphs/0"],"caption":{"span":{"offset":1}}},{"id":"5.07","elements":["/paragraphs/1"],"caption":{"span":{"offset":5}}},'
        '{"id":"9.07","elements":["/paragraphs/2"],"caption":{"span":{"offset":8}}}]}'
    )
    assert {(r.name, r["items"]) for r in counts.collect()} == {("pages", 4), ("paragraphs", 3), ("figures", 3)}


def test_members_are_united_in_order_and_markdown_is_joined_as_it_is_spelled(spark):
    a = part([1], "<p>", contentFormat='"markdown"', figures=None, content='"\\u003cp\\u003e"')
    b = part([1], "q", contentFormat='"markdown"', styles="[]")
    c = part([1], "q", contentFormat='"markdown"').replace('"figures"', '"tables":[{}],"figures"')
    got, bad, _ = run(spark, [(1, 0, [1], a), (1, 1, [2], b), (1, 2, [3], c)])
    assert not bad and list(json.loads(got[1])) == ["apiVersion", "modelId", "stringIndexType", "content", "pages", "paragraphs", "tables", "figures", "contentFormat", "styles"]
    assert '\\u003cp\\u003e\\n\\u003c!-- PageBreak --\\u003e\\nq' in got[1]


SECTIONS = '[{"spans":[{"offset":0,"length":2}],"elements":["/sections/1"]},{"spans":[{"offset":0,"length":2}],"elements":["/paragraphs/0"]}]'

FAULTS = {
    "V03": (part([1])[:-1], None), "V04": (part([1], extra=',"\\u0061":1'), None), "V05": (part([1], extra=',"modelId":"m"'), None), "V06": (part([1], pages="{}"), None),
    "V07": (part([1], pages="[{}]"), None), "V08": (part([1], pages='[{"pageNumber":1.0}]'), None), "V09": (part([1]).replace('"content"', '"contents"'), None),
    "V10": (part([1]).replace('"content":"ab"', '"content":7'), None), "V11": (part([1]), part([1], modelId='"x"')), "V12": (part([1], extra=',"z":1'), part([1], extra=',"z":1.0')),
    "V13": (part([1], extra=',"z":[]'), part([1], extra=',"z":1')), "V14": (part([1], extra=',"z":[],"y":[]'), part([1], extra=',"y":[],"z":[]')), "V16": (part([1, 2]), None),
    "V17": (part([4]), None), "V18": (part([1], stringIndexType='"utf16CodeUnit"'), part([1], stringIndexType='"utf16CodeUnit"')), "V19": (part([1], contentFormat='"rtf"'), part([1], contentFormat='"rtf"')),
    "V21": (part([1]).replace('"length":2', '"length":3'), None), "V29": (part([1], figures='[{"span":{"offset":0.5}}]'), None), "V30": (part([1], tables='[{"boundingRegions":[{"pageNumber":2}]}]'), None),
    "V31": (part([1], figures='[{"elements":["/paragraphs/1"]}]'), None), "V32": (part([1], figures='[{"id":"1"}]'), None), "V22": (part([1], sections=SECTIONS), None),
    "V23": (part([1], sections='[{"spans":[],"spans":[]}]'), part([1], sections=SECTIONS)), "V24": (part([1], sections='[{"spans":[{"offset":0,"length":2,"x":1}]}]'), part([1], sections=SECTIONS)),
    "V25": (part([1], sections='[{"spans":[{"offset":0,"length":3}]}]'), part([1], sections=SECTIONS)), "V26": (part([1], sections=SECTIONS), part([1], sections=SECTIONS.replace('2}],"elements":["/p', '9}],"elements":["/p'))),
    "V27": (part([1], sections=SECTIONS), part([1], sections=SECTIONS.replace('["/sections/1"]', '["/paragraphs/7","/sections/1"]'))),
    "V28": (part([1], sections=SECTIONS), part([1], sections='[{"elements":[],"spans":[{"offset":0,"length":2}]}]')),
}


def test_each_fault_has_its_code(spark):
    rows, want = [], set()
    for i, (code, (first, second)) in enumerate(FAULTS.items()):
        rows += [(i, 0, [1], first), (i, 1, [2], second or part([1]))]
        want.add((i, code))
    rows += [(90, 0, [2], part([1])), (90, 1, [2], part([1])), (91, 0, [], part([1])), (92, 0, [1], part([1])), (93, 0, [1], None)]
    got, bad, _ = run(spark, rows)
    assert set(bad) == want | {(90, "V15"), (91, "V02"), (93, "V03")} and set(got) == {92}


def test_cr_before_the_separator_and_unit(spark):
    rows = [(1, 0, [1], part([1], "a\r", stringIndexType='"textElements"')), (1, 1, [2], part([1], "b", stringIndexType='"textElements"'))]
    assert run(spark, rows, unit=units.GRAPHEMES)[1] == [(1, "V20")]


def test_read_results_round_trip(spark):
    page = lambda n: f'{{ "page":{n},"lines":[{{"text":"l{n}"}}]}}'
    whole = '{"version":"3.2","modelVersion":"m","readResults":[' + ",".join(map(page, (2, 3, 5, 8))) + "]}"
    results = spark.createDataFrame([(1, whole)], "doc_id int, result string")
    plan = spark.createDataFrame([(1, 0, [2, 3]), (1, 1, [5]), (1, 2, [8])], "doc_id int, k int, planned array<int>")
    parts = assembly.cut(results, plan)
    assert '"page":1,' in parts.where("k = 2").first()["raw"]
    out, _, bad = assembly.merged(parts, assembly.READ)
    assert bad.count() == 0 and [(r.result, r.pages, r.bytes, r.too_large) for r in out.collect()] == [(whole, 4, len(whole), False)]
    out, _, _ = assembly.merged(parts, assembly.READ, most_bytes=10)
    assert [(r.result, r.too_large) for r in out.collect()] == [(None, True)]


@pytest.mark.parametrize("rows", [[]])
def test_no_parts(spark, rows):
    got, bad, _ = run(spark, rows)
    assert not got and not bad


PAGES = [
    '{"version":"3.2","readResults":[{ "page":1, "lines":[{"page":9}]},{"lines":[], "page" : 2 }],"x":{"page":3}}', ' {"readResults" : [ {"page":1} ] , "n":-1.50e3} ', '{"readResults":[]}', '{"readResults":{}}', "{}", "[]", "", "{",
    '{"readResults":[{"page":1}],"readResults":[{"page":2}]}', '{"readResults":[{"page":1,"page":2}]}', '{"readResults":[{"page":"1"}]}', '{"readResults":[{"page":0}]}', '{"readResults":[{"page":01}]}', '{"readResults":[{"page":1}{"page":2}]}',
    '{"readResults":[{"page":1},]}', '{"readResults":[{"page":1,}]}', '{"readResults":[1,{"page":1}]}', '{"readResults":[{"page":1},{"page":1}]}', '{"readResults":[{"page":2},{"page":1}]} x', '{"readResults":[{"page":1,"a":NaN}]}',
    '{"readResults":[{"page":1,"a":"\\u00e9\\"","\\u0070age":2},{"page":2,"b":"é"}]}', '{"readResults":[{"page":1,"' + "n" * 5000 + '":1}]}', '{"readResults":[{"page":1,"a":' + "1" * 5000 + "}]}", '{"readResults":[{"page":1,"a":' + "[" * 3000 + "]" * 3000 + "}]}",
    '{"readResults":[{"page":1}]]', '{"readResults":[{"page":1]}', '{"readResults":[{"page":null},{"page":[1]}]}', '{"readResults":[{"page":1,"a":"\t"}]}',
]


def test_pages_without_references_are_read_alike_by_both_ways(monkeypatch):
    plans = [(0, [2, 1]), (1, [1])]

    def told(raw):
        cut = [assembly.cut_pages(raw, [p], assembly.READ) for p in plans]
        array = raw[raw.find("[") : raw.rfind("]") + 1]
        try:
            new = assembly.Renumber(assembly.READ, [7, 8], True, 0, [], []).items(array, "readResults")
        except (jsontext.Malformed, assembly.Refused) as e:
            new = type(e), getattr(e, "code", None)
        return cut, new

    quick = [told(raw) for raw in PAGES]
    assert jsontext.array_members('[{"page":1}]') == [(0 + 1, 11, [("page", 9, 10)])]
    monkeypatch.setattr(jsontext, "array_members", lambda text: None)
    assert quick == [told(raw) for raw in PAGES]


def test_pages_without_references_are_not_read_value_by_value(monkeypatch):
    monkeypatch.setattr(jsontext, "values", None)
    cut, problems = assembly.cut_pages(PAGES[0], [(0, [2]), (1, [1])], assembly.READ)
    assert not problems and '"page" : 1 }' in cut[0]
    assert assembly.Renumber(assembly.READ, [7], True, 0, [], []).items('[ { "page":1, "x":{"page":5} } ]', "readResults") == (' { "page":7, "x":{"page":5} } ', 1)
