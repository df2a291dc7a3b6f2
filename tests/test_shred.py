import json
import random

import pytest

from pagefold.functions import jsontext
from pagefold.operators import ordering, shred


def flat(v, path=""):
    if isinstance(v, dict) and v:
        for k, x in v.items():
            yield from flat(x, f"{path}.{k}")
    elif isinstance(v, list) and v:
        for i, x in enumerate(v):
            yield from flat(x, f"{path}[{i}]")
    else:
        yield path, v


def value(rng, depth=0):
    pick = rng.random()
    if depth < 4 and pick < 0.3:
        return {rng.choice("abcdé"): value(rng, depth + 1) for _ in range(rng.randint(0, 4))}
    if depth < 4 and pick < 0.5:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return rng.choice([None, True, False, 0, -1.5, 1e-7, "", "x\n\"y", "😀", 10**20])


def test_scalars_equal_the_parsed_document(spark):
    rng = random.Random(8)
    docs = [value(rng) for _ in range(200)]
    frame = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "id int, text string")
    got = {}
    for r in shred.shred(frame, "id", "text").orderBy("id", "ord").collect():
        got.setdefault(r.id, []).append((r.path, r.raw if r.kind == "String" else json.loads(r.raw)))
    assert got == {i: list(flat(d)) for i, d in enumerate(docs)}


def test_spelling_duplicates_limits_and_refusals(spark):
    texts = ['{"a":1.50,"a":1e-07,"b":{"c":[true]}}', '{"x": 1} tail', "NaN", None, '"' + "s" * 5000 + '"', "[" * 100_000, '{"a":"\\ud800"}']
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = shred.shred(frame, "id", "text")
    kinds = {(r.id, r.path, r.kind, r.raw) for r in rows.collect()}
    assert {(0, ".a", "Number", "1.50"), (0, ".a", "Number", "1e-07"), (0, ".b.c[0]", "Bool", "true"), (4, "", "String", "s" * 5000)} <= kinds
    assert {i for i, _, k, _ in kinds if k == shred.MALFORMED} == {1, 2, 3, 5}
    assert [tuple(r) for r in shred.duplicates(rows, "id").collect()] == [(0, ".a", 2)]
    assert {r.path for r in shred.shred(frame.where("id = 0"), "id", "text", under=("b",)).collect()} == {".b.c[0]"}


def compared(spark, a, b):
    """Both ways of comparing give the same."""
    side = lambda t: shred.shred(spark.createDataFrame([(1, t)], "id int, text string"), "id", "text", containers=True)
    found = {(r.path, r.pattern, r.kind, r.whole, r.split) for r in shred.json_differences(side(a), side(b), "id").collect()}
    both = spark.createDataFrame([(1, a, b)], "id int, whole string, split string")
    assert found == {(r.path, r.pattern, r.kind, r.whole, r.split) for r in shred.document_differences(both, "id", "whole", "split").collect()}
    return found


def test_long_strings_are_compared_whole(spark):
    a, b = (json.dumps({"content": "s" * 5000 + c, "n": 1}) for c in "xy")
    assert compared(spark, a, b) == {(".content", ".content", "changed", "s" * 5000 + "x", "s" * 5000 + "y")} and compared(spark, a, a) == set()
    assert {r[2] for r in compared(spark, a, json.dumps({"content": "s" * 4000, "n": 1.0}))} == {"changed"}
    both = spark.createDataFrame([(1, a, b)], "id int, whole string, split string")
    assert [r.path for r in shred.exact_differences(both, "id", "whole", "split").collect()] == [".content"]
    assert {r.member: (r.identical, r.n) for r in shred.member_report(both, "id", "whole", "split").collect()} == {"content": (False, 1), "n": (True, 0)}


def test_differences_of_random_documents(spark):
    rng = random.Random(3)
    pairs = []
    for i in range(150):
        a = value(rng)
        b = json.loads(json.dumps(a))
        if isinstance(b, dict) and b:
            b[rng.choice(list(b))] = value(rng)
        pairs.append((i, json.dumps(a), json.dumps(b if rng.random() < 0.7 else value(rng))))
    pairs += [(900, None, "{}"), (901, "{", None), (902, "", "[")]
    docs = spark.createDataFrame(pairs, "id int, whole string, split string")
    side = lambda c: shred.shred(docs.select("id", c), "id", c, containers=True)
    key = lambda rows: sorted(((r.id, r.path, r.pattern, r.kind, r.whole, r.split) for r in rows), key=str)
    assert key(shred.json_differences(side("whole"), side("split"), "id").collect()) == key(shred.document_differences(docs, "id", "whole", "split").collect())


def test_levels():
    paths = {("pages", 0, "angle"): "page", ("readResults", 1): "page", ("figures",): "page", ("paragraphs", 3, "boundingRegions", 0): "page", ("tables", 0, "cells", 2, "content"): "page"}
    paths |= {("tables", 0, "rowCount"): "document", ("paragraphs", 3, "role"): "document", (): "document", ("sections", 0): "document"}
    assert {p: shred.level_of(p) for p in paths} == {p: f"{level}-level" for p, level in paths.items()}


def test_differences(spark):
    a, b = '{"n":1.0,"s":"x","t":1,"only":{"x":{"y":2}},"l":[1,2]}', '{"l":[3],"n":1,"s":"y","t":{"z":[]},"new":[]}'
    assert compared(spark, a, b) == {
        (".s", ".s", "changed", "x", "y"), (".t", ".t", "type", "1", "1 items"), (".only", ".only", "missing", "1 items", None),
        (".l", ".l", "length", "2 items", "1 items"), (".l[0]", ".l[*]", "changed", "1", "3"), (".new", ".new", "added", None, "0 items"),
    }
    assert compared(spark, "[1]", "{}") == {("", "", "type", "1 items", "0 items")}


def test_a_document_has_no_difference_from_itself(spark):
    for text in ('{"a.b":1,"a":{"b":2},"a":{"b":3},"x[0]":1,"x":[1]}', '{"a":"\\ud800","\\"q":1}', "[[[]],{}]"):
        assert compared(spark, text, text) == set(), text


def test_members_masks_and_reports(spark):
    frame = spark.createDataFrame([(1, '{"a" : 1.50, "\\u0062":[1,{}],"a":"x"}'), (2, "[1]")], "id int, text string")
    rows = [tuple(r)[1:] for r in shred.members(frame, "id", "text").orderBy("id", "ord").collect()]
    assert rows == [(0, "a", False, "Number", -1, "1.50"), (1, "\\u0062", True, "Array", 2, "[1,{}]"), (2, "a", False, "String", -1, '"x"'), (0, "", False, "Malformed", -1, None)]
    odd = '{ "t":"2024-05-06 07:08:09.123+02:00" ,"u":["http://h/3F2504E0-4F89-11D3-9A0C-0305E82C3301"], "n":1e-07}'
    want = '{ "t":"<datetime:2006-01-02 15:04:05.000-07:00>" ,"u":["<base>/<guid>"], "n":1e-07}'
    got = shred.masked(spark.createDataFrame([(1, odd), (2, "{"), (3, None)], "id int, text string"), "text", "http://h").orderBy("id").collect()
    assert [r.text for r in got] == [want, None, None]
    rows = [(1, '{"p":[1,2],"q":1}', '{"p":[1,3] , "q":1}'), (2, '{"p":1.0,"a":{"x":1,"y":2},"l":[1]}', '{"p":1,"a":{"y":2,"x":1},"l":[1,2],"new":0}'), (3, "[1]", "[2]"), (4, None, "{}"), (5, "{", None)]
    both = spark.createDataFrame(rows, "id int, whole string, split string")
    found = [tuple(r) for r in shred.member_report(both, "id", "whole", "split").collect()]
    assert found == [
        (1, "p", False, 1, ["p[1]"]), (1, "q", True, 0, []), (2, "p", False, 1, ["p"]), (2, "a", False, 1, ["a (member order)"]), (2, "l", False, 1, ["l (length)"]), (2, "new", False, 1, ["new"]),
        (3, "(result)", False, 1, ["(result)"]), (4, "(result)", False, 1, ["(result)"]), (5, "(result)", False, 1, ["(result)"]),
    ]
    exact = [tuple(r) for r in shred.exact_differences(both, "id", "whole", "split").collect()]
    assert exact == [
        (1, ".p[1]", "2", "3"), (2, " (member order)", "p,a,l", "p,a,l,new"), (2, ".p", "1.0", "1"), (2, ".a (member order)", "x,y", "y,x"), (2, ".l (length)", "1", "2"), (3, "[0]", "1", "2"), (4, "", None, "{}"),
    ]
    assert shred.exact_differences(both, "id", "whole", "split", limit=2).where("id = 2").count() == 2


@pytest.mark.parametrize("text", ["", "01", "1 2", "[1,]", '{"a":1,}', '{"a"}', "{1:2}", '"\\x"', '"a\nb"', "tru", "[", '{"a":', "-", "1.", "nan", '"' + "a", "1" * 5000, "[" * 10_001])
def test_texts_that_are_no_json_value(text):
    with pytest.raises(ValueError):
        list(jsontext.values(text))


def test_rewriting_copies_all_else():
    text = ' {"a" : [1.50, "x\\u00e9", {"b":null}] , "c":-0e+1 } '
    assert jsontext.rewrite(text, lambda *_: None) == text
    assert jsontext.rewrite(text, lambda path, kind, raw: "7" if path == ("a", 0) else None) == text.replace("1.50", "7")
    assert jsontext.array_items(" [1, [2] ,3] ", lambda p, k, raw: str(int(raw) + len(p)), "m") == ("3, [5] ,5", 3)


@pytest.mark.parametrize(
    "lists,want",
    [
        ([["a", "b"]], ["a", "b"]),
        ([["a", "c"], ["a", "b", "c"]], ["a", "b", "c"]),
        ([["a"], ["z", "a"]], ["z", "a"]),
        ([["a", "b"], ["b", "a"]], None),
        ([["a", "c"], ["c", "b"], ["a", "b"]], ["a", "c", "b"]),
        ([["b", "c"], ["a"], ["a", "b"]], ["a", "b", "c"]),
        ([["c"], ["b", "e"], ["c", "e"]], ["b", "c", "e"]),
        ([[], []], []),
    ],
)
def test_order_union(lists, want):
    got = ordering.union(lists)
    assert got == want and (got is None or all(ordering.keeps(got, x) for x in lists))


def test_member_orders(spark):
    rows = [(1, 0, 0, "a"), (1, 0, 1, "c"), (1, 1, 0, "a"), (1, 1, 1, "b"), (1, 1, 2, "c"), (2, 0, 0, "x"), (2, 0, 1, "y"), (2, 1, 0, "y"), (2, 1, 1, "x")]
    frame = spark.createDataFrame(rows, "doc int, k int, at int, name string")
    assert {r.doc: r.names for r in ordering.member_orders(frame, "doc", "k", "at", "name").collect()} == {1: ["a", "b", "c"], 2: None}
