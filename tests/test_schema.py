"""The schema rules against a plain recursive check, on mutated documents."""

import json
import random
import re

import pytest

from pagefold.operators import schema

SPEC = {
    "swagger": "2.0",
    "definitions": {
        "Base": {"required": ["id"], "properties": {"id": {"type": "string", "format": "uuid"}, "kind": {"$ref": "#/definitions/Kind"}}},
        "Kind": {"type": "string", "enum": ["a", "b"], "x-ms-enum": {"name": "Kind", "modelAsString": True}},
        "Closed": {"type": "string", "enum": ["x", "y"], "x-nullable": True},
        "Doc": {
            "allOf": [{"$ref": "#/definitions/Base"}], "type": "object", "required": ["n"],
            "properties": {
                "n": {"type": "integer", "format": "int32", "minimum": 0}, "ratio": {"type": "number", "minimum": 0, "maximum": 1}, "when": {"type": "string", "format": "date-time"},
                "name": {"type": "string", "minLength": 2, "maxLength": 5, "pattern": "^[a-z]+$"}, "odd": {"type": "string", "pattern": "(?<"}, "closed": {"$ref": "#/definitions/Closed"},
                "not_null": {"$ref": "#/definitions/Closed", "x-nullable": False}, "flag": {"type": "boolean"}, "list": {"type": "array", "items": {"type": "number", "enum": [1, 2.5]}, "minItems": 1, "maxItems": 3},
                "free": {}, "map": {"type": "object", "additionalProperties": {"type": "integer"}}, "any": {"type": "object", "additionalProperties": True}, "none": {"type": "object", "additionalProperties": False},
                "tree": {"$ref": "#/definitions/Tree"}, "file": {"type": "file"}, "plain": {"properties": {"a": {"type": "string"}}},
            },
        },
        "Tree": {"type": "object", "properties": {"children": {"type": "array", "items": {"$ref": "#/definitions/Tree"}}, "v": {"type": "string", "enum": ["x"]}}},
    },
}
GOOD = {
    "id": "3F2504E0-4F89-11D3-9A0C-0305E82C3301", "kind": "a", "n": 3, "ratio": 0.5, "when": "2024-01-02T03:04:05.6Z", "name": "abc", "odd": "?", "closed": None, "not_null": "x", "flag": True, "list": [1, 2.5],
    "free": {"x": [None]}, "map": {"k": 1}, "any": {"z": None}, "none": {}, "tree": {"children": [{"children": []}, {"v": "x"}]}, "file": 3, "plain": {"a": "s"},
}


def plain(value, spec, defs, path=""):
    """A recursive check, written apart: (severity, rule, path) of everything."""
    here, nullable = path or "/", spec.get("x-nullable")
    while "$ref" in spec:
        spec = defs[spec["$ref"].rsplit("/", 1)[1]]
    nullable = spec.get("x-nullable", False) if nullable is None else nullable
    if "allOf" in spec:
        spec = {"type": "object", "properties": defs["Base"]["properties"] | spec["properties"], "required": defs["Base"]["required"] + spec["required"]}
    if value is None:
        return [] if nullable else [("error", "null", here)]
    kind, out = spec.get("type") or ("object" if "properties" in spec else None), []
    right = {"object": dict, "array": list, "string": str, "integer": int, "number": (int, float), "boolean": bool}.get(kind, object)
    if not isinstance(value, right) or isinstance(value, bool) and kind not in ("boolean", None, "file"):
        return [("error", "type", here)]
    if "enum" in spec and value not in spec["enum"] and kind != "object":
        out.append(("warning", "enum-open", here) if spec.get("x-ms-enum", {}).get("modelAsString") else ("error", "enum", here))
    if kind == "object":
        out += [("error", "required", here) for r in spec.get("required", []) if r not in value]
        for k, v in value.items():
            below = spec.get("properties", {}).get(k, spec.get("additionalProperties"))
            if isinstance(below, dict):
                out += plain(v, below, defs, f"{path}/{k}")
            elif not below:
                out.append(("error", "unknown-property", f"{path}/{k}"))
    if kind == "array":
        out += [x for i, v in enumerate(value) for x in plain(v, spec["items"], defs, f"{path}/{i}")]
    tests = {
        "minItems": kind == "array" and len(value) < spec.get("minItems", 0), "maxItems": kind == "array" and len(value) > spec.get("maxItems", 10**9),
        "minLength": kind == "string" and len(value) < spec.get("minLength", 0), "maxLength": kind == "string" and len(value) > spec.get("maxLength", 10**9),
        "minimum": kind in ("integer", "number") and value < spec.get("minimum", value), "maximum": kind in ("integer", "number") and value > spec.get("maximum", value),
        "pattern": kind == "string" and spec.get("pattern") == "^[a-z]+$" and not re.search("^[a-z]+$", value),
        "format": {"uuid": lambda: not re.match(schema.UUID, value), "date-time": lambda: not re.match(schema.DATE_TIME, value), "int32": lambda: not -(2**31) <= value < 2**31}.get(spec.get("format"), lambda: False)(),
    }
    return out + [("error", rule, here) for rule, bad in tests.items() if bad]


VALUES = [None, True, 0, -1, 7, 2.5, 0.5, 2**40, "", "a", "x", "abc", "toolong", "ABC", "2024-01-02T03:04:05Z", [], {}, [1], [1, 1, 1, 1], {"a": 1}, {"id": 1}]


def mutated(rng):
    doc = json.loads(json.dumps(GOOD))
    for _ in range(rng.randint(0, 3)):
        pick = rng.random()
        if pick < 0.6:
            doc[rng.choice(list(GOOD))] = rng.choice(VALUES)
        elif pick < 0.75:
            doc.pop(rng.choice(list(GOOD)), None)
        elif pick < 0.85:
            doc[rng.choice(["new", "x/y"])] = rng.choice(VALUES)
        else:
            doc["tree"] = {"children": [{"v": rng.choice(["x", "z", 3]), "w": 1}, {"children": [{"children": rng.choice(VALUES)}]}]}
    return doc


def test_equal_a_recursive_check_on_mutated_documents(spark):
    rng = random.Random(6)
    docs = [GOOD, *(mutated(rng) for _ in range(900)), 3, [], None]
    frame = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "id int, text string")
    found = sorted((r.id, r.severity, r.rule, r.path) for r in schema.schema_findings(frame, "id", "text", json.dumps(SPEC), "Doc").collect())
    want = sorted((i, *f) for i, d in enumerate(docs) for f in plain(d, SPEC["definitions"]["Doc"], SPEC["definitions"]))
    assert sorted(set(found) ^ set(want)) == [] and found == want
    assert len({f[2] for f in found}) >= 13


def test_spellings_and_malformed_texts(spark):
    good = json.dumps(GOOD)
    texts = [good.replace('"n": 3', '"n": 3.0'), good.replace('"n": 3', '"n": 3e0'), good.replace('"ratio": 0.5', '"ratio": 1e999'), None, "{", good + "x", good.replace('"n": 3', '"\\u006e": 3'), '{"n":1,"n":null}']
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = sorted((r.id, r.rule, r.path) for r in schema.schema_findings(frame, "id", "text", json.dumps(SPEC), "Doc").collect())
    assert found == [(0, "type", "/n"), (1, "type", "/n"), (2, "type", "/ratio"), (3, "malformed", "/"), (4, "malformed", "/"), (5, "malformed", "/"), (7, "null", "/n"), (7, "required", "/")]
    assert schema.schema_findings(frame.limit(0), "id", "text", json.dumps(SPEC), "Doc").collect() == []


@pytest.mark.parametrize("spec", ["[]", "{}", '{"definitions":{"A":{}}}', '{"definitions":{"Doc":{"$ref":"#/definitions/Doc"}}}', '{"definitions":{"Doc":{"properties":{"a":{"$ref":"#/x/y"}}}}}'])
def test_descriptions_that_cannot_be_followed(spec):
    with pytest.raises(ValueError):
        schema.Rules(spec, "Doc")
