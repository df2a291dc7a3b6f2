"""JSON documents against the definitions of an API description: a table of rules, applied to a row for each value.

The definitions are compiled once, on the driver: references followed, allOf parts merged, each kind of value a numbered
rule with its type, bounds, enumeration and required members.  Tasks shred documents and give each value the number of
the rule that its place has; the rest is one join with the rules and expressions over its row.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagefold.functions import arrowrows, jsontext, jsontree

#: Rules that a description may have, so that their table is small beside any task's memory.
MOST_RULES = 100_000
RULE = """rule bigint, context string, type string, nullable boolean, required array<string>, enum array<string>, open boolean, format string, pattern string,
    minimum double, maximum double, min_length double, max_length double, min_items double, max_items double"""
# Spellings of formats.
DATE_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})$"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


@dataclass
class Place:
    """What may stand below a value: rules of named members, of other members (None: none may, True: any), of items."""

    type: str | None
    members: dict[str, int] = field(default_factory=dict)
    others: int | bool | None = None
    items: int | None = None
    pattern: re.Pattern | None = None


class Rules:
    """The compiled rules of one definition; rule 0 is the document's own."""

    def __init__(self, description: str, definition: str):
        told = json.loads(description, parse_int=str, parse_float=str)
        self.definitions = told.get("definitions") if isinstance(told, dict) else None
        if not isinstance(self.definitions, dict) or definition not in self.definitions:
            raise ValueError(f"no definition {definition}")
        self.rows: list[tuple] = []
        self.places: list[Place] = []
        self.known: dict[tuple, int] = {}
        self.rule({"$ref": f"#/definitions/{definition}"}, definition)

    def resolved(self, schema: dict) -> tuple[dict, str | None]:
        name, seen = None, set()
        while isinstance(ref := schema.get("$ref"), str):
            name = ref.removeprefix("#/definitions/")
            if name == ref or name not in self.definitions or name in seen:
                raise ValueError(f"cannot follow {ref}")
            seen.add(name)
            schema = self.definitions[name]
        return schema, name

    def merged(self, schema: dict) -> dict:
        """A schema with its allOf parts taken into it; what comes later holds."""
        if not isinstance(schema.get("allOf"), list):
            return schema
        out: dict = {"type": "object", "properties": {}, "required": []}
        for part in [self.merged(self.resolved(p)[0]) for p in schema["allOf"]] + [{k: v for k, v in schema.items() if k != "allOf"}]:
            out["properties"] |= part.get("properties", {})
            out["required"] += part.get("required", [])
            if "additionalProperties" in part:
                out["additionalProperties"] = part["additionalProperties"]
        return out

    def rule(self, schema: dict, context: str) -> int:
        """The number of a schema's rule, compiled when it is first met, so that definitions may hold themselves."""
        own, name = self.resolved(schema)
        nullable = bool(schema["x-nullable"] if isinstance(schema.get("x-nullable"), bool) else own.get("x-nullable", False))
        context = name or context
        if (key := (id(own), nullable, context)) in self.known:
            return self.known[key]
        if len(self.rows) >= MOST_RULES:
            raise ValueError("the description has too many rules")
        number = self.known[key] = len(self.rows)
        flat = self.merged(own)
        kind = flat.get("type") or ("object" if "properties" in flat else None)
        bound = lambda k: float(flat[k]) if k in flat else None
        spelled = [{True: "true", False: "false", None: "null"}.get(v, v) if isinstance(v, bool | None) else str(v) for v in flat["enum"]] if "enum" in flat else None
        is_open = bool(flat.get("x-ms-enum", {}).get("modelAsString", False))
        bounds = [bound(k) for k in ("minimum", "maximum", "minLength", "maxLength", "minItems", "maxItems")]
        self.rows.append((number, context, kind, nullable, list(dict.fromkeys(flat.get("required", []))), spelled, is_open, flat.get("format"), flat.get("pattern"), *bounds))
        place = Place(kind)
        self.places.append(place)
        if kind == "object":
            place.members = {k: self.rule(v, context) for k, v in flat.get("properties", {}).items()}
            others = flat.get("additionalProperties")
            place.others = self.rule(others, context) if isinstance(others, dict) else others or None
        elif kind == "array" and isinstance(flat.get("items"), dict):
            place.items = self.rule(flat["items"], context)
        try:
            place.pattern = re.compile(flat["pattern"]) if kind == "string" and "pattern" in flat else None
        except re.error:
            pass  # a pattern that cannot be read is not checked
        return number

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame(self.rows, RULE)


#: A value of a document: `rule` is null where no rule allows it; `keys` of an object, `items` of an array, `fits` the pattern.
VALUE = "path string, rule bigint, kind string, value string, keys array<string>, items bigint, fits boolean"


def placed(text: str | None, places: list[Place]):
    """The rows of VALUE of one document; a malformed one is a row of kind Malformed.  Nothing below a wrong kind is told."""
    try:
        root = jsontree.parse(text or "")
    except ValueError:
        yield "/", 0, "Malformed", None, None, None, None
        return
    waits: list[tuple[str, int | bool | None, jsontree.Node]] = [("", 0, root)]
    while waits:
        path, rule, node = waits.pop()
        if rule is True:
            continue
        shown = path or "/"
        place = places[rule] if rule is not None else None
        value = jsontext.plain(node.raw) if node.kind == "String" else node.raw or None
        fits = None if place is None or place.pattern is None or node.kind != "String" else place.pattern.search(value) is not None
        keys = [jsontext.plain(f'"{k}"') for k in node.keys] if node.kind == "Object" else None
        yield shown, rule, node.kind, value, keys, len(node.items), fits
        if place is None:
            continue
        if place.type == "object" and node.kind == "Object":
            last = dict(zip(keys, node.items, strict=True))  # of names that repeat, the last one counts
            waits += [(f"{path}/{k}", place.members.get(k, place.others), v) for k, v in last.items()]
        elif place.type == "array" and node.kind == "Array" and place.items is not None:
            waits += [(f"{path}/{i}", place.items, v) for i, v in enumerate(node.items)]


def shredded(docs: DataFrame, doc: str, text: str, rules: Rules) -> DataFrame:
    """(doc, VALUE): a row for each value of each document that a rule looks at."""
    rows, places = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")), rules.places
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.bool_())
    names = [c.split(" ")[0] for c in VALUE.split(", ")]

    def run(batches):
        for b in arrowrows.slices(batches):
            out = [(i, *row) for i, t in enumerate(b.column(1).to_pylist()) for row in placed(t, places)]
            at, *columns = zip(*out, strict=True) if out else [()] * (1 + len(names))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True))], ["doc", *names])

    return rows.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, {VALUE}")


FOUND = "array<struct<severity:string,rule:string,path:string>>"


def found(condition: Column, name: str | Column, severity: str | Column = "error", path: Column | None = None) -> Column:
    one = F.struct((F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), (F.lit(name) if isinstance(name, str) else name).alias("rule"), (F.col("path") if path is None else path).alias("path"))
    return F.when(F.coalesce(condition, F.lit(False)), F.array(one)).otherwise(F.array().cast(FOUND))


def checks() -> Column:
    """The findings of a value joined to its rule."""
    wanted = F.when(F.col("type") == "object", "Object").when(F.col("type") == "array", "Array").when(F.col("type") == "string", "String").when(F.col("type").isin("integer", "number"), "Number").when(F.col("type") == "boolean", "Bool")
    kind, string = F.col("kind"), F.col("kind") == "String"
    number = F.when(kind == "Number", F.col("value").try_cast("double"))
    fraction = (F.col("type") == "integer") & F.col("value").rlike("[.eE]")
    wrong = (wanted != kind) | ((kind == "Number") & wanted.isNotNull() & (fraction | (F.abs(number) == float("inf"))))
    listed = F.array_contains("enum", F.col("value"))
    outside = F.col("enum").isNotNull() & F.col("value").isNotNull() & ~listed & ~F.coalesce(F.col("type").isin("boolean", "file", "object", "array"), F.lit(False))
    length = F.when(string, F.length("value"))
    size = F.when(kind == "Array", F.col("items"))
    required = F.transform(F.array_except("required", "keys"), lambda _: F.struct(F.lit("error").alias("severity"), F.lit("required").alias("rule"), F.col("path").alias("path")))
    bounds = [
        found(outside, F.when(F.col("open"), "enum-open").otherwise("enum"), F.when(F.col("open"), "warning").otherwise("error")),
        found(string & (F.col("format") == "date-time") & ~F.col("value").rlike(DATE_TIME), "format"), found(string & (F.col("format") == "uuid") & ~F.col("value").rlike(UUID), "format"),
        found((F.col("format") == "int32") & ~number.between(-(2**31), 2**31 - 1), "format"), found(~F.col("fits"), "pattern"),
        found(length < F.col("min_length"), "minLength"), found(length > F.col("max_length"), "maxLength"), found(number < F.col("minimum"), "minimum"), found(number > F.col("maximum"), "maximum"),
        found(size < F.col("min_items"), "minItems"), found(size > F.col("max_items"), "maxItems"),
    ]
    every = F.concat(F.when(F.col("type") == "object", F.coalesce(required, F.array().cast(FOUND))).otherwise(F.array().cast(FOUND)), *bounds)
    return (
        F.when(kind == "Malformed", found(F.lit(True), "malformed"))
        .when(F.col("rule").isNull(), found(F.lit(True), "unknown-property"))
        .when(kind == "Null", found(~F.col("nullable"), "null"))
        .when(wrong, found(F.lit(True), "type"))
        .otherwise(every)
    )


def schema_findings(docs: DataFrame, doc: str, text: str, description: str, definition: str) -> DataFrame:
    """(doc, severity, rule, path): where documents depart from a definition of an API description (JSON text).

    Rules: type (integers without fraction or exponent), null, required (a row for each member that lacks),
    unknown-property, enum (a warning, enum-open, where the set is open), format (date-time, uuid, int32), pattern,
    minimum, maximum, minLength, maxLength, minItems, maxItems; a null or malformed text is one row, malformed.  Paths
    are JSON pointers, `/` for the document.  The description is the caller's; one that cannot be followed is an error.
    """
    rules = Rules(description, definition)
    table = F.broadcast(rules.table(docs.sparkSession))  # at most MOST_RULES rows
    joined = shredded(docs, doc, text, rules).join(table.withColumnRenamed("rule", "number"), F.col("rule") == F.col("number"), "left")
    return joined.select(F.col("doc").alias(doc), F.inline(checks()))
