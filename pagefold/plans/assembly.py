"""Merged results: the JSON results of a document's parts joined to one, byte for byte where nothing is renumbered.

Parts are measured in an Arrow task each and shuffled once, by document.  What they say of one another is checked by
windows over a document's parts, whose sums are also their shifts; then each document's parts are one row, which is
renumbered and put together.  So the plan has one shuffle, whatever is asked of it.  The violations are one relation
(doc_id, k, code); any of them keeps its document out of the merged results.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagefold.functions import arrowrows, jsontext, policy, text, units
from pagefold.operators import ordering, sections
from pagefold.operators.sections import Refused


@dataclass(frozen=True)
class Profile:
    """What differs between the kinds of results."""

    di: bool
    page_array: str
    page_key: str
    agree: tuple[str, ...]


# The page array, its page number and the members that must agree, of both kinds of results.
DI = Profile(True, "pages", "pageNumber", ("apiVersion", "modelId", "stringIndexType", "contentFormat"))
READ = Profile(False, "readResults", "page", ("version", "modelVersion"))

MEMBER = pa.struct([("name", pa.string()), ("is_array", pa.bool_()), ("items", pa.int64()), ("mark", pa.string()), ("raw", pa.string())])
MEASURES = {"codes": pa.list_(pa.string()), "members": pa.list_(MEMBER), "pages": pa.list_(pa.int64()), "page_end": pa.int64(), "content": pa.string()}
MEASURED = "codes array<string>, members array<struct<name:string,is_array:boolean,items:bigint,mark:string,raw:string>>, pages array<bigint>, page_end bigint, content string"
#: Spellings up to so many characters stand for themselves where parts are compared, longer ones by their digest.
MARKED = 64


class PageNumbers:
    """The page numbers of a page array, and the furthest end of a page's span, as its values go by."""

    def __init__(self, key: str):
        self.key, self.numbers, self.codes, self.items, self.spans, self.places = key, [], set(), 0, {}, []

    def see(self, path: tuple, kind: str, raw: str, begin: int, end: int, items: int) -> None:
        """One value below the array, whose path begins there."""
        if not path:
            self.items = items
        elif len(path) == 2 and path[1] == self.key:
            v = jsontext.canonical(raw[begin:end]) if kind == "Number" else None
            if not v:
                self.codes.add("V08")
            elif path[0] != len(self.numbers):
                self.codes.add("V07")
            self.numbers.append(v or 0)
            self.places.append((begin, end))
        elif len(path) == 4 and path[1] == "spans" and kind == "Number" and path[3] in ("offset", "length"):
            self.spans.setdefault(path[:3], {})[path[3]] = jsontext.canonical(raw[begin:end])

    def see_array(self, pages: list) -> None:
        """All values of an array, as `see` would be told of them; places are not kept."""
        self.items = len(pages)
        for i, page in enumerate(pages):
            for name, value in page if type(page) is jsontext.Pairs else ():
                if name == self.key:
                    v = jsontext.canonical(value) if type(value) is jsontext.Number else None
                    if not v:
                        self.codes.add("V08")
                    elif i != len(self.numbers):
                        self.codes.add("V07")
                    self.numbers.append(v or 0)
                if name == "spans" and type(value) in (list, jsontext.Pairs):
                    for j, span in enumerate(value) if type(value) is list else value:
                        for key, at in span if type(span) is jsontext.Pairs else ():
                            if key in ("offset", "length") and type(at) is jsontext.Number:
                                self.spans.setdefault((i, j), {})[key] = jsontext.canonical(at)

    def told(self) -> tuple[list[int], int, list[str]]:
        """(page numbers, furthest end of a page's span or -1, codes)."""
        if len(self.numbers) != self.items:
            self.codes.add("V07")
        ends = [s["offset"] + s["length"] for s in self.spans.values() if s.get("offset") is not None and s.get("length") is not None]
        return self.numbers, max([-1, *ends]), sorted(self.codes)


def mark(raw: str) -> str:
    return raw if len(raw) <= MARKED else hashlib.md5(raw.encode(), usedforsecurity=False).hexdigest()


def measure(raw: str | None, profile: Profile) -> tuple:
    """(codes, members, pages, page_end, content) of one part's result, in one pass over it."""
    raw, found, pages = raw or "", [], PageNumbers(profile.page_key)
    told = jsontext.decoded_members(raw)
    if told is not None and len({m[0] for m in told}) == len(told):
        for name, value, own in told:
            found.append((name, jsontext.kind_of(value), len(value) if type(value) in (list, jsontext.Pairs) else -1, own))
            if name == profile.page_array and type(value) is list:
                pages.see_array(value)
    else:
        try:
            for path, kind, begin, end, items in jsontext.values(raw):
                if not path:
                    if kind != "Object":
                        return ["V03"], [], [], -1, None
                elif len(path) == 1:
                    found.append((path[0], kind, items, raw[begin:end]))
                if path and path[0] == profile.page_array:
                    pages.see(path[1:], kind, raw, begin, end, items)
        except ValueError:
            return ["V03"], [], [], -1, None
    codes, by = [], {m[0]: m for m in found}
    if any("\\" in n for n in by):
        codes.append("V04")
    if len(by) < len(found):
        codes.append("V05")
    compared = lambda name, kind: kind != "Array" and not (profile.di and name == "content")
    members = [{"name": n, "is_array": kind == "Array", "items": items, "mark": mark(own) if compared(n, kind) else "", "raw": own} for n, kind, items, own in found]
    numbers, end = [], -1
    if by.get(profile.page_array, ("", ""))[1] != "Array":
        codes.append("V06")
    else:
        numbers, end, bad = pages.told()
        codes += bad
    content = None
    if profile.di:
        if "content" not in by:
            codes.append("V09")
        elif not by["content"][3].startswith('"'):
            codes.append("V10")
        else:
            content = jsontext.plain(by["content"][3])
    return codes, members, numbers, end, content


def measured(parts: DataFrame, profile: Profile = DI) -> DataFrame:
    """parts (doc_id, k, planned, raw) with what each says of itself; the raw text itself is left out."""
    rows = parts.select("doc_id", "k", F.col("planned").cast("array<bigint>").alias("planned"), "raw")

    def run(batches):
        for b in arrowrows.slices(batches):
            told = zip(*(measure(r, profile) for r in b.column(3).to_pylist()), strict=True) if b.num_rows else [()] * 5
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(list(c), t) for c, t in zip(told, MEASURES.values(), strict=True))], ["doc_id", "k", "planned", *MEASURES])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, f"doc_id {kinds['doc_id']}, k {kinds['k']}, planned array<bigint>, {MEASURED}")


def member(name: str, field: str = "raw") -> Column:
    return F.get(F.filter("members", lambda m: m["name"] == name), F.lit(0))[field]


def own_codes() -> Column:
    """V02 to V10, what a part shows by itself."""
    rising = F.forall(F.sequence(F.lit(1), F.greatest(F.size("planned") - 1, F.lit(1))), lambda i: (F.size("planned") < 2) | (F.get("planned", i) > F.get("planned", i - 1)))
    plan = F.when(F.coalesce(F.size("planned") < 1, F.lit(True)) | ~rising | (F.get("planned", F.lit(0)) < 1), "V02")
    return F.array_union("codes", F.array_compact(F.array(plan)))


def in_order():
    """A document's parts up to each one."""
    return Window.partitionBy("doc_id").orderBy("k")


def whole():
    return in_order().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def before():
    return in_order().rowsBetween(Window.unboundedPreceding, -1)


def part_codes(profile: Profile, unit: str) -> list[Column]:
    """V15 to V22, what a part shows among its document's parts."""
    local = F.forall("pages", lambda n: n <= F.size("planned"))
    mapped = F.when(local, F.transform("pages", lambda n: F.get("planned", (n - 1).cast("int")))).otherwise(F.col("pages"))
    last = F.lag(F.try_element_at("planned", F.lit(-1))).over(in_order())
    codes = [
        F.when(F.get("planned", F.lit(0)) <= last, "V15"),
        F.when(F.size("pages") != F.size("planned"), "V16"),
        F.when((F.size("pages") == F.size("planned")) & ~F.coalesce(mapped == F.col("planned"), F.lit(False)), "V17"),
    ]
    if profile.di:
        length = units.unit_length(F.col("content"), unit)
        has = F.coalesce(member("sections", "is_array") & (member("sections", "items") > 0), F.lit(False))
        codes += [
            F.when(F.lit(unit == units.GRAPHEMES) & F.lead("k").over(in_order()).isNotNull() & F.endswith("content", F.lit("\r")), "V20"),
            F.when(((F.col("page_end") < 0) & (length > 0)) | ((F.col("page_end") >= 0) & (F.col("page_end") != length)), "V21"),
            F.when(F.max(has).over(whole()) & ~has & (length > 0), "V22"),
        ]
    return codes


def first_codes(profile: Profile, unit: str) -> list[Column]:
    """V18 and V19, told of the first part, whose unit and format hold for all."""
    if not profile.di:
        return []
    told = member("stringIndexType")
    got = F.when(told.isNull(), F.lit(units.GRAPHEMES)).otherwise(units.parse_unit(F.regexp_extract(told, r'^"(.*)"\z', 1)))
    string = F.coalesce(told.startswith('"'), F.lit(True))
    layout = F.when(member("contentFormat").isNotNull(), F.regexp_extract(member("contentFormat"), r'^"(.*)"\z', 1))
    return [F.when(~string | ~F.coalesce(got == unit, F.lit(False)), "V18"), F.when(policy.separator(layout).isNull(), "V19")]


def agreement_codes(profile: Profile) -> Column:
    """V11 to V13 of a document, from the distinct lists of its parts' (name, is_array, mark)."""
    facts = F.flatten("told")
    names = F.array_distinct(F.transform(facts, lambda m: m["name"]))

    def code(name: Column) -> Column:
        own = F.filter(facts, lambda m: m["name"] == name)
        any_array, all_arrays = F.exists(own, lambda m: m["is_array"]), F.forall(own, lambda m: m["is_array"])
        differ = (F.size(F.array_distinct(F.transform(own, lambda m: m["mark"]))) > 1) | ~F.forall("told", lambda p: F.exists(p, lambda m: m["name"] == name))
        skipped = any_array | (F.lit(profile.di) & (name == "content")) | ~differ
        return F.when(any_array & ~all_arrays, "V13").when(skipped, None).when(name.isin(*profile.agree), "V11").otherwise("V12")

    # One list for all parts is the common case, and leaves nothing to compare.
    return F.when(F.size("told") > 1, F.array_distinct(F.array_compact(F.transform(names, code)))).otherwise(F.array().cast("array<string>"))


def checked(rows: DataFrame, profile: Profile, unit: str) -> DataFrame:
    """rows with `own`, `mutual` and `agree`, the codes of a part, of it among others, and of its document as a whole.

    Parts of a document with codes of their own are not compared.
    """
    rows = rows.withColumn("own", own_codes())
    facts = F.transform("members", lambda m: F.struct(m["name"].alias("name"), m["is_array"].alias("is_array"), m["mark"].alias("mark")))
    rows = rows.withColumns({"spoilt": F.max(F.size("own") > 0).over(whole()), "mutual": F.array(*part_codes(profile, unit)), "told": F.collect_set(F.array_sort(facts)).over(whole()), "is_first": F.row_number().over(in_order()) == 1})
    none = F.array().cast("array<string>")
    mutual = F.concat("mutual", F.when(F.col("is_first"), F.array(*first_codes(profile, unit)).cast("array<string>")).otherwise(none))
    return rows.withColumns({"mutual": F.when(F.col("spoilt"), none).otherwise(F.array_compact(mutual)), "agree": F.when(~F.col("spoilt") & F.col("is_first"), agreement_codes(profile)).otherwise(none)}).drop("told", "is_first")


def shifted(rows: DataFrame, profile: Profile, unit: str) -> DataFrame:
    """rows with separator, length, char shift, page numbering, and bases and counts of the members that pointers name."""
    layout = F.first(member("contentFormat")).over(whole())
    joint = policy.separator(F.when(layout.isNotNull(), F.regexp_extract(layout, r'^"(.*)"\z', 1)))
    style = F.first(policy.angle_style(member("content")), ignorenulls=True).over(whole())
    out = rows.withColumn("joint", joint).withColumn("separator", policy.spelled_separator(F.col("joint"), style))
    length = F.coalesce(units.unit_length(F.col("content"), unit), F.lit(0)).cast("bigint")
    at = range(len(text.POINTER_MEMBERS))
    counts = F.array(*(F.coalesce(F.greatest(member(name, "items"), F.lit(0)), F.lit(0)).cast("bigint") for name in text.POINTER_MEMBERS))
    out = out.withColumns({"length": length, "counts": counts, "local": F.forall("pages", lambda n: n <= F.size("planned"))})
    sums = {"shift": F.sum(F.col("length") + F.coalesce(units.unit_length(F.col("joint"), unit), F.lit(0))).over(before())} | {f"base{i}": F.sum(F.get("counts", F.lit(i))).over(before()) for i in at}
    out = out.withColumns({name: F.coalesce(value, F.lit(0)).cast("bigint") for name, value in sums.items()})
    return out.withColumn("bases", F.array(*(f"base{i}" for i in at))).drop("joint", *(f"base{i}" for i in at))


@dataclass
class Renumber:
    """The rewriting rules of one part's scalars; Refused names the violation of what cannot be renumbered exactly."""

    profile: Profile
    planned: list[int]
    local: bool
    shift: int
    bases: list[int]
    counts: list[int]
    #: Leading sections of the part that were folded into earlier ones, and the merged place of its first section kept.
    folded: int = 0
    first_section: int = 1

    def page(self, number: int | None, code: str) -> int:
        if number is not None and (1 <= number <= len(self.planned) if self.local else number in self.planned):
            return self.planned[number - 1] if self.local else number
        raise Refused(code)

    def __call__(self, path: tuple, kind: str, raw: str) -> str | None:
        key, above = path[-1], path[-2] if len(path) > 1 else None
        if not self.profile.di:
            if len(path) == 3 and path[0] == self.profile.page_array and key == self.profile.page_key:
                return self.number(path, kind, raw, "V30")
            return None
        if isinstance(key, int):
            return self.pointer(kind, raw) if above == "elements" else None
        listed = isinstance(above, int)
        if key == "offset" and (above == "span" or listed and path[-3] == "spans"):
            if kind != "Number" or (at := jsontext.canonical(raw)) is None:
                raise Refused("V29")
            return str(at + self.shift)
        if key == "pageNumber" and listed and (len(path) == 3 and path[0] == "pages" or path[-3] == "boundingRegions"):
            return self.number(path, kind, raw, "V30")
        if key == "id" and len(path) == 3 and path[0] == "figures" and listed:
            page, dot, rest = raw[1:-1].partition(".")
            if kind != "String" or not dot or not rest:
                raise Refused("V32")
            return f'"{self.page(jsontext.canonical(page), "V32")}.{rest}"'
        return None

    def items(self, raw: str, name: str) -> tuple[str, int]:
        """An array member's items, rewritten, and their number; pages without cross-references are rewritten in one place alone."""
        found = None
        if not self.profile.di and name == self.profile.page_array:
            found = jsontext.renumbered(raw, self.profile.page_key, lambda kind, own: self.number((), kind, own, "V30"))
        return found or jsontext.array_items(raw, self, name)

    def number(self, path, kind, raw, code):
        return str(self.page(jsontext.canonical(raw) if kind == "Number" else None, code))

    def pointer(self, kind: str, raw: str) -> str:
        name, _, index = raw[2:-1].rpartition("/")
        at = jsontext.canonical(index)
        if kind != "String" or raw[1:2] != "/" or name not in text.POINTER_MEMBERS or at is None or at >= self.counts[text.POINTER_MEMBERS.index(name)]:
            raise Refused("V31")
        if name != "sections":
            return f'"/{name}/{at + self.bases[text.POINTER_MEMBERS.index(name)]}"'
        if 0 < at <= self.folded:
            raise Refused("V31")
        return f'"/sections/{self.first_section + at - 1 - self.folded if at else 0}"'


@dataclass
class Document:
    """A document's parts as one row of `gathered`, put together."""

    profile: Profile
    parts: list[dict]
    spoilt: bool = False

    def order(self) -> list[str] | None:
        return ordering.union(list(dict.fromkeys(tuple(m["name"] for m in p["members"]) for p in self.parts)))

    def codes(self) -> list[tuple[int | None, str]]:
        """(k, code) of what was told of the parts and of the document before anything is renumbered."""
        found = [(p["k"], c) for p in self.parts for c in p["codes"] or ()] + [(None, c) for p in self.parts for c in p["agree"] or ()]
        if not self.spoilt and self.order() is None:
            found.append((None, "V14"))
        return found

    def plan_sections(self, numbers: list[Renumber]) -> tuple[list, list, dict]:
        """(parts with sections, all parts, folds); numbers learn where sections go."""
        every = []
        for at, (p, number) in enumerate(zip(self.parts, numbers, strict=True)):
            arrays = {m["name"]: m["raw"] for m in p["members"] if m["is_array"] and m["name"] in text.POINTER_MEMBERS}
            every.append(sections.Part(at, p["length"], p["shift"], arrays, lambda raw, path, number=number: jsontext.rewrite(raw, number, path)))
        having = [q for q, p in zip(every, self.parts, strict=True) if p["counts"][text.POINTER_MEMBERS.index("sections")]]
        for q in having:
            try:
                q.read()
            except Refused as e:
                raise Refused(e.code, q.at) from None
        folds = sections.folded(having)
        place = 1
        for q in having:
            numbers[q.at].folded, numbers[q.at].first_section = q.folded, place
            place += len(q.sections) - 1 - q.folded
        return having, every, folds

    def merged(self) -> tuple[list[tuple[int | None, str]], str | None, list[dict]]:
        """(codes, result, counts); with codes there is no result."""
        if codes := self.codes():
            return codes, None, []
        try:
            return self.assembled(self.order())
        except Refused as e:
            return [(None if e.part is None else self.parts[e.part]["k"], e.code)], None, []

    def assembled(self, order: list[str]) -> tuple:
        numbers = [Renumber(self.profile, p["planned"], p["local"], p["shift"], p["bases"], p["counts"]) for p in self.parts]
        by = [{m["name"]: m for m in p["members"]} for p in self.parts]
        tree = self.plan_sections(numbers) if any("sections" in m for m in by) and self.profile.di else None
        out, counts, refused = [], [], []
        for name in order:
            having = [(p, number, m[name]) for p, number, m in zip(self.parts, numbers, by, strict=True) if name in m]
            if not having[0][2]["is_array"]:
                value = self.content() if self.profile.di and name == "content" else having[0][2]["raw"]
            elif tree and name == "sections":
                value, n = sections.merged(*tree)
                counts.append({"name": name, "items": n})
            else:
                pieces, total = [], 0
                for p, number, m in having:
                    try:
                        new, n = number.items(m["raw"], name)
                        if n != m["items"]:
                            raise Refused("V34")
                    except Refused as e:
                        refused.append((p["k"], e.code))
                        continue
                    total += n
                    if n:
                        pieces.append(new)
                value = "[" + ",".join(pieces) + "]"
                counts.append({"name": name, "items": total})
            out.append(f'"{name}":{value}')
        return (refused, None, []) if refused else ([], "{" + ",".join(out) + "}", counts)

    def content(self) -> str:
        bodies = (next(m["raw"] for m in p["members"] if m["name"] == "content")[1:-1] for p in self.parts)
        return '"' + self.parts[0]["separator"].join(bodies) + '"'


def gathered(parts: DataFrame, profile: Profile, unit: str) -> DataFrame:
    """(doc_id, parts): each document's parts in order, measured, checked and with their shifts, as one row.

    Parts are shuffled by document once; the windows and this grouping share that.  The spellings of documents with a
    violation are left out.
    """
    rows = shifted(checked(measured(parts, profile), profile, unit), profile, unit)
    rows = rows.withColumn("bad", F.max((F.size("own") > 0) | (F.size("mutual") > 0) | (F.size("agree") > 0)).over(whole()))
    bare = F.transform("members", lambda m: F.struct(m["name"].alias("name"), m["is_array"].alias("is_array"), m["items"].alias("items"), F.when(~F.col("bad"), m["raw"]).alias("raw")))
    rows = rows.withColumn("members", bare)
    told = lambda codes: F.when(F.size(codes) > 0, codes)
    placed = [F.when(F.lit(profile.di), F.col(c)).alias(c) for c in ("separator", "length", "shift", "counts", "bases")]
    kept = F.struct("k", "planned", "members", told(F.concat("own", "mutual")).alias("codes"), told(F.col("agree")).alias("agree"), "local", *placed)
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(kept)).alias("parts"), F.max("spoilt").alias("spoilt"))


CODE = pa.struct([("k", pa.int64()), ("code", pa.string())])
COUNT = pa.struct([("name", pa.string()), ("items", pa.int64())])


def documents(parts: DataFrame, profile: Profile = DI, unit: str = units.GRAPHEMES) -> DataFrame:
    """(doc_id, codes, result, counts, pages) of every document: result is null where there are codes."""
    rows = gathered(parts, profile, unit)

    def run(batches):
        for b in arrowrows.slices(batches):
            told = []
            for given, spoilt in zip(arrowrows.values(b.column(1)), b.column(2).to_pylist(), strict=True):
                codes, result, counts = Document(profile, given, spoilt).merged()
                told.append(([{"k": k, "code": c} for k, c in dict.fromkeys(codes)], result, counts, sum(len(p["planned"] or []) for p in given)))
            codes, results, counts, pages = map(list, zip(*told, strict=True)) if told else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes, pa.list_(CODE)), pa.array(results, pa.string()), pa.array(counts, pa.list_(COUNT)), pa.array(pages, pa.int64())], ["doc_id", "codes", "result", "counts", "pages"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, codes array<struct<k:bigint,code:string>>, result string, counts array<struct<name:string,items:bigint>>, pages bigint")


def merged(parts: DataFrame, profile: Profile = DI, unit: str = units.GRAPHEMES, most_bytes: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, counts, violations) of parts (doc_id, k, planned array<int>, raw), all three views of `documents`.

    results: (doc_id, result, pages, bytes, too_large) of documents without a violation; result is null beyond
    most_bytes.  counts: (doc_id, name, items) of their arrays.  A null raw text is malformed.  (doc_id, k) is distinct.
    Who needs more than one of them stores `documents` once.
    """
    return views(documents(parts, profile, unit), most_bytes)


def views(found: DataFrame, most_bytes: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """merged() of `documents`."""
    good = found.where(F.size("codes") == 0)
    out = good.select("doc_id", "result", "pages", F.octet_length("result").cast("bigint").alias("bytes"))
    large = F.lit(False) if most_bytes is None else F.col("bytes") > most_bytes
    results = out.select("doc_id", F.when(~large, F.col("result")).alias("result"), "pages", "bytes", large.alias("too_large"))
    counts = good.select("doc_id", F.inline("counts"))
    return results, counts, found.select("doc_id", F.inline("codes"))


def cut_pages(raw: str | None, plans: list[tuple[int, list[int]]], profile: Profile) -> tuple[list[str | None], list[str]]:
    """(the parts' results, problems) of a result whose pages do not refer to one another, in one pass over it."""
    raw, members, items, pages = raw or "", [], [], PageNumbers(profile.page_key)
    if told := quick_pages(raw, profile):
        return cut_items(plans, profile, *told)
    try:
        for path, kind, a, b, n in jsontext.values(raw):
            if not path and kind != "Object":
                raise jsontext.Malformed("no object")
            if len(path) == 1:
                members.append((path[0], kind, raw[a:b]))
            if path and path[0] == profile.page_array:
                pages.see(path[1:], kind, raw, a, b, n)
                if len(path) == 2:
                    items.append((a, b))
    except ValueError as e:
        return [None] * len(plans), [f"not well-formed: {e}"]
    numbers, _, codes = pages.told()
    return cut_items(plans, profile, raw, members, items, pages.places, numbers, codes)


def quick_pages(raw: str, profile: Profile) -> tuple | None:
    """(raw, members, items, places, numbers, codes) of a result as cut_items takes them, from the standard library's decoder.

    None where it does not read the text, or a page is not an object with one number: those are told by `values`.
    """
    told = jsontext.object_members(raw)
    if told is None or (names := [m[0] for m in told]).count(profile.page_array) != 1:
        return None
    _, begin, end = told[names.index(profile.page_array)]
    text = raw[begin:end]
    found = jsontext.array_members(text)
    if found is None:
        return None
    places = [[(a, b) for name, a, b in own or () if name == profile.page_key] for *_, own in found]
    if any(len(p) != 1 for p in places):
        return None
    places = [p for (p,) in places]
    numbers = [jsontext.canonical(text[a:b]) for a, b in places]
    if not all(numbers):
        return None
    members = [(name, "Array" if raw[a] == "[" else "", raw[a:b]) for name, a, b in told]
    return text, members, [(a, b) for a, b, _ in found], places, numbers, []


def cut_items(plans: list, profile: Profile, raw: str, members: list, items: list, places: list, numbers: list[int], codes: list[str]) -> tuple[list[str | None], list[str]]:
    """cut_pages() from what was read: top members (name, kind, raw), places of the pages and of their numbers in `raw`, and the numbers."""
    if codes or len(set(numbers)) < len(numbers):
        return [None] * len(plans), [f"the pages of {profile.page_array} are not numbered"]
    at = {n: i for i, n in enumerate(numbers)}
    problems = [f"part {k} wants page {n}, which the result lacks" for k, planned in plans for n in planned if n not in at]
    if problems:
        return [None] * len(plans), problems
    out = []
    for _, planned in plans:
        texts = []
        for local, n in enumerate(planned, 1):
            (a, b), (c, d) = items[at[n]], places[at[n]]
            texts.append(f"{raw[a:c]}{local}{raw[d:b]}")
        own = (f'"{name}":' + ("[" + ",".join(texts) + "]" if name == profile.page_array and kind == "Array" else value) for name, kind, value in members)
        out.append("{" + ",".join(own) + "}")
    return out, []


def cut(results: DataFrame, plan: DataFrame, profile: Profile = READ) -> DataFrame:
    """(doc_id, k, planned, raw, problems): the parts that whole results of pages without cross-references split into.

    results (doc_id, result), plan (doc_id, k, planned array<int>).  Pages keep all their bytes but their number, which
    becomes their place in the part; the other members are copied to every part.  A result that is null or malformed,
    or lacks a planned page, gives its parts a null raw text and says why in problems; a document without a plan, or a
    plan without a document, gives nothing.
    """
    if profile.di:
        raise ValueError("results whose pages refer to one another are cut by realcut.cut")
    plans = plan.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("k", F.col("planned").cast("array<bigint>").alias("planned")))).alias("plans"))
    joined = results.select("doc_id", "result").join(plans.hint("merge"), "doc_id")
    kind_k = plan.schema["k"].dataType.simpleString()

    def run(batches):
        for b in arrowrows.slices(batches):
            at, ks, planned, raws, told = [], [], [], [], []
            for i, (raw, plans) in enumerate(zip(b.column(1).to_pylist(), arrowrows.values(b.column(2)), strict=True)):
                wanted = [(p["k"], p["planned"] or []) for p in plans]
                texts, problems = cut_pages(raw, wanted, profile)
                at += [i] * len(wanted)
                ks += [k for k, _ in wanted]
                planned += [p for _, p in wanted]
                raws += texts
                told += [problems] * len(wanted)
            columns = [pa.array(ks, pa.int64()), pa.array(planned, pa.list_(pa.int64())), pa.array(raws, pa.string()), pa.array(told, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *columns], ["doc_id", "k", "planned", "raw", "problems"])

    schema = f"doc_id {joined.schema['doc_id'].dataType.simpleString()}, k bigint, planned array<bigint>, raw string, problems array<string>"
    return joined.mapInArrow(run, schema).withColumn("k", F.col("k").cast(kind_k))
