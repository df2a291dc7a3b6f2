"""Personal data: patterns propose spans, checksums confirm them, context words adjust their score."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefold.llm.common import table, text_or_empty
from pagefold.llm.wordhash import buffer_of

#: The kinds of the base contract, in its order, then the kinds that this method adds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "secret")

# Lookbehinds and possessive repeats keep every scan linear: a run that fails once is not entered again.  A pattern
# begins with what it consumes, and looks behind that, as the scan for a first character is much faster than a try at each.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"[A-Z](?<![A-Za-z0-9][A-Z])[A-Z][0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SSN = re.compile(r"[0-8](?<![0-9-][0-8])[0-9]{2}(?<!000)(?<!666)-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
SECRET = re.compile(r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?:password|passwd|secret|api_key|token)[=:][^\s\"']{8,}+", re.ASCII)
#: Every secret holds one of these.
SECRET_MARKS = ("AKIA", *(f"{w}{mark}" for w in ("password", "passwd", "secret", "api_key", "token") for mark in "=:"))
#: Kinds without a digit in their patterns.
NO_DIGITS = frozenset(["email", "secret"])

#: Score of a confirmed span before its neighbourhood is read, and words near it that raise or lower the score.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.35, "secret": 0.7}
NEAR = {
    "email": {"mail": 0.1, "contact": 0.1, "write": 0.05},
    "ip": {"ip": 0.2, "address": 0.15, "host": 0.15, "server": 0.1, "version": -0.4, "release": -0.3},
    "card": {"card": 0.15, "visa": 0.15, "credit": 0.15, "payment": 0.1, "order": -0.2, "serial": -0.3},
    "phone": {"phone": 0.25, "call": 0.2, "tel": 0.25, "mobile": 0.25, "fax": 0.2},
    "iban": {"iban": 0.2, "bank": 0.15, "account": 0.15, "konto": 0.15},
    "ssn": {"ssn": 0.5, "social": 0.35, "security": 0.25, "taxpayer": 0.3, "part": -0.2, "serial": -0.3},
    "secret": {"key": 0.1, "secret": 0.1, "example": -0.1},
}
WINDOW = 48
WORD = re.compile(r"[a-z]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def emails(text: str):
    """Leftmost matches of local@domain, found from each @: the longest local part that no earlier match holds."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", at + 1)


def cards(text: str):
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def ibans(text: str):
    """A proposal may run into the capitals behind it, so its ends at each group are tried, longest first."""
    for m in IBAN.finditer(text):
        raw = m.group()
        for end in range(len(raw), 14, -1):
            if end == len(raw) or raw[end] == " ":
                plain = raw[:end].replace(" ", "")
                if 15 <= len(plain) <= 34 and mod97(plain):
                    yield m.start(), m.start() + end
                    break


def secrets(text: str):
    if any(mark in text for mark in SECRET_MARKS):
        for m in SECRET.finditer(text):
            yield m.span()


FINDERS = {
    "email": emails,
    "ip": lambda t: (m.span() for m in IP.finditer(t) if all(len(p) <= 3 and int(p or 0) <= 255 for p in (p.lstrip("0") for p in m.group().split(".")))),
    "card": cards,
    "phone": lambda t: (m.span() for m in PHONE.finditer(t) if 9 <= sum(map(str.isdigit, m.group())) <= 15),
    "iban": ibans,
    "ssn": lambda t: (m.span() for m in SSN.finditer(t)),
    "secret": secrets,
}


def score(kind: str, text: str, start: int, end: int) -> float:
    around = f"{text[max(0, start - WINDOW):start]} {text[end:end + WINDOW]}".lower()
    weights = NEAR[kind]
    return round(min(1.0, max(0.0, PRIOR[kind] + sum(weights.get(w, 0.0) for w in set(WORD.findall(around))))), 3)


def have_digits(texts: pa.Array) -> list[bool]:
    """Whether each text has a digit, from the bytes of all of them at once."""
    raw, offsets = buffer_of(texts)
    return (np.diff(np.searchsorted(np.flatnonzero(raw - np.uint8(48) < 10), offsets)) > 0).tolist()


def spans(text: str, min_score: float, digits: bool = True) -> list[dict]:
    """All spans by kind, then start.  Base kinds stay whatever their score; others need min_score.

    digits: whether the text may have any; without one, only the kinds that need none are sought.
    """
    out = []
    for kind in KINDS:
        if not digits and kind not in NO_DIGITS:
            continue
        for start, end in FINDERS[kind](text):
            points = score(kind, text, start, end)
            if kind in BASE or points >= min_score:
                out.append({"kind": kind, "start": start, "end": end, "score": points})
    return out


SPANS = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"
SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_score: float = 0.5) -> DataFrame:
    """(id, spans): personal data of every whole text, one row for each input row.

    A null or empty text has no spans; a null id stays null; equal rows give equal rows; an empty table gives an
    empty one.  Other columns are not read, whatever their names.  Offsets are code points, the end exclusive.
    """
    ids = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))

    def run(batches):
        for b in batches:
            found = [spans(t, min_score, d) for t, d in zip(b.column(1).to_pylist(), have_digits(b.column(1)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, SPANS_ARROW)], ["id", "spans"])

    return ids.mapInArrow(run, f"id {ids.schema['id'].dataType.simpleString()}, spans {SPANS}").withColumnRenamed("id", id_col)


def cut(text: str, found: list[dict]) -> str:
    """text with each span, or union of overlapping ones, replaced by its first kind in brackets."""
    out, at = [], 0
    for s in sorted(found, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            out += [text[at : s["start"]], f"[{s['kind'].upper()}]"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", min_score: float = 0.5) -> DataFrame:
    """docs with personal data in text_col replaced by its kind in brackets; every row and column stays.

    A null text stays null.  length_col, where the table has it, gets the new length in code points.
    """
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        for b in batches:
            texts = zip(b.column(at).to_pylist(), have_digits(b.column(at)), strict=True)
            new = [None if t is None else cut(t, found) if (found := spans(t, min_score, d)) else t for t, d in texts]
            yield b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    if length_col in names:
        kind = docs.schema[length_col].dataType
        out = out.withColumn(length_col, F.when(F.col(text_col).isNull(), F.col(length_col)).otherwise(F.length(text_col)).cast(kind))
    return out


def op2_pii(spark, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of_kind = lambda kind: lambda s: s["kind"] == kind
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id",
        *(F.size(F.filter("spans", of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )


QUERIES = {"op2_pii": op2_pii}
ORACLE_SQL: dict[str, str] = {}
