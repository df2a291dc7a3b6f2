"""Decisions as column expressions: parameters, page and unit choice, whole or split, errors, verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagefold.functions import pages, units

# The error vocabulary by status; retriable statuses.
CODE_OF_STATUS = {401: "Unauthorized", 403: "Forbidden", 404: "NotFound", 405: "MethodNotAllowed", 409: "Conflict", 415: "UnsupportedMediaType", 503: "ServiceUnavailable"}
READ_CODE_OF_STATUS = {401: "Unauthorized", 415: "UnsupportedMediaType"}
# The messages of codes and of inner codes, and the statuses of codes.
MESSAGES = {
    "InvalidRequest": "Invalid request.", "InvalidArgument": "Invalid argument.", "Unauthorized": "Access denied due to invalid subscription key.",
    "Forbidden": "Access forbidden due to policy or other configuration.", "NotFound": "Resource not found.", "MethodNotAllowed": "The requested HTTP method isn't allowed.",
    "Conflict": "The request couldn't be completed due to a conflict.", "UnsupportedMediaType": "Request content type isn't supported.", "InternalServerError": "An unexpected error occurred.",
    "ServiceUnavailable": "A transient error occurred. Try again.",
}
INNER_MESSAGES = {
    "InvalidContent": "The file is corrupted or format is unsupported. Refer to documentation for the list of supported formats.",
    "InvalidContentLength": "The input image is too large. Refer to documentation for the maximum file size.",
    "InvalidContentDimensions": "The input image dimensions are out of range. Refer to documentation for supported image dimensions.",
    "OperationNotFound": "The requested operation wasn't found. The identifier is invalid or the operation is expired.",
    "ModelNotFound": "The requested model wasn't found. It was deleted or still building.", "ContentSourceTimeout": "Timeout while receiving the file from client.", "Unknown": "Unknown error.",
}
STATUS_OF_CODE = {"InvalidRequest": 400, "InvalidArgument": 400, "Unauthorized": 401, "Forbidden": 403, "NotFound": 404, "MethodNotAllowed": 405, "Conflict": 409, "UnsupportedMediaType": 415, "InternalServerError": 500, "ServiceUnavailable": 503}
NO_DETAIL = "The upstream container reported the analysis as failed without detail."
RETRIABLE = (408, 429, 500, 502, 503, 504)
ERROR = "error struct<code string, message string, target string, innererror struct<code string, message string>>, code string, message string, requestId string, status string"


def heading(role: Column) -> Column:
    """Whether a paragraph's role opens a section."""
    return F.coalesce(role.isin("title", "sectionHeading"), F.lit(False))


def values_of(params: Column, name: str) -> Column:
    """All values of a parameter of a map<string, array<string>>, under every spelling of its name; null if none is given."""
    found = F.map_filter(params, lambda k, _: F.lower(k) == name.lower())
    return F.when(F.size(found) > 0, F.flatten(F.transform(F.array_sort(F.map_entries(found)), lambda e: e["value"])))


def without(params: Column, name: str) -> Column:
    """The parameters without any spelling of a name."""
    return F.map_filter(params, lambda k, _: F.lower(k) != name.lower())


def one(values: Column) -> Column:
    return F.when(F.size(values) == 1, F.get(values, F.lit(0)))


def page_selection(params: Column, count: Column) -> Column:
    """The pages to analyse: all where none are asked for; null where the request is not one valid selection."""
    given = values_of(params, "pages")
    every = F.when(count > 0, F.sequence(F.lit(1), count.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.when(given.isNull(), every).otherwise(pages.select_pages(pages.parse_pages(one(given)), count))


def unit_choice(params: Column, surface: Column) -> Column:
    """The unit that offsets are counted in; null where it is unknown or asked for more than once."""
    given = values_of(params, "stringIndexType")
    return F.when((surface != "di") | given.isNull(), F.lit(units.GRAPHEMES)).otherwise(F.when(F.size(given) == 1, units.parse_unit(one(given))))


def split_decision(limit: Column, is_pdf: Column, failure: Column, selected: Column, unit: Column) -> Column:
    """struct<mode, fallback>: `whole` or `split`, and why a document that could be split goes whole.

    failure: panic, encrypted, budget, unparseable or null; selected: its pages, null where they cannot be told.
    """
    told = lambda mode, why=None: F.struct(F.lit(mode).alias("mode"), F.lit(why).cast("string").alias("fallback"))
    return (
        F.when(F.coalesce(limit <= 0, F.lit(True)) | ~F.coalesce(is_pdf, F.lit(False)), told("whole"))
        .when(failure.isNotNull(), F.struct(F.lit("whole").alias("mode"), failure.alias("fallback")))
        .when(selected.isNull(), told("whole", "pages_param"))
        .when(F.size(selected) <= limit, told("whole"))
        .when(unit.isNull(), told("whole", "string_index_type"))
        .otherwise(told("split"))
    )


def refused_parameter(params: Column) -> Column:
    """The parameter that a synchronous analysis cannot honour: output, outputContentFormat, features, queryFields; else null."""
    none = F.array().cast("array<string>")
    values = lambda name: F.coalesce(values_of(params, name), none)
    outputs = F.exists(values("output"), lambda v: F.exists(F.split(v, ","), lambda o: F.lower(F.trim(o)).isin("pdf", "figures")))
    formats = F.exists(values("outputContentFormat"), lambda v: ~F.lower(v).isin("", "text"))
    features = F.exists(values("features"), lambda v: v != "")
    return F.when(outputs, "output").when(formats, "outputContentFormat").when(features, "features").when(values_of(params, "queryFields").isNotNull(), "queryFields")


def parsed_error(body: Column) -> Column:
    """struct<code, message, target, inner_code, inner_message, request_id> of a failed answer's body; null where it tells none.

    The shapes: wrapped in `error`, flat, and a bare failed status.
    """
    b = F.from_json(body, ERROR)
    text = lambda c: c.cast("string")
    made = lambda code, message, target, ic, im, rid: F.struct(code.alias("code"), message.alias("message"), target.alias("target"), ic.alias("inner_code"), im.alias("inner_message"), rid.alias("request_id"))
    none = F.lit(None).cast("string")
    e = b["error"]
    return (
        F.when(F.coalesce(e["code"], F.lit("")) != "", made(e["code"], text(e["message"]), e["target"], e["innererror"]["code"], e["innererror"]["message"], none))
        .when(F.coalesce(b["code"], F.lit("")) != "", made(b["code"], b["message"], none, none, none, b["requestId"]))
        .when(F.lower(b["status"]) == "failed", made(F.lit("InternalServerError"), F.lit(NO_DETAIL), none, none, none, none))
    )


def code_of_status(surface: Column, status: Column) -> Column:
    """The code of an error that is made from a status alone."""
    di, read = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for s, c in CODE_OF_STATUS.items():
        di = di.when(status == s, c)
    for s, c in READ_CODE_OF_STATUS.items():
        read = read.when(status == s, c)
    client = status.between(400, 499)
    return F.when(surface == "read", read.when(client, "BadArgument").otherwise("InternalServerError")).otherwise(di.when(client, "InvalidRequest").otherwise("InternalServerError"))


def looked_up(table: dict, key: Column) -> Column:
    """The value of a small fixed table, null for a key that it lacks."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def message_of_code(code: Column) -> Column:
    return looked_up(MESSAGES, code)


def message_of_inner_code(code: Column) -> Column:
    return looked_up(INNER_MESSAGES, code)


def status_of_code(code: Column) -> Column:
    return looked_up(STATUS_OF_CODE, code)


def retriable(status: Column) -> Column:
    return F.coalesce(status.isin(*RETRIABLE), F.lit(False))


def guid(text: Column) -> Column:
    """A GUID in lower case; null for anything else."""
    return F.when(text.rlike(r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\z"), F.lower(text))


def is_model_id(text: Column) -> Column:
    """2 to 64 characters: a letter or digit, then those and . _ ~ -"""
    return F.coalesce(text.rlike(r"^[a-zA-Z0-9][a-zA-Z0-9._~-]{1,63}\z"), F.lit(False))


def is_digits(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[0-9]+\z"), F.lit(False))


def separator(content_format: Column) -> Column:
    """What joins two parts' content; null for a format without a known one."""
    return F.when(content_format.isNull() | (content_format == "text"), F.lit("\n")).when(content_format == "markdown", F.lit("\n<!-- PageBreak -->\n"))


def angle_style(raw: Column) -> Column:
    """How a spelled string writes < and >, by the first of them: raw, lower, upper; null where it has none."""
    at = F.right(F.regexp_extract(raw, r"([<>]|(?<!\\)(?:\\\\)*+\\u003[cCeE])", 1), F.lit(1))
    return F.when(at.isin("<", ">"), "raw").when(at.isin("c", "e"), "lower").when(at.isin("C", "E"), "upper")


def spelled_separator(text: Column, style: Column) -> Column:
    """A separator as the body of a JSON string, its angle brackets spelled as the content's are."""
    line = F.replace(text, F.lit("\n"), F.lit("\\n"))
    escaped = lambda a, b: F.replace(F.replace(line, F.lit("<"), F.lit(a)), F.lit(">"), F.lit(b))
    return F.when(style == "lower", escaped("\\u003c", "\\u003e")).when(style == "upper", escaped("\\u003C", "\\u003E")).otherwise(line)


def page_limit(text: Column) -> Column:
    """A listing's limit: 1 to 1000, else 50."""
    n = F.when(text.rlike(r"^[+-]?[0-9]+\z"), text.try_cast("bigint"))
    return F.coalesce(F.when(n.between(1, 1000), n), F.lit(50)).cast("bigint")


def content_type(path: Column, head: Column) -> Column:
    """A document's media type: its PDF marker, its extension, its image signature, else octet-stream.  head: its first bytes."""
    start = F.hex(F.substring(head, 1, 16))
    return (
        F.when(F.instr(F.substring(head, 1, 1024).cast("string"), "%PDF-") > 0, "application/pdf")
        .when(F.lower(path).rlike(r"\.tiff?\z"), "image/tiff").when(F.lower(path).rlike(r"\.hei[fc]\z"), "image/heif")
        .when(start.startswith("89504E470D0A1A0A"), "image/png").when(start.startswith("FFD8FF"), "image/jpeg")
        .when(start.rlike("^474946383[79]61"), "image/gif").when(start.startswith("424D"), "image/bmp")
        .when(start.rlike("^52494646.{8}57454250"), "image/webp").otherwise("application/octet-stream")
    )


def sync_verdict(status: Column, timed_out: Column, body: Column) -> Column:
    """Whether a route serves synchronous analysis, from one answer; a null status is no answer."""
    missing = status.isin(404, 405, 501) | ((status == 500) & F.coalesce(body.contains("UnhandledEndpointException"), F.lit(False)))
    return F.when(status.isNull(), F.when(timed_out, "CANNOT RUN").otherwise("INCONCLUSIVE")).when(status == 200, "READY").when(missing, "CANNOT RUN").otherwise("INCONCLUSIVE")


def envelope(body: Column) -> Column:
    """struct<status, has_result, bare, failed> of an answer: an envelope with a status, or a bare result."""
    names = F.coalesce(F.json_object_keys(body), F.array().cast("array<string>"))
    status = F.coalesce(F.get_json_object(body, "$.status"), F.lit(""))
    within = F.array_contains(names, "analyzeResult")
    bare = ~within & (status == "") & F.ltrim(body).startswith("{")
    return F.struct(F.when(bare, "succeeded").otherwise(status).alias("status"), (within | bare).alias("has_result"), bare.alias("bare"), (F.lower(status) == "failed").alias("failed"))


def result_of(body: Column) -> Column:
    """The result in a successful answer: its member, or the whole of a body without a status; else null."""
    names, member = F.json_object_keys(body), F.get_json_object(body, "$.analyzeResult")
    return F.when(F.array_contains(names, "analyzeResult") & member.startswith("{"), member).when(names.isNotNull() & ~F.array_contains(names, "status"), body)


def poll_wait(retry_after: Column) -> Column:
    """Seconds before the next poll: what was told, 10 at most, else 1."""
    n = F.when(F.trim(retry_after).rlike(r"^[+-]?[0-9]+\z"), F.trim(retry_after).try_cast("bigint"))
    return F.coalesce(F.when(n > 0, F.least(n, F.lit(10))), F.lit(1)).cast("bigint")


def squashed(text: Column, most: int = 400) -> Column:
    """A body on one line, at most so many characters of it."""
    line = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(line) > most, F.concat(F.left(line, F.lit(most)), F.lit("…"))).otherwise(line)


def usage(total: Column, free: Column) -> Column:
    """The used share of a volume; null where its size is unknown."""
    return F.when(total > 0, (total - free) / total)


def summary(status: Column, message: Column) -> Column:
    return F.concat_ws(": ", F.when(status != "", status), F.when(message != "", message))
