"""Blobs: sharded paths, keyset-paged listings, orphan reports and source classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def safe_id(ident: Column) -> Column:
    """Characters outside [A-Za-z0-9_-] become _, at most 128 stay, an empty id is _."""
    return F.when(F.coalesce(ident, F.lit("")) == "", F.lit("_")).otherwise(F.left(F.regexp_replace(ident, "[^A-Za-z0-9_-]", "_"), F.lit(128)))


def blob_path(ident: Column, kind: Column) -> Column:
    """Two shard folders of the id's first four characters, `zz` where it has too few; then id.kind."""
    own = safe_id(ident)
    first = F.when(F.length(own) >= 2, F.left(own, F.lit(2))).otherwise(F.lit("zz"))
    second = F.when(F.length(own) >= 4, F.substring(own, 3, 2)).otherwise(F.lit("zz"))
    return F.concat_ws("/", first, second, F.concat(own, F.lit("."), kind))


def page_of(blobs: DataFrame, after: str, limit: int, id_col: str = "id") -> DataFrame:
    """The next distinct ids behind a cursor, in order."""
    return blobs.where(F.col(id_col) > after).select(id_col).distinct().orderBy(id_col).limit(limit)


def orphans(blobs: DataFrame, jobs: DataFrame, before: Column, id_col: str = "id", time_col: str = "modified") -> DataFrame:
    """Ids without a job all of whose files are older than `before`."""
    aged = blobs.groupBy(id_col).agg(F.max(time_col).alias("newest"), F.count("*").alias("files")).where(F.col("newest") < before)
    return aged.join(jobs.select(id_col), id_col, "left_anti")


def has_pdf_marker(content: Column) -> Column:
    """%PDF- within the first 1024 bytes of a binary value."""
    return F.instr(F.substring(content, 1, 1024).cast("string"), "%PDF-") > 0


def source_class(content_type: Column, body: Column) -> Column:
    """`pdf`, `base64` or `none`: what a request's body holds, by its content type before its marker."""
    kind = F.lower(F.trim(F.get(F.split(content_type, ";"), F.lit(0))))
    binary = kind.isin("application/pdf", "application/octet-stream") & has_pdf_marker(body)
    member = F.get_json_object(body.cast("string"), "$.base64Source")
    within = (kind == "application/json") & ~F.coalesce(member.contains("\\"), F.lit(True)) & has_pdf_marker(F.try_to_binary(member, F.lit("base64")))
    return F.when(binary, F.lit("pdf")).when(F.coalesce(within, F.lit(False)), F.lit("base64")).otherwise(F.lit("none"))
