"""Media columns: payloads in content-defined chunks, stored once, rebuilt from ordered chunk lists and verified.

A text's bytes are 8-bit samples of a WAV file.  A gear hash rolls over the samples and cuts chunks where it says so,
so equal passages give equal chunks wherever they stand.  Digests of chunks are joined in Spark: the first medium
that has a chunk owns its bytes, others refer to it.  The store has one row for each distinct medium, with its
ordered chunk list and the bytes of the chunks it owns.  Readers rebuild most media from their own row; chunks owned
elsewhere come by a join on their digest.  Bytes are shuffled once, compressed.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefold.llm.common import hot_keys, pieces, salted_join, spot_of, spots, spotted, stored, table, text_or_empty
from pagefold.llm.wordhash import BYTE_VALUE

UNIT = 64
RATE = 8000
HEADER = 44
#: Chunk sizes in bytes: least, expected beyond the least, most.
LEAST, EXPECTED, MOST = 512, 2048, 16384
GEAR = (BYTE_VALUE >> np.uint64(32)).astype(np.uint32)
#: Bytes that the gear hash sees; no more than LEAST, so that what stands before a chunk never moves its end.
ROLL = 32

def payload(text: str) -> bytes:
    raw = text.encode()
    return raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT))


def wav(samples: bytes) -> bytes:
    """A WAV file of one channel of unsigned 8-bit samples."""
    n = len(samples)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n) + samples


def samples_of(medium: bytes) -> bytes:
    riff, size, kind, _, _, coding, channels, _, _, _, bits, _, n = struct.unpack_from("<4sI4s4sIHHIIHH4sI", medium)
    if (riff, kind, coding, channels, bits) != (b"RIFF", b"WAVE", 1, 1, 8) or size != 36 + n or len(medium) != HEADER + n:
        raise ValueError("not the WAV file that was stored")
    return medium[HEADER:]


def gear(raw: np.ndarray) -> np.ndarray:
    """At each byte the sum of GEAR of the last ROLL bytes, each shifted by its distance; by doubling the span."""
    h, span = GEAR[raw], 1
    while span < ROLL:
        ahead = h[span:] + (h[:-span] << np.uint32(span))
        h = np.concatenate([h[:span], ahead])
        span *= 2
    return h


def cuts(media: list[bytes]) -> list[list[int]]:
    """Chunk ends of each medium; the last is its length."""
    raw = np.frombuffer(b"".join(media), np.uint8)
    marks = np.flatnonzero(gear(raw) < np.uint32((1 << 32) // EXPECTED)) + 1
    out, base = [], 0
    for m in media:
        n = len(m)
        lo, hi = np.searchsorted(marks, [base + 1, base + n])
        ends, last = [], 0
        for at in (marks[lo:hi] - base).tolist():
            while at - last > MOST:
                last += MOST
                ends.append(last)
            if at - last >= LEAST and at < n:
                ends.append(last := at)
        while n - last > MOST:
            last += MOST
            ends.append(last)
        out.append([*ends, n])
        base += n
    return out


def digest(chunk) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def prepared(batch: pa.RecordBatch, column: int):
    """Media, their keys (SHA-256), chunk ends and chunk digests, of the texts in a column."""
    media = [wav(payload(t)) for t in batch.column(column).to_pylist()]
    ends = cuts(media)
    digests = [[digest(memoryview(m)[a:b]) for a, b in zip([0, *e[:-1]], e, strict=True)] for m, e in zip(media, ends, strict=True)]
    return media, [hashlib.sha256(m).digest() for m in media], ends, digests


RECIPE = "array<struct<digest:binary,length:int>>"
RECIPE_ARROW = pa.list_(pa.struct([("digest", pa.binary()), ("length", pa.int32())]))


def listed(docs: DataFrame) -> DataFrame:
    """(id, n_bytes, key, digests) of (id, text)."""

    def run(batches):
        for batch in batches:
            for b in pieces(batch, 1):
                _, keys, _, digests = prepared(b, 1)
                n_bytes = pa.compute.binary_length(b.column(1)).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0), n_bytes, pa.array(keys, pa.binary()), pa.array(digests, pa.list_(pa.binary()))], ["id", "n_bytes", "key", "digests"])

    return docs.mapInArrow(run, "id bigint, n_bytes bigint, key binary, digests array<binary>")


def shared_chunks(rows: DataFrame) -> DataFrame:
    """(plan_id, plan_key, holds, drops, lends): what holders of media leave out or lend; and rows that hold nothing.

    Of equal media the smallest id holds the bytes; of equal chunks the first place among the holders owns them.
    Both sides of every join grow with the corpus, so they are merged and never broadcast, whatever their size; rows
    of equal media meet their holder by id and medium, and those of a chunk that many media have are dealt to many tasks.
    """
    holder = rows.groupBy(F.col("key").alias("held_key")).agg(F.min("id").alias("holder"))
    holders = rows.join(holder.hint("merge"), (F.col("key") == F.col("held_key")) & F.col("id").eqNullSafe(F.col("holder")), "left_semi")
    idle = rows.join(holder.hint("merge"), (F.col("key") == F.col("held_key")) & F.col("id").eqNullSafe(F.col("holder")), "left_anti")
    idle = idle.select(F.col("id").alias("plan_id"), F.col("key").alias("plan_key")).distinct()
    chunks = holders.dropDuplicates(["key"]).select("id", "key", F.posexplode("digests").alias("ord", "digest"))
    owner = chunks.groupBy(F.col("digest").alias("owned")).agg(F.min(F.struct("key", "ord")).alias("owner"), F.count("*").alias("n")).where("n > 1")
    owner = stored(owner, "media-owners")
    met = salted_join(chunks, owner.drop("n"), "digest", "owned", "key", hot_keys(owner.select("owned", "n"), "owned", "n"))
    owns = (F.col("owner.key") == F.col("key")) & (F.col("owner.ord") == F.col("ord"))
    plan = met.groupBy(F.col("id").alias("plan_id"), F.col("key").alias("plan_key")).agg(
        F.collect_list(F.when(~owns, F.col("ord"))).alias("drops"), F.collect_list(F.when(owns, F.col("ord"))).alias("lends")
    )
    none = F.array().cast("array<int>")
    return plan.select("plan_id", "plan_key", F.lit(True).alias("holds"), "drops", "lends").unionByName(idle.select("plan_id", "plan_key", F.lit(False).alias("holds"), none.alias("drops"), none.alias("lends")))


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, media): rows (id, n_bytes, key) of every text; media (key, recipe, drops, lends, pack), each once, but
    again for rows that repeat both id and text.

    A recipe lists a medium's chunks in order; pack has the owned ones' bytes joined and compressed, drops the numbers
    of those owned elsewhere, lends the numbers of those that other media use.  Null texts are empty; equal texts are
    one medium; rows that repeat keep a row each.  An empty table gives empty tables.  Other columns are not read.
    Ids are taken as bigint; one that is no number is an error.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), text_or_empty(text_col).alias("text"))
    rows = stored(listed(docs), "media-rows")
    plan = stored(shared_chunks(rows), "media-plan")
    # Texts whose bit is not set need no plan, and their bytes no shuffle; a bit set by another id only sends a text to
    # the join.
    planned = spots(plan, "plan_id")

    def compress(wanted: bool):
        def run(batches):
            for batch in batches:
                batch = batch.filter(pa.array(spotted(planned, batch.column(2).to_numpy()) == wanted))
                for b in pieces(batch, 1):
                    media, keys, ends, digests = prepared(b, 1)
                    recipes = [[{"digest": d, "length": e - a} for d, a, e in zip(ds, [0, *es[:-1]], es, strict=True)] for ds, es in zip(digests, ends, strict=True)]
                    packs = [zlib.compress(m, 6) for m in media]
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(recipes, RECIPE_ARROW), pa.array(packs, pa.binary())], ["id", "key", "recipe", "pack"])

        return docs.withColumn("spot", spot_of("id")).mapInArrow(run, f"id bigint, key binary, recipe {RECIPE}, pack binary")

    none = F.array().cast("array<int>")
    alone = compress(False).select("key", "recipe", none.alias("drops"), none.alias("lends"), "pack")
    joined = compress(True).join(plan.hint("merge"), F.col("id").eqNullSafe(F.col("plan_id")) & (F.col("key") == F.col("plan_key")), "left").where(F.coalesce("holds", F.lit(True)))
    joined = joined.select("key", "recipe", F.coalesce("drops", none).alias("drops"), F.coalesce("lends", none).alias("lends"), "pack")

    def reduce(batches):
        for b in batches:
            packs = b.column(4).to_pylist()
            for i, drops in enumerate(b.column(2).to_pylist()):
                if drops:
                    raw, at, own, out = zlib.decompress(packs[i]), 0, set(drops), []
                    for k, c in enumerate(b.column(1)[i].as_py()):
                        if k not in own:
                            out.append(raw[at : at + c["length"]])
                        at += c["length"]
                    packs[i] = zlib.compress(b"".join(out), 6)
            yield b.set_column(4, b.schema.field(4), pa.array(packs, pa.binary()))

    schema = f"key binary, recipe {RECIPE}, drops array<int>, lends array<int>, pack binary"
    return rows.select("id", "n_bytes", "key"), stored(alone.unionByName(joined.mapInArrow(reduce, schema)), "media")


def owned(recipe: list[dict], drops: list[int], pack: bytes) -> dict[int, bytes]:
    """Bytes of the owned chunks by their number."""
    raw, at, left, out = zlib.decompress(pack), 0, set(drops), {}
    for k, c in enumerate(recipe):
        if k not in left:
            out[k] = raw[at : at + c["length"]]
            at += c["length"]
    return out


def rebuild(key: bytes, recipe: list[dict], drops: list[int], pack: bytes, fetched: dict[int, bytes]) -> bytes:
    """The medium of an ordered chunk list; every fetched chunk's digest and the whole's SHA-256 are verified."""
    have = owned(recipe, drops, pack)
    for k, chunk in fetched.items():
        if digest(chunk) != recipe[k]["digest"]:
            raise ValueError("a chunk's bytes do not have its digest")
        have[k] = chunk
    medium = b"".join(have[k] for k in range(len(recipe)))
    if hashlib.sha256(medium).digest() != key:
        raise ValueError("a medium does not have its SHA-256")
    return medium


def described(medium: bytes, recipe: list[dict]) -> tuple:
    """Digests of a medium that was read back, and a feature of its samples."""
    samples = samples_of(medium)
    x = np.frombuffer(samples, np.uint8)
    level = x.astype(np.int64) - 128
    crossings = int(np.count_nonzero(np.diff(np.signbit(level))))
    bins = np.bincount(x >> 5, minlength=8).tolist()
    feature = f"mean={int(x.sum()) // len(x)};power={int((level * level).sum()) // len(x)};crossings={crossings};bins={'/'.join(map(str, bins))};chunks={len(recipe)}"
    return len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), len(medium), hashlib.sha256(medium).hexdigest(), feature


FIELDS = {"key": pa.binary(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}
SCHEMA = "key binary, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def read(media: DataFrame, each=described, fields=FIELDS, schema: str = SCHEMA) -> DataFrame:
    """`each` of every stored medium, rebuilt and verified: (key, *each(medium, recipe))."""

    def emit(rows):
        out = [(key, *each(rebuild(key, recipe, drops, pack, fetched), recipe)) for key, recipe, drops, pack, fetched in rows]
        columns = zip(*out, strict=True) if out else [()] * len(fields)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, fields.values(), strict=True)], list(fields))

    def alone(batches):
        for batch in batches:
            for b in pieces(batch, 3, 2 << 20):
                yield emit((k, r, d, p, {}) for k, r, d, p in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True))

    def together(batches):
        for batch in batches:
            for b in pieces(batch, 3, 2 << 20):
                yield emit((k, r, d, p, {f["ord"]: f["bytes"] for f in got}) for k, r, d, p, got in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True))

    def lent(batches):
        for b in batches:
            digests, chunks = [], []
            for recipe, drops, lends, pack in zip(*(c.to_pylist() for c in b.columns), strict=True):
                have = owned(recipe, drops, pack)
                digests += [recipe[k]["digest"] for k in lends]
                chunks += [have[k] for k in lends]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(chunks, pa.binary())], ["lent_digest", "bytes"])

    columns = ["key", "recipe", "drops", "pack"]
    whole = media.where("size(drops) = 0").select(columns).mapInArrow(alone, schema)
    parts = media.where("size(drops) > 0").select(columns)
    chunks = media.where("size(lends) > 0").select("recipe", "drops", "lends", "pack").mapInArrow(lent, "lent_digest binary, bytes binary")
    # A dropped chunk's row has its digest alone, never the whole list of chunks.
    dropped = F.expr("transform(drops, d -> struct(d as ord, recipe[d].digest as digest))")
    wanted = parts.select(F.col("key").alias("wanted_key"), F.explode(dropped).alias("drop")).select("wanted_key", "drop.ord", "drop.digest")
    fetched = wanted.join(chunks.hint("merge"), F.col("digest") == F.col("lent_digest")).groupBy("wanted_key").agg(F.collect_list(F.struct("ord", "bytes")).alias("fetched"))
    return whole.unionByName(parts.join(fetched.hint("merge"), F.col("key") == F.col("wanted_key")).select(*columns, "fetched").mapInArrow(together, schema))


def op8_media_chunks(spark, sf_dir: str) -> DataFrame:
    rows, media = store(table(spark, sf_dir, "documents"))
    found = read(media).dropDuplicates(["key"]).withColumnRenamed("key", "media_key")
    hot = hot_keys(rows.groupBy("key").agg(F.count("*").alias("n")))
    out = salted_join(rows, found, "key", "media_key", "id", hot)
    return out.select(F.col("id").alias("doc_id"), "n_bytes", *list(FIELDS)[1:])


QUERIES = {"op8_media_chunks": op8_media_chunks}
ORACLE_SQL: dict[str, str] = {}
