"""Benchmark decontamination: an FM-index per training shard, searched for the windows of test phrases.

Each task cuts its documents into shards of bounded size, indexes a shard's words and searches all windows backwards
through wavelet-tree ranks; occurrences are located by sampled suffix positions and merged to spans.  A shard's text
is reduced before it is indexed, without loss: words that no phrase has, and runs of words too short to hold any
window, become one break symbol, since no window can reach across them.

The benchmark's windows are a table, dealt to groups of bounded size and prepared by tasks; a task that searches
documents reads group after group from the shared folder, each once for many pieces of text, and holds one.  Spans and items of all groups are joined on
the whole text, so results do not depend on the number of groups.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefold.llm.common import file_system, pieces, scratch_path, stored, table, text_or_empty
from pagefold.llm.fmindex import FMIndex
from pagefold.llm.wordhash import ALNUM, Powers, words

WINDOW = 10
#: Symbols of one shard's index; a longer document is a shard of its own.
SHARD = 1 << 20
#: Pairs of window and item in one group, about: what a task holds of the benchmark at once.
PASS_WINDOWS = 200_000
#: Bytes of the texts that are cut to words at once.
PIECE = 2 << 20
#: Words of the pieces that a group of windows is read once for.
HELD_WORDS = 4_000_000
#: Rows located at once.
LOCATE = 1 << 20


def windows_of(hashes: np.ndarray) -> list[bytes]:
    """The windows of an item's words, as bytes; one shorter window for an item of fewer words."""
    width, raw = min(WINDOW, len(hashes)), hashes.tobytes()
    return [raw[8 * i : 8 * (i + width)] for i in range(len(hashes) - width + 1)] if width else []


class Phrases:
    """Distinct windows as rows of a matrix of word ids, and the items that have them."""

    def __init__(self, items: list[tuple[str, np.ndarray]]):
        self.prepare((w, item) for item, hashes in items for w in windows_of(hashes))

    def prepare(self, pairs):
        found: dict[bytes, set[str]] = {}
        for window, item in pairs:
            found.setdefault(window, set()).add(item)
        keys = sorted(found)
        arrays = [np.frombuffer(k, np.uint64) for k in keys]
        vocabulary = np.unique(np.concatenate(arrays)) if arrays else np.zeros(0, np.uint64)
        matrix = np.zeros((len(arrays), WINDOW), np.int32)
        for row, a in zip(matrix, arrays, strict=True):
            row[: len(a)] = np.searchsorted(vocabulary, a) + 2
        self.take(vocabulary, matrix, np.array([len(a) for a in arrays], np.int64), [sorted(found[k]) for k in keys])

    def take(self, vocabulary, matrix, lengths, items):
        self.vocabulary, self.matrix, self.lengths, self.items = vocabulary, matrix.astype(np.int64), lengths, items
        self.symbols = len(vocabulary) + 2  # 0 ends the text, 1 breaks it
        self.shortest = int(lengths.min()) if len(lengths) else WINDOW

    def row(self) -> tuple:
        return self.vocabulary.tobytes(), self.matrix.astype(np.int32).tobytes(), self.lengths.tobytes(), self.items

    @classmethod
    def of_row(cls, vocabulary: bytes, matrix: bytes, lengths: bytes, items: list[list[str]]) -> Phrases:
        out = cls([])
        out.take(np.frombuffer(vocabulary, np.uint64), np.frombuffer(matrix, np.int32).reshape(-1, WINDOW), np.frombuffer(lengths, np.int64), items)
        return out


class Groups:
    """The groups of a benchmark's windows, read from the shared folder one at a time; the last one read is kept."""

    def __init__(self, folder: str, n: int):
        self.folder, self.n, self.held = folder, n, (None, None)

    def __iter__(self):
        import pyarrow.parquet as pq

        for i in range(self.n):
            if self.held[0] != i:
                fs, at = file_system(f"{self.folder}/group={i}")
                self.held = i, [Phrases.of_row(*r.values()) for r in pq.read_table(at, filesystem=fs, partitioning=None).to_pylist()]
            yield from self.held[1]


def grouped_windows(benchmark: DataFrame, id_col: str, text_col: str) -> tuple[str, int]:
    """(folder, number of groups) of the benchmark's windows, written to the shared folder.

    A pair of a window and an item is in one group by its hash, so that a window that many items have is split too.
    """
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), text_or_empty(text_col).alias("text"))

    def run(batches):
        powers = Powers()
        for batch in batches:
            for b in pieces(batch, 1, PIECE):
                first, _, _, hashes = words(b.column(1), ALNUM, powers)
                for i, (begin, end) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                    found = windows_of(hashes[begin:end])
                    for at in range(0, len(found), 1 << 16):
                        own = found[at : at + (1 << 16)]
                        yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[i].as_py()] * len(own), pa.string()), pa.array(own, pa.binary())], ["item", "window"])

    pairs = stored(rows.mapInArrow(run, "item string, window binary").distinct(), "windows")
    n = -(-pairs.count() // PASS_WINDOWS)
    folder = scratch_path(benchmark.sparkSession, "window-groups")

    def prepared(frame):
        phrases = Phrases([])
        phrases.prepare(zip(frame["window"], frame["item"], strict=True))
        return pd.DataFrame([(int(frame["group"].iloc[0]), *phrases.row())], columns=["group", "vocabulary", "matrix", "lengths", "items"])

    if n:
        dealt = pairs.withColumn("group", F.pmod(F.xxhash64("window", "item"), F.lit(n)).cast("int"))
        ready = dealt.groupBy("group").applyInPandas(prepared, "group int, vocabulary binary, matrix binary, lengths binary, items array<array<string>>")
        ready.write.partitionBy("group").option("compression", "zstd").parquet(folder)
    return folder, n


def shards(kept: np.ndarray, limit: int):
    """Ranges of documents whose kept words are at most `limit`, or one document."""
    begin = held = 0
    for i, n in enumerate(kept.tolist()):
        if i > begin and held + n > limit:
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(kept):
        yield begin, len(kept)


def occurrences(phrases: Phrases, first: np.ndarray, hashes: np.ndarray, shard: int = SHARD):
    """(word position, window) of every occurrence of a window in the documents whose words start at `first`."""
    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(phrases.items) or not len(hashes):
        return nothing
    ids = np.searchsorted(phrases.vocabulary, hashes)
    ids[ids == len(phrases.vocabulary)] = 0
    known = phrases.vocabulary[ids] == hashes
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    opens = np.flatnonzero(known & np.r_[True, ~known[:-1] | (doc[1:] != doc[:-1])])
    closes = np.flatnonzero(known & np.r_[~known[1:] | (doc[1:] != doc[:-1]), True]) + 1
    long = closes - opens >= phrases.shortest
    opens, closes = opens[long], closes[long]
    size = np.bincount(doc[opens], weights=closes - opens + 1, minlength=len(first) - 1).astype(np.int64)
    at, which = [], []
    for a, b in shards(size, shard):
        mine = slice(*np.searchsorted(opens, [first[a], first[b]]))
        o, lengths = opens[mine], (closes - opens)[mine]
        if not len(o):
            continue
        # Text of the shard: each run and one break behind it.
        begins = np.cumsum(lengths + 1) - (lengths + 1)
        place = np.repeat(o - begins, lengths + 1) + np.arange(int((lengths + 1).sum()))
        text = ids[np.minimum(place, len(ids) - 1)] + 2
        text[begins + lengths] = 1
        index = FMIndex(text, phrases.symbols)
        lo, hi = index.count(phrases.matrix, phrases.lengths)
        hit = np.flatnonzero(hi > lo)
        for part in np.array_split(hit, max(1, -(-int((hi - lo)[hit].sum()) // LOCATE))):
            counts = (hi - lo)[part]
            rows = np.repeat(lo[part] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
            at.append(place[index.locate(rows)])
            which.append(np.repeat(part, counts))
    return (np.concatenate(at), np.concatenate(which)) if at else nothing


FOUND = "n_words bigint, spans array<struct<first:bigint,last:bigint,start:bigint,end:bigint>>, items array<string>"
SPAN = pa.struct([(f, pa.int64()) for f in ("first", "last", "start", "end")])


class Piece:
    """Texts cut to words, and what the groups of windows find in them."""

    def __init__(self, batch: pa.RecordBatch, texts: pa.Array, powers: Powers):
        self.batch, self.texts = batch, texts
        self.first, self.starts, self.ends, self.hashes = words(texts, ALNUM, powers)
        self.items = [set() for _ in range(len(texts))]
        self.depth = np.zeros(len(self.hashes) + 1, np.int64)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def meet(self, phrases: Phrases) -> None:
        at, which = occurrences(phrases, self.first, self.hashes)
        np.add.at(self.depth, at, 1)
        np.add.at(self.depth, at + phrases.lengths[which], -1)
        for d, w in np.unique(np.c_[self.doc[at], which], axis=0).tolist():
            self.items[d].update(phrases.items[w])

    def found(self) -> tuple[np.ndarray, list[list[dict]], list[list[str]]]:
        """For each text: number of words, merged spans (words, last exclusive, and UTF-8 bytes), items."""
        spans, doc, first = [[] for _ in self.items], self.doc, self.first
        covered = np.cumsum(self.depth)[:-1] > 0
        if covered.any():
            opens = np.flatnonzero(covered & np.r_[True, ~covered[:-1] | (doc[1:] != doc[:-1])])
            closes = np.flatnonzero(covered & np.r_[~covered[1:] | (doc[1:] != doc[:-1]), True]) + 1
            zero = byte_starts(self.texts)
            for o, c in zip(opens.tolist(), closes.tolist(), strict=True):
                d = int(doc[o])
                spans[d].append({"first": o - int(first[d]), "last": c - int(first[d]), "start": int(self.starts[o] - zero[d]), "end": int(self.ends[c - 1] - zero[d])})
        return np.diff(first), spans, [sorted(i) for i in self.items]


def searched(batches, at: int, groups: Groups):
    """(batch, *found) of all pieces of the batches, their texts in column `at`.

    Where there are several groups, pieces of HELD_WORDS words wait for one another, so that a group is read once for
    all of them.
    """
    powers, held, n = Powers(), [], 0

    def flush():
        for phrases in groups if held else ():
            for p in held:
                p.meet(phrases)
        for p in held:
            yield p.batch, *p.found()

    for batch in batches:
        for b in pieces(batch, at, PIECE):
            held.append(Piece(b, b.column(at).cast(pa.string()), powers))
            n += len(held[-1].hashes)
            if groups.n < 2 or n >= HELD_WORDS:
                yield from flush()
                held, n = [], 0
    yield from flush()


def byte_starts(texts: pa.Array) -> np.ndarray:
    sizes = pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.cumsum(sizes) - sizes


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, n_words, spans, items): occurrences of benchmark windows in every whole text, one row for each input row.

    A window is WINDOW consecutive item words; an item of fewer, but not none, is one window.  Null texts have no
    words; null item ids are taken as ''; items with equal texts are all named.  An empty benchmark finds nothing.
    Spans are merged; `first` and `last` count words, `start` and `end` are UTF-8 byte offsets.  Rows that repeat give
    rows that repeat.  Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    folder, n = grouped_windows(benchmark, item_col, item_text_col)

    def run(batches):
        for b, n_words, spans, items in searched(batches, 1, Groups(folder, n)):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(SPAN)), pa.array(items, pa.list_(pa.string()))], ["id", "n_words", "spans", "items"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {FOUND}").withColumnRenamed("id", id_col)


def cut(batch: pa.RecordBatch, at: int, n_words, spans) -> pa.RecordBatch:
    """The batch with each row's spans cut out of its text, without the rows that lose all of their words."""
    texts = batch.column(at).to_pylist()
    stay = [True] * len(texts)
    for i, found in enumerate(spans):
        if found:
            raw, end, parts = texts[i].encode(), 0, []
            for s in found:
                parts.append(raw[end : s["start"]])
                end = s["end"]
            texts[i] = b"".join([*parts, raw[end:]]).decode()
            stay[i] = sum(s["last"] - s["first"] for s in found) < n_words[i]
    field = batch.schema.field(at)
    return batch.set_column(at, field, pa.array(texts, field.type)).filter(pa.array(stay, pa.bool_()))


def remove(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with the found spans cut out of their texts; rows that had words and lose all of them go.

    Spans are found in the whole text, for all of the benchmark, and cut out once.  Clean rows stay as they are, and
    rows that repeat stay each.  length_col gets the new length of changed texts.
    """
    names, schema = docs.columns, docs.schema
    at = names.index(text_col)
    folder, n = grouped_windows(benchmark, "item_id", "text")

    def run(batches):
        for b, n_words, spans, _ in searched(batches, at, Groups(folder, n)):
            yield cut(b, at, n_words, spans)

    docs = docs.mapInArrow(run, schema)
    if length_col in names:
        docs = docs.withColumn(length_col, F.when(F.col(text_col).isNull(), F.col(length_col)).otherwise(F.length(text_col)).cast(schema[length_col].dataType))
    return docs


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["last"] - s["first"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


QUERIES = {"op5_decontamination": op5_decontamination}
ORACLE_SQL: dict[str, str] = {}
