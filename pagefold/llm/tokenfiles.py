"""Token-id files: flat unsigned integers with 64-bit document offsets, one pair of files for each range of ids.

Texts are dealt by ranges of their id and sorted, each task encodes its range and appends to its own file; the start
of every file among all ids is a prefix sum over the files' lengths (one row for each file).  Readers map the files.
"""

from __future__ import annotations

import array
import base64
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefold.llm.common import scratch_path, table, text_or_empty

#: Words whose ids a task keeps; beyond that it starts anew.
CACHE_WORDS = 400_000
MARKS = frozenset(".,;:!?")


class ByteBpe:
    """Ids of a text as the tokenizers file gives them, word by word, with the ids of words kept.

    The split pattern never joins text across a space that has no white space on one of its sides, so a text may be
    cut before such spaces.  Words of Latin letters take the same vocabulary as ranks, which is faster; all others,
    and those with special tokens, take the tokenizers file itself.
    """

    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    UNSAFE = re.compile(r"\s (?=\s|\Z)")
    PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-ſ]*")

    def __init__(self, file: str, ranks_file: str | None, dtype):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(file)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.code, self.ranks = {"<u2": "H", "<u4": "I"}[dtype], None
        if ranks_file:
            import tiktoken

            with open(ranks_file, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.ranks = tiktoken.Encoding("own", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.words = self.Words(self)

    class Words(dict):
        """Ids of a word with the space before it, encoded when first asked for."""

        def __init__(self, bpe):
            self.bpe, self.marks = bpe, {}

        def __missing__(self, word):
            if len(self) >= CACHE_WORDS:
                self.clear()
            bpe = self.bpe
            if bpe.ranks is not None and word.isalpha() and bpe.PLAIN.fullmatch(word):
                # Letters alone are one piece of the split.
                ids = bpe.packed(bpe.ranks._core_bpe.encode_single_piece(b" " + word.encode()))
            elif word[-1:] in MARKS and word[:-1].isalpha():
                # Letters and one mark are two pieces.
                mark = word[-1]
                if mark not in self.marks:
                    self.marks[mark] = bpe.encode(mark)
                ids = self[word[:-1]] + self.marks[mark]
            else:
                ids = bpe.encode(f" {word}")
            self[word] = ids
            return ids

    def packed(self, ids: list[int]) -> bytes:
        return array.array(self.code, ids).tobytes()

    def encode(self, text: str) -> bytes:
        if self.ranks is not None and "<|" not in text and self.PLAIN.fullmatch(text):
            ids = self.ranks.encode_ordinary(text)
        else:
            ids = self.whole.encode(text, add_special_tokens=False).ids
        return self.packed(ids)

    def ids(self, text: str) -> bytes:
        if self.UNSAFE.search(text):
            return self.encode(text)
        head, *rest = text.split(" ")
        return b"".join([self.encode(head) if head else b"", *map(self.words.__getitem__, rest)])


class Files:
    """Reading and writing in a folder given as a URI: by plain paths where it is a local or mounted one."""

    def __init__(self, uri: str):
        self.fs, self.at = None, re.sub(r"^file:(//)?(?=/)", "", uri)
        if "://" in self.at:
            from pyarrow import fs

            self.fs, self.at = fs.FileSystem.from_uri(uri)

    def put(self, name: str, chunks) -> int:
        """Write under a name of this attempt, then rename: a task that is repeated leaves one whole file."""
        part, total = f"{self.at}/.{name}.{TaskContext.get().taskAttemptId()}", 0
        if self.fs is None:
            os.makedirs(self.at, exist_ok=True)
        else:
            self.fs.create_dir(self.at)
        with open(part, "wb") if self.fs is None else self.fs.open_output_stream(part) as f:
            for c in chunks:
                f.write(c)
                total += len(c)
        (os.replace if self.fs is None else self.fs.move)(part, f"{self.at}/{name}")
        return total

    def mapped(self, name: str, dtype):
        """A file's numbers, by slices: a memory map, or ranges of a store that has no local paths."""
        path = f"{self.at}/{name}"
        if self.fs is not None:
            return Ranged(self.fs, path, dtype)
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)


class Ranged:
    """The numbers of a remote file; a slice reads its own bytes and no others."""

    def __init__(self, fs, path: str, dtype):
        self.file, self.dtype = fs.open_input_file(path), np.dtype(dtype)
        self.n = self.file.size() // self.dtype.itemsize

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, part: slice) -> np.ndarray:
        a, b, _ = part.indices(self.n)
        self.file.seek(a * self.dtype.itemsize)
        return np.frombuffer(self.file.read(max(0, b - a) * self.dtype.itemsize), self.dtype)


def write(docs: DataFrame, folder: str, tokenizer: str, ranks: str | None, end_id: int, dtype: str = "<u2", id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Write the ids of every whole text in order of id, each text's behind it end_id; return the files' manifest.

    For each file: .ids (flat dtype), .offsets (int64, n + 1 starts within the file), .keys (int64 ids) and .nulls
    (one byte, 1 for a null id).  Null ids come first; ties of an id are ordered by text; rows that repeat are
    written each.  Null texts are empty: end_id alone.  An empty table writes no file.  Other columns are not read.
    Ids are taken as bigint; one that is no number is an error.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text_or_empty(text_col).alias("text"))
    # As many files as input partitions: the files' lengths follow the partitions' sizes.
    rows = rows.repartitionByRange(max(1, rows.rdd.getNumPartitions()), "id").sortWithinPartitions("id", "text")

    def run(batches):
        keys, nulls, lengths, bpe, end = [], [], [], None, np.array([end_id], dtype).tobytes()
        width = np.dtype(dtype).itemsize

        def chunks():
            nonlocal bpe
            for b in batches:
                bpe = bpe or ByteBpe(tokenizer, ranks, dtype)
                for k, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    ids = bpe.ids(text.as_py())
                    keys.append(k or 0)
                    nulls.append(k is None)
                    lengths.append(len(ids) // width + 1)
                    yield ids
                    yield end

        files, name = Files(folder), f"part-{TaskContext.get().partitionId():06d}"
        size = files.put(f"{name}.ids", chunks())
        if keys:
            files.put(f"{name}.offsets", [np.concatenate([[0], np.cumsum(lengths)]).astype("<i8").tobytes()])
            files.put(f"{name}.keys", [np.array(keys, "<i8").tobytes()])
            files.put(f"{name}.nulls", [np.array(nulls, np.uint8).tobytes()])
            yield pa.RecordBatch.from_pydict({"name": [name], "n_docs": [len(keys)], "n_ids": [size // width]})

    parts = sorted(rows.mapInArrow(run, "name string, n_docs bigint, n_ids bigint").collect(), key=lambda r: r["name"])
    manifest, base = [], 0
    for r in parts:
        manifest.append({"name": r["name"], "n_docs": r["n_docs"], "n_ids": r["n_ids"], "base": base})
        base += r["n_ids"]
    return manifest


def read(spark, folder: str, manifest: list[dict], dtype: str = "<u2") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the mapped files."""
    schema = "id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    if not manifest:
        return spark.createDataFrame([], schema)

    def run(batches):
        files = Files(folder)
        for b in batches:
            for i in b.column(0).to_pylist():
                part = manifest[i]
                ids, offsets = files.mapped(f"{part['name']}.ids", dtype), files.mapped(f"{part['name']}.offsets", "<i8")
                keys, nulls = files.mapped(f"{part['name']}.keys", "<i8"), files.mapped(f"{part['name']}.nulls", np.uint8)
                for at in range(0, len(keys), 8192):
                    cuts = offsets[at : at + 8193]
                    own_ids, zero = ids[cuts[0] : cuts[-1]], cuts[0]
                    crc = [zlib.crc32(own_ids[a - zero : e - zero].astype("<u4").tobytes()) for a, e in zip(cuts[:-1], cuts[1:], strict=True)]
                    own = pa.array(keys[at : at + 8192].astype(np.int64), mask=nulls[at : at + 8192].astype(bool))
                    yield pa.RecordBatch.from_arrays([own, pa.array(cuts[:-1] + part["base"]), pa.array(np.diff(cuts)), pa.array(crc, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

    return spark.range(0, len(manifest), 1, len(manifest)).mapInArrow(run, schema)


def op9_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = scratch_path(spark, "token-files")
    manifest = write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), end_id=2)
    return read(spark, folder, manifest).withColumnRenamed("id", "doc_id")


QUERIES = {"op9_token_files": op9_token_files}
ORACLE_SQL: dict[str, str] = {}
