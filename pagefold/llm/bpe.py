"""BPE encoding and decoding over a table of distinct words.

Words are split once and coded: a block of texts (a bounded number of characters) keeps, for each text, the codes of
its words by position, and the block's distinct words, dealt to buckets by their hash.  A bucket gathers its words
from all blocks and encodes each distinct word once; their ids go back to the blocks, where they are joined to the
positions.  Decoding joins ids to pieces in the same place: the vocabulary is a table of fixed size on every task.
"""

from __future__ import annotations

import array
import hashlib
import json
import os
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefold.llm.common import stored, table, text_or_empty

#: Characters of the texts of one block; a longer text is a block of its own.
BLOCK_CHARS = 32 << 20
#: Tasks that join blocks, for each bucket: there are about as many blocks as buckets, and a task should not hash several.
BLOCK_TASKS = 4
#: Words in one row of coded texts, about.
ROW_WORDS = 200_000
ABOVE_LATIN = re.compile("[^\0-ſ]")


def split(text: str) -> list[str]:
    """Parts of a text that are encoded alike alone and together: the tokenizer's pattern never crosses white space.

    Lower case is taken here where it is the tokenizer's own: without characters that compose, and without special
    tokens, which are matched in the text as it stands.
    """
    if "<|" not in text and not ABOVE_LATIN.search(text):
        text = text.lower()
    return [w for w in text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if w]


class Codes(dict):
    def __missing__(self, word):
        code = self[word] = len(self)
        return code


ONE_BYTE = 192


def packed(numbers: np.ndarray) -> bytes:
    """Numbers under 2**22, small ones mostly, as bytes: one each, the two lower ones of large numbers apart."""
    n = numbers.astype(np.int64)
    wide = n >= ONE_BYTE
    if len(n) and n.max() - ONE_BYTE >= (256 - ONE_BYTE) << 16:
        return b"w" + zstandard.compress(n.astype("<u4").tobytes(), 9)
    rest = n[wide] - ONE_BYTE
    first = np.where(wide, ONE_BYTE + ((n - ONE_BYTE) >> 16), n).astype(np.uint8)
    return b"n" + zstandard.compress(len(n).to_bytes(8, "little") + first.tobytes() + (rest & 255).astype(np.uint8).tobytes() + (rest >> 8 & 255).astype(np.uint8).tobytes(), 9)


def unpacked(data: bytes) -> np.ndarray:
    raw = zstandard.decompress(data[1:])
    if data[:1] == b"w":
        return np.frombuffer(raw, "<u4")
    n = int.from_bytes(raw[:8], "little")
    out = np.frombuffer(raw, np.uint8, n, 8).astype(np.uint32)
    wide = np.flatnonzero(out >= ONE_BYTE)
    low, high = (np.frombuffer(raw, np.uint8, len(wide), 8 + n + i * len(wide)).astype(np.uint32) for i in (0, 1))
    out[wide] = ONE_BYTE + ((out[wide] - ONE_BYTE) << 16) + low + (high << 8)
    return out


class Block:
    def __init__(self):
        self.codes, self.chars, self.ids, self.rows = Codes(), 0, [], []

    def add(self, key, text: str):
        self.ids.append(key)
        self.rows.append(np.array(array.array("I", map(self.codes.__getitem__, split(text))), np.uint32))
        self.chars += len(text)

    def batches(self, block: int, buckets: int, kind):
        """Words are numbered anew, frequent ones first; a bucket's words are sorted, so that they pack well."""
        n = len(self.ids)
        often = np.bincount(np.concatenate(self.rows), minlength=len(self.codes))
        rank = np.empty(len(often), np.uint32)
        rank[np.argsort(-often, kind="stable")] = np.arange(len(often))
        # Many texts to a row, so that they pack well together: their ids, codes in order and numbers of words.
        sizes, begin = np.array([len(r) for r in self.rows]), 0
        cuts = [*(np.flatnonzero(np.diff(np.cumsum(sizes) // ROW_WORDS)) + 1).tolist(), n]
        for end in cuts:
            rows = self.rows[begin:end]
            yield batch([block], [None], pa.array([self.ids[begin:end]], pa.list_(kind)), [packed(rank[np.concatenate(rows)])], [packed(sizes[begin:end])], kind)
            begin = end
        dealt: dict[int, list[tuple[str, int]]] = {}
        for word, code in zip(self.codes, rank.tolist(), strict=True):
            dealt.setdefault(zlib.crc32(word.encode()) % buckets, []).append((word, code))
        if dealt:
            k = len(dealt)
            for words in dealt.values():
                words.sort()
            codes = [packed(np.array([c for _, c in words])) for words in dealt.values()]
            lists = [zstandard.compress("\n".join([w for w, _ in words]).encode(), 9) for words in dealt.values()]
            yield batch([block] * k, list(dealt), pa.nulls(k, pa.list_(kind)), codes, lists, kind)


def batch(block, bucket, ids, codes, words, kind):
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(bucket, pa.int32()), ids, pa.array(codes, pa.binary()), pa.array(words, pa.binary())], ["block", "bucket", "ids", "codes", "words"])


def coded(docs: DataFrame, id_col: str, text_col: str, buckets: int, block_chars: int) -> DataFrame:
    """(block, bucket, ids, codes, words): rows of texts (bucket is null), and one for each block's words of a bucket."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), text_or_empty(text_col).alias("text"))  # a null among numbers would make them floats

    def run(batches):
        now, nth, task = Block(), 0, TaskContext.get().partitionId() << 32
        kind = None
        for b in batches:
            kind = b.schema.field(0).type
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py()
                if now.ids and now.chars + len(text) > block_chars:
                    yield from now.batches(task + nth, buckets, kind)
                    now, nth = Block(), nth + 1
                now.add(key, text)
        if now.ids:
            yield from now.batches(task + nth, buckets, kind)

    return rows.mapInArrow(run, f"block bigint, bucket int, ids array<{rows.schema['id'].dataType.simpleString()}>, codes binary, words binary")


def encoded_words(words: DataFrame, tokenizer: str, buckets: int) -> DataFrame:
    """(block, codes, lengths, ids) of (bucket, block, codes, words): each distinct word of a bucket is encoded once."""

    def run(frame):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(tokenizer)
        whole.no_truncation()
        whole.no_padding()
        lists = [zstandard.decompress(w).decode().split("\n") for w in frame["words"]]
        distinct = list(dict.fromkeys(w for words in lists for w in words))
        ids: dict[str, bytes] = {}
        for at in range(0, len(distinct), 4096):
            part = distinct[at : at + 4096]
            found = whole.encode_batch_fast(part, add_special_tokens=False)
            ids.update(zip(part, (array.array("H", e.ids).tobytes() for e in found), strict=True))
        out = []
        for block, codes, words in zip(frame["block"], frame["codes"], lists, strict=True):
            got = [ids[w] for w in words]
            out.append((block, codes, packed(np.array([len(g) for g in got])), zstandard.compress(b"".join(got), 9)))
        return pd.DataFrame(out, columns=["block", "codes", "lengths", "ids"])

    return words.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(run, "block bigint, codes binary, lengths binary, ids binary")


def vocabulary(tokenizer: str) -> list[str]:
    """Pieces by id, added tokens included; a few MB at most, whatever the corpus."""
    with open(tokenizer, encoding="utf-8") as f:
        told = json.load(f)
    if told["decoder"] is not None or len(told["model"]["vocab"]) > 1 << 16:
        raise ValueError("pieces are joined as they are: the tokenizer must have no decoder, and ids of 16 bits")
    pieces = told["model"]["vocab"] | {t["content"]: t["id"] for t in told["added_tokens"]}
    out = [""] * (max(pieces.values()) + 1)
    for piece, i in pieces.items():
        out[i] = piece
    return out


def placed(texts):
    """(id, word codes by position) of every text in the rows of a block."""
    for ids, codes, sizes in zip(texts["ids"], texts["codes"], texts["sizes"], strict=True):
        yield from zip(ids.tolist(), np.split(unpacked(codes), np.cumsum(unpacked(sizes))[:-1]), strict=True)


#: What encode() returns beside the id.
WANT = {
    "texts": "ids array<int>, decoded string",
    "ids": "n_tokens bigint, ids array<int>",
    "digests": "n_tokens bigint, ids_sha256 string, decoded_sha256 string",
}


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", want: str = "texts", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The id and WANT[want] of every whole text: ids and their decoded text, ids alone, or digests of both.

    Null and empty texts have no ids and decode to ''.  Rows that repeat give rows that repeat; a null id stays null.
    An empty table gives an empty one.  Other columns are not read.  Larger blocks
    (block_chars) share more words and take more memory of a task.
    """
    # As many buckets of words, and as many tasks that join blocks, as the input has partitions: both grow with it, so
    # that what a task holds does not.
    buckets = max(16, docs.rdd.getNumPartitions())
    both = stored(coded(docs, id_col, text_col, buckets, block_chars), "coded")
    joins = BLOCK_TASKS * buckets
    words = encoded_words(both.where("bucket is not null").select("bucket", "block", "codes", "words"), tokenizer, buckets).repartition(joins, "block")
    texts = both.where("bucket is null").select("block", "ids", "codes", F.col("words").alias("sizes")).repartition(joins, "block")
    pieces = vocabulary(tokenizer)
    kind = docs.schema[id_col].dataType

    def run(texts, words):
        lists = [(unpacked(c), unpacked(n), zstandard.decompress(i)) for c, n, i in zip(words["codes"], words["lengths"], words["ids"], strict=True)]
        total = sum(len(c) for c, _, _ in lists)
        # By word code: where its ids begin and how many they are; its ids in decimals; its decoded pieces.
        flat = np.frombuffer(b"".join(i for _, _, i in lists), np.uint16)
        codes = np.concatenate([c for c, _, _ in lists]) if lists else np.zeros(0, np.uint32)
        sizes = (np.concatenate([n for _, n, _ in lists]) if lists else np.zeros(0, np.uint32)).astype(np.int64) // 2
        ends = np.cumsum(sizes)
        starts, counts = np.zeros(total, np.int64), np.zeros(total, np.int64)
        starts[codes], counts[codes] = ends - sizes, sizes
        numbers, decoded = [b""] * total, [b""] * total
        if want != "ids":
            decimal = [str(i) for i in range(len(pieces))]
            for code, begin, end in zip(codes.tolist(), (ends - sizes).tolist(), ends.tolist(), strict=True):
                own = flat[begin:end].tolist()
                if want == "digests":
                    numbers[code] = " ".join([decimal[i] for i in own]).encode()
                decoded[code] = " ".join([pieces[i] for i in own]).encode()
        out = []
        for key, codes in placed(texts):
            each, n = codes.tolist(), int(counts[codes].sum())
            if want != "digests":
                reps = counts[codes]
                ids = flat[np.repeat(starts[codes] - (np.cumsum(reps) - reps), reps) + np.arange(n)].astype(np.int32)
            if want == "ids":
                out.append((key, n, ids))
                continue
            text = b" ".join(filter(None, map(decoded.__getitem__, each)))
            if want == "texts":
                out.append((key, ids, text.decode()))
            else:
                told = b" ".join(filter(None, map(numbers.__getitem__, each)))
                out.append((key, n, hashlib.sha256(told).hexdigest(), hashlib.sha256(text).hexdigest()))
        return pd.DataFrame(out, columns=columns)

    columns = ["id", *(c.split(" ")[0] for c in WANT[want].split(", "))]
    out = texts.groupBy("block").cogroup(words.groupBy("block")).applyInPandas(run, f"id string, {WANT[want]}")
    return out.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded): the pieces of an id array joined by spaces, by a lookup join with the vocabulary; null ids are ''."""
    spark = tokens.sparkSession
    pieces = F.broadcast(spark.createDataFrame([(vocabulary(tokenizer),)], "pieces array<string>"))
    joined = tokens.select(F.col(id_col), F.coalesce(F.col(ids_col), F.array()).alias("ids")).join(pieces, F.lit(True))
    return joined.select(id_col, F.array_join(F.transform("ids", lambda i: F.get("pieces", i)), " ").alias("decoded"))


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), want="digests")


QUERIES = {"op6_bpe": op6_bpe}
ORACLE_SQL: dict[str, str] = {}
