"""Periodic runs of words: repeated k-gram masking, then Main and Lorentz's divide and conquer on what survives.

A run of period q has at least max(least, exponent * q) words, so it overlaps itself, moved by q, in at least
k = min over q of max(least, exponent * q) - q words.  Every word of it thus lies in a k-gram that its document repeats;
words outside such k-grams cannot join runs.  In most texts nothing survives.  Each surviving segment is split at its
middle, again and again; every period is tried at once against the middle, both ways, by comparing names of its
2^j-grams, which are exact (equal names are equal words).

A document is one row, so nothing is shuffled, and a task holds one document's names at a time.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefold.llm.common import pieces, table, text_or_empty

#: Least words of a run, and least number of its periods.
LEAST, EXPONENT = 24, 3


def least_overlap(least: int, exponent: int) -> int:
    """The fewest words in which any run overlaps itself, moved by its period."""
    return min(max(least, exponent * q) - q for q in range(1, least // exponent + 2))


def paired(a: np.ndarray, b: np.ndarray):
    """(names, how often each row's pair occurs) of pairs of names."""
    _, name, often = np.unique(a.astype(np.int64) * (int(b.max(initial=0)) + 1) + b, return_inverse=True, return_counts=True)
    return name.astype(np.int32), often[name]


def repeated(words: np.ndarray, k: int) -> np.ndarray:
    """Where the k-grams begin that occur more than once; words are numbers.

    k-grams are named from the names of their halves, and only halves that are repeated themselves go on.
    """
    names, at, size = words.astype(np.int32), np.arange(len(words)), 1
    while size < k and len(at):
        step = min(size, k - size)
        at = at[at + step + size <= len(words)]
        at = at[names[at + step] >= 0]
        name, often = paired(names[at], names[at + step])
        names = np.full(len(words), -1, np.int32)
        at = at[often > 1]
        names[at] = name[often > 1]
        size += step
    return at


def segments(words: np.ndarray, k: int, least: int) -> list[tuple[int, int]]:
    """Stretches of at least `least` words that repeated k-grams cover."""
    if len(words) < least or not len(at := repeated(words, k)):
        return []
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, at, 1)
    np.add.at(depth, at + k, -1)
    covered = np.r_[False, np.cumsum(depth[:-1]) > 0, False]
    edges = np.flatnonzero(covered[1:] != covered[:-1])
    return [(a, b) for a, b in edges.reshape(-1, 2).tolist() if b - a >= least]


class Names:
    """Exact names of all 2^j-grams of a segment, and how far two places agree, forwards and backwards."""

    def __init__(self, words: np.ndarray):
        self.n = n = len(words)
        self.levels = [paired(words, np.zeros_like(words))[0]]
        while (size := 1 << len(self.levels)) <= n:
            last = self.levels[-1]
            self.levels.append(paired(last[: n - size + 1], last[size // 2 : n - size // 2 + 1])[0])

    def agree(self, j: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the 2^j-grams at a and at b, a < b, are within the segment and equal."""
        last = len(self.levels[j]) - 1
        inside = (a >= 0) & (b <= last)
        return inside & (self.levels[j][np.clip(a, 0, last)] == self.levels[j][np.clip(b, 0, last)])

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        far = np.zeros(len(a), np.int64)
        for j in range(len(self.levels) - 1, -1, -1):
            far += self.agree(j, a + far, b + far).astype(np.int64) << j
        return far

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        far = np.zeros(len(a), np.int64)
        for j in range(len(self.levels) - 1, -1, -1):
            far += self.agree(j, a - far - (1 << j), b - far - (1 << j)).astype(np.int64) << j
        return far


def crossing(words: np.ndarray, least: int, exponent: int) -> np.ndarray:
    """(start, end, period) of all runs of a segment, by Main and Lorentz; periods are the smallest ones.

    A run lies in halves until it crosses one's middle m.  There it has m and m + p, or m - p and m, among its words
    that agree at distance p, so that both ways of extending either pair give its whole extent.
    """
    names, found = Names(words), [np.zeros((0, 3), np.int64)]
    # Agreement of at least k words reaches half of them on one side of the pair.
    j = ((least_overlap(least, exponent) + 1) // 2).bit_length() - 1
    low, high = np.array([0]), np.array([len(words)])
    while len(low):
        middle, tries = (low + high) // 2, (high - low) // exponent
        p = np.arange(tries.sum()) - np.repeat(np.cumsum(tries) - tries, tries) + 1
        m = np.repeat(middle, tries)
        a, p = np.r_[m, m - p], np.r_[p, p]
        maybe = names.agree(j, a, a + p) | names.agree(j, a - (1 << j), a + p - (1 << j))
        a, p = a[maybe], p[maybe]
        start, end = a - names.backward(a, a + p), a + p + names.forward(a, a + p)
        long = end - start >= np.maximum(least, exponent * p)
        found.append(np.c_[start, end, p][long])
        low, high = np.r_[low, middle], np.r_[middle, high]
        whole = high - low >= least
        low, high = low[whole], high[whole]
    every = np.concatenate(found)
    every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
    # A multiple of the smallest period has the same extent, and comes behind it.
    return every[np.r_[True, (every[1:, :2] != every[:-1, :2]).any(axis=1)][: len(every)]]


def find_runs(words: list, least: int = LEAST, exponent: int = EXPONENT) -> np.ndarray:
    """(start, length, period) of every run of a list of words, by start, then period."""
    if len(words) < least:
        return np.zeros((0, 3), np.int64)
    known: dict = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int32)
    found = [crossing(ids[a:b], least, exponent) + [a, a, 0] for a, b in segments(ids, least_overlap(least, exponent), least)]
    every = np.concatenate([np.zeros((0, 3), np.int64), *found])
    every = every[np.lexsort((every[:, 2], every[:, 0]))]
    return np.c_[every[:, 0], every[:, 1] - every[:, 0], every[:, 2]]


def kept_words(words: list, runs: np.ndarray) -> list:
    """The words that no run has behind its first period."""
    if not len(runs):
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """(id, n_words, runs, collapsed) of every whole text, one row for each input row.

    Words are separated by ASCII white space.  runs: (start, length, period) in words, by start, then period, of every
    longest stretch of at least `least` words and `exponent` (2 or more) times its smallest period; runs may overlap.
    collapsed: the words that no run has behind its first period, joined by one space.

    A null or empty text, or one of white space, has no words, no runs and ''.  Rows that repeat give rows that repeat,
    a null id stays null, an empty table gives an empty one, and other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))

    def run(batches):
        for b in (p for batch in batches for p in pieces(batch, 1)):
            counts, found, texts = [], [], []
            for text in b.column(1).cast(pa.binary()).to_pylist():
                words = text.split()
                runs = find_runs(words, least, exponent)
                counts.append(len(words))
                found.append([{"start": s, "length": n, "period": p} for s, n, p in runs.tolist()])
                texts.append(b" ".join(kept_words(words, runs)))
            told = [pa.array(counts, pa.int64()), pa.array(found, pa.list_(RUN)), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(0), *told], ["id", "n_words", "runs", "collapsed"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {FOUND}").withColumnRenamed("id", id_col)


def replanted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text): where h = crc32(id in decimals) is a multiple of 10, words from h // 10 mod n on repeat a part of themselves.

    Word i >= a becomes word a + (i - a) mod p, with g = h // 10, a = g mod n, p = 1 + (n - a) // (3 + g mod 8).  Such a
    text's words are joined by one space; all others, and those of null ids, stay as they are.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))

    def one(key, text: str) -> str:
        g, rest = divmod(zlib.crc32(str(key).encode()), 10)
        words = [] if key is None or rest else text.encode().split()
        if not words:
            return text
        a = g % len(words)
        p = 1 + (len(words) - a) // (3 + g % 8)
        return b" ".join(words[:a] + [words[a + i % p] for i in range(len(words) - a)]).decode()

    def run(batches):
        for b in batches:
            texts = [one(k, t) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return rows.mapInArrow(run, rows.schema).withColumnsRenamed({"id": id_col, "text": text_col})


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = periodic_runs(replanted(table(spark, sf_dir, "documents")))
    # The first of the greatest exact length / period, as runs come by start, then period.
    best = F.aggregate("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    out = found.withColumn("best", best).withColumn("lines", F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")))
    milli = F.expr("(1000 * best.length) div best.period")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", milli.alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {"op11_periodic_runs": op11_periodic_runs}
ORACLE_SQL: dict[str, str] = {}
