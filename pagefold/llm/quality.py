"""Text quality by random-indexing word vectors, pooled per document, and a two-layer network with calibrated probabilities.

Every token has a sparse random index vector.  A token's word vector is the sum of the index vectors of its neighbours
over all texts, so tokens that are used alike have vectors alike.  Tokens are dealt to a fixed number of slots by their
hash, so that the vectors are a table of fixed size at every size of the corpus: tasks sum what their texts add, Spark
sums the tasks.  A document is the mean of its tokens' vectors, made of equal length.

A two-layer network is fitted to the pooled vectors of a bounded number of labelled rows, in numpy on the driver; a part
of these rows is kept from it, to fit the temperature by which its probabilities are calibrated.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefold.llm.common import pieces, table, text_or_empty
from pagefold.llm.wordhash import BYTE_VALUE, Powers, buffer_of, mix

#: Slots of tokens, length of vectors, non-zero places of an index vector, neighbours on either side.
SLOTS, SIZE, PLACES, WINDOW = 1 << 13, 64, 4, 2
#: At most so many labelled rows are read for the fit, those of the smallest crc32 (documented bound).
MAX_FIT_ROWS = 12_000
#: Hidden units, rounds of gradient descent, ridge; one in so many rows is kept for calibration.
HIDDEN, ROUNDS, RIDGE, KEPT_BACK = 24, 400, 1e-4, 5

#: Bytes of the texts that are pooled at once.
POOLED = 1 << 18

#: White space, characters of words, marks.
KINDS = np.array([0 if b == 0x20 or 0x09 <= b <= 0x0D else 1 if b >= 0x80 or chr(b).isalnum() else 2 for b in range(256)], np.int8)
UPPER, LOWER = (np.array([low <= b <= low + 25 for b in range(256)]) for low in (0x41, 0x61))
#: The tokens that stand behind a word of two or more capital letters, without small ones, and behind a repeated token.
SHOUT, AGAIN = (mix(np.array([1, 2], np.uint64)) % np.uint64(SLOTS)).astype(np.int32).tolist()


def slots(texts: pa.Array, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(slot of every token, first token of each text (n + 1)): stretches of word characters, and of marks.

    A-Z count as a-z; a word of capitals alone has the token SHOUT behind it, one that repeats the last one AGAIN.
    """
    raw, offsets = buffer_of(texts)
    kind = KINDS[raw]
    changes = np.ones(len(raw) + 1, bool)
    changes[1:-1] = kind[1:] != kind[:-1]
    changes[offsets] = True
    edges = np.flatnonzero(changes)
    start, end = edges[:-1], edges[1:]
    start, end = start[kind[start] > 0], end[kind[start] > 0]
    up, down = powers.get(len(raw) + 1)
    low = np.where(UPPER[raw], raw | 0x20, raw)
    total = np.r_[np.uint64(0), np.cumsum(BYTE_VALUE[low] * up[: len(raw)])]
    token = (mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)) % np.uint64(SLOTS)).astype(np.int32)
    capitals, small = (np.r_[0, np.cumsum(s[raw])] for s in (UPPER, LOWER))
    shouts = np.flatnonzero((capitals[end] - capitals[start] > 1) & (small[end] == small[start]))
    first = np.searchsorted(start, offsets)
    repeats = np.r_[False, token[1:] == token[:-1]]
    repeats[first[first < len(token)]] = False
    repeats = np.flatnonzero(repeats)
    marks = np.r_[np.full(len(shouts), SHOUT), np.full(len(repeats), AGAIN)]
    return np.insert(token, np.r_[shouts, repeats] + 1, marks), first + np.searchsorted(shouts, first) + np.searchsorted(repeats, first)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of each slot's index vector, from the hash of the slot's number."""
    drawn = mix(mix(np.arange(1, SLOTS * PLACES + 1, dtype=np.uint64)))
    return (drawn % np.uint64(SIZE)).astype(np.int64).reshape(SLOTS, PLACES), (1 - 2 * (drawn >> np.uint64(63)).astype(np.int8)).reshape(SLOTS, PLACES)


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """SLOTS x SIZE sums of neighbours' index vectors over all whole texts; neighbours are of the same text.

    The driver gets one row for each place of this table that is not 0, whatever the corpus.
    """

    def run(batches):
        powers, (places, signs) = Powers(), index_vectors()
        sums = np.zeros(SLOTS * SIZE)
        for b in (p for batch in batches for p in pieces(batch, 0)):
            token, first = slots(b.column(0), powers)
            text = np.repeat(np.arange(len(first) - 1), np.diff(first))
            for far in range(1, WINDOW + 1):
                same = text[far:] == text[:-far]
                left, right = token[:-far][same], token[far:][same]
                for one, other in ((left, right), (right, left)):
                    for j in range(PLACES):
                        sums += np.bincount(one * SIZE + places[other, j], signs[other, j], SLOTS * SIZE)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at].astype(np.int64))], ["place", "n"])

    told = docs.select(text_or_empty(text_col).alias("text")).mapInArrow(run, "place int, n bigint").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS * SIZE)
    out[told.column(0).to_numpy()] = told.column(1).to_numpy()
    return out.reshape(SLOTS, SIZE)


def levelled(vectors: np.ndarray) -> np.ndarray:
    """Word vectors of length 1, without what all tokens have in common; a slot without neighbours stays 0."""
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    out = np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)
    seen = length[:, 0] > 0
    if seen.any():
        out[seen] -= out[seen].mean(axis=0)
    return out


def pooled(texts: pa.Array, vectors: np.ndarray, powers: Powers) -> np.ndarray:
    """The mean of each text's token vectors; 0 where it has none.  Long texts count their tokens by slot instead."""
    token, first = slots(texts, powers)
    total, n = np.zeros((len(texts), vectors.shape[1])), np.diff(first)
    long = n > SLOTS
    for i in np.flatnonzero(long).tolist():
        total[i] = np.bincount(token[first[i] : first[i + 1]], minlength=SLOTS) @ vectors
    some = (n > 0) & ~long
    if some.any():
        sizes = n[some]
        total[some] = np.add.reduceat(vectors[token[np.repeat(~long, n)]], np.cumsum(sizes) - sizes, axis=0)
    return total / np.maximum(n, 1)[:, None]


@dataclass
class Network:
    """Two layers, tanh between them, on standardised inputs; probabilities are of the output by the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    bias: np.ndarray
    second: np.ndarray
    last: float
    temperature: float = 1.0

    def output(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.first + self.bias) @ self.second + self.last

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.output(x) / self.temperature)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def constant(size: int, share: float) -> Network:
    """A network that gives every text the same probability."""
    return Network(np.zeros(size), np.ones(size), np.zeros((size, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))


def trained(x: np.ndarray, y: np.ndarray, seed: int = 1) -> Network:
    """Adam over all rows at once, from a fixed seed."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = (x - mean) / scale
    params = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, ROUNDS + 1):
        first, bias, second, last = params
        hidden = np.tanh(z @ first + bias)
        off = (sigmoid(hidden @ second + last) - y) / len(y)
        back = np.outer(off, second) * (1 - hidden**2)
        grads = [z.T @ back + RIDGE * first, back.sum(axis=0), hidden.T @ off + RIDGE * second, off.sum(keepdims=True)]
        for i, g in enumerate(grads):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            params[i] = params[i] - 0.01 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Network(mean, scale, *params[:3], float(params[3][0]))


def calibrated(network: Network, x: np.ndarray, y: np.ndarray) -> Network:
    """The network with the temperature of the least log loss over rows that it was not trained on.

    Rows of either class count as Platt's targets do, not as 0 and 1, so that rows told apart without an error leave
    the temperature finite.
    """
    out, ones = network.output(x), y.sum()
    aims = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))

    def loss(t):
        p = np.clip(sigmoid(out / t), 1e-12, 1 - 1e-12)
        return -np.mean(aims * np.log(p) + (1 - aims) * np.log(1 - p))

    network.temperature = float(min(np.exp(np.linspace(np.log(0.25), np.log(16), 161)), key=loss)) if len(y) else 1.0
    return network


def crc(column: str):
    return F.crc32(F.col(column).cast("string").cast("binary"))


def learned(name: str):
    """Whether a row's label may be read: crc32(id as text) mod 3 is not 1."""
    return F.col(name).isNotNull() & (crc(name) % 3 != 1)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_FIT_ROWS):
    """(word vectors, network) of docs and labels (id, label 0 or 1).

    The vectors are of all texts.  The network is of the labelled rows that may be read (learned()): at most max_rows
    of the smallest crc32 of their ids.  A null id or label is left out; labels that repeat for an id count once, the
    highest; texts that repeat for an id are rows of their own.  Without rows of both labels every text gets the
    labels' share, (ones + 1) / (rows + 2), as its probability.
    """
    vectors = levelled(word_vectors(docs, text_col))
    marked = labels.where(learned(id_col) & F.col(label_col).isNotNull())
    marked = marked.groupBy(F.col(id_col).alias("fit_id")).agg(F.max(F.col(label_col).cast("int")).alias("y")).orderBy(crc("fit_id"), "fit_id").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("fit_id"), text_or_empty(text_col).alias("text")).join(F.broadcast(marked), "fit_id")
    rows = rows.select(crc("fit_id").alias("at"), F.xxhash64("text").alias("h"), (F.col("y") > 0).cast("int").alias("y"), "text")

    def run(batches):
        powers = Powers()
        for b in (p for batch in batches for p in pieces(batch, 3, POOLED)):
            x = pooled(b.column(3), vectors, powers)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.FixedSizeListArray.from_arrays(x.ravel(), SIZE).cast(pa.list_(pa.float64()))], ["at", "h", "y", "x"])

    told = rows.mapInArrow(run, "at bigint, h bigint, y int, x array<double>").orderBy("at", "h", "y").limit(max_rows).toArrow()
    y = told.column("y").to_numpy().astype(float)
    if len(set(y.tolist())) < 2:
        return vectors, constant(SIZE, (y.sum() + 1) / (len(y) + 2))
    x, back = np.array(told.column("x").to_pylist()), told.column("at").to_numpy() // 3 % KEPT_BACK == 0
    if len(set(y[~back].tolist())) < 2:
        return vectors, trained(x, y)
    return vectors, calibrated(trained(x[~back], y[~back]), x[back], y[back])


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every whole text, one row for each input row; only the text is scored.

    score: the probability of label 1; predicted: 1 from 0.5 on.  A null or empty text is scored as one without tokens.
    Rows that repeat give rows that repeat, a null id stays null, an empty table gives an empty one.
    """
    vectors, network = model
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))

    def run(batches):
        powers = Powers()
        for b in (p for batch in batches for p in pieces(batch, 1, POOLED)):
            p = network.probability(pooled(b.column(1), vectors, powers))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["id", "score", "predicted"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double, predicted int").withColumnRenamed("id", id_col)


def op12_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(crc("doc_id") % 3 == 1, F.lit(False)).alias("held_out"), "score", "predicted")


QUERIES = {"op12_quality": op12_quality}
ORACLE_SQL: dict[str, str] = {}
