"""Quality: tokens and random indexing against plain Python, the fit on held-out rows, edges."""

import re

import numpy as np
import pyarrow as pa
import pytest

from pagefold.llm import quality
from pagefold.llm.wordhash import Powers

SF = "/root/testdata/sf0.1"
KIND = "doc_id long, text string, score string, predicted long, quality int"


@pytest.fixture(scope="module")
def fitted(spark):
    return quality.fit(*(spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")))


def plain_tokens(text):
    out, last = [], None
    for m in re.finditer(r"(?:[0-9A-Za-z]|[^\x00-\x7f])+|(?:(?![0-9A-Za-z\x20\x09-\x0d])[\x00-\x7f])+", text):
        word = "".join(c.lower() if c.isascii() else c for c in m[0])
        out.append(word)
        if sum("A" <= c <= "Z" for c in m[0]) > 1 and not re.search("[a-z]", m[0]):
            out.append("<SHOUT>")
        if word == last:
            out.append("<AGAIN>")
        last = word
    return out


TEXTS = ["", "One two, TWO two!! THREE", "a a a", "  ", "x|y *** *** ÄÖ Äö ÉÀ1", "!!", "é" * 40, "A", "\x00\x00 q", "And AND and"]


def test_tokens_equal_plain_ones():
    token, first = quality.slots(pa.array(TEXTS), Powers())
    own = {"<SHOUT>": quality.SHOUT, "<AGAIN>": quality.AGAIN}
    for i, text in enumerate(TEXTS):
        got, want = token[first[i] : first[i + 1]].tolist(), plain_tokens(text)
        assert len(got) == len(want)
        for g, w in zip(got, want, strict=True):
            assert own.setdefault(w, g) == g
    assert len(set(own.values())) > len(own) - 2


def test_word_vectors_are_sums_of_neighbours(spark):
    places, signs = quality.index_vectors()
    vector = np.zeros((quality.SLOTS, quality.SIZE))
    for j in range(quality.PLACES):
        np.add.at(vector, (np.arange(quality.SLOTS), places[:, j]), signs[:, j])
    want, powers = np.zeros((quality.SLOTS, quality.SIZE)), Powers()
    for text in TEXTS:
        token = quality.slots(pa.array([text]), powers)[0].tolist()
        for i, t in enumerate(token):
            for j in range(max(0, i - quality.WINDOW), min(len(token), i + quality.WINDOW + 1)):
                if i != j:
                    want[t] += vector[token[j]]
    docs = spark.createDataFrame([(t,) for t in [*TEXTS, None]], "text string")
    assert (quality.word_vectors(docs) == want).all() and (quality.word_vectors(docs.repartition(3)) == want).all()


def test_pooling_of_long_texts_equals_that_of_short_ones(monkeypatch):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(quality.SLOTS, quality.SIZE))
    texts = pa.array([" ".join(f"w{i}" for i in rng.integers(0, 500, n)) for n in (3, 9000, 0, 9000, 40)])
    both = quality.pooled(texts, vectors, Powers())
    for i, t in enumerate(texts):
        token = quality.slots(pa.array([t.as_py()]), Powers())[0]
        assert np.allclose(both[i], vectors[token].mean(axis=0) if len(token) else 0)


def test_temperature():
    x = np.random.default_rng(1).normal(size=(4000, 2))
    y = (np.random.default_rng(2).random(4000) < quality.sigmoid(2 * x[:, 0])).astype(float)
    sure = quality.Network(np.zeros(2), np.ones(2), np.array([[1e-3], [0.0]]), np.zeros(1), np.array([8e3]), 0.0)
    assert 3.2 < quality.calibrated(sure, x, y).temperature < 5
    assert quality.calibrated(sure, x[:0], y[:0]).temperature == 1


def test_held_out_accuracy_and_calibration(spark, fitted):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score(docs, fitted).join(labels.where(quality.crc("doc_id") % 3 == 1), "doc_id").select("score", "predicted", "quality").collect()
    good, bad = [r for r in rows if r.quality], [r for r in rows if not r.quality]
    assert len(bad) > 100 and sum(r.predicted for r in good) / len(good) > 0.99 and sum(1 - r.predicted for r in bad) / len(bad) > 0.97
    assert -np.mean([np.log(r.score if r.quality else 1 - r.score) for r in rows]) < 0.03


def test_edges(spark, fitted):
    docs = spark.createDataFrame([(1, None, "", 0, 0), (2, "", "", 0, 0), (3, "The of and. " * 200_000, "", 0, 0), (3, "STOP!! STOP!! STOP!!", "", 0, 0), (3, "STOP!! STOP!! STOP!!", "", 0, 0), (None, " ", "", 0, 0)], KIND)
    rows = quality.score(docs, fitted).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert len({r.score for r in rows if r.doc_id != 3}) == 1
    assert quality.score(docs.limit(0), fitted).collect() == []


def test_fit_without_rows_of_both_labels(spark):
    docs = spark.createDataFrame([(i, "good words", "", 0, 0) for i in range(20)] + [(None, None, "", 0, 0)], KIND)
    labels = "doc_id long, quality int, toxic int, text string"
    for rows, share in (([], 0.5), ([(i, 1, 0, "") for i in range(20)] * 2, None), ([(None, 0, 0, ""), (3, None, 0, "")], 0.5)):
        model = quality.fit(docs, spark.createDataFrame(rows, labels))
        got = {round(r.score, 6) for r in quality.score(docs, model).collect()}
        assert len(got) == 1 and (share is None and min(got) > 0.5 or got == {share})
    assert quality.fit(docs.limit(0), spark.createDataFrame([], labels))[0].any() == False  # noqa: E712
