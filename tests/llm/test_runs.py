"""Periodic runs against a brute force over all starts and periods."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagefold.llm import runs

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, runs int, n_words string"


def brute(words, least=24, exponent=3):
    known, out = {}, []
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    for q in range(1, len(ids) // exponent + 1):
        same = np.r_[False, ids[q:] == ids[:-q], False]
        edges = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
        for a, b in edges[edges[:, 1] + q - edges[:, 0] >= max(least, exponent * q)].tolist():
            whole = ids[a : b + q]
            if not any((whole[r:] == whole[:-r]).all() for r in range(1, q)):
                out.append((a, b + q - a, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def made(rnd):
    n, k = rnd.randint(0, 160), rnd.choice([1, 2, 3, 6, 40])
    words = [rnd.randrange(k) for _ in range(n)]
    for _ in range(rnd.randint(0, 3) if n else 0):
        a, p = rnd.randrange(n), rnd.randint(1, 20)
        for i in range(a + p, min(n, a + rnd.randint(1, 80))):
            words[i] = words[i - p]
    return words


@pytest.mark.parametrize(("least", "exponent"), [(24, 3), (8, 2), (6, 3), (30, 4)])
def test_equal_brute_force(least, exponent):
    rnd, some = random.Random(least), 0
    for _ in range(400):
        words = made(rnd)
        found = [tuple(r) for r in runs.find_runs(words, least, exponent).tolist()]
        assert found == brute(words, least, exponent)
        some += len(found)
    assert some > 100


def test_least_overlap_and_what_survives():
    assert runs.least_overlap(24, 3) == 16 and runs.least_overlap(8, 2) == 4
    rnd = random.Random(5)
    words = np.array([rnd.randrange(10**6) for _ in range(5000)])
    assert runs.segments(words, 16, 24) == []
    words[1000:1016] = words[3000:3016]
    assert runs.segments(words, 16, 24) == [] and runs.repeated(words, 16).tolist() == [1000, 3000]
    words[2000:2030] = words[1990:2000].tolist() * 3
    assert runs.segments(words, 16, 24) == [(1990, 2030)]


def test_long_texts():
    assert runs.find_runs(["a"] * 100_000).tolist() == [[0, 100_000, 1]]
    rnd = random.Random(3)
    part = [rnd.randrange(900) for _ in range(20_000)]
    assert runs.find_runs([-1, *part * 3, part[0], -2]).tolist() == [[1, 60_001, 20_000]]


def test_edges(spark):
    long = "x y " * 50_000
    data = [(1, None), (2, ""), (3, " \t\r\n\v\f "), (4, long), (4, long), (None, "a " * 24), (5, "a " * 23), (6, "a b " * 24), (7, "é\nè\t" * 15)]
    docs = spark.createDataFrame([(i, t, 0, "n") for i, t in data], KIND)
    rows = runs.periodic_runs(docs).collect()
    told = sorted(((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in rows), key=str)
    assert told == sorted([
        (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 100_000, [(0, 100_000, 2)], "x y"), (4, 100_000, [(0, 100_000, 2)], "x y"), (0, 24, [(0, 24, 1)], "a"),
        (5, 23, [], " ".join("a" * 23)), (6, 24, [(0, 24, 1)], "a b"), (7, 30, [(0, 30, 2)], "é è"),
    ], key=str)
    assert runs.periodic_runs(docs.limit(0)).collect() == []
    assert sorted(t for t, in runs.replanted(docs.where("doc_id is null")).select("text").collect()) == ["a " * 24]


def test_overlapping_runs_drop_what_any_has_behind_its_first_period(spark):
    words = ["a", "b"] * 15 + ["a"] * 30
    row = runs.periodic_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id int, text string")).first()
    assert [tuple(r) for r in row.runs] == [(0, 31, 2), (30, 30, 1)] and row.collapsed == "a b"


def test_query_equals_brute_force(spark):
    rows = {r.doc_id: r for r in runs.op11_periodic_runs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert len(rows) == len(docs)
    planted = 0
    for doc_id, text in docs:
        words = [w.decode() for w in text.encode().split()]
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        found = brute(words)
        planted += bool(found)
        drop = {i for s, m, q in found for i in range(s + q, s + m)}
        best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        row = rows[doc_id]
        assert row.n_runs == len(found) and row.runs_sha256 == sha("".join(f"{s},{m},{q}\n" for s, m, q in found))
        assert row.collapsed_sha256 == sha(" ".join(w for i, w in enumerate(words) if i not in drop))
        assert (row.start, row.length, row.period) == (best or (None,) * 3) and row.exponent_milli == (best and 1000 * best[1] // best[2])
    assert planted > 5
