"""Source divergence against its SQL and a brute force."""

import random
from collections import Counter

import duckdb
import pytest

from pagefold.llm import divergence

KIND = "doc_id long, lang string, source string, text string, n int, docs int, term string, value string, rank int, part string"
SOURCES = ["a", "b", "ä", "B", None]


def made(seed=1, n=400):
    rnd = random.Random(seed)
    words = ["The", "the", "WORD", "été", "Été", "naïve", "x", "y-z", "a1b", "日本", "\x7f|{", "q\x00r"] + [f"w{chr(97 + i)}" for i in range(26)]
    rows = []
    for i in range(n):
        text = rnd.choice([None, "", " ".join(rnd.choices(words[rnd.randint(0, 9) :], k=rnd.randint(1, 30)))])
        rows.append((i // 2, rnd.choice(["en", "en", "fr", None]), rnd.choice(SOURCES), text, 1, 1, "t", "v", 1, "p"))
    rows.append((-1, "lone", "s", "alone", 1, 1, "t", "v", 1, "p"))
    rows += [(-2, "void", s, None, 1, 1, "t", "v", 1, "p") for s in "st"]
    return rows


def terms_of(text):
    out, now = [], ""
    for c in (text or "") + " ":
        if "A" <= c <= "Z" or "a" <= c <= "z" or ord(c) >= 128:
            now += c.lower() if c.isascii() else c
        elif now:
            out.append(now)
            now = ""
    return out


def brute(rows, least, prior, top):
    count, docs, groups = {}, {}, set()
    for _, lang, source, text, *_ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        count.setdefault((lang, source), Counter()).update(terms_of(text))
        docs.setdefault(lang, Counter()).update(set(terms_of(text)))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        mine = sorted(s for g, s in groups if g == lang)
        share = lambda c: {t: 1 + 10**9 * (c[t] + prior) // (sum(c[k] for k in kept) + prior * len(kept)) for t in kept}
        p, q = {s: share(count[lang, s]) for s in mine}, share(sum((count[lang, s] for s in mine), Counter()))
        for s in mine:
            found = {"pair": [(-sum(abs(p[s][t] - p[u][t]) for t in kept), u) for u in mine if u != s], "term": [(q[t] - p[s][t], t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]}
            for part, values in found.items():
                ranked = sorted(values, key=lambda v: (v[0], v[1].encode()))
                out += [(lang, s, part, item, -v, i + 1) for i, (v, item) in enumerate(ranked) if part == "pair" or i < top]
    return sorted(out)


@pytest.mark.parametrize(("seed", "cells", "held"), [(1, 500_000, 400_000), (2, 20, 5), (3, 60, 400_000)])
def test_equal_brute_force_in_one_and_many_shards(spark, monkeypatch, seed, cells, held):
    monkeypatch.setattr(divergence, "SHARD_CELLS", cells)
    monkeypatch.setattr(divergence, "HELD_TERMS", held)
    monkeypatch.setattr(divergence, "HELD_ROWS", 4 if held == 5 else 10**6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7 if held == 5 else 10_000)
    rows = made(seed)
    found = divergence.divergence(spark.createDataFrame(rows, KIND).repartition(5), least_docs=9, top_terms=6).collect()
    assert sorted(tuple(r) for r in found) == brute(rows, 9, 5, 6)
    assert {r.lang for r in found} >= {"", "en", "fr", "void"} and "lone" not in {r.lang for r in found if r.part == "pair"}


def test_sql_equals_brute_force(spark):
    rows = [r for r in made(4, 900)]
    with duckdb.connect() as db:
        db.execute("CREATE TABLE documents (doc_id BIGINT, lang VARCHAR, source VARCHAR, text VARCHAR)")
        db.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", [r[:4] for r in rows])
        found = db.execute(divergence.SQL).fetchall()
    assert sorted(found) == brute(rows, 30, 5, 50)


def test_edges(spark):
    none = spark.createDataFrame([], KIND)
    assert divergence.divergence(none).collect() == []
    long = spark.createDataFrame([(1, "en", "a", "word " * 200_000, 1, 1, "", "", 1, ""), (2, "en", "b", "other", 1, 1, "", "", 1, "")], KIND)
    assert [tuple(r) for r in divergence.divergence(long, least_docs=1).where("part = 'term'").collect()] == [
        ("en", "a", "term", "word", divergence_of(200_000, 0, 200_000, 200_001, 2), 1), ("en", "b", "term", "other", divergence_of(1, 0, 1, 200_001, 2, 1), 1),
    ]
    assert sorted((r.source, r.item, r.value) for r in divergence.divergence(long).collect()) == [("a", "b", 0), ("b", "a", 0)]


def divergence_of(n, rest, total, lang_total, terms, lang_n=None):
    share = lambda c, t: 1 + 10**9 * (c + 5) // (t + 5 * terms)
    return share(n, total) - share(n if lang_n is None else lang_n, lang_total)


def test_arithmetic_is_exact_beyond_64_bits(spark):
    with divergence.connect() as db:
        db.execute("CREATE TABLE kept AS SELECT 'l' AS lang, NULL::VARCHAR AS source, 't' AS term, 4000000000000000001::BIGINT AS n")
        db.execute("CREATE TABLE groups AS SELECT 'l' AS lang, NULL::VARCHAR AS source, 4000000000000000007::BIGINT AS total, 1::BIGINT AS terms")
        db.execute(divergence.SHARES_SQL.format(scale=10**9, prior=5))
        assert db.execute("SELECT p FROM shares").fetchall()[0][0] == 1 + 10**9 * 4000000000000000006 // 4000000000000000012
