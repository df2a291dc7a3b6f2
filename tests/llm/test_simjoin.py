import random
import time
import re
from collections import Counter

import numpy as np

from pagefold.llm import common, simjoin
from pagefold.llm.components import components
from pagefold.llm.tsearch import block_links, divide_skip

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs):
    sets = []
    for _, text in docs:
        w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    least = {}
    for i, (key, _) in enumerate(docs):
        if key is not None:
            least[root(i)] = min(least.get(root(i), key), key)
    return Counter((key, len(sets[i]), least.get(root(i), key) if sets[i] else key) for i, (key, _) in enumerate(docs))


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(30)]
    bases = [[rng.choice(words) for _ in range(rng.choice([3, 4, 30, 80, 200]))] for _ in range(12)]
    docs = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
            w[rng.randrange(len(w))] = rng.choice(words)
        if rng.random() < 0.3:
            w[len(w) // 2 : len(w) // 2] = passage
        docs.append((i * 3 % n, rng.choice([" ", "\n", " \t"]).join(w).upper() if i % 5 == 0 else " ".join(w)))
    return docs


def test_equal_brute_force_with_small_and_large_blocks(spark):
    for seed, tokens in ((1, 1_500_000), (2, 400)):
        docs = corpus(seed)
        docs += [(-5, None), (-4, ""), (-3, " \n "), (-2, "one"), (-1, "One"), (None, docs[0][1]), (7, docs[3][1]), (7, docs[3][1])]
        frame = spark.createDataFrame([(*d, "c", 1) for d in docs], "doc_id long, text string, size string, node int")
        got = Counter(tuple(r) for r in simjoin.classes(frame, block_tokens=tokens).collect())
        assert got == brute(docs)


def test_one_very_long_text_and_empty_table(spark):
    text = " ".join(f"t{i}" for i in range(60_000))
    frame = spark.createDataFrame([(1, text), (2, text + " end"), (3, "x")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simjoin.classes(frame).collect()} == {1: 1, 2: 1, 3: 3}
    assert simjoin.classes(frame.limit(0)).collect() == []


def test_keep_first(spark):
    frame = spark.createDataFrame([(4, "a b c d e f", "x"), (2, "a b c d e f", "y"), (3, "", "z"), (5, None, "n")], "doc_id long, text string, tag string")
    assert sorted((r.doc_id, r.tag) for r in simjoin.keep_first(frame).collect()) == [(2, "y"), (3, "z"), (5, "n")]


def test_keep_first_groups_rows_and_not_ids(spark):
    kind = "doc_id long, text string, group_id string, of int"
    rows = [
        (1, "a b c d e f", "x", 0), (1, "q r s t u v", "y", 0), (1, "a b c d e f", "x", 0), (2, "Q r s t u v", "z", 0), (None, "a b c d e f", "n", 0),
        (None, "only here at all", "m", 0), (7, "", "e", 0), (7, "", "e", 0), (8, None, "f", 0),
    ]
    got = Counter(tuple(r)[:3] for r in simjoin.keep_first(spark.createDataFrame(rows, kind)).collect())
    assert got == Counter([(1, "a b c d e f", "x"), (1, "q r s t u v", "y"), (None, "only here at all", "m"), (7, "", "e"), (7, "", "e"), (8, None, "f")])


def test_ids_of_any_type(spark):
    frame = spark.createDataFrame([("b", "one two three four five"), ("a", "one two three four five"), ("9", "x")], "doc_id string, text string")
    assert {r.doc_id: r.component_id for r in simjoin.classes(frame).collect()} == {"a": "a", "b": "a", "9": "9"}


def test_hot_nodes_tokens_and_hubs_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(simjoin, "hot_keys", lambda counts, key="key", n="n": common.hot_keys(counts, key, n, least=2))
    docs = corpus(5, 60) + [(1000 + i, "the same text many times over") for i in range(40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert Counter(tuple(r) for r in simjoin.classes(frame, block_tokens=400).collect()) == brute(docs)
    assert {r.doc_id for r in simjoin.keep_first(frame, n=4, percent=85).collect()} == {c for _, _, c in brute(docs)}


def test_divide_skip_counts_like_a_scan():
    rng = random.Random(4)
    for _ in range(300):
        lists = [np.array(sorted(rng.sample(range(30), rng.randint(1, 30)))) for _ in range(rng.randint(1, 20))]
        needed = rng.randint(1, len(lists))
        counts = Counter(x for a in lists for x in a.tolist())
        assert sorted(divide_skip(lists, needed)) == sorted((k, c) for k, c in counts.items() if c >= needed)


def test_block_links_span_all_links():
    rng = random.Random(9)
    for _ in range(40):
        base = np.array(sorted(rng.sample(range(1000), 60)), np.uint64)
        sets = [np.array(sorted(set(base.tolist()) ^ set(rng.sample(range(1000), rng.randint(0, 8)))), np.uint64) for _ in range(15)]
        up = list(range(15))
        for i, j in block_links(sets, 85):
            inter = len(np.intersect1d(sets[i], sets[j]))
            assert 100 * inter >= 85 * (len(sets[i]) + len(sets[j]) - inter)
            a, b = up[i], up[j]
            up = [min(a, b) if x in (a, b) else x for x in up]
        for i in range(15):
            for j in range(i):
                inter = len(np.intersect1d(sets[i], sets[j]))
                if 100 * inter >= 85 * (len(sets[i]) + len(sets[j]) - inter):
                    assert up[i] == up[j]


def test_components_of_a_chain_and_of_nothing(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 51), (3, 3)], "a long, b long")
    found = {r.node: r.component for r in components(chain).collect()}
    assert found == {i: 0 for i in range(21)} | {50: 50, 51: 50}
    assert components(chain.limit(0)).collect() == []


def test_a_block_of_many_near_sets_is_searched_in_little_time():
    """Sets that are near one another but not near the hub each search the whole block; a heap took 20 s and more here."""
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 1 << 62, 400).astype(np.uint64))
    sets = [np.unique(rng.integers(0, 1 << 62, 400).astype(np.uint64))]
    sets += [np.unique(np.r_[base[rng.permutation(len(base))[:390]], rng.integers(0, 1 << 62, 10).astype(np.uint64)]) for _ in range(1499)]
    began = time.process_time()
    found = block_links(sets, 85)
    assert len(found) == 1498 and all(i for i, _ in found)
    assert time.process_time() - began < 8


def test_a_census_task_gives_few_rows_whatever_it_counts(spark, monkeypatch):
    told = []
    monkeypatch.setattr(simjoin, "stored", lambda df, label: told.append(df) or df)
    texts = [" ".join(f"w{i * 50 + k % 40}" for k in range(90)) for i in range(40)] + ["", None, "three words only"]
    marks = simjoin.census(spark.createDataFrame([(t or "",) for t in texts], "text string").coalesce(1), 4)
    assert len(marks) == simjoin.COUNTERS
    assert told[0].agg({"n": "sum"}).first()[0] == 40 * 87  # windows of whole texts, none across two of them
