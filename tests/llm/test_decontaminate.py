import random
import re

import numpy as np

from pagefold.llm import decontaminate
from pagefold.llm.fmindex import FMIndex, WaveletMatrix, suffix_array

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for key, text in items:
        w = words_of(text)
        k = min(10, len(w))
        for i in range(len(w) - k + 1) if w else ():
            windows.setdefault(tuple(w[i : i + k]), set()).add(str(key) if key is not None else "")
    out = []
    for key, text in docs:
        w, hit, found = words_of(text), set(), set()
        for win, names in windows.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    found |= names
        out.append((key, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def case(seed):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(12)] + ["É", "ß1"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 9, 10, 14, 30])))) for i in range(25)]
    docs = []
    for i in range(60):
        parts = [rng.choice(vocabulary + ["zz", "yy"]) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.6:
            parts += rng.choice(items)[1].upper().split(" ")
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(parts)))
    return docs + [(None, None), (3, ""), (3, docs[5][1]), (3, docs[5][1])], items + [(None, items[6][1]), (99, None), (98, "?!")]


def test_equal_brute_force_in_one_pass_and_in_many(spark, monkeypatch):
    for seed, windows in ((1, 200_000), (2, 40)):
        docs, items = case(seed)
        monkeypatch.setattr(decontaminate, "PASS_WINDOWS", windows)
        d = spark.createDataFrame([(*x, "c", 1) for x in docs], "doc_id long, text string, items string, h int")
        b = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, n_words int")
        got = [(r.doc_id, r.n_words, sum(s.last - s.first for s in r.spans), r.items) for r in decontaminate.find(d, b).collect()]
        assert sorted(got, key=repr) == brute(docs, items)


def test_small_shards_find_the_same():
    docs, items = case(5)
    import pyarrow as pa

    from pagefold.llm.wordhash import ALNUM, Powers, words

    phrases = decontaminate.Phrases([(str(k), words(pa.array([t]), ALNUM, Powers())[3]) for k, t in items if words_of(t)])
    first, _, _, hashes = words(pa.array([t for _, t in docs]), ALNUM, Powers())
    whole, parts = (sorted(zip(*decontaminate.occurrences(phrases, first, hashes, n), strict=True)) for n in (1 << 20, 30))
    assert whole == parts and whole


def test_index_counts_and_locates():
    rng = np.random.default_rng(3)
    for _ in range(20):
        s = rng.integers(1, 5, rng.integers(1, 300))
        text = np.append(s, 0)
        assert [tuple(text[i:]) for i in suffix_array(text)] == sorted(tuple(text[i:]) for i in range(len(text)))
        index = FMIndex(s, 5)
        patterns = rng.integers(1, 5, (30, 3))
        lengths = rng.integers(1, 4, 30)
        lo, hi = index.count(patterns, lengths)
        for p, n, a, b in zip(patterns, lengths, lo, hi, strict=True):
            want = [i for i in range(len(s) - n + 1) if (s[i : i + n] == p[:n]).all()]
            assert max(0, b - a) == len(want) and (b <= a or sorted(index.locate(np.arange(a, b)).tolist()) == want)
    w = WaveletMatrix(np.array([3, 1, 2, 3, 0]), 4)
    assert w.access(np.arange(5)).tolist() == [3, 1, 2, 3, 0] and w.rank(np.array([3, 1]), np.array([4, 1])).tolist() == [2, 0]


def test_remove_cuts_spans_and_keeps_clean_rows(spark):
    item = "alpha beta gamma delta one two three four five six"
    d = spark.createDataFrame([(1, f"Keep é this. {item.upper()}; and that.", 1, 0), (2, item, 1, 0), (3, None, 1, 0), (4, "clean", 1, 0), (5, "", 1, 0)], "doc_id long, text string, n_chars long, n_words int")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.remove(d, b).collect()}
    assert sorted(got) == [1, 3, 4, 5] and got[1].text == "Keep é this. ; and that." and got[1].n_chars == len(got[1].text)
    assert decontaminate.find(d, b.limit(0)).where("size(items) > 0").count() == 0 and decontaminate.find(d.limit(0), b).collect() == []


def test_several_passes_give_what_one_pass_gives(spark, monkeypatch):
    w = [f"w{i}" for i in range(1, 31)]
    a, b = " ".join(w[:20]), " ".join(w[10:])
    c = " ".join(["p0", "p1", "p2", "p3", "p4", "q0", "q1", "q2", "q3", "q4"])  # stands in no text until a's passage is cut
    items = spark.createDataFrame([(1, a), (2, b), (3, c)], "item_id long, text string")
    joined = f"p0 p1 p2 p3 p4 {a} q0 q1 q2 q3 q4"
    data = [(1, " ".join(w[:25]), 1, 0), (2, " ".join([*w[:25], "end"]), 1, 0), (3, joined, 1, 0), (4, "clean", 1, 0), (4, "clean", 1, 0), (5, None, 1, 0), (6, f"x {b}", 1, 0), (6, f"x {b}", 1, 0)]
    docs = spark.createDataFrame(data, "doc_id long, text string, n_chars long, spans int")
    got = []
    # The windows in one group, in several, and in several with pieces of text that wait for one another, or do not.
    for windows, piece, held in ((200_000, 2 << 20, 4_000_000), (11, 2 << 20, 4_000_000), (11, 40, 60), (11, 40, 1)):
        monkeypatch.setattr(decontaminate, "PASS_WINDOWS", windows)
        monkeypatch.setattr(decontaminate, "PIECE", piece)
        monkeypatch.setattr(decontaminate, "HELD_WORDS", held)
        cut = sorted((tuple(r) for r in decontaminate.remove(docs, items).collect()), key=repr)
        found = sorted((repr(r) for r in decontaminate.find(docs, items).collect()))
        got.append((cut, found))
    assert all(g == got[0] for g in got) and len(got[0][1]) == len(data)
    assert [(r[0], r[1]) for r in got[0][0]] == [(2, " end"), (3, "p0 p1 p2 p3 p4  q0 q1 q2 q3 q4"), (4, "clean"), (4, "clean"), (5, None), (6, "x "), (6, "x ")]


def test_groups_split_a_window_of_many_items(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PASS_WINDOWS", 3)
    items = spark.createDataFrame([(i, "b c d e f g h i j k" if i % 2 else f"{i} " * 12) for i in range(12)], "item_id long, text string")
    folder, n = decontaminate.grouped_windows(items, "item_id", "text")
    groups = list(decontaminate.Groups(folder, n))
    assert n == 4 and 1 < len(groups) <= n and sum(len(i) for g in groups for i in g.items) == 12
    found = decontaminate.find(spark.createDataFrame([(1, "x b c d e f g h i j k y")], "doc_id long, text string"), items).first()
    assert found["items"] == sorted(str(i) for i in range(1, 12, 2)) and [(s.first, s.last) for s in found.spans] == [(1, 11)]


def test_a_group_is_read_once_for_many_pieces(monkeypatch):
    import pyarrow as pa

    class Told(decontaminate.Groups):
        reads = 0

        def __iter__(self):
            Told.reads += 1
            yield decontaminate.Phrases([("i", np.arange(10, dtype=np.uint64))])

    batches = [pa.RecordBatch.from_pydict({"id": list(range(50)), "text": ["word " * 30] * 50}) for _ in range(4)]
    monkeypatch.setattr(decontaminate, "PIECE", 1000)
    for n, held, reads in ((2, 10**6, 1), (2, 1500, 4), (1, 10**6, None)):
        monkeypatch.setattr(decontaminate, "HELD_WORDS", held)
        Told.reads = 0
        found = list(decontaminate.searched(batches, 1, Told("", n)))
        assert sum(b.num_rows for b, *_ in found) == 200 and [x for _, words, *_ in found for x in words.tolist()] == [30] * 200
        assert Told.reads == (reads or len(found))
