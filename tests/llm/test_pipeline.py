import random
import re

import pyarrow as pa

import corpus_pipeline
from pagefold.llm import decontaminate, pii, simjoin, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "pii", "bpe"]
    kept, at = [docs], docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = spark.createDataFrame(stage(spark, at, SF).collect(), docs.schema)
        assert at.columns == docs.columns
        kept.append(at)
    ids = [{r.doc_id for r in k.collect()} for k in kept]
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids[1] == {r.doc_id for r in toxicity.score(docs, model).where("predicted = 0").collect()}
    assert ids[2] == {r.component_id for r in simjoin.classes(kept[1]).collect()}
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    spans = decontaminate.find(kept[3], bench).where("size(spans) > 0").count()
    assert spans == 0 and ids[4] == ids[3] <= ids[2]
    assert all(not pii.spans(r.text, 0.5) or not re.search("[^ ]@[^ ]", r.text) for r in kept[4].collect())
    out = corpus_pipeline.run(spark, SF)
    rows = out.collect()
    assert {r.doc_id for r in rows} == ids[4] and all(len(r.ids) == r.n_tokens for r in rows)


def test_near_duplicates_are_linked_by_five_words_and_four_fifths(spark):
    rng = random.Random(3)
    texts = []
    for length, edits in ((140, 3), (200, 4), (120, 3), (150, 4), (300, 6)):
        words = [f"v{rng.randrange(10**9)}" for _ in range(length)]
        changed = list(words)
        for k in range(edits):
            changed[(k + 1) * length // (edits + 1)] = f"edit{length}x{k}"
        texts += [" ".join(words), " ".join(changed)]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in texts)]
    alike = [len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in range(0, len(sets), 2)]
    assert sum(0.80 <= a < 0.85 for a in alike) == 3 and sum(a < 0.80 for a in alike) == 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()}
    assert kept == {j for j in range(len(sets)) if not any(10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]) for i in range(j))}


LONG = " ".join(f"word{i}" for i in range(60_000))
EDGES = [
    (1, None), (2, ""), (3, " \n "), (4, LONG), (5, LONG + " tail"), (6, "the same short text of some words"), (6, "the same short text of some words"), (7, "the same short text of some words"),
    (None, "a row without an id, and with words of its own"), (8, "write to someone@example.com or not"), (9, "You idiot moron, you pathetic scum and loser, you worthless trash. You idiot."), (10, None), (2, ""),
]
KIND = "doc_id long, text string, lang string, source string, n_chars long, score string, spans int, key string, h int, id int, component_id long, y int, x int, folder string"


def edge_docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "score", 1, "key", 2, 3, -4, 5, 6, "f") for i, t in rows], KIND)


def test_edges_of_every_stage(spark):
    docs = edge_docs(spark, EDGES)
    key = lambda rows: sorted(((r.doc_id, r.text) for r in rows), key=repr)
    kept = {name: stage(spark, docs, SF) for name, stage in corpus_pipeline.STAGES}
    for name in ("toxicity", "near_duplicates", "decontamination", "pii"):
        assert kept[name].columns == docs.columns, name
        rows = kept[name].collect()
        assert {(r.score, r.spans, r.key, r.h, r.id, r.component_id, r.y, r.x, r.folder) for r in rows} == {("score", 1, "key", 2, 3, -4, 5, 6, "f")}, name
        kept[name] = rows
    assert key(kept["toxicity"]) == key(r for r in docs.collect() if r.doc_id != 9)
    assert key(kept["decontamination"]) == key(docs.collect())
    # One of the long texts, which share all but a few shingles, and one of the three equal ones; texts without words all stay.
    want = [r for r in EDGES if r[0] not in (5, 6, 7)] + [(6, EDGES[5][1])]
    assert key(kept["near_duplicates"]) == sorted(want, key=repr)
    assert key(r for r in kept["pii"] if r.doc_id != 8) == key(r for r in docs.collect() if r.doc_id != 8)
    assert [r.text.startswith("write to [") and r.text.endswith("] or not") for r in kept["pii"] if r.doc_id == 8] == [True]
    assert all(r.n_chars == len(r.text or "") for r in kept["pii"])
    tokens = kept["bpe"].collect()
    assert len(tokens) == len(EDGES) and all(r.n_tokens == len(r.ids) for r in tokens) and sum(r.n_tokens == 0 for r in tokens) == 5


def test_empty_tables(spark):
    none = edge_docs(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).collect() == [], name


def test_tasks_of_a_stage_get_small_batches(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [b.nbytes]})

    docs = spark.range(0, 4000, 1, 1).selectExpr("id doc_id", "repeat('word ', 1000) text")
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    for name, stage in corpus_pipeline.STAGES:
        spark.conf.unset(key)
        stage(spark, edge_docs(spark, []), SF)
        found = docs.mapInArrow(sizes, "rows long, bytes long").collect()
        assert sum(r["rows"] for r in found) == 4000 and max(r["bytes"] for r in found) < 6 << 20, name
    spark.conf.unset(key)
