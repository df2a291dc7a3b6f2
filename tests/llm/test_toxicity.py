import random

import pytest

from pagefold.llm import toxicity
from pagefold.llm.toxicity import Scorer

KIND = "doc_id long, text string, score string, clauses int"


@pytest.fixture(scope="module")
def fitted(spark):
    return toxicity.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))


def marks(text, lexicon=None):
    return ["".join(outs) for _, _, outs, _ in Scorer(lexicon or {"idiot": 1.0, "scum": 1.0, "lowei*": 2.0}).clauses(text)]


def test_grammar_weakens_negated_and_reported_insults_and_strengthens_aimed_ones():
    assert marks("He is an idiot.") == ["oooI"]
    assert marks("You are an idiot") == ["YooJ"]
    assert marks("He is not an idiot") == ["ooNoi"]
    assert marks("She said he is an idiot") == ["oRoooi"]
    assert marks("an idiot like you") == ["oIoA"]
    assert marks("We will kill them. Nothing here.") == ["oMtU"]
    assert marks("not. idiot") == ["I"] and marks("Das ist loweick") == ["ooI"] and marks("nothing at all") == []


def test_negation_reaches_three_words():
    assert marks("not a b idiot")[0][-1] == "i" and marks("not a b c idiot")[0][-1] == "I"


def test_held_out_accuracy(spark, fitted):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = labels.where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0")
    rows = toxicity.score(docs, fitted).join(held, "doc_id").select("predicted", "toxic").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit / sum(r.predicted for r in rows) > 0.95 and hit / sum(r.toxic for r in rows) > 0.8


def test_edges(spark, fitted):
    data = [(1, None, "a", 1), (2, "", "a", 1), (3, "ok words " * 100_000, "a", 1), (3, "idiot moron scum you", "a", 1), (3, "idiot moron scum you", "a", 1), (None, "fine", "a", 1)]
    docs = spark.createDataFrame(data, KIND)
    rows = toxicity.score(docs, fitted).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert sum(r.predicted for r in rows) == 2 and toxicity.keep_clean(docs, fitted).count() == 4
    assert toxicity.score(docs.limit(0), fitted).collect() == []


def test_fit_without_labels(spark):
    docs = spark.createDataFrame([(1, "you idiot"), (2, "fine")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.predicted for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()}[2] == 0


def weight(text):
    return [w for *_, w in Scorer({"idiot": 2.0, "loser": 1.0, "lowei*": 1.0}).clauses(text)]


def test_composed_weights_of_clauses():
    assert weight("He is an idiot") == [2.0] and weight("Das ist loweick") == [1.0] and weight("We kill time") == [0.5]
    assert weight("He was never an idiot") == weight("She said he is an idiot") == [0.5]
    assert weight("You are an idiot") == [3.0] == weight("an idiot like you") and weight("You, I kill") == [0.5]
    assert weight("not you idiot") == [0.5] and weight("You are no loser. You loser") == [0.25, 1.5]


def test_negated_and_reported_insults_score_less_than_direct_ones(spark):
    docs = spark.createDataFrame([(1, "he was an idiot"), (2, "he was never an idiot"), (3, "she called him an idiot"), (4, "you are an idiot")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    found = {r.doc_id: toxicity.Scorer(*model).features(r.text) for r in docs.collect()}
    total, best = 1, 2
    for at in (total, best):
        assert found[2][at] == found[3][at] < found[1][at] < found[4][at]
    assert {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect()} == {1: 1, 2: 0, 3: 0, 4: 1}


def test_threats_are_verbs_with_targets():
    assert weight("They will shoot the film next week") == [0.5] == weight("I like to kill time")
    assert weight("They shoot them") == [1.5] and weight("I will kill you") == [3.0] == weight("We are going to kill all of them")
    assert weight("I will not kill you") == [0.5] and weight("I kill time and so much else that you like") == [0.5]


def test_commas_and_contrasts_bound_negation():
    assert weight("You are not wrong, you idiot") == [3.0] and weight("not nice but an idiot") == [2.0]
    assert weight("You are not an idiot") == [0.5] == weight("You are not an idiot, nor wrong")


def test_quotations_go_on_over_full_stops():
    quoted = 'He said: "You fool. You are an idiot." Then he left.'
    assert weight(quoted) == [0.5] and weight('He said "fine", you idiot') == [3.0]
    assert weight('"Fine. You idiot." And so on.\nIdiot') == [3.0, 2.0]
    spans = [(a, e) for a, e, *_ in Scorer({"idiot": 2.0}).clauses(quoted)]
    assert [quoted[a:e] for a, e in spans] == [quoted[:-1]]


def test_clauses_are_told_of_every_text(spark):
    docs = spark.createDataFrame([(1, "He is never an idiot, they said."), (2, "fine")], "doc_id long, text string")
    model = toxicity.Model({"idiot": 2.0}, [-4.0, *[0.0] * 11], toxicity.Factors())
    rows = {r.doc_id: (r.predicted, len(r.clauses)) for r in toxicity.score(docs, model).collect()}
    assert rows == {1: (0, 1), 2: (0, 0)}


def plain_score(text, model):
    """The composed weight of every clause, rule by rule over its words, without machines."""
    out = []
    for _, _, parts in Scorer(*model).matched(text):
        total, negated, report, intent, state, waits = 0.0, 0, 0, 0, "none", 0
        for symbol, w in parts:
            weak = symbol in "IT" and (negated > 0 or report > 0)
            negated = {"N": toxicity.REACH, "B": 0}.get(symbol, negated if symbol in "IT" else max(0, negated - 1)) if symbol in "NBIT" or negated else negated
            report = max(report, 1) if symbol == "R" else {1: 2, 2: 0}.get(report, 0) if symbol == "Q" else report
            meant = symbol == "T" and not weak and intent > 0
            intent = toxicity.REACH if symbol == "M" else 0 if symbol == "B" or meant else max(0, intent - 1)
            if weak:
                total += w * model.factors.weaker
                if waits:
                    waits -= 1
                    state = state if waits else "none"
                continue
            if symbol == "I":
                total, state, waits = total + w * (model.factors.aimed if state == "target" else 1), "target" if state == "target" else "insult", 0
            elif symbol == "T":
                total, state, waits = total + w * toxicity.LOOSE, "intended" if meant else "threat", toxicity.REACH
            elif symbol == "Y":
                total += {"insult": model.factors.aimed_behind, "threat": toxicity.THREATENS, "intended": toxicity.INTENDS}.get(state, 0)
                state, waits = "target", 0
            elif waits:
                waits -= 1
                state = state if waits else "none"
        out.append(total)
    return out


def test_machine_equals_the_rules(fitted):
    rng = random.Random(4)
    words = ["you", "idiot", "kill", "not", "said", "will", "but", "word", "them", ",", '"', ".", "loweick", "x", "y", "moron"]
    model = toxicity.Model({"idiot": 2.0, "moron": 1.0, "lowei*": 1.0}, fitted.weights, toxicity.Factors(0.5, 2.0, 1.0))
    for _ in range(3000):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 14)))
        got = [w for *_, w in Scorer(*model).clauses(text)]
        want = plain_score(text, model)
        assert [round(w, 9) for w in got] == [round(w, 9) for w in want], text


def test_texts_are_told_apart_by_the_first_bytes_of_their_words():
    scorer = toxicity.Scorer({"idiot": 2.0, "stup*": 1.0, "été": 1.0, "ab": 3.0, "worthlessness": 1.0}, [-4.0, 0.1, 1.0, 0.4, *[0.3] * (1 + len(toxicity.FEATURES))])
    yes = ["You IDIOT", "x_idiot", "„idiot“", "idiot", "stupidity", "l'été", "ab", "ab,", "worthlessness", "kill you"]
    no = ["", "idiotic", "idio", "an étés", "abc", "a b", "ordinary words", "wort", "skilled"]
    assert scorer.suspects([t.lower() for t in yes]) == [True] * len(yes)
    assert not any(scorer.suspects([t.lower() for t in no]))
    assert scorer.suspects([]) == []
    mixed = [t for pair in zip(yes, no, strict=False) for t in pair]
    assert scorer.all_clauses(mixed) == [scorer.clauses(t) for t in mixed]
    assert all(scorer.clauses(t) for t in yes)
