"""Toxicity by a weighted finite-state pattern grammar over clauses.

Transducers are composed.  The insult and the threat transducer read the words of a clause; their arcs have the
lexicon's weights.  Words that they pass, targets, negations, reporting words and others, become their class.  Then
negation rewrites an insult or threat near behind it and weakens its weight, as far as the next comma or `but`; reported
speech does so with those behind a reporting word, up to the end of what is quoted; targets raise the weight of the
insults that they meet.  A threat is a verb with a target near behind it, more so behind a word of intention: a verb
alone (to kill time, to shoot a film) keeps a small part of its weight.  The score of a text rests on its matched
clauses, not on isolated words: the composed weight of each and what the machine writes for it are weighed by a
logistic model.

The insult lexicon (words and word beginnings), the factors of negation, report and target, and the model are fitted on
labelled rows; threats, intentions, targets, negations and reporting words are closed classes, given below.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefold.llm.common import pieces, stored, table, text_or_empty
from pagefold.llm.fsa import Composed, Lexical, Transducer
from pagefold.llm.wordhash import buffer_of

#: At most so many labelled rows are read for the fit, those of the smallest crc32 (documented bound).
MAX_FIT_ROWS = 12_000
#: Tasks that the rows of the fit are dealt to.
FIT_TASKS = 32
#: Words whose class and weight a task keeps; beyond that it starts anew.
CACHE_WORDS = 100_000
#: Hashes of the first bytes of a word, of HEAD bytes at most.
HEADS = 1 << 16
HEAD = 8

# Closed word classes in English, German, French and Spanish.
SEED_INSULTS = ["idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "dumb", "imbecile", "vermin"]
THREATS = ["kill", "murder", "strangle", "shoot", "stab", "beat", "destroy", "umbringen", "töten", "erschießen", "tuer", "matar", "matarte"]
TARGETS = ["you", "your", "yours", "u", "him", "her", "them", "these", "those", "people", "du", "dich", "dein", "euch", "ihr", "tu", "toi", "vous", "votre", "tú", "usted", "ustedes"]
NEGATIONS = ["not", "never", "no", "isn", "aren", "wasn", "don", "doesn", "won", "nicht", "kein", "keine", "nie", "pas", "jamais", "ne", "nunca", "jamás"]
INTENTIONS = ["will", "ll", "gonna", "going", "shall", "want", "must", "should", "werde", "werden", "will", "vais", "veux", "voy", "quiero"]
CONTRASTS = ["but", "however", "aber", "sondern", "mais", "pero", "sino"]
REPORTS = ["said", "says", "wrote", "quoted", "claimed", "called", "reported", "alleged", "sagte", "schrieb", "dit", "écrit", "dijo", "escribió"]
CLASS_OF = {w: c for c, words in (("Y", TARGETS), ("N", NEGATIONS), ("R", REPORTS), ("M", INTENTIONS), ("B", CONTRASTS)) for w in words}

WORD = re.compile(r"[^\W\d_]+")
#: What ends a clause, but for a new line only outside of quotation marks: what is reported goes on to their end.
CLAUSE_END, QUOTES = frozenset(".!?;\n"), frozenset('"“”„«»')
BOUND = re.compile(r'[.!?;\n"“”„«»]')
#: A clause's words and marks: a comma, or a sentence's end inside a quotation, bounds a negation (B); quotation marks (Q).
PART = re.compile(r'[^\W\d_]+|[,.!?;"“”„«»]')
MARKS = dict.fromkeys(",.!?;", ("B", 0.0)) | dict.fromkeys(QUOTES, ("Q", 0.0))
STEMS = (4, 5, 6)
#: How far a negation, an intention and a threat reach, in words of the clause.
REACH = 3
#: Weight of a seed insult and of a threat; what is left of a threat's without a target; what a target adds to it, and one
#: with an intention.
SEED, LOOSE, THREATENS, INTENDS = 2.0, 0.25, 1.0, 2.5


class Factors(NamedTuple):
    """What negation and report leave of a weight, what a target before an insult makes of it, what one behind it adds."""

    weaker: float = 0.25
    aimed: float = 1.5
    aimed_behind: float = 1.0


#: The factors that the fit tries, the plain ones first.
TRIED = (Factors(), *(Factors(w, a) for w in (0.25, 0.1, 0.5) for a in (1.5, 1.0, 2.0) if (w, a) != (0.25, 1.5)))


def grammar(factors: Factors = TRIED[0]) -> tuple[Transducer, ...]:
    """Negation, report, intention and aim.

    I insult, T threat, Y target, N negation, R report, M intention, B bound, Q quotation mark, o other; i and t:
    weakened; J: an insult behind a target; V: an intended threat; A and U: a target behind an insult or threat, behind
    an intended threat.
    """
    steps = range(1, REACH + 1)
    fading = {s: (s + 1) % (REACH + 1) for s in steps}
    negate = Transducer(
        arcs={(s, "N"): (1, "N", 1.0, 0.0) for s in (0, *steps)} | {(s, "B"): (0, "B", 1.0, 0.0) for s in steps} | {(s, c): (s, c.lower(), factors.weaker, 0.0) for s in steps for c in "IT"},
        rest=fading,
    )
    # State 1: behind a reporting word; state 2: inside the quotation behind it.
    reported = Transducer(
        arcs={(s, "R"): (max(s, 1), "R", 1.0, 0.0) for s in (0, 1, 2)} | {(1, "Q"): (2, "Q", 1.0, 0.0), (2, "Q"): (0, "Q", 1.0, 0.0)} | {(s, c): (s, c.lower(), factors.weaker, 0.0) for s in (1, 2) for c in "IT"}
    )
    intend = Transducer(arcs={(s, "M"): (1, "M", 1.0, 0.0) for s in (0, *steps)} | {(s, "T"): (0, "V", 1.0, 0.0) for s in steps} | {(s, "B"): (0, "B", 1.0, 0.0) for s in steps}, rest=fading)
    # State 1: a target was met; state 2: an insult was met that waits for one; from 10 and from 20 on: a threat waits, an intended one.
    waits = [*range(10, 10 + REACH), *range(20, 20 + REACH)]
    arcs = {(0, "Y"): (1, "Y", 1.0, 0.0), (1, "Y"): (1, "Y", 1.0, 0.0), (2, "Y"): (1, "A", 1.0, factors.aimed_behind)}
    arcs |= {(s, "I"): (2, "I", 1.0, 0.0) for s in (0, 2, *waits)} | {(1, "I"): (1, "J", factors.aimed, 0.0)}
    arcs |= {(s, c): (at, "t", LOOSE, 0.0) for s in (0, 1, 2, *waits) for c, at in (("T", 10), ("V", 20))}
    arcs |= {(s, "Y"): (1, "A", 1.0, THREATENS) if s < 20 else (1, "U", 1.0, INTENDS) for s in waits}
    aim = Transducer(arcs=arcs, rest={s: s + 1 if s + 1 in waits else 0 for s in waits})
    return negate, reported, intend, aim


THREAT = Lexical("T", dict.fromkeys(THREATS, SEED))
FEATURES = ("I", "i", "J", "A", "T", "t", "U")


def keys_of(word: str):
    """A word's lexicon keys: itself, and its beginnings where it is longer than them."""
    yield word
    for n in STEMS:
        if len(word) > n:
            yield f"{word[:n]}*"


def lower_bound(hits: float, tries: float, z: float = 2.6) -> float:
    """Wilson's lower bound of a share."""
    p, q = hits / tries, z * z / tries
    return (p + q / 2 - z * math.sqrt((p * (1 - p) + q / 4) / tries)) / (1 + q)


def first_bytes(eight: np.ndarray, n: int) -> np.ndarray:
    return eight & np.uint64((1 << 8 * n) - 1)


def place(heads: np.ndarray) -> np.ndarray:
    """A place among HEADS for each."""
    return (heads * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)


def marked_heads(keys: set[str]) -> list[tuple[int, bool, np.ndarray, np.ndarray]]:
    """(n, whole, heads, marks) of lexicon keys: their first n bytes, sorted, and marks of these; whole: the word ends behind them."""
    told: dict[tuple[int, bool], set[bytes]] = {}
    for key in keys:
        raw = key.rstrip("*").encode()
        told.setdefault((min(len(raw), HEAD), key[-1:] != "*" and len(raw) < HEAD), set()).add(raw[:HEAD].ljust(HEAD, b"\0"))
    out = []
    for (n, whole), found in told.items():
        heads, marks = np.sort(np.frombuffer(b"".join(found), "<u8")), np.zeros(HEADS, bool)
        marks[place(heads)] = True
        out.append((n, whole, heads, marks))
    return out


class Scorer:
    """Features and score of one text; made on each task from the fitted lexicon and weights."""

    def __init__(self, lexicon: dict[str, float], weights: list[float] | None = None, factors: Factors = TRIED[0]):
        self.insult = Lexical("I", lexicon)
        self.machine = Composed(*grammar(factors))
        self.weights = weights
        self.known: dict[str, tuple[str, float]] = {}
        keys = [k.rstrip("*") for k in (*lexicon, *THREATS)]
        self.width = min(3, *map(len, keys))
        self.begins = {k[: self.width] for k in keys}
        self.heads = marked_heads({*lexicon, *THREATS})

    def lexical(self, word: str) -> tuple[str, float]:
        """Class and weight that the insult and the threat transducer write for a word."""
        symbol, weight = self.insult.step(word)
        if not weight:
            symbol, weight = THREAT.step(word)
        return (symbol, weight) if weight else (CLASS_OF.get(word, "o"), 0.0)

    def word(self, word: str) -> tuple[str, float]:
        """`lexical`, kept for words that come again."""
        told = self.known.get(word)
        if told is None:
            if len(self.known) > CACHE_WORDS:
                self.known.clear()
            told = self.known[word] = self.lexical(word)
        return told

    def suspects(self, lows: list[str]) -> list[bool]:
        """Whether each lower-cased text may hold a word with a weight: by the first bytes of all their words at once."""
        if not lows:
            return []
        raw, offsets = buffer_of(pa.array([t + "\n" for t in lows], pa.large_string()))
        padded = np.r_[raw, np.zeros(HEAD, np.uint8)]
        letter = (padded >= 97) & (padded <= 122)
        begins = raw >= 0xC0  # any character beyond ASCII may begin a word
        begins[0] |= letter[0]
        begins[1:] |= letter[1 : len(raw)] & ~letter[: len(raw) - 1]
        at = np.flatnonzero(begins)
        eight = np.ndarray(len(raw), "<u8", padded, strides=(1,))[at]
        hit = np.zeros(len(at), bool)
        for n, whole, heads, marks in self.heads:
            own = first_bytes(eight, n)
            found = np.flatnonzero(marks[place(own)])
            found = found[heads[np.minimum(np.searchsorted(heads, own[found]), len(heads) - 1)] == own[found]]
            hit[found] |= ~letter[at[found] + n] if whole else True
        return (np.diff(np.searchsorted(at[hit], offsets)) > 0).tolist()

    def all_clauses(self, texts: list[str]) -> list[list]:
        """`clauses` of each text."""
        lows = [t.lower() for t in texts]
        return [[(a, b, *run(self.machine, parts)) for a, b, parts in self.matched(t, low)] if may else [] for t, low, may in zip(texts, lows, self.suspects(lows), strict=True)]

    def matched(self, text: str, low: str | None = None) -> list[tuple[int, int, list[tuple[str, float]]]]:
        """(start, end, classes and weights of words and marks) of every clause that holds an insult or a threat."""
        low = text.lower() if low is None else low
        triggers = {w for w in set(WORD.findall(low)) if w[: self.width] in self.begins and self.word(w)[1]}
        if not triggers:
            return []
        out, at, quoted = [], 0, False
        for end in [*(m.start() for m in BOUND.finditer(low)), len(low)]:
            mark = low[end : end + 1]
            if mark in QUOTES and mark:
                quoted = not quoted
                continue
            if quoted and mark and mark != "\n":
                continue
            quoted = False
            clause = low[at:end]
            if any(w in clause for w in triggers) and not triggers.isdisjoint(parts := PART.findall(clause)):
                out.append((at, end, [MARKS.get(p) or self.word(p) for p in parts]))
            at = end + 1
        return out

    def clauses(self, text: str) -> list[tuple[int, int, list[str], float]]:
        """(start, end, grammar output of its words, composed weight) of every clause that holds an insult or a threat."""
        return [(a, b, *run(self.machine, parts)) for a, b, parts in self.matched(text)]

    def features(self, text: str) -> list[float]:
        return self.measures(self.clauses(text))

    def measures(self, found: list) -> list[float]:
        marks = Counter(c for _, _, outs, _ in found for c in outs)
        total = sum(w for *_, w in found)
        best = max((w for *_, w in found), default=0.0)
        return [float(bool(found)), math.log1p(total), best, math.log1p(len(found)), *(math.log1p(marks[c]) for c in FEATURES)]

    def score(self, text: str) -> float:
        return self.judged(self.clauses(text))

    def judged(self, found: list) -> float:
        """The score of a text's matched clauses."""
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], self.measures(found), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def run(machine: Composed, parts: list[tuple[str, float]]) -> tuple[list[str], float]:
    """What a machine writes for a clause's words, and the composed weight."""
    outs, weight = machine.run(*zip(*parts, strict=True))
    return [o for o in outs if o not in "BQ"], weight


class Model(NamedTuple):
    """What fit() learns, and a Scorer needs."""

    lexicon: dict[str, float]
    weights: list[float]
    factors: Factors


def crc(column: str):
    return F.crc32(F.col(column).cast("string").cast("binary"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", max_rows: int = MAX_FIT_ROWS):
    """The Model of the labelled rows whose crc32(id as text) mod 5 is not 0.

    At most max_rows of them are read, those of the smallest crc32, ties by id, and at most max_rows distinct texts of
    these, should ids repeat.  Ids, text copies and null labels: a null id or label is left out; labels that repeat for
    an id count once, the highest; equal texts count once.  The lexicon and the weights depend on these rows alone, so
    both are bounded by them.  Without any labelled row the seed lexicon and a fixed weight of the composed total stand.
    """
    marked = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull() & (crc(id_col) % 5 != 0))
    marked = marked.groupBy(F.col(id_col).alias("fit_id")).agg(F.max("toxic").alias("y"))
    marked = marked.orderBy(crc("fit_id"), "fit_id").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("fit_id"), text_or_empty().alias("text")).join(F.broadcast(marked), "fit_id")
    rows = stored(rows.groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("y").alias("y")).orderBy("h").limit(max_rows).repartition(FIT_TASKS, "h"), "fit")

    def terms(batches):
        for b in batches:
            n1, n0 = Counter(), Counter()
            for text, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                (n1 if y else n0).update({k for w in set(WORD.findall(text.lower())) if len(w) > 2 for k in keys_of(w)})
            if n1 or n0:
                keys = list(n1.keys() | n0.keys())
                yield pa.RecordBatch.from_pydict({"k": keys, "n1": [n1[k] for k in keys], "n0": [n0[k] for k in keys]})

    n = rows.groupBy().agg(F.coalesce(F.sum("y"), F.lit(0)).alias("y"), F.count("*").alias("n")).first()
    counts = rows.mapInArrow(terms, "k string, n1 bigint, n0 bigint").groupBy("k").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    kept = counts.where((F.col("n1") >= 3) & (F.col("n1") >= 2 * F.col("n0"))).orderBy("k").collect()
    lexicon = dict.fromkeys(SEED_INSULTS, SEED)
    for r in kept:
        if (low := lower_bound(r["n1"], r["n1"] + r["n0"])) >= 0.45:
            lexicon[r["k"]] = round(math.log((r["n1"] + 0.5) / (r["n0"] + 0.5) * max(1, n["n"] - n["y"]) / max(1, n["y"])) * low, 4)

    def features(batches):
        scorer, machines = Scorer(lexicon), [Composed(*grammar(f)) for f in TRIED]
        for b in batches:
            found = [scorer.matched(t) for t in b.column(1).to_pylist()]
            x = [[scorer.measures([(a, e, *run(m, parts)) for a, e, parts in clauses]) for m in machines] for clauses in found]
            yield pa.RecordBatch.from_pydict({"x": pa.array(x, pa.list_(pa.list_(pa.float64()))), "y": b.column(2).cast(pa.int32())})

    sample = rows.mapInArrow(features, "x array<array<double>>, y int").collect()
    if len({bool(r["y"]) for r in sample}) < 2:
        return Model(lexicon, [-4.0, 0.0, 4.0, *[0.0] * (2 + len(FEATURES))], TRIED[0])
    y = np.array([float(bool(r["y"])) for r in sample])
    tried = [logistic(np.array([r["x"][i] for r in sample]), y) for i in range(len(TRIED))]
    best = min(range(len(TRIED)), key=lambda i: round(tried[i][1], 6))
    return Model(lexicon, tried[best][0], TRIED[best])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> tuple[list[float], float]:
    """(weights, the intercept first; their cost) by Newton's method on the ridge-penalised likelihood."""
    order = np.lexsort((*x.T[::-1], y))  # the same weights whatever the order of rows
    x, y = np.c_[np.ones(len(x)), x][order], y[order]
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-12, 1 - 1e-12)
    cost = -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum() + (penalty @ w @ w) / 2
    return [round(float(v), 6) for v in w], float(cost)


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted, clauses) of every whole text, one row for each input row.

    A null or empty text is scored as a text without matches.  clauses: spans of matched clauses, code points of the
    lower-cased text.  Only the text is read.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marks", pa.string())]))

    def run(batches):
        scorer = Scorer(*model)
        for b in (p for batch in batches for p in pieces(batch, 1)):
            matched = scorer.all_clauses(b.column(1).to_pylist())
            scores = [scorer.judged(m) for m in matched]
            found = [[{"start": a, "end": e, "marks": "".join(c for c in outs if c in FEATURES)} for a, e, outs, _ in m] for m in matched]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(found, kind)], ["id", "score", "predicted", "clauses"])

    schema = f"id {rows.schema['id'].dataType.simpleString()}, score double, predicted int, clauses array<struct<start:bigint,end:bigint,marks:string>>"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, model, text_col: str = "text") -> DataFrame:
    """docs without the rows whose text is scored 0.5 or more; all columns stay."""
    at = docs.columns.index(text_col)

    def run(batches):
        scorer = Scorer(*model)
        for b in batches:
            found = (m for p in pieces(b, at) for m in scorer.all_clauses([t or "" for t in p.column(at).to_pylist()]))
            yield b.filter(pa.array([scorer.judged(m) < 0.5 for m in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(crc("doc_id") % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", F.size("clauses").cast("long").alias("n_clauses"))


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLE_SQL: dict[str, str] = {}
