import random

from pagefold.llm import licences


def brute(text, threshold=licences.THRESHOLD):
    out = {}
    import re

    places = [("line", p) for p in text.split("\n")] + [("paragraph", p) for p in re.split(r"\n[ \t]*\n", text)] + [("text", text)]
    told = [p for p in re.split(r"[.!?]+[ \t\n]+|\n[ \t]*\n", text) if licences.normal_words(p)]
    places += [("run", " ".join(told[i : i + k])) for k in range(1, 5) for i in range(len(told) - k + 1)]
    for name, body in licences.TEMPLATES.items():
        want = licences.bigrams(licences.normal_words(body))
        for _, place in places:
            have = licences.bigrams(licences.normal_words(place))
            if have and 2 * len(want & have) >= threshold * (len(want) + len(have)) - 1e-9:
                dice = round(2 * len(want & have) / (len(want) + len(have)), 6)
                best, n = out.get(name, (0, 0))
                out[name] = (max(best, dice), n + 1)
    return out


def test_equal_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for i in range(150):
        name = rng.choice(sorted(licences.TEMPLATES))
        w = licences.TEMPLATES[name].split(" ")
        for _ in range(rng.choice([0, 0, 1, 2, len(w) // 8, len(w) // 4])):
            w[rng.randrange(len(w))] = rng.choice(["foo", "the", "license", "É"])
        body = rng.choice([" ", "\n", " - "]).join(w)
        rows.append((i, rng.choice(["", "Some text before.\n", "x\n\n"]) + rng.choice([body, body.upper()]) + rng.choice(["", "\n\nafter it", "\n" + body])))
    rows += [(1000, None), (1001, ""), (1002, "license"), (None, "Released under the MIT License."), (1003, "the of and " * 100_000)]
    docs = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, licence string, size int")
    got = {(r.doc_id, r.licence): (r.dice, r.n_places) for r in licences.scan(docs).collect()}
    assert got == {(k, name): v for k, t in rows for name, v in brute(t or "").items()}
    assert got[None, "mit-notice"] == (1.0, 4)
    assert licences.scan(docs.limit(0)).collect() == []


def test_notices_inside_other_text_are_found(spark):
    prose = "the stones of the old harbour were counted again in spring " * 80
    mit = licences.TEMPLATES["mit"]
    for stop in ("The above copyright", "THE SOFTWARE IS PROVIDED", "IN NO EVENT"):
        mit = mit.replace(stop, "\n\n" + stop, 1)
    apache = licences.TEMPLATES["apache-2.0"]
    lines = [apache[i : i + 70] for i in range(0, len(apache), 70)]
    texts = {
        1: f"{prose}\n\n{mit}\n\n{prose}",
        2: "Released in May by the city archive. Licensed under the Apache License, Version 2.0. It has ten rooms.",
        3: "/*\n * " + "\n * ".join(lines) + "\n */\n\n" + prose,
        4: prose,
        5: "# " + apache.replace(". ", ".\n#\n# ") + "\n" + prose,
    }
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    got = {(r.doc_id, r.licence) for r in licences.scan(docs).collect()}
    assert {(1, "mit"), (2, "apache-2.0-notice"), (3, "apache-2.0"), (5, "apache-2.0")} <= got
    assert 4 not in {i for i, _ in got}


def test_native(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = licences.scan(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
