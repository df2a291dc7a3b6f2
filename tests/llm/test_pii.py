import random
import re
import timeit

import pyarrow as pa

from pagefold.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    odd, even = digits[::-1][::2], digits[::-1][1::2]
    return (sum(map(int, odd)) + sum(sum(map(int, str(2 * int(d)))) for d in even)) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")),
                "card": lambda: 13 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 9 <= len(digits) <= 15,
            }[kind]()
            if ok:
                out.append((kind, *m.span()))
    return out


def base(text):
    return [(s["kind"], s["start"], s["end"]) for s in pii.spans(text, 0.5) if s["kind"] in pii.BASE]


def test_base_spans_equal_brute_force():
    rng = random.Random(11)
    parts = ["a", "b.c", "@", "@x.io", ".", "..", "1", "25", "256", "001", "4111111111111111", "4111 1111-1111 1111", "+1", "+49 (30) 555-1234", " ", "-", "(", ")", "é", "\n", "%", "x@y@z.com"]
    for _ in range(30_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert base(text) == brute(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "1." * 100_000, "+1" * 100_000, "1 " * 100_000, "+1(((" * 50_000, "0" * 6000 + ".1.2.3"):
        pii.spans(text, 0.5)


def test_checksums_and_context():
    assert pii.mod97("DE89370400440532013000") and not pii.mod97("DE88370400440532013000")
    kinds = lambda t: [s["kind"] for s in pii.spans(t, 0.5)]
    assert kinds("iban DE89 3704 0044 0532 0130 00 ok") == ["iban"]
    assert kinds("code 123-45-6789 on the part") == [] and kinds("social security number 123-45-6789") == ["ssn"]
    near, far = pii.spans("call my phone +1 (988) 555-2485", 0.5), pii.spans("xx +1 (988) 555-2485", 0.5)
    assert near[0]["score"] > far[0]["score"]


def test_detect_and_redact_edges(spark):
    data = [(1, "mail me: a.b@c.example.com!", 5, "k"), (1, "mail me: a.b@c.example.com!", 5, "k"), (None, None, None, None), (2, "", 0, ""), (3, "é 10.0.0.1 " * 50_000, 9, "")]
    docs = spark.createDataFrame(data, "doc_id long, text string, n_chars long, spans string")
    got = pii.detect(docs).collect()
    assert len(got) == 5 and sorted(len(r.spans) for r in got) == [0, 0, 1, 1, 50_000]
    out = {(r.doc_id, r.text[:20] if r.text else r.text): r for r in pii.redact(docs).collect()}
    assert out[1, "mail me: [EMAIL]!"].n_chars == len("mail me: [EMAIL]!") and out[None, None].text is None
    assert out[3, "é [IP] é [IP] é [IP]"].spans == ""
    assert pii.detect(docs.limit(0)).collect() == [] and pii.redact(docs.limit(0)).collect() == []


def test_a_long_secret_is_one_span():
    for value in ("k" * 64, "eyJhbGciOi" * 40 + ".x-y_z=", "é" * 300):
        text = f"use token={value} here"
        (found,) = pii.spans(text, 0.5)
        assert (found["kind"], found["start"], found["end"]) == ("secret", 4, len(text) - 5)
        assert pii.cut(text, [found]) == "use [SECRET] here"
    pii.spans("token=" * 100_000, 0.5)
    pii.spans("token=a " * 100_000, 0.5)


def test_digits_of_slices_nulls_and_empty_texts():
    texts = pa.array(["no", None, "a1", "", "é٣", "9", "x:y/"])  # digits are those of ASCII, as in the patterns
    want = [False, False, True, False, False, True, False]
    assert pii.have_digits(texts) == want and pii.have_digits(texts.slice(2, 3)) == want[2:5]
    assert pii.have_digits(texts.slice(0, 0)) == []


def test_prose_costs_little_more_than_a_scan_for_digits():
    text = "An ordinary sentence, with words and a comma. " * 40_000
    took = lambda f: min(timeit.repeat(f, number=1, repeat=3))
    scan = took(lambda: re.findall("[0-9]", text))
    assert took(lambda: pii.spans(text, 0.5)) < 12 * scan
    assert pii.spans(text, 0.5, False) == pii.spans(text, 0.5) == []
