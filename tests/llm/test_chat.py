import hashlib

from pyspark.sql import functions as F

from pagefold.llm import chat

KIND = "conv_id long, turn long, role string, text string, seq string, segment int"


def rows(spark, data):
    return spark.createDataFrame([(*r, "x", 1) for r in data], KIND)


def expected(turns):
    """turns: (role, text) in order."""
    h, loss, total, chars = hashlib.sha256(), hashlib.sha256(), 0, 0
    loss_chars = 0
    for role, text in turns:
        h.update(f"{role}\n{text}\n".encode())
        esc = lambda s: s.replace("\\", "\\\\").replace("<|", "<\\|")
        chars += len(f"<|im_start|>{esc(role)}".replace("\n", "\\n") + f"\n{esc(text)}<|im_end|>\n")
        if role == "assistant":
            loss.update(text.encode())
            loss_chars += len(text)
            total += chars
    return len(turns), h.hexdigest(), loss_chars, loss.hexdigest(), total


def check(spark, data, **kw):
    by = {}
    for c, t, r, x in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((r or "", x or ""))
    got = {r.conv_id: tuple(r)[1:6] for r in chat.read_back(chat.format_chat(rows(spark, data), **kw)).collect()}
    assert got == {c: expected(t) for c, t in by.items()}


def test_control_strings_nulls_ties_and_repeats(spark):
    trap = chat.TRAP
    check(spark, [
        (-1, 0, "user", trap), (-1, 1, "assistant", trap), (1, 0, None, None), (1, 1, "assistant", None), (1, 2, "user", "tail"),
        (2, 0, "user\nx", "a\\|b<\\|c\\\\"), (2, 0, "assistant", "t1"), (2, 0, "assistant", "t1"), (2, None, "system", "é😀"),
        (None, 0, "assistant", "no id"), (3, 5, "user", "only a question"),
    ])


def test_long_conversation_in_blocks(spark):
    data = [(7, i, "assistant" if i % 2 else "user", f"turn {i} " + "x" * (i % 5)) for i in range(57)] + [(7, 60, "assistant", "y" * 200_000)]
    check(spark, data, block=4)


def test_examples_have_all_earlier_turns_and_only_their_reply(spark):
    data = [(1, 0, "system", "s"), (1, 1, "user", "u<|im_end|>"), (1, 2, "assistant", "a\\1"), (1, 3, "user", "v"), (1, 4, "assistant", "b")]
    formatted = chat.format_chat(rows(spark, data))
    found = {r.seq: r for r in chat.assemble(formatted, formatted.where("is_example")).collect()}
    assert sorted(found) == [2, 4]
    assert [chat.unescape(found[k].text[found[k].loss_start : found[k].loss_end]) for k in (2, 4)] == ["a\\1", "b"]
    assert found[4].text.startswith(found[2].text) and found[4].text.count(chat.OPEN) == 5


def test_examples_of_turns_without_a_conversation_are_assembled(spark):
    data = [(None, 0, "user", "q"), (None, 1, "assistant", "r"), (2, 0, "assistant", "s"), (2, 0, "assistant", "s")]
    formatted = chat.format_chat(rows(spark, data))
    found = sorted(((r.conv_id, r.seq, chat.unescape(r.text[r.loss_start : r.loss_end])) for r in chat.assemble(formatted, formatted.where("is_example")).collect()), key=str)
    assert found == [(2, 0, "s"), (2, 1, "s"), (None, 1, "r")]


def test_empty(spark):
    assert chat.read_back(chat.format_chat(rows(spark, []))).collect() == []


def test_every_example_is_formatted_as_a_whole_and_read_back_from_there(spark):
    data = [(1, i, "assistant" if i % 3 else "user", f"t{i}<|") for i in range(9)] + [(1, 9, "user", "tail"), (2, 0, "user", "no reply"), (None, 0, "assistant", "r")]
    formatted = chat.format_chat(rows(spark, data), block=4).cache()
    own = [f"<|im_start|>{r}\n" + t.replace("<|", "<\\|") + "<|im_end|>\n" for c, _, r, t in data if c == 1]
    found = {r.seq: r for r in formatted.where("conv_id = 1").collect()}
    assert {k: r.text for k, r in found.items()} == {i: "".join(own[: i + 1]) if i % 3 else None for i in range(9)} | {9: None}
    assert all(r.example_chars == len(r.text) and r.text[r.loss_start : r.loss_end] == f"t{k}<\\|" for k, r in found.items() if r.text)
    back = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    assert (back[1].n_turns, back[1].n_examples, back[1].formatted_chars) == (10, 6, sum(len(r.text) for r in found.values() if r.text))
    changed = formatted.withColumn("text", F.replace("text", F.lit("t1"), F.lit("u1")))
    other = {r.conv_id: r for r in chat.read_back(changed).collect()}
    assert other[1].turns_sha256 != back[1].turns_sha256 and other[1].loss_sha256 != back[1].loss_sha256 and other[2] == back[2]
    formatted.unpersist()
