"""Ranges of members from chunks of any size, against the pass over the whole text."""

import json
import random
import tracemalloc

import pytest

from pagefold.functions import bytescan, jsontext


def value(rng, depth=0):
    pick = rng.random()
    if depth < 4 and pick < 0.3:
        return {rng.choice(["a", "b", "é", 'q"', "\\"]): value(rng, depth + 1) for _ in range(rng.randint(0, 4))}
    if depth < 4 and pick < 0.5:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return rng.choice([None, True, 0, -1.5, 1e-7, "", 'x\n"y\\', "😀{}[],:", 10**20])


def ranges(raw, size):
    return list(bytescan.member_ranges(raw[i : i + size] for i in range(0, len(raw), size)))


def test_ranges_equal_the_members():
    rng = random.Random(5)
    for i in range(300):
        text = json.dumps({f"k{j}": value(rng) for j in range(rng.randint(0, 5))} | {'"\\é': 1}, ensure_ascii=bool(i % 2), indent=rng.choice([None, 1]))
        raw = f" {text}\n".encode()
        for size in (1, 2, 7, 1000):
            found = ranges(raw, size)
            assert [(n, raw[a:b].decode()) for n, a, b in found] == [(n, own) for n, _, _, own in jsontext.members(raw.decode())], (text, size)


@pytest.mark.parametrize("text", ["", "[]", "1", '"a"', "{", '{"a"}', '{"a":1', '{"a":1,}', '{"a" 1}', '{"a":}', "{1:2}", '{"a":1]', '{"a":[}', '{"a":"x', '{"a":1}}', '{"a":1} x', "{,}", '{"a":1 "b":2}', '{"a"::1}', '{"' + "n" * 5000 + '":1}', '{"a":' + "[" * 20_000])
def test_texts_that_are_no_object(text):
    for size in (1, 3, 10_000):
        with pytest.raises(jsontext.Malformed):
            ranges(text.encode(), size)


def test_size_limit():
    assert list(bytescan.member_ranges([b'{"a":1}'], 7)) == [("a", 5, 6)]
    with pytest.raises(jsontext.Malformed, match="more than"):
        list(bytescan.member_ranges([b'{"a"', b":1}"], 6))


def test_memory_does_not_grow_with_the_document():
    def chunks(n):
        yield b'{"long":"'
        for _ in range(n):
            yield b"s" * 65_536
        yield b'","list":['
        for _ in range(n):
            yield b'{"a":[1,2,"x"]},' * 1000
        yield b'0],"end":true}'

    peaks = []
    for n in (10, 120):
        tracemalloc.start()
        found = list(bytescan.member_ranges(chunks(n)))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert [name for name, *_ in found] == ["long", "list", "end"] and found[0][2] - found[0][1] == n * 65_536 + 2
    assert peaks[1] < peaks[0] + 200_000
