import hashlib
import random
import zlib

import numpy as np
import pytest

from pagefold.llm import media


def words(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(["alpha", "bravo", "é", "delta"]) + str(rng.randrange(50)) for _ in range(n))


def test_gear_hash_is_the_rolling_sum():
    raw = np.frombuffer(words(1, 50).encode(), np.uint8)
    h, want = 0, []
    for b in raw.tolist():
        h = ((h << 1) + int(media.GEAR[b])) & 0xFFFFFFFF
        want.append(h)
    assert media.gear(raw)[media.ROLL :].tolist() == want[media.ROLL :]


def test_cuts_are_within_bounds_and_follow_the_content():
    base, extra = words(2, 30_000).encode(), words(3, 100).encode()
    a, b = media.cuts([base, extra + base])
    for ends, n in ((a, len(base)), (b, len(extra + base))):
        sizes = np.diff([0, *ends])
        assert ends[-1] == n and sizes.max() <= media.MOST and sizes[:-1].min() >= media.LEAST
    shared = {e + len(extra) for e in a} & set(b)
    assert len(shared) > len(a) * 0.9
    assert media.cuts([base]) == [a] and media.cuts([b"x" * 40_000]) == [[16384, 32768, 40_000]]


def test_store_and_rebuild(spark):
    base = words(4, 8000)
    rows = [(1, base), (2, words(5, 300) + base), (3, base), (4, None), (5, ""), (5, ""), (None, "abc"), (7, base + base), (8, "x" * 63), (9, "y" * 64)]
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, key string, pack int")
    told, store = media.store(docs)
    assert told.count() == len(rows)
    assert store.select("key").distinct().count() == len({t or "" for _, t in rows})
    assert store.selectExpr("sum(size(drops)) n").first()["n"] > 5  # shared chunks are stored once
    found = told.join(media.read(store).dropDuplicates(["key"]), "key").collect()
    assert len(found) == len(rows)
    by = {}
    for key, text in rows:
        raw = (text or "").encode()
        by.setdefault((key, len(raw)), raw)
    for r in found:
        raw = by[r.id, r.n_bytes]
        padded = raw + bytes(-len(raw) % 64) or bytes(64)
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert r.media_bytes == len(padded) + media.HEADER
    assert media.read(media.store(docs.limit(0))[1]).collect() == []


def test_damage_is_found():
    medium = media.wav(media.payload("abc"))
    recipe = [{"digest": media.digest(medium), "length": len(medium)}]
    pack, key = zlib.compress(medium), hashlib.sha256(medium).digest()
    assert media.samples_of(media.rebuild(key, recipe, [], pack, {})) == b"abc" + bytes(61)
    with pytest.raises(ValueError):
        media.rebuild(hashlib.sha256(b"").digest(), recipe, [], pack, {})
    with pytest.raises(ValueError):
        media.rebuild(key, recipe, [0], zlib.compress(b""), {0: medium[:-1] + b"z"})
    with pytest.raises(ValueError):
        media.samples_of(b"RIFX" + medium[4:])
