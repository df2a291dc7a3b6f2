import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pagefold.llm import bpe, tokenfiles
from pagefold.llm.common import scratch_path

WORD_FILE, BYTE_FILE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PARTS = [" ", "  ", "\n", "\t", "a", "B", "é", "ß", "'S", "'s", "'", ".", "12", "<|endoftext|>", "<|ENDOFTEXT|>", "中", "́", " ", "　", "😀", "É", "\r\n", "%%%", "\x85", "\x1c", "Σ", "J̌", "İ", "²", "foo,", "Bar.", "word"]


def texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def library(file):
    t = Tokenizer.from_file(file)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t in enumerate(texts(1, 3000))] + [(None, "no id"), (-3, None), (-2, ""), (5000, "long Words " * 40_000), (7, "again"), (7, "again")]
    return rows, spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, ids string, block int")


def test_word_bpe_equals_the_library_and_decodes(docs):
    rows, frame = docs
    t = library(WORD_FILE)
    want = []
    for key, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((key, ids, t.decode(ids, skip_special_tokens=False)))
    encoded = bpe.encode(frame, WORD_FILE)
    got = [(r.doc_id, list(r.ids), r.decoded) for r in encoded.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sorted(((r.doc_id, r.decoded) for r in bpe.decode(encoded, WORD_FILE).collect()), key=repr) == sorted(((k, d) for k, _, d in want), key=repr)
    digests = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode(frame, WORD_FILE, want="digests").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert digests == {(k, len(i), sha(" ".join(map(str, i))), sha(d)) for k, i, d in want}


def test_word_bpe_in_small_blocks(docs, monkeypatch):
    monkeypatch.setattr(bpe, "ROW_WORDS", 50)
    rows, frame = docs
    t = library(WORD_FILE)
    got = sorted(((r.doc_id, list(r.ids)) for r in bpe.encode(frame, WORD_FILE, want="ids", block_chars=2000).collect()), key=repr)
    assert got == sorted(((k, t.encode(x or "", add_special_tokens=False).ids) for k, x in rows), key=repr)


def test_word_bpe_of_nothing(docs):
    assert bpe.encode(docs[1].limit(0), WORD_FILE).collect() == []


def test_byte_bpe_equals_the_library():
    t, own = library(BYTE_FILE), tokenfiles.ByteBpe(BYTE_FILE, RANKS, "<u2")
    for text in texts(2, 20_000):
        assert np.frombuffer(own.ids(text), "<u2").tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_token_files_round_trip(spark, docs):
    rows, frame = docs
    folder = scratch_path(spark, "test-files")
    manifest = tokenfiles.write(frame, folder, BYTE_FILE, RANKS, end_id=2)
    t, start, want = library(BYTE_FILE), 0, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in tokenfiles.read(spark, folder, manifest).collect()]
    assert sorted(got, key=lambda r: r[1]) == want and sum(m["n_ids"] for m in manifest) == start


def test_token_files_of_nothing(spark, docs):
    folder = scratch_path(spark, "test-files")
    assert tokenfiles.read(spark, folder, tokenfiles.write(docs[1].limit(0), folder, BYTE_FILE, RANKS, end_id=2)).collect() == []


def test_files_of_a_store_are_read_by_ranges(spark, docs, monkeypatch):
    """The same through a file system that has no local paths, as a remote store has none."""
    frame = docs[1].where("doc_id < 400 or doc_id is null")
    folder = scratch_path(spark, "ids")
    manifest = tokenfiles.write(frame, folder, BYTE_FILE, RANKS, end_id=2)
    want = sorted(map(tuple, tokenfiles.read(spark, folder, manifest).collect()), key=repr)
    near = tokenfiles.Files(folder)

    class Far(tokenfiles.Files):
        def __init__(self, uri):
            from pyarrow import fs

            self.at = tokenfiles.re.sub(r"^file:(//)?(?=/)", "", uri)
            self.fs = fs.LocalFileSystem()

    monkeypatch.setattr(tokenfiles, "Files", Far)
    assert sorted(map(tuple, tokenfiles.read(spark, folder, manifest).collect()), key=repr) == want and len(want) > 400
    again = scratch_path(spark, "ids")
    written = tokenfiles.write(frame, again, BYTE_FILE, RANKS, end_id=2)
    assert sorted(map(tuple, tokenfiles.read(spark, again, written).collect()), key=repr) == want
    far = Far(folder).mapped(f"{manifest[0]['name']}.ids", "<u2")
    whole = near.mapped(f"{manifest[0]['name']}.ids", "<u2")
    assert isinstance(far, tokenfiles.Ranged) and len(far) == len(whole)
    for a, b in ((0, 5), (3, 3), (7, 400), (len(whole) - 2, len(whole) + 9)):
        assert (far[a:b] == whole[a:b]).all()
