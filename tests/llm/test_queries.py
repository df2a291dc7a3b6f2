"""Every registered query over the whole small tables: its contract's columns, their types, and what only the query adds."""

import hashlib
import zlib

import pytest

from pagefold.llm import chat, registry

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_chat_formatting": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op2_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op3_jaccard_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op4_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op5_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op6_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op7_licences": "doc_id bigint, licence string, dice double, n_places bigint",
    "op8_media_chunks": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op9_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op10_html_extraction": "page_id bigint, url string, text string, n_chars bigint",
    "op11_periodic_runs": "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string",
    "op12_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op13_source_divergence": "lang string, source string, part string, item string, value bigint, rank int",
}


@pytest.fixture(scope="module")
def found(spark):
    return {}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(spark, found, name):
    df = registry.QUERIES[name](spark, SF)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    assert {c: kinds.get(c) for c in (x.split(" ")[0] for x in COLUMNS[name].split(", "))} == dict(x.split(" ") for x in COLUMNS[name].split(", "))
    rows = found[name] = df.collect()
    if name not in ("op1_chat_formatting", "op7_licences", "op10_html_extraction", "op13_source_divergence"):
        docs = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
        assert {r.doc_id for r in rows} == docs and len(rows) == len(docs)


def test_what_the_queries_add(spark, found):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    extra = next(r for r in found["op1_chat_formatting"] if r.conv_id == -1)
    trap = chat.TRAP
    assert (extra.n_turns, extra.turns_sha256, extra.loss_chars, extra.loss_sha256) == (2, sha(f"user\n{trap}\nassistant\n{trap}\n"), len(trap), sha(trap))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in found["op4_toxicity"])
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5) for r in found["op12_quality"])
    for r in found["op2_pii"]:
        base = [s for s in r.spans.split(",") if s.split(":")[0] in ("email", "ip", "card", "phone")]
        assert r.base_sha256 == sha(",".join(base)) and len(base) == r.n_email + r.n_ip + r.n_card + r.n_phone
    assert all(r.contaminated == (r.n_hit > 0) and (r.n_items > 0 or r.items_sha256 == sha("")) for r in found["op5_decontamination"])
    assert all(r.n_chars == len(r.text) for r in found["op10_html_extraction"])
    start = 0
    for r in sorted(found["op9_token_files"], key=lambda r: r.doc_id):
        assert r.start == start and r.n_tokens >= 1
        start += r.n_tokens


def test_media_of_equal_texts_are_equal_and_as_they_are_stored(spark, found):
    from pagefold.llm import media

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    for r in found["op8_media_chunks"]:
        raw = texts[r.doc_id].encode()
        samples = raw + bytes(-len(raw) % 64) or bytes(64)
        header = b"RIFF" + (36 + len(samples)).to_bytes(4, "little") + b"WAVEfmt " + bytes([16, 0, 0, 0, 1, 0, 1, 0, 64, 31, 0, 0, 64, 31, 0, 0, 1, 0, 8, 0]) + b"data" + len(samples).to_bytes(4, "little")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(samples), hashlib.sha256(samples).hexdigest())
        assert (r.media_bytes, r.media_sha256, r.tail_crc32) == (len(samples) + media.HEADER, hashlib.sha256(header + samples).hexdigest(), zlib.crc32(samples[-64:]))
        bins = [0] * 8
        for b in samples:
            bins[b >> 5] += 1
        level = [b - 128 for b in samples]
        crossings = sum((a < 0) != (b < 0) for a, b in zip(level, level[1:], strict=False))
        want = f"mean={sum(samples) // len(samples)};power={sum(v * v for v in level) // len(level)};crossings={crossings};bins={'/'.join(map(str, bins))};chunks="
        assert r.feature.startswith(want) and r.feature[len(want) :].isdigit()
