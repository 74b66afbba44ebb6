"""Every registered operator query, as registered, against its contract by brute force."""

import hashlib
import zlib

import numpy as np
import pytest

from shoebox.llm import bpe_words, queries, simhash

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op2_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op3_media": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op4_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op5_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op6_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op7_embedding_dedup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op8_chunk_store": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op9_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op10_chunk_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op11_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op12_vector_codes": "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string",
    "op13_turn_repair": "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string",
}


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def ran(spark):
    cache = {}

    def run(name):
        if name not in cache:
            df = queries.QUERIES[name](spark, SF)
            cache[name] = dict(df.dtypes), [r.asDict() for r in df.collect()]
        return cache[name]

    return run


def ids_by_library(texts, name, end):
    tokenizer = bpe_words.load_tokenizer(queries.tokenizer_path(name))
    return {k: np.asarray(tokenizer.encode(t, add_special_tokens=False).ids + end, dtype="<u4") for k, t in texts.items()}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns(ran, name):
    types, _ = ran(name)
    assert all(types[c.split()[0]] == c.split()[1] for c in COLUMNS[name].split(", "))


def test_media(ran, texts):
    rows = {r["doc_id"]: r for r in ran("op3_media")[1]}
    assert rows.keys() == texts.keys()
    for k, text in texts.items():
        raw = text.encode()
        padded = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        want = {"n_bytes": len(raw), "payload_bytes": len(padded), "payload_sha256": hashlib.sha256(padded).hexdigest(), "tail_crc32": zlib.crc32(padded[-16:])}
        assert {c: rows[k][c] for c in want} == want
        height = len(padded) // 192
        samples = np.frombuffer(padded, np.uint8).reshape(height, 192).astype(np.int64)
        cut = lambda n: [(i * n // 8, max(i * n // 8 + 1, (i + 1) * n // 8)) for i in range(8)]
        cells = [samples[a:b, c:d].sum() for a, b in cut(height) for c, d in cut(192)]
        hash_ = "".join("1" if x * 64 > sum(cells) else "0" for x in cells)
        deviation = max(0.0, (samples ** 2).sum() / samples.size - (samples.sum() / samples.size) ** 2) ** 0.5
        assert rows[k]["feature"] == f"192x{height} mean={samples.sum() / samples.size:.4f} dev={deviation:.4f} ahash={int(hash_, 2):016x}"


def test_packing(ran, texts):
    ids, pieces = ids_by_library(texts, "word_bpe_49k.json", [2]), {}
    rows = ran("op4_packing")[1]
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
    assert pieces.keys() == texts.keys() and len({r["sequence_id"] for r in rows}) == len(rows)
    for k, want in ids.items():
        at = 0
        for r in sorted(pieces[k], key=lambda r: r["start"]):
            assert r["start"] == at and r["offset"] == 0 and r["length"].bit_count() == 1 and r["length"] <= 4096 and r["doc_tokens"] == len(want)
            assert r["ids_crc32"] == zlib.crc32(want[at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(want)


def test_fingerprints(ran, texts):
    rows = {r["doc_id"]: r for r in ran("op5_simhash")[1]}
    fps = {}
    for k, text in texts.items():
        hashes = simhash.shingle_hashes(text, 3)
        fps[k] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert rows[k]["fingerprint"] == f"{fps[k]:016x}"
    group = {k: k for k in fps}
    changed = True
    while changed:
        changed = False
        for k in fps:
            least = min(group[m] for m in fps if (fps[k] ^ fps[m]).bit_count() <= 3)
            changed |= least != group[k]
            group[k] = least
    assert {k: r["component_id"] for k, r in rows.items()} == group


def test_chunk_store(ran, texts):
    ids, start = ids_by_library(texts, "word_bpe_49k.json", [1]), 0
    rows = {r["doc_id"]: r for r in ran("op8_chunk_store")[1]}
    for k in sorted(ids):
        assert rows[k] == {"doc_id": k, "start": start, "n_tokens": len(ids[k]), "ids_crc32": zlib.crc32(ids[k].tobytes())}
        start += len(ids[k])


def test_chunk_bpe(ran, texts):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    tokenizer, ids = bpe_words.load_tokenizer(path), ids_by_library(texts, "byte_bpe_50k.json", [])
    rows = {r["doc_id"]: r for r in ran("op10_chunk_bpe")[1]}
    assert rows.keys() == ids.keys()
    for k, want in ids.items():
        decoded = tokenizer.decode(want.tolist(), skip_special_tokens=False).encode()
        assert rows[k] == {"doc_id": k, "n_tokens": len(want), "ids_sha256": hashlib.sha256(want.tobytes()).hexdigest(), "decoded_sha256": hashlib.sha256(decoded).hexdigest()}


@pytest.mark.parametrize("name", ["op6_toxicity", "op9_language"])
def test_learned(ran, texts, name):
    rows = {r["doc_id"]: r for r in ran(name)[1]}
    assert rows.keys() == texts.keys()
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for k, r in rows.items())
    if name == "op6_toxicity":
        assert all(r["predicted"] == (r["score"] >= 0.3) for r in rows.values())
    else:
        assert all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in texts[k])) for k, r in rows.items())
