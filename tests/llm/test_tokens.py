"""Token ids: packing, the chunk store, and chunked byte-level BPE."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from shoebox.llm import bpe_words, castore, chunkbpe, packing, queries, storage

WORD, BYTE = queries.tokenizer_path("word_bpe_49k.json"), queries.tokenizer_path("byte_bpe_50k.json")
library = {p: Tokenizer.from_file(p) for p in (WORD, BYTE)}
pieces = st.sampled_from(["the ", "Thnt", "'s", "'S", " é", "É", "\u0301", "日本", "<|endoftext|>", "<|", "\t", "\n\n", "  ", "12", "½", "ǅ", "ß", "İ", "Σ", "%%%", "it's", "_", "\u00a0", "\U0001F600", "\x00", "\u2028", "ﬁ"])
texts = st.lists(st.lists(pieces | st.text(max_size=5), max_size=30).map("".join), min_size=1, max_size=4)


def ids_of(path, text, end=None):
    return [*library[path].encode(text, add_special_tokens=False).ids, *([] if end is None else [end])]


@settings(max_examples=150, deadline=None)
@given(texts)
def test_piecewise_ids_are_the_library_s(found):
    ids, counts = bpe_words.word_encoder(WORD).encode(pa.array(found, pa.large_string()))
    want = [ids_of(WORD, t) for t in found]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


@settings(max_examples=150, deadline=None)
@given(texts, st.integers(1, 40))
def test_chunked_ids_are_the_library_s(found, step):
    encoder = chunkbpe.chunk_encoder(BYTE)
    for text in found:
        data = text.encode()
        cuts = [i for i in range(step, len(data), step) if data[i] & 0xC0 != 0x80] + ([len(data)] if data else [])
        ids = encoder.encode(data, cuts, 0)
        assert ids.tolist() == ids_of(BYTE, text)
        assert encoder.decode(ids).decode() == library[BYTE].decode(ids.tolist(), skip_special_tokens=False)


def test_decoding_broken_utf8_matches_the_library():
    encoder = chunkbpe.chunk_encoder(BYTE)
    ids = ids_of(BYTE, "日本\U0001F600é")
    for low in range(len(ids)):
        part = ids[low:-1]
        assert encoder.decode(np.asarray(part, dtype=np.uint32)).decode() == library[BYTE].decode(part, skip_special_tokens=False)


def test_long_texts_share_chunks():
    encoder = chunkbpe.ChunkEncoder(BYTE)
    passage = " ".join(f"word{i * 7919 % 1000}" for i in range(9000))
    column = pa.array([passage, "An opening, then: " + passage + " end", "x" * 100_000, ""], pa.large_string())
    found = chunkbpe.encode_column(encoder, column)
    assert [x.tolist() for x in found] == [ids_of(BYTE, t) for t in column.to_pylist()]
    chunks = sum(len(c) for c in encoder.known)
    assert chunks < 1.2 * (len(passage) + 100_000)


def test_encoding_odd_documents(spark, odd_docs, no_docs):
    got = chunkbpe.decode_ids(chunkbpe.encode_documents(odd_docs, BYTE), BYTE).collect()
    want = sorted((d["doc_id"] or 0, d["text"] or "") for d in odd_docs.collect())
    for r, (key, text) in zip(sorted(got, key=lambda r: r["doc_id"] or 0), want):
        assert (r["doc_id"] or 0) == key and np.frombuffer(r["ids"], "<u4").tolist() == ids_of(BYTE, text) and r["text_utf8"].decode() == text
    assert chunkbpe.encode_documents(no_docs, BYTE).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30_000), max_size=8), st.sampled_from([1, 2, 64, 4096]))
def test_pieces_are_falling_powers_of_two(lengths, limit):
    row, size = packing.power_pieces(np.asarray(lengths, dtype=np.int64), limit)
    for i, n in enumerate(lengths):
        own = size[row == i].tolist()
        assert sum(own) == n and own == sorted(own, reverse=True) and all(s & (s - 1) == 0 and s <= limit for s in own)
        assert len({s for s in own if s < limit}) == len([s for s in own if s < limit])


def test_limit_must_be_a_power_of_two():
    with pytest.raises(ValueError):
        packing.power_pieces(np.asarray([5]), 100)


def test_packing_odd_documents(spark, odd_docs, no_docs):
    rows = packing.pack_documents(odd_docs, WORD, 2, limit=64).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows) and all(r["offset"] == 0 and 1 << r["bucket"] == r["length"] for r in rows)
    whole = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"] or 0, r["sequence_id"] & ((1 << 58) - 1 << 34), r["piece"])):
        whole.setdefault(r["doc_id"], []).append(r)
    for d in odd_docs.collect():
        want = ids_of(WORD, d["text"] or "", 2)
        got = {r["start"]: np.frombuffer(r["ids"], "<u4").tolist() for r in whole[d["doc_id"]]}
        assert [i for s in sorted(got) for i in got[s]] == want
    assert packing.pack_documents(no_docs, WORD, 2).count() == 0


def test_store_round_trip(spark, odd_docs, no_docs):
    folder = storage.scratch(spark, "s")
    castore.write_store(odd_docs, folder, WORD, 1)
    got = castore.read_store(spark, folder).orderBy("start").collect()
    start = 0
    for r, (key, text) in zip(got, sorted((d["doc_id"], d["text"] or "") for d in odd_docs.collect() if d["doc_id"] is not None)):
        want = ids_of(WORD, text, 1)
        assert (r["doc_id"], r["start"], r["n_tokens"], np.frombuffer(r["ids"], "<u4").tolist()) == (key, start, len(want), want)
        start += len(want)
    assert len(got) == 9
    empty = storage.scratch(spark, "s")
    castore.write_store(no_docs, empty, WORD, 1)
    assert castore.read_store(spark, empty).count() == 0


def shared_store(spark):
    passage = " ".join(f"w{i * 31 % 997}" for i in range(6000))
    df = spark.createDataFrame([(i, f"intro {i} " + passage) for i in range(12)], "doc_id long, text string").repartition(4)
    folder = storage.scratch(spark, "s")
    castore.write_store(df, folder, WORD, 1)
    return folder


def test_chunks_are_stored_once(spark):
    folder = shared_store(spark)
    index = spark.read.parquet(f"{folder}/index")
    total = castore.read_store(spark, folder).groupBy().sum("n_tokens").first()[0]
    assert index.count() == index.select("name").distinct().count()
    assert index.groupBy().sum("n_ids").first()[0] < total / 6
    manifest = spark.read.parquet(f"{folder}/manifest")
    assert manifest.where("kind = 'pack'").groupBy().sum("rows").first()[0] == index.count()


def test_a_changed_byte_is_found(spark):
    folder = shared_store(spark)
    where = spark.read.parquet(f"{folder}/index").first()
    _, local = storage.open_fs(f"{folder}/packs/{where['pack']}")
    with open(local, "r+b") as file:
        file.seek(where["offset"])
        byte = file.read(1)
        file.seek(where["offset"])
        file.write(bytes([byte[0] ^ 1]))
    with pytest.raises(Exception, match="does not match its name"):
        castore.read_store(spark, folder).collect()


def test_cuts_depend_on_the_document_alone():
    rng = np.random.default_rng(1)
    doc, other = (rng.integers(0, 49_000, n).astype(np.uint32) for n in (20_000, 777))
    alone = castore.cut_points(doc, np.asarray([len(doc)]))[0]
    assert castore.cut_points(np.concatenate([other, doc]), np.asarray([len(other), len(doc)]))[1] == alone
    assert alone[-1] == len(doc) and max(np.diff([0, *alone])) <= castore.MOST
    assert castore.merkle_root([b"a"]) != castore.merkle_root([b"a", b"a"])
    assert zlib.crc32(doc.tobytes()) != zlib.crc32(other.tobytes())


def test_every_word_of_the_vocabulary_has_the_library_s_ids():
    encoder = bpe_words.WordEncoder(WORD)
    back = {c: b for b, c in bpe_words.byte_alphabet().items()}
    shown = [t.removesuffix("</w>") for t in encoder.tokenizer.get_vocab(False) if t.endswith("</w>")]
    raw = {t: bytes(map(back.__getitem__, t)) for t in shown if t}
    cores = {t: r.decode() for t, r in raw.items() if b"\x00" not in r and r.decode("utf-8", "ignore").encode() == r}
    assert len(cores) > 30_000
    ids, sizes = encoder.ranks.encode(list(cores.values()))
    ends = np.cumsum(sizes)
    assert all([x.id for x in encoder.tokenizer.model.tokenize(t)] == ids[e - n:e].tolist() for t, e, n in zip(cores, ends, sizes))


@pytest.mark.parametrize("part, keep", [("index", "n_ids > 0 and pack <> ''"), ("recipes", "doc_id <> 3"), ("manifest", "kind <> 'pack'"), ("index", "false"), ("recipes", "false"), ("seal", "false")])
def test_a_lost_row_of_any_part_is_found(spark, part, keep):
    docs = spark.createDataFrame([(i, f"text {i} " + "word " * i) for i in range(20)], "doc_id long, text string")
    folder = storage.scratch(spark, "store")
    castore.write_store(docs, folder, WORD, 1)
    assert castore.read_store(spark, folder).count() == 20
    rows = spark.read.parquet(f"{folder}/{part}")
    rest = rows.where(keep) if keep != "n_ids > 0 and pack <> ''" else rows.orderBy("offset").limit(rows.count() - 1)
    rest = storage.materialize(rest, "rest")
    rest.write.mode("overwrite").parquet(f"{folder}/{part}")
    with pytest.raises(castore.CorruptChunk):
        castore.read_store(spark, folder).count()


def test_an_altered_manifest_is_found(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(5)], "doc_id long, text string")
    folder = storage.scratch(spark, "store")
    castore.write_store(docs, folder, WORD, 1)
    altered = storage.materialize(spark.read.parquet(f"{folder}/manifest").selectExpr("kind", "part", "rows + 1 as rows", "ids", "root"), "rest")
    altered.write.mode("overwrite").parquet(f"{folder}/manifest")
    with pytest.raises(castore.CorruptChunk, match="seal"):
        castore.read_store(spark, folder)


def test_a_window_grows_until_it_agrees(monkeypatch):
    """Ids that a chunk has wrong at its ends are found by the comparison and replaced."""
    encoder = chunkbpe.ChunkEncoder(BYTE)
    text = " ".join(f"word{i * 7919 % 1000} und mehr" for i in range(3000))
    want = encoder._plain(text)
    right = encoder._chunk
    turn = iter(range(10**6))

    def wrong(chunk):
        ids, ends, *anchors = right(chunk)
        if next(turn) % 5 == 2:
            ids = ids.copy()
            ids[np.searchsorted(ends, anchors[0], "right")] ^= 1
        return ids, ends, *anchors

    monkeypatch.setattr(encoder, "_chunk", wrong)
    got = chunkbpe.encode_column(encoder, pa.array([text], pa.large_string()))[0]
    assert len(chunkbpe.cut_points(np.frombuffer(text.encode(), np.uint8), np.asarray([], dtype=int), 0, len(text))) > 1
    assert got.tolist() == want.tolist()
