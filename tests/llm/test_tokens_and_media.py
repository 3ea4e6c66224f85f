"""Operators 1, 5, 6, 7."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rasterloom.llm import common, idcoder, media, packing, piece_bpe, queries, tokens
from tests.conftest import DATA


def library(name):
    t = Tokenizer.from_file(queries.tokenizer_file(name))
    return lambda texts: [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


LATIN = st.text(st.sampled_from("abcXYZéÀßñ '\n\t.,!0129-_<|>ļ"), max_size=40)
PARTS = ["it's", "we'LL", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "\u2003", "\u0085", "\x1c", "\u200b", "’", "É", "à", "Σ", "İ", "é", "漢字", "😀", ".", ",", "a.b", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "\x00"]
MIXED = st.lists(st.sampled_from(PARTS), max_size=30).map("".join)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@given(st.lists(st.one_of(LATIN, MIXED, st.text(max_size=20), st.none()), max_size=20))
@settings(max_examples=100, deadline=None)
def test_ids_are_the_librarys(name, texts):
    ids, offsets = tokens.tokenizer(queries.tokenizer_file(name)).encode(pa.array(texts, pa.string()))
    assert [ids[a:z].tolist() for a, z in zip(offsets, offsets[1:])] == library(name)(texts)


def test_added_tokens_are_the_librarys():
    ids, _ = tokens.tokenizer(queries.tokenizer_file("byte_bpe_50k.json")).encode(pa.array(["a b<|endoftext|>c"]))
    assert 50256 in ids.tolist()


# ---- operator 1


@given(st.integers(0, 3000), st.integers(1, 6), st.integers(1, 300), st.integers(0, 2**32 - 1), st.booleans())
@settings(max_examples=40, deadline=None)
def test_id_blocks_round_trip(n, lanes, vocabulary, seed, repeat):
    rng = np.random.default_rng(seed)
    ids = (np.resize(rng.integers(0, vocabulary, 17), n) if repeat else rng.integers(0, vocabulary, n)).astype(np.uint32)
    blocks = idcoder.encode_blocks(ids, [(5, n)] if n else [], np.zeros(1 if n else 0), vocabulary, lanes=lanes, block=3000)
    assert np.array_equal(np.concatenate([b.ids for b in idcoder.decode_blocks(blocks)]), ids)
    if repeat and n > 2000 and vocabulary > 100 and lanes == 1:
        assert sum(map(len, blocks)) < n


def test_damaged_blocks():
    ids = np.arange(500, dtype=np.uint32) % 50
    (block,) = idcoder.encode_blocks(ids, [], np.zeros(0), 50, lanes=1, block=500)
    for bad in (b"XXXX" + block[4:], block[:10], block[:40] + bytes((block[40] ^ 16,)) + block[41:]):
        with pytest.raises(ValueError):
            list(idcoder.decode_blocks([bad]))
    with pytest.raises(ValueError):
        idcoder.encode_blocks(np.array([50], np.uint32), [], np.zeros(0), 50)


def ids_expected(rows):
    out, at = {}, 0
    for (doc, _), ids in zip(rows, library("word_bpe_49k.json")([t for _, t in rows])):
        ids = ids + [1]
        out[doc] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    return out


def test_op1(spark, documents):
    found = queries.op1_id_files(spark, DATA).collect()
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in found} == ids_expected(documents)


def test_id_files_of_odd_documents(spark, odd_docs, odd_texts, no_docs):
    path = queries.tokenizer_file("word_bpe_49k.json")
    found = idcoder.id_report(odd_docs, path).collect()
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in found} == ids_expected(odd_texts)
    assert idcoder.id_report(no_docs, path).count() == 0
    idcoder.write_ids(odd_docs, where := common.scratch_path(spark, "ids"), path)
    ids = {r["doc_id"]: r["ids"] for r in idcoder.read_ids(spark.read.parquet(where), with_ids=True).collect()}
    assert ids == {d: i + [1] for (d, _), i in zip(odd_texts, library("word_bpe_49k.json")([t for _, t in odd_texts]))}


# ---- operator 5


@given(st.lists(st.integers(1, 60), max_size=200))
@settings(max_examples=60, deadline=None)
def test_plans_pack_everything(lengths):
    counts = np.bincount(lengths, minlength=65)[:65] if lengths else np.zeros(65, np.int64)
    plan = packing.plan_packing(counts, 64)
    used = np.zeros(65, np.int64)
    for parts, times in plan:
        assert sum(n * k for n, k in parts) <= 64
        for n, k in parts:
            used[n] += k * times
    assert np.array_equal(used, counts)
    best_fit = sum(n for _, n in packing.fill_exactly(counts, 64, 0))
    assert sum(n for _, n in plan) <= best_fit


def test_exact_fills():
    counts = np.zeros(65, np.int64)
    counts[[40, 24, 30, 20, 14, 33, 16, 10, 5]] = 3
    plan = packing.fill_exactly(counts, 64, 3)
    assert ((40, 1), (24, 1)) in [p for p, _ in plan] and ((30, 1), (20, 1), (14, 1)) in [p for p, _ in plan]
    assert ((33, 1), (16, 1), (10, 1), (5, 1)) in [p for p, _ in plan]


def check_packing(rows, texts, end=0):
    ids = {d: i + [end] for (d, _), i in zip(texts, library("byte_bpe_50k.json")([t for _, t in texts]))}
    sequences, seen = {}, {}
    for r in rows:
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(piece, "<u4").tobytes()) == r["ids_crc32"] and len(piece) == r["length"]
        seen.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for doc, all_ids in ids.items():
        pieces = sorted(seen[doc])
        assert [p for p, _, _ in pieces] == list(range(-(-len(all_ids) // 2048)))
        assert [s for _, s, _ in pieces] == [sum(n for _, _, n in pieces[:k]) for k in range(len(pieces))]
        assert sum(n for _, _, n in pieces) == len(all_ids) and all(n == 2048 for _, _, n in pieces[1:])
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(map(len, ids.values()))
    return len(sequences), -(-total // 2048)


def test_op5(spark, documents):
    used, least = check_packing(queries.op5_packing(spark, DATA).collect(), documents)
    assert used <= least * 1.05 + 2


def test_packing_of_odd_documents(odd_docs, odd_texts, no_docs):
    path = queries.tokenizer_file("byte_bpe_50k.json")
    check_packing(packing.pack_documents(odd_docs, path).collect(), odd_texts)
    assert packing.pack_documents(no_docs, path).count() == 0
    with_ids = packing.token_pieces(odd_docs, path, with_ids=True).collect()
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in with_ids)


# ---- operator 6


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("tile", [0, 16])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("compression", sorted(media.PACK))
def test_tiff_round_trip(compression, predictor, tile, order):
    rng = np.random.default_rng(1)
    pages = [rng.integers(0, 4, (37, 53, 3)).astype(np.uint8), rng.integers(0, 60000, (20, 33)).astype(np.uint16), np.repeat(rng.integers(0, 255, (9, 10)).astype(np.uint8), 30, axis=1)]
    back = list(media.read_pages(media.write_tiff(pages, compression, predictor, 7, tile, order)))
    assert [b["data"] for b in back] == [p.tobytes() for p in pages] and [b["page_no"] for b in back] == [0, 1, 2]


@given(st.binary(max_size=3000), st.booleans())
@settings(max_examples=60, deadline=None)
def test_unpacking(data, repeat):
    data = data * 40 if repeat else data
    assert media.unpack_lzw(media.pack_lzw(data), len(data)) == data
    assert media.unpack_bits(media.pack_bits(data), len(data)) == data


def test_bad_tiffs(spark):
    good = media.write_tiff([np.arange(64, dtype=np.uint8).reshape(8, 8)] * 2)
    looped = bytearray(good)
    at = int.from_bytes(good[4:8], "little")
    n = int.from_bytes(good[at : at + 2], "little")
    looped[at + 2 + 12 * n : at + 6 + 12 * n] = good[4:8]
    contents = [None, b"", b"XXXX", good[:100], bytes(looped), good, good]
    rows = spark.createDataFrame([(k, bytearray(c) if c is not None else None, "clash") for k, c in enumerate(contents)], "k int, content binary, width string")
    found = media.tiff_pages(rows).collect()
    errors = {k: [r["error"] for r in found if r["k"] == k] for k in range(7)}
    assert all(errors[k][-1] for k in range(5)) and errors[5] == errors[6] == [None, None]
    assert media.tiff_pages(rows.limit(0)).count() == 0


def check_media(rows, texts):
    texts = dict(texts)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        padded = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        stored = media.text_media(raw)
        assert r["media_sha256"] == hashlib.sha256(stored).hexdigest() and r["media_bytes"] == len(stored) and r["feature"]
    assert len(rows) == len(texts)


def test_op6(spark, documents):
    check_media(queries.op6_media_tiff(spark, DATA).collect(), documents)


def test_media_of_odd_documents(odd_docs, odd_texts, no_docs):
    rows = media.media_digests(odd_docs).collect()
    check_media(rows, odd_texts)
    assert {r["n_pages"] for r in rows} == {1, 3} and media.media_digests(no_docs).count() == 0


# ---- operator 7


@pytest.fixture(scope="module")
def pieces():
    path = queries.tokenizer_file("piece_bpe_32k.model")
    return piece_bpe.model(path), sentencepiece.SentencePieceProcessor(model_file=path)


@given(text=st.one_of(LATIN, st.text(max_size=30), st.text(st.sampled_from("ab ▁ the in\n"), max_size=60)))
@settings(max_examples=300, deadline=None)
def test_pieces_are_the_librarys(pieces, text):
    own, lib = pieces
    ids = own.encode(text)
    assert ids == lib.encode(text) and own.decode(ids + [2]) == lib.decode(ids + [2])


@given(ids=st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31999)), max_size=12))
@settings(max_examples=200, deadline=None)
def test_any_ids_decode_like_the_library(pieces, ids):
    own, lib = pieces
    assert own.decode(ids) == lib.decode(ids)


@pytest.mark.parametrize("unit", ["aaaa" * 30, " " * 37, "th" * 300, "\n" * 20, "ingingingthethe" * 20])
def test_repetitive_units(pieces, unit):
    own, lib = pieces
    assert own.encode(unit) == lib.encode(unit)


def check_pieces(rows, texts, lib):
    texts = dict(texts)
    for r in rows:
        ids = lib.encode(texts[r["doc_id"]] or "") + [2]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())
    assert len(rows) == len(texts)


def test_op7(spark, documents, pieces):
    check_pieces(queries.op7_piece_bpe(spark, DATA).collect(), documents, pieces[1])


def test_pieces_of_odd_documents(odd_docs, odd_texts, no_docs, pieces):
    path = queries.tokenizer_file("piece_bpe_32k.model")
    check_pieces(piece_bpe.piece_digests(odd_docs, path).collect(), odd_texts, pieces[1])
    assert piece_bpe.piece_digests(no_docs, path).count() == 0
    back = piece_bpe.decode_column(piece_bpe.encode_column(odd_docs, path), path).collect()
    assert all(r["decoded"] == pieces[1].decode(r["ids"]) and r["ids"] == pieces[1].encode(r["text"] or "") for r in back)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_the_dealt_plan_reaches_the_bound(seed):
    """Single, pair and triple sums take part, every exact fill is full, and best fit of the rest wastes no sequence."""
    rng = np.random.default_rng(seed)
    lengths = np.minimum(2048, 1 + rng.lognormal(5.6, 1.3, 12_000).astype(np.int64))
    counts = np.bincount(lengths, minlength=2049)
    plan = packing.fill_exactly(counts, 2048, 3, packing.RESERVE)
    assert sum(n for _, n in plan) == -(-int(lengths.sum()) // 2048) and plan == packing.plan_packing(counts)
    full = {sum(k for _, k in parts) for parts, _ in plan if sum(length * k for length, k in parts) == 2048}
    assert {2, 3, 4} <= full
