import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sightline.llm.packing import byte_encoder, cut, differencing, op1_packing, pack, pack_block
from sightline.llm.sharding import SHARDS, interleave_shards, op7_shards
from sightline.llm.token_counts import count_tokens, merge_counter, op4_token_counts

SF = "/root/testdata/sf0.001"
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "a  b", " x\n y \n", "it's IT'S we'll", "ΑΣ ΟΔΟΣ Σ", "İstanbul", "é x ́", "a<|endoftext|>b <|startoftext|>", "\x1c\x1d a\x85b\xa0c d", "12345 ½ ²", "日本語 🎉🎉", "a" * 5000, "\x00 a \x00b", "don’t", "x\r\ny\tz", "ﬁ Å", "<| <|endoftext|", "a﻿b", "  q"]


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text or "" for r in rows}


def test_merge_counts_as_the_library(texts):
    library, own = Tokenizer.from_file(WORD), merge_counter(WORD)
    for t in [*ODD, *texts.values()]:
        assert own.count(t.encode()) == len(library.encode(t, add_special_tokens=False).ids), t[:80]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_merge_counts_any_text(t):
    assert merge_counter(WORD).count(t.encode()) == len(Tokenizer_word.encode(t, add_special_tokens=False).ids)


Tokenizer_word, Tokenizer_byte = Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_byte_ids_any_text(t):
    assert np.frombuffer(byte_encoder(BYTE).encode(t), "<u4").tolist() == Tokenizer_byte.encode(t, add_special_tokens=False).ids


def test_byte_ids_as_the_library(texts):
    for t in [*ODD, *texts.values()]:
        assert np.frombuffer(byte_encoder(BYTE).encode(t), "<u4").tolist() == Tokenizer_byte.encode(t, add_special_tokens=False).ids, t[:80]


@pytest.mark.parametrize("t", [" " * 30_000 + "abc", "x" + "\n" * 20_000 + " y  z", "  " * 8000 + "a" + " " * 12_000, " " * 10_000 + "<|endoftext|>" + " " * 10_001 + "b", "\x1c" * 20_000 + "a"], ids=range(5))
def test_byte_ids_of_long_white_space(t):
    assert np.frombuffer(byte_encoder(BYTE).encode(t), "<u4").tolist() == Tokenizer_byte.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("t", [" " * 2_000_000, "a" * 2_000_000, "!" * 2_000_000, "1." * 1_000_000, "a b" + "\u3000" * 1_000_000], ids=range(5))
def test_very_long_texts_are_encoded_and_counted(spark, t):
    ids = byte_encoder(BYTE).encode(t)
    docs = spark.createDataFrame([(1, t)], "doc_id long, text string")
    assert pack(docs, BYTE).agg({"length": "sum"}).first()[0] == len(ids) // 4 + 1
    assert (count_tokens(docs, WORD).first().n_tokens == 0) == (not t.strip())


def test_op4(spark, texts):
    rows = op4_token_counts(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(Tokenizer_word.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 2048)


def test_count_tokens_nulls_repeats_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, None, 9), (1, None, 9), (None, "a b", 8), (2, "", 7)], "doc_id long, text string, n_tokens long")
    rows = count_tokens(docs, WORD).select("doc_id", "n_tokens").collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == [(0, 2), (1, 0), (1, 0), (2, 0)]
    assert count_tokens(docs.limit(0), WORD).count() == 0


@given(st.lists(st.integers(1, 2048), max_size=60), st.integers(1, 9))
def test_differencing_deals_each_size_once(sizes, k):
    sets = differencing(sizes, k)
    assert sorted(i for s in sets for i in s) == list(range(len(sizes))) and len(sets) <= k
    assert all(sum(sizes[i] for i in w) <= 2048 for w in pack_block(sizes, 2048))


def test_differencing_known_case():
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in s) for s in differencing([8, 7, 6, 5, 4], 2)) == [14, 16]
    assert sorted(sum([4, 5, 6, 7, 8][i] for i in s) for s in differencing([4, 5, 6, 7, 8], 3)) == [8, 11, 11]


@given(st.integers(0, 10000))
def test_cut_covers(n):
    at = 0
    for s, length in cut(n, 2048, 512):
        assert s == at and 0 < length <= 2048
        at += length
    assert at == n


def check_pieces(rows, texts):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for d, t in texts.items():
        ids = np.array([*Tokenizer_byte.encode(t, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc.pop(d), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert not by_doc
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    return len(by_seq)


def test_op1_exact_and_little_padding(spark, texts):
    rows = op1_packing(spark, SF).collect()
    n = check_pieces(rows, texts)
    assert n * 2048 <= 1.05 * sum(r.length for r in rows)


def test_pack_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "x" * 30000, 3)], "doc_id long, text string, length int")
    check_pieces(pack(docs, BYTE).collect(), {1: "", 2: "", 3: "x" * 30000})
    assert pack(docs.limit(0), BYTE).count() == 0
    assert pack(docs.where("doc_id < 3"), BYTE, end_id=None).count() == 0
    kept = pack(docs, BYTE, keep_ids=True).where("doc_id = 2").first()
    assert kept.ids == (1).to_bytes(4, "little")
    large = spark.createDataFrame([(2**62 + 1, "a b"), (None, "c")], "doc_id long, text string").coalesce(1)
    assert sorted(r.doc_id or 0 for r in pack(large, BYTE).collect()) == [0, 2**62 + 1]
    twice = pack(docs.union(docs), BYTE).where("doc_id = 1").collect()
    assert len(twice) == 2


def test_op7_law(spark, texts):
    rows = op7_shards(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    slots = {s: [] for s in range(SHARDS)}
    for r in rows:
        b = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(b) + 8, zlib.crc32(b), "rows", None)
        slots[r.shard].append(r.slot)
    counts = [len(x) for x in slots.values()]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_shards_have_the_mixture(spark):
    rows = spark.range(9600).selectExpr("id as doc_id", "case when id % 3 = 0 then 'hot' when id % 7 = 0 then null else concat('s', id % 5) end as source", "1 as slot")
    out = interleave_shards(rows, 8)
    assert out.where("shard is null or slot is null").count() == 0
    n = {(r.source, r.shard): r["count"] for r in out.groupBy("source", "shard").count().collect()}
    for s in {k[0] for k in n}:
        each = [n.get((s, k), 0) for k in range(8)]
        assert max(each) - min(each) <= 2
    assert interleave_shards(rows.limit(0), 8).count() == 0
    assert interleave_shards(rows.union(rows), 8).count() == 19200
