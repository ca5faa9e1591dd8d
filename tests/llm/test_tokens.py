import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from seqloom.llm import packing as K
from seqloom.llm import token_counts as C

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "b", "the", "'s", "'r", "e", "'ll", "l", "'ve", " ", "  ", "\n", "\t", "\r", "\x1c", "\x85", " ", " ", "é", "É", "é", "日本", "🙂", "Σ", "ς", "İ", "1", "0", "23", "٣", "...", "%%%", "word.", "word!!", "x'", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|endof", "|>", "'"]
TEXT = st.lists(st.sampled_from(PARTS) | st.text(max_size=3), max_size=12).map("".join).filter(lambda t: all(not 0xD800 <= ord(c) < 0xE000 for c in t))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)


@settings(max_examples=250, deadline=None)
@given(TEXT)
def test_every_prefix_counts_as_the_library_says(library, text):
    c = C.counter(BYTES)
    expected = [len(library[0].encode(text[:k], add_special_tokens=False).ids) for k in range(1, len(text) + 1)]
    assert c.prefixes(text).tolist() == expected
    assert c.total(text) == (expected[-1] if text else 0)


@settings(max_examples=250, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_word_ids_equal_the_library(library, texts):
    encode = K._encoders.get(WORDS) or K.encoder(WORDS)
    got = [np.frombuffer(x, "<u4").tolist() for x in encode([t.encode() for t in texts])]
    assert got == [library[1].encode(t, add_special_tokens=False).ids for t in texts]


def test_memory_of_words_is_bounded(library, monkeypatch):
    monkeypatch.setattr(K, "REMEMBERED_WORDS", 50)
    encode, r = K.WordIds(WORDS), random.Random(1)
    for _ in range(30):
        t = " ".join("".join(r.choice("abcé.0") for _ in range(4)) for _ in range(40))
        assert np.frombuffer(encode([t.encode()])[0], "<u4").tolist() == library[1].encode(t, add_special_tokens=False).ids
        assert len(encode.known) < 50 + 200 and len(encode.known.before) < 50 + 200


def test_counts(spark, library):
    texts = [None, "", "hello world", "é" * 3, "x " * 1024, "x " * 1025, "don't <|endoftext|> 'll"]
    df = spark.createDataFrame([(k if k else None, t) for k, t in enumerate(texts)] + [(2, "hello world")], "doc_id long, text string").selectExpr("*", "1 AS n_bytes", "2 AS n_tokens")
    got = C.token_counts(df, BYTES).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        t = texts[r.doc_id or 0] or ""
        n = len(library[0].encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 1024)
    assert C.token_counts(df.limit(0), BYTES).count() == 0
    fit = {r.doc_id: r.fit_chars for r in C.truncation_points(C.prefix_counts(df.where("doc_id > 1"), BYTES), 3).collect()}
    for k, n in fit.items():
        counts = [len(library[0].encode(texts[k][:m], add_special_tokens=False).ids) for m in range(1, len(texts[k]) + 1)]
        assert n == max([0, *(m for m, c in enumerate(counts, 1) if c <= 3)]) == C.counter(BYTES).longest_fit(texts[k], 3)


def test_counts_of_very_long_texts(spark, library):
    texts = ["word, " * 200_000, "é\n" * 100_000, "a" * 5_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in C.token_counts(df, BYTES).collect()}
    for k, t in enumerate(texts):
        n = len(library[0].encode(t, add_special_tokens=False).ids)
        assert got[k] == (len(t.encode()), n, n > 1024)


def test_counts_of_a_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = C.op8(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: r.n_tokens for r in got} == {k: len(library[0].encode(t, add_special_tokens=False).ids) for k, t in texts.items()}


def check_packed(rows, texts, library, most, segments=512):
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for doc, own in pieces.items():
        ids = np.asarray([*library[1].encode(texts[doc] or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert pieces.keys() == texts.keys()
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= most and len(own) <= segments
    return sequences


def test_packing(spark, library):
    r = random.Random(2)
    texts = {k: " ".join(r.choice(["a", "bee", "sea!", "ü", "42"]) for _ in range(r.choice([0, 1, 5, 30, 200]))) for k in range(200)}
    texts |= {1000: None, 1001: ""}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").selectExpr("*", "1 AS length", "2 AS sequence_id").repartition(3)
    for segments in (512, 3):
        rows = K.packed_documents(df, WORDS, most=64, max_segments=segments).collect()
        check_packed(rows, texts, library, 64, segments)
    assert K.packed_documents(df.limit(0), WORDS).count() == 0
    full = K.op5(spark, "/root/testdata/sf0.001").collect()
    docs = {x.doc_id: x.text for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    sequences = check_packed(full, docs, library, 4096)
    total = sum(x.length for x in full)
    assert len(sequences) <= 1.05 * total / 4096 + 1


def test_all_three_limits(spark):
    rows = [(k, 10, 9 if k % 2 else 1) for k in range(100)] + [(k, 10, 9) for k in range(3)]
    df = spark.createDataFrame(rows, "k long, length long, loss_tokens long")
    out = K.pack(df, max_tokens=100, max_segments=6, max_loss=20).groupBy("sequence_id").agg({"length": "sum", "k": "count", "loss_tokens": "sum"}).collect()
    assert all(r["sum(length)"] <= 100 and r["count(k)"] <= 6 and r["sum(loss_tokens)"] <= 20 for r in out)
    assert sum(r["count(k)"] for r in out) == 103
    with pytest.raises(ValueError):
        K.pack(df, max_tokens=5)


def test_fill_prefers_what_there_is_room_for():
    sizes = np.array([[60, 1, 5], [40, 1, 5], [50, 1, 90], [50, 1, 10]], float)
    bins, place = K.fill(sizes, np.array([100.0, 10.0, 100.0]))
    assert len(set(bins.tolist())) == 2 and sorted(zip(bins.tolist(), place.tolist(), strict=True)) == [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_examples_with_columns_of_our_names(spark):
    rows = [(k, 10, 1, k % 3, -1, "x") for k in range(20)]
    df = spark.createDataFrame(rows, "_no long, length long, loss_tokens long, _group long, sequence_id long, offset string")
    out = K.pack(df, max_tokens=45).collect()
    assert sorted((r._no, r.length, r._group) for r in out) == [(k, 10, k % 3) for k in range(20)]
    assert sorted(r.offset for r in out) == [10 * (k // 5) for k in range(20)]


def test_pieces_of_null_ids_repeated_rows_and_long_texts(spark, library):
    long = "word " * 300_000
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None), (1, "a b"), (2, long)], "doc_id long, text string").selectExpr("*", "0 AS start", "0 AS doc_tokens")
    out = K.pieces(df, WORDS).collect()
    assert sorted((r.doc_id or 0, r.start, r.length) for r in out if r.doc_id != 2) == [(0, 0, 3), (0, 0, 3), (1, 0, 1), (1, 0, 3)]
    assert sum(r.length for r in out if r.doc_id == 2) == 300_001
    packed = K.packed_documents(df, WORDS).collect()
    assert len(packed) == len(out) and len({(r.sequence_id, r.offset) for r in packed}) == len(out)


def test_conversations_have_loss_where_the_assistant_speaks(spark, library, monkeypatch):
    monkeypatch.setattr(K, "TURNS", 7)
    r = random.Random(5)
    rows = [(c, t, r.choice(["user", "assistant", "assistant", None]), r.choice([None, "", "one two", "three, four five!", "é " * 9])) for c in (1, 2, 3, None) for t in range(1 if c == 3 else 40)]
    rows += [(1, 5, "assistant", "again"), (1, 5, "assistant", "again"), (2, None, "assistant", "before all")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS start", "2 AS length").repartition(3)
    wanted = {}
    for c in {x[0] for x in rows}:
        bears = []
        size = lambda t: len(library[1].encode(t or "", add_special_tokens=False).ids) + 1
        for _, _, role, text in sorted((x for x in rows if x[0] == c), key=lambda x: (x[1] is not None, x[1], x[2] is not None, x[2] or "", size(x[3]), zlib.crc32((x[3] or "").encode()))):
            bears += [role == "assistant"] * size(text)
        bears[0] = False
        wanted |= {(c, s): (len(bears[s : s + 16]), sum(bears[s : s + 16])) for s in range(0, len(bears), 16)}
    cut = K.conversation_pieces(df, WORDS, most=16)
    assert {(x.conv_id, x.start): (x.length, x.loss_tokens) for x in cut.collect()} == wanted
    packed = K.pack(cut, max_tokens=64, max_segments=9, max_loss=16).groupBy("sequence_id").agg({"length": "sum", "loss_tokens": "sum", "start": "count"}).collect()
    assert all(x["sum(length)"] <= 64 and x["sum(loss_tokens)"] <= 16 and x["count(start)"] <= 9 for x in packed)
    assert sum(x["count(start)"] for x in packed) == len(wanted)
    roomy = K.pack(cut, max_tokens=64, max_segments=9, max_loss=64).select("sequence_id").distinct().count()
    assert roomy < len(packed)  # the limit of loss binds
