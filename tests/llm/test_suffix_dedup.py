import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqloom.llm import suffix_dedup as D


def brute(docs, least):
    """Every string of every document, in order."""
    seen, out = set(), {}
    for d, t in sorted(docs):
        covered = bytearray(len(t))
        for p in range(len(t) - least + 1):
            w = t[p : p + least]
            if w in seen:
                covered[p : p + least] = b"\1" * least
            seen.add(w)
        kept = bytes(b for b, c in zip(t, covered, strict=True) if not c)
        runs = sum(1 for i, c in enumerate(covered) if c and (i == 0 or not covered[i - 1]))
        out[d] = (len(t), sum(covered), runs, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9))) for _ in range(60)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = [say(r.randint(1, 80)) for _ in range(12)]
    docs = [(-1, ""), (-2, "x" * 99), (-3, "x" * 100), (-4, None)]
    for k in range(140):
        x = r.random()
        if x < 0.15:
            t = r.choice(base)
        elif x < 0.5:
            t = say(r.randint(0, 30)) + r.choice(base)[r.randint(0, 40) :] + say(r.randint(0, 30))
        elif x < 0.7:
            t = list(r.choice(base) * 2)
            for _ in range(r.randint(0, 4)):
                t[r.randrange(len(t))] = "Z"
            t = "".join(t)
        elif x < 0.8:
            t = "é日🙂" * r.randint(0, 60) + say(5)
        elif x < 0.9:
            t = "x" * r.randint(0, 400) + "ab" * r.randint(0, 200)
        else:
            t = say(r.randint(0, 60))
        docs.append((k, t))
    r.shuffle(docs)
    return docs


@pytest.mark.parametrize(("seed", "crowd"), [(0, 2000), (1, 3), (2, 10)])
def test_equals_brute_force(spark, seed, crowd):
    docs = corpus(seed)
    rows = docs + docs[:20]  # rows that repeat a document, in other partitions
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).selectExpr("*", "doc_id AS place", "text AS anchor", "1 AS bucket")
    expected = brute([(d, (t or "").encode()) for d, t in docs], 100)
    got = D.removals(df, 100, crowd).collect()
    assert len(got) == len(rows)
    assert all(expected[r.doc_id] == (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)


def test_one_id_for_two_texts_and_null_ids(spark):
    a, b = "q" * 50 + "some words that are long enough " * 4, "some words that are long enough " * 4
    df = spark.createDataFrame([(1, a), (1, b), (None, b)], "doc_id long, text string")
    got = {(r.doc_id, r.n_bytes): r.n_removed for r in D.removals(df).collect()}
    assert got[None, 128] == sum(brute([(0, b.encode())], 100)[0][1:2])
    assert got[1, 178] == 128 and got[1, 128] == 128


def test_empty_table(spark):
    assert D.removals(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_stage_keeps_columns_and_whole_characters(spark):
    t = "é" * 120
    df = spark.createDataFrame([(1, t, "fr", "s", 120), (2, "a" + t, "fr", "s", 121), (3, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r for r in D.stage(spark, df, "").collect()}
    assert D.stage(spark, df, "").schema.names == ["doc_id", "text", "lang", "source", "n_chars"]
    assert out[2].text == "a" and out[2].n_chars == 1 and out[3].text is None


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(max_size=30).map(lambda b: bytes(x % 2 + 97 for x in b)), min_size=1, max_size=25), st.integers(0, 20))
def test_deep_shallow_sort(texts, shallow):
    order, common = D.deep_shallow_sort(texts, shallow)
    assert [texts[k] for k in order] == sorted(texts)
    for x, y, c in zip(order[:-1], order[1:], common[1:], strict=True):
        a, b = texts[x], texts[y]
        assert c == next((k for k, (p, q) in enumerate(zip(a, b, strict=False)) if p != q), min(len(a), len(b)))


def test_equal_strings_have_equal_anchors():
    r = random.Random(3)
    shared = bytes(r.choice(b"ab cd") for _ in range(180))
    x, y = b"z" * 77 + shared, bytes(r.choice(b"xyz") for _ in range(301)) + shared
    here = {p - 77 for p, _ in zip(*D.anchors(x, 100), strict=True)}
    there = {p - 301 for p, _ in zip(*D.anchors(y, 100), strict=True)}
    for s in range(81):
        assert {p for p in here & there if s <= p <= s + 68}


def test_long_text_is_cut_without_loss(monkeypatch):
    r = random.Random(4)
    text = bytes(r.choice(b"abcdefgh ") for _ in range(5000))
    whole = [x.tolist() for x in D.anchors(text, 100)]
    monkeypatch.setattr(D, "CHUNK", 700)
    assert [x.tolist() for x in D.anchors(text, 100)] == whole
