import base64
import hashlib
import random
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import same
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from seqloom.llm import decontamination as D
from seqloom.llm import licenses as L
from seqloom.llm import sharding as S
from seqloom.llm import warc as W

SF = "/root/testdata/sf0.001"


# --- WARC ------------------------------------------------------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=300), st.integers(1, 50), st.integers(40, 200))
def test_records_round_trip(payload, chunk, segment):
    assert W.dechunked(W.chunked(payload, chunk)) == payload
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    records = W.response_records(7, "http://x", payload, digest, segment)
    rows = sorted((W._row(f, b) for f, b in W.parsed(b"".join(r + W.END for r in records))), key=lambda r: (r[0], r[7] or 0))
    if len(records) > 1:
        assert [r[7] for r in rows] == list(range(1, len(records) + 1)) and len({r[0] for r in rows}) == 1
        assert W._checked(b"".join(r[5] for r in rows), digest, "x") == payload
    else:
        assert rows[0][5] == payload


def test_broken_framing_is_an_error():
    for bad in (b"", b"5\r\nabc\r\n0\r\n\r\n", b"zz\r\n", b"3\r\nabcd\r\n0\r\n\r\n"):
        with pytest.raises(ValueError):
            W.dechunked(bad)
    assert W.dechunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: v\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        list(W.parsed(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"))


PAGES = [(1, "u", ""), (2, None, None), (3, "http://x\r\ny", "é" * 9000), (4, "u", "é" * 9000), (4, "u", "é" * 9000), (5, "v", "a\r\n\r\nb"), (6, "v", "WARC/1.1\r\n\r\n"), (7, "q", "z" * 70000), (7, "q", "z" * 70000), (8, "q", "z" * 16000)]


def expected_pages(pages):
    payloads = [(p, (h or "").encode()) for p, _, h in pages]
    last = {}
    for p, b in payloads:
        last[b] = max(last.get(b, p), p)
    return sorted((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if last[b] == p else "revisit", None if last[b] == p else last[b]) for p, b in payloads)


def test_pages_round_trip(spark, tmp_path):
    spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "'x' AS sha1", "1 AS keeper").repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    rows = W.op7(spark, str(tmp_path)).collect()
    key = lambda r: (r[0], r[1], r[2], r[3], r[4] is not None, r[4])
    assert sorted((tuple(r) for r in rows), key=key) == sorted(expected_pages(PAGES), key=key)


def test_payloads_and_limits(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    W.write_archives(df, str(tmp_path / "w"), least_bytes=17_000, segment=500)
    got = W.read_archives(spark, str(tmp_path / "w")).collect()
    assert sorted(bytes(r.payload).decode() for r in got if r.record_type == "response") == sorted([h or "" for p, _, h in PAGES if p != 3])
    assert [r.url for r in got if r.record_type == "revisit"] == ["http://x y"]


def test_missing_segment_is_an_error(spark, tmp_path):
    import gzip

    digest = base64.b32encode(hashlib.sha1(b"x" * 900).digest()).decode()
    records = W.response_records(1, "u", b"x" * 900, digest, 200)
    with gzip.open(tmp_path / "a.gz", "wb") as f:
        f.write(b"".join(r + W.END for k, r in enumerate(records) if k != 1))
    with pytest.raises(PySparkException):
        W.read_archives(spark, str(tmp_path)).collect()


def test_archive_with_a_member_for_each_record(spark, tmp_path):
    import gzip

    payloads = [b"one", b"", b"x" * 200_000, bytes(range(256)) * 900, b"last"]
    records = [r + W.END for k, p in enumerate(payloads) for r in W.response_records(k, "u", p, base64.b32encode(hashlib.sha1(p).digest()).decode(), 50_000)]
    members = b"".join(map(gzip.compress, records))
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "a.warc.gz").write_bytes(members)
    assert sorted(bytes(r.payload) for r in W.read_archives(spark, str(tmp_path / "a")).collect()) == sorted(payloads)
    (tmp_path / "a" / "b.warc").write_bytes(b"".join(records[:1]))
    assert sorted(bytes(r.payload) for r in W.read_archives(spark, str(tmp_path / "a")).collect()) == sorted([*payloads, b"one"])
    for bad in (members + b"garbage", members[:-9], members + b"\x1f"):
        (tmp_path / "a" / "b.warc.gz").write_bytes(bad)
        with pytest.raises((PySparkException, Py4JJavaError)):
            W.read_archives(spark, str(tmp_path / "a")).collect()


def test_archive_of_another_writer(spark, tmp_path):
    """Records of all types, a member each; a long request and a long response in segments; revisits without a length;
    digests of other kinds; a response that isn't HTTP."""
    import gzip

    def made(kind, name, block, *fields):
        return W.record([("WARC-Type", kind), ("WARC-Record-ID", name), *fields], block) + W.END

    http = b"HTTP/1.1 200 OK\r\nX\r\nTransfer-Encoding: chunked\r\n\r\n" + W.chunked(b"\xff\x00\r\n\r\nbody" * 50)
    records = [
        made("warcinfo", "<i>", b"software: x\r\n"),
        made("request", "<q>", b"GET / HTTP/1.1\r\n", ("WARC-Segment-Number", "1")),
        made("metadata", "<m>", b"fetchTimeMs: 3\r\n\r\n"),
        made("response", "<r>", http[:100], ("WARC-Segment-Number", "1"), ("WARC-Payload-Digest", "md5:abc")),
        made("continuation", "<c2>", b"Host: x\r\n\r\n", ("WARC-Segment-Number", "2"), ("WARC-Segment-Origin-ID", "<q>"), ("WARC-Segment-Total-Length", "27")),
        made("continuation", "<c1>", http[100:], ("WARC-Segment-Number", "2"), ("WARC-Segment-Origin-ID", "<r>"), ("WARC-Segment-Total-Length", str(len(http)))),
        made("revisit", "<v>", b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n", ("WARC-Refers-To", "<r>")),
        made("revisit", "<w>", b""),
        made("response", "<d>", b"dns answer", ("Content-Type", "text/dns")),
        made("conversion", "<t>", b"text"),
    ]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    got = {r.record_id: r for r in W.read_archives(spark, str(tmp_path)).collect()}
    assert got.keys() == {"<r>", "<v>", "<w>", "<d>"}
    assert bytes(got["<r>"].payload) == b"\xff\x00\r\n\r\nbody" * 50 and got["<r>"].payload_digest == "md5:abc"
    assert bytes(got["<d>"].payload) == b"dns answer"
    assert got["<v>"].payload_bytes is got["<w>"].payload_bytes is None and got["<v>"].refers_to_id == "<r>"


def test_null_and_repeated_page_ids(spark, tmp_path):
    pages = [(None, "u", "alone"), (None, "u", "shared"), (3, None, "shared"), (3, None, "shared"), (None, None, None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in W.op7(spark, str(tmp_path)).collect())
    assert got == [(0, 0, "response", None), (0, 5, "response", None), (0, 6, "revisit", 3), (3, 6, "response", None), (3, 6, "response", None)]


def test_no_pages(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert W.op7(spark, str(tmp_path)).count() == 0


# --- sharding --------------------------------------------------------------------------------------------------------


def plain_shards(rows, limit):
    """Buckets split bit by bit."""
    h = lambda k: format(int(hashlib.md5(("" if k is None else str(k)).encode()).hexdigest()[:15], 16), "060b")
    done, todo = {}, {"": rows}
    while todo:
        p, own = todo.popitem()
        if sum(n for _, n in own) <= limit or len({k for k, _ in own}) < 2:
            done["s" + p] = own
        else:
            for bit in "01":
                if part := [r for r in own if h(r[0])[len(p)] == bit]:
                    todo[p + bit] = part
    return done


@pytest.mark.parametrize("limit", [1, 700, 5000, 10**9])
def test_shards_equal_splitting_bit_by_bit(spark, limit):
    r = random.Random(limit)
    rows = [(k, r.randint(0, 900)) for k in range(400)]
    df = spark.createDataFrame(rows, "key long, n_bytes long").repartition(3)
    expected = {k: s for s, own in plain_shards(rows, limit).items() for k, _ in own}
    got = S.shards(df, limit).collect()
    assert {x.key: x.shard for x in got} == expected
    assert all(x.shard_bytes <= limit or x.shard_rows == 1 for x in got)


def test_a_hot_key_is_parted(spark):
    rng = np.random.default_rng(0)
    rows = [(7 if k < 500 else None if k < 503 else k, int(rng.integers(0, 5000))) for k in range(1000)] + [(7, None), (7, 20_000)]
    df = spark.createDataFrame(rows, "key long, n_bytes long").repartition(4)
    got = S.shards(df, 8000).toPandas()
    assert len(got) == len(rows)
    size = got.groupby("shard").n_bytes.agg(["sum", "size"])
    assert ((size["sum"] <= 8000) | (size["size"] == 1)).all()
    assert (got.groupby("shard").n_bytes.sum() == got.groupby("shard").shard_bytes.first()).all()
    assert S.shards(df.limit(0)).count() == 0


def test_shards_of_rows_with_other_columns(spark):
    df = spark.createDataFrame([(k % 7, 10, "x", 1, "y") for k in range(50)] + [(None, None, "x", 1, "y")], "key long, n_bytes long, shard string, depth int, h string")
    got = S.shards(df, 60).collect()
    assert len(got) == 51 and {r.key for r in got} == {*range(7), None}
    assert all(r.shard_bytes <= 60 for r in got) and S.shards(df.limit(0), 60).count() == 0


def test_shards_equal_their_sql(spark):
    same(S.op2(spark, SF), S.OP2_SQL, SF)


# --- licences --------------------------------------------------------------------------------------------------------


def test_licences_equal_their_sql(spark):
    same(L.op1(spark, SF), L.OP1_SQL, SF)


def test_licences(spark):
    mit = "Copyright (c) 2020 Someone\n\n" + dict(reversed(L.KNOWN))["MIT"]
    texts = [None, "", "...\n(c) x", mit, L._MIT.upper().replace(",", " -"), L._ISC.replace("ISC", "isc"), "Some text\nReleased under the MIT licence\nLicensed under CC BY-NC 4.0!\n# released under the mit license", L._MIT + " and more", "x" * 300_000]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(None, "Licensed under CC BY 4.0")], "doc_id long, text string").selectExpr("*", "'x' AS digest", "'y' AS licence")
    got = {r.doc_id: r for r in L.licence_scan(df, L.known_digests(spark)).collect()}
    assert len(got) == len(texts) + 1
    assert [got[k].licence for k in range(9)] == [None, None, None, "MIT", "MIT", "ISC", None, None, None]
    assert got[0].digest is got[1].digest is got[2].digest is None and got[8].digest
    assert (got[6].n_licence_lines, got[6].line_licences) == (3, "CC-BY-NC-4.0,MIT") and got[None].licence == "CC-BY-4.0"
    assert L.licence_scan(df.limit(0), L.known_digests(spark)).count() == 0
    full = [(k, "Copyright 2020 X\n\n" + t.upper().replace(",", "").replace("\n", " \n ")) for k, (n, t) in enumerate(L.KNOWN) if len(t) > 1000]
    found = {r.doc_id: r.licence for r in L.licence_scan(spark.createDataFrame(full, "doc_id long, text string"), L.known_digests(spark)).collect()}
    assert found == {k: n for k, (n, t) in enumerate(L.KNOWN) if len(t) > 1000} and len(found) > 15


# --- decontamination -------------------------------------------------------------------------------------------------


def plain_overlap(words, item, similarity=0.8, stretch=13):
    """(length, matches, start) of the best overlap: of each diagonal the stretch that ends last, from its first possible
    start on; of these the one with most matches, the first of equals. All diagonals are tried."""
    least, best = min(stretch, len(item)), None
    for shift in range(-len(item) + 1, len(words)):
        same_ = [0 <= k + shift < len(words) and words[k + shift] == w for k, w in enumerate(item)]
        if sum(same_) < similarity * least - 1e-9:
            continue
        good = [(j, -i) for i in range(len(item)) for j in range(i + least, len(item) + 1) if sum(same_[i:j]) >= similarity * (j - i) - 1e-9]
        if good:
            j, i = max(good)
            i = -i
            own = (sum(same_[i:j]), -(i + shift), j - i)
            best = max(best or own, own)
    return best and (best[2], best[0], max(0, -best[1]))


def test_masks_miss_no_overlap():
    """Every placement of as many substitutions as an overlap may have leaves a window whose picked words are unlike none."""
    for n in range(1, 26):
        masks = D.MASKS[D.family_of(n)]
        picked = [(len(m), [k for k, c in enumerate(m) if c == "1"]) for m in masks]
        for unlike in combinations(range(n), n - -(-4 * n // 5)):
            assert any(not set(unlike) & {at + k for k in own} for size, own in picked for at in range(n - size + 1)), (n, unlike)


def test_overlaps_equal_brute_force(spark, monkeypatch):
    r = random.Random(6)
    vocabulary = [f"w{k}" for k in range(200)]
    say = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [say(n) for n in (1, 2, 3, 4, 5, 6, 9, 10, 13, 16, 30, 50)] + [["same"] * 20]
    docs = []
    for _ in range(120):
        w = list(r.choice(items))
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        cut = r.choice([0, 0, 3]) if len(w) > 20 else 0
        docs.append(say(r.randint(0, 30)) + w[cut:] + say(r.randint(0, 30)))
    docs += [say(60) for _ in range(40)] + [[], ["same"] * 300, docs[0]]
    rows = [(k, " ".join(d).upper().replace("W1 ", "W1, ").replace("W2 ", "W2\n--\t")) for k, d in enumerate(docs)]
    df = spark.createDataFrame([*rows, (999, None), (999, "!? ..."), rows[5]], "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS hashes")
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)] * 2 + [(50, None), (51, "..."), (12, "other words here")], "item_id long, text string").selectExpr("*", "1 AS doc_id", "'x' AS words")
    found = ((d, k, plain_overlap(docs[d], x)) for d, _ in [*rows, rows[5]] for k, x in enumerate(items))
    expected = sorted((d, k, *x) for d, k, x in found if x)
    for bits in (28, 6):  # a filter that lets nearly everything pass changes nothing
        monkeypatch.setattr(D, "MOST_BITS", bits)
        assert sorted((x.doc_id, x.item_id, x.n_words, x.n_matches, x.start_word) for x in D.contaminated(df, bench).collect()) == expected


def test_decontamination_of_nothing_nulls_and_long_texts(spark):
    docs = spark.createDataFrame([(None, "x y z"), (1, "x y z"), (2, "word " * 300_000 + "x Y z!")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert D.contaminated(docs, bench).count() == 0
    assert D.contaminated(docs.limit(0), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0
    got = D.contaminated(docs, spark.createDataFrame([(None, "X, Y, Z"), (1, "word " * 40)], "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id, x.n_words, x.n_matches, x.start_word) for x in got} == {(None, None, 3, 3, 0), (1, None, 3, 3, 0), (2, None, 3, 3, 300_000), (2, 1, 40, 40, 0)}
    with pytest.raises(ValueError):
        D.contaminated(docs, bench, similarity=0.7)


def test_decontamination_query_equals_brute_force(spark):
    docs, bench = ({r[0]: r[1] for r in spark.read.parquet(f"{SF}/{t}.parquet").select(k, "text").collect()} for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    bare = lambda t: [w for w in (w.strip(D.ENDS) for w in t.lower().split()) if w]
    number = {}
    of = lambda t: np.array([number.setdefault(w, len(number)) for w in bare(t)], np.int64)
    items, expected = {k: of(t) for k, t in bench.items()}, set()
    for d, t in docs.items():
        words = of(t)
        padded = np.concatenate([np.full(100, -1), words, np.full(100, -1)])
        for k, x in items.items():
            windows = np.lib.stride_tricks.sliding_window_view(padded, len(x))
            if (windows == x).sum(axis=1).max() >= 0.8 * min(13, len(x)) and (o := plain_overlap(words.tolist(), x.tolist())):
                expected.add((d, k, *o))
    got = D.op4(spark, SF).collect()
    assert {(r.doc_id, r.item_id, r.n_words, r.n_matches, r.start_word) for r in got} == expected and len(got) == len(expected) > 2


def test_every_known_licence_is_found_at_every_width(spark):
    """Paragraphs wrapped anew, with and without comment marks, and a copyright line of one's own before them."""
    import re
    import textwrap

    rows = []
    for licence, text in L.KNOWN:
        parts = re.split(r"\n[ \t]*\n", text)
        for width in range(30, 121, 5 if len(text) < 5000 else 30):
            for mark in ("", " * ", "# "):
                lines = ["\n".join(mark + x for x in textwrap.wrap(p, width, break_long_words=False, break_on_hyphens=False)) for p in parts]
                rows.append((len(rows), licence, f"{mark}Copyright (c) 2019 Some Body\n{mark}\n" + f"\n{mark.rstrip()}\n".join(lines)))
    df = spark.createDataFrame([(k, t) for k, _, t in rows], "doc_id long, text string").repartition(8)
    found = {r.doc_id: r.licence for r in L.licence_scan(df, L.known_digests(spark)).collect()}
    assert [(k, x) for k, x, _ in rows if found[k] != x] == []
