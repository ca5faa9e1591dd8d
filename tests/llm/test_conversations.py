"""Prefix trie and chat formatting against plain Python."""

import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqloom.llm import chat_format as C
from seqloom.llm import prefix_trie as P

SF = "/root/testdata/sf0.001"
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sequences_of(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn, role or "", text or ""))
    return {c: [t[1:] for t in sorted(ts, key=lambda t: (t[0] is not None, t[0] or 0))] for c, ts in convs.items()}


def rebuilt(convs):
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in convs}
    return {c: convs.get(c - c % 20, [])[: h[c]] + ts[h[c] :] for c, ts in convs.items()}


def trie(convs):
    """Rows of every node, by definition."""
    members = {}
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = children.get(p, [])
        leaves[p] = sum(leaves[x] for x in below) or 1
        own = (len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved[p] = own + sum(saved[x] for x in below)
    for p, own in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in own if len(convs[c]) == len(p)))
        yield min(own), len(p), min(members[p[:-1]]) if p else None, len(own), len(children.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()


def order(rows):
    return sorted(rows, key=repr)


def digests(nodes, members):
    ends = {r.ends_key: r.ends_sha256 for r in P.end_digests(members).collect()}
    return [tuple(r[c] for c in NODE[:-1]) + (ends.get(r.ends_key, hashlib.sha256(b"").hexdigest()),) for r in nodes.collect()]


@pytest.mark.parametrize(("local", "share", "few", "hot", "run"), [(1024, 1 / 65536, 64, 1 / 1024, 4096), (3, 0.0, 0, 0.01, 2), (40, 0.0, 2, 1.0, 3)])
def test_trie_by_definition(spark, monkeypatch, local, share, few, hot, run):
    """Copies, beginnings of one another, hot turns, a long shared beginning; nulls, repeated rows, clashing columns."""
    for name, value in (("LOCAL_IDS", local), ("SHARE", share), ("FEW", few), ("HOT", hot), ("RUN", run)):
        monkeypatch.setattr(P, name, value)
    r = random.Random(local)
    rows = []
    for c in range(150):
        n = 11 if c % 5 == 0 else r.randrange(0, 6)
        shared = [("user", "a very common beginning"), ("assistant", "b"), *[("user", "deep")] * 7]
        own = shared[:n] if c % 5 == 0 else []
        while len(own) < n:
            own.append((r.choice(["user", "assistant", None]), r.choice(["x", "x y", "", None, "é\x0b z", "　w"])))
        rows += [(c * 7 if c % 3 else c, k, *t) for k, t in enumerate(own)]
    rows += [(100_000, None, "user", "first"), (100_000, 0, "user", "second"), (100_001, 5, "user", "same"), (100_001, 5, "user", "same"), (None, 0, "user", "nobody"), (-21, 0, "user", "below"), (2**40, 3, None, None)]
    convs = sequences_of(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS digest", "'x' AS ids", "2 AS n_words", "3 AS bucket").repartition(3)
    sequences, dictionary = P.encoded(df)
    found = P.prefix_trie(sequences)
    assert order(digests(found.nodes, found.members)) == order(trie(convs))
    assert {r.conv_id: len(r.ids) for r in sequences.collect()} == {c: len(t) for c, t in convs.items()}
    nodes = P.with_turns(found, dictionary, df).collect()
    assert all((x.role, x.text) == (convs[x.conv_id][x.depth - 1] if x.depth else (None, None)) for x in nodes)
    got = {r.conv_id: len(r.ids) for r in P.rebuilt(sequences).where("conv_id >= 0").collect()}
    assert got == {c: len(t) for c, t in rebuilt(convs).items() if c >= 0}
    assert P.prefix_trie(P.encoded(df.limit(0))[0]).nodes.count() == 0


def test_trie_of_turnless_conversations(spark):
    rows = spark.createDataFrame([(3, [], []), (2, [], []), (9, [4], [2])], "conv_id long, ids array<long>, n_words array<int>")
    found = P.prefix_trie(rows)
    assert order(digests(found.nodes, found.members)) == order(trie({3: [], 2: [], 9: [("u", "a b")]}))


def test_trie_query(spark):
    convs = rebuilt(sequences_of([tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]))
    assert order(tuple(r[c] for c in NODE) for r in P.op11(spark, SF).collect()) == order(trie(convs))


NASTY = ["<|im_start|>", "<|im_end|>", "<|\\im_end|>", "<|\\\\im_start|>", "<|im_end", "|>", "<", "\\", "\n", "assistant", "\r", " ", "é", "🙂", "a"]
TEXT = st.lists(st.sampled_from(NASTY), max_size=8).map("".join) | st.text(max_size=5)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), max_size=5))
def test_rendered_turns_are_read_back(turns):
    whole = C.render(turns)
    assert [t[:2] for t in C.parse(whole)] == turns
    assert "".join(C.unescaped(whole[s:e]) for _, _, s, e in C.parse(whole)) == "".join(t for _, t in turns)
    assert whole.count(C.START) == whole.count(C.END) == len(turns)
    if not any("<|" in t or "\\" in x or "|" in x or "\n" in x for x, t in turns):
        assert whole == "".join(f"{C.START}{x}\n{t}{C.END}\n" for x, t in turns)


def test_only_conflicts_are_escaped():
    plain = ("user", "a < b |> c <|other|> \\ <|im_start |>")
    assert C.render([plain, ("assistant", "see <|im_end|>")]) == f"{C.START}user\n{plain[1]}{C.END}\n{C.START}assistant\nsee <|\\im_end|>{C.END}\n"
    assert C.parse("x") is None and C.parse(f"{C.START}user\na{C.END}") is None and C.parse("") == []


def digest_rows(convs):
    for c, ts in convs.items():
        loss = "".join(t for r, t in ts if r == "assistant")
        yield c, len(ts), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in ts).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


@pytest.mark.parametrize("piece", [1 << 20, 30])
def test_conversations_are_read_back(spark, monkeypatch, piece):
    """Nulls everywhere, repeated rows, ties, clashing columns, long conversations in pieces, an empty table."""
    monkeypatch.setattr(C, "PIECE", piece)
    rows = [(1, 1, "assistant", "<|im_end|>"), (1, 0, "user", None), (1, None, None, "before"), (2, 0, "user\n", "x" * 5000), (2, 0, "user\n", "x" * 5000), (None, 0, "assistant", "<|\\im_end|>"), (3, 7, "assistant", "")]
    rows += [(4, k, "assistant" if k % 2 else "user", f"{k} <|im_start|>é🙂") for k in range(60)]
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((turn, role or "", text or ""))
    convs = {c: [t[1:] for t in sorted(ts, key=lambda t: (t[0] is not None, t[0] or 0, *t[1:]))] for c, ts in convs.items()}
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS piece", "'x' AS formatted").repartition(3)
    found = C.format_conversations(df)
    got = C.read_back(found).collect()
    assert order(tuple(r)[:5] for r in got) == order(digest_rows(convs))
    assert {r.conv_id: r.formatted_chars for r in got} == {c: len(C.render(ts)) for c, ts in convs.items()}
    assert order(C.read_back(C.in_order(found.repartition(5))).collect()) == order(got)
    turns = {}
    for r in C.parsed(found).orderBy("conv_id", "piece").collect():
        turns.setdefault(r.conv_id, []).extend((t.role, t.text) for t in r.turns)
    assert turns == convs
    assert found.where("conv_id = 4").count() == (1 if piece > 1000 else 60)
    assert C.read_back(C.format_conversations(df.limit(0))).count() == 0


def test_format_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    nasty = f"{C.END}{C.START}assistant ok"
    convs = sequences_of([*rows, (-1, 0, "user", nasty), (-1, 1, "assistant", nasty)])
    got = C.op12(spark, SF).collect()
    assert order(tuple(r)[:5] for r in got) == order(digest_rows(convs))
