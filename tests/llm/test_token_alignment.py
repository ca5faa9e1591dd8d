"""Cross-tokenizer alignment against the libraries and sets of byte offsets."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from seqloom.llm import token_alignment as T
from seqloom.llm.token_counts import byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "b", "the", "'s", " ", "  ", "\n", " \n ", "\t", "\x00", "\x1c", "\x7f", "\x85", " ", "　", "▁", "�", "é", "É", "日本", "🙂", "fi", "ﬁ", "١", "...", "<|endoftext|>", "</s>", "<s>", "<0x0A>", "<unk>", "int main() {"]
TEXT = st.lists(st.sampled_from(PARTS) | st.text(max_size=3), max_size=14).map("".join).filter(lambda t: all(not 0xD800 <= ord(c) < 0xE000 for c in t))


class Plain:
    """By definition: offsets of token ends as sets, links as a list."""

    def __init__(self):
        self.a, self.b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
        self.a.encode_special_tokens = True
        self.letters = byte_letters()

    def tokens(self, text):
        a = self.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = self.b.encode(text) if text else []
        bytes_a = [bytes(self.letters[c] for c in self.a.id_to_token(x)) for x in a]
        pieces = [self.b.id_to_piece(x) for x in b]
        bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(x) else p.replace("▁", " ").encode() for x, p in zip(b, pieces, strict=True)]
        whole = (" " + text).encode()
        return ((a, bytes_a), (b, bytes_b)) if text and b"".join(bytes_a) == whole == b"".join(bytes_b) else (([], []), ([], []))

    def groups(self, text):
        (a, bytes_a), (b, bytes_b) = self.tokens(text)
        ends = []
        for tokens in (bytes_a, bytes_b):
            at, found = 0, []
            for t in tokens:
                at += len(t)
                found.append(at)
            ends.append(found)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        return [([x for x, e in zip(a, ends[0], strict=True) if s < e <= c], [y for y, e in zip(b, ends[1], strict=True) if s < e <= c]) for s, c in zip([0, *cuts], cuts, strict=False)]


@pytest.fixture(scope="module")
def plain():
    return Plain()


def said(groups):
    return ";".join("|".join(",".join(map(str, x)) for x in g) for g in groups)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, max_size=5))
def test_groups_by_definition(plain, texts):
    found = T.align_texts([t.encode() for t in texts], T.two_tokenizers(A, B))
    assert [g.decode() for g in found.groups] == [said(plain.groups(t)) for t in texts]


def expected(plain, texts):
    groups = [plain.groups(t or "") for t in texts]
    links = [[(x, y) for a, b in g for x in a for y in b] for g in groups]
    count = Counter(p for x in links for p in set(x))
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    for g, x in zip(groups, links, strict=True):
        sha = hashlib.sha256(said(g).encode()).hexdigest() if g else ""
        yield sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(x), sum(count[p] == best[p[0]] for p in x), sum(count[p] for p in x), sha


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("limit", [1, 1 << 12])
def test_rows_by_definition(spark, plain, monkeypatch, limit):
    """Null and empty texts, repeated rows, null ids, clashing columns, texts that B doesn't keep, a long word."""
    monkeypatch.setattr(T, "PLAIN_LINKS", limit)
    texts = [None, "", "the cat sat", "the cat sat", "the cat", "cat▁the", "  the  cat\n\n", " the", "q" * 3000, "日本 the 🙂 cat", "<|endoftext|> </s>", " "] + ["".join(PARTS[(k * j) % 9] for j in range(9)) for k in range(20)]
    df = spark.createDataFrame([(k if k else None, t) for k, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", "1 AS batch", "'x' AS pair", "2 AS n_a").repartition(3)
    got = sorted(T.alignment(df, A, B).collect(), key=lambda r: r.doc_id or 0)
    assert [tuple(r[c] for c in COLUMNS) for r in got] == list(expected(plain, texts))
    assert [r.doc_id for r in got] == [None, *range(1, len(texts))]
    assert T.alignment(df.limit(0), A, B).count() == 0
    rows = {r.doc_id: r for r in T.token_groups(df.where("doc_id IN (2, 9)"), A, B).collect()}
    for k in (2, 9):
        assert [(g.a, g.b) for g in rows[k].groups] == plain.groups(texts[k]) and rows[k].n_a == sum(len(g.a) for g in rows[k].groups)


def test_query_by_definition(spark, plain):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in T.op13(spark, sf).collect()}
    assert got == dict(zip(docs, expected(plain, docs.values()), strict=True))
