"""Token counts: the exact number of tokens of every prefix of a text, by dynamic programming over byte pair encoding.

A byte pair encoder has one answer for every string, and the answer for a prefix that ends at e is the answer for a
shorter prefix plus one last token. That last token is the one token ending at e which no merge could join to the last
token of the shorter prefix. So one pass from left to right finds the count of every prefix, each from one before it.
Questions about truncation or budgets read the stored counts and never encode again.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import Remembered, rows_of, table

#: How the byte-level encoder cuts a text before merging (fixed value of its file format).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces, and pairs of tokens, that a worker remembers before it starts afresh: a bound on its memory only.
REMEMBERED_PIECES, REMEMBERED_TOTALS, REMEMBERED_PAIRS = 50_000, 300_000, 600_000
LATEST = 1 << 60


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable bytes stand for themselves, others follow 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class PrefixCounter:
    """Counts for one tokenizer file (byte-level byte pair encoding with one or more special tokens)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = {t: bytes(letters[c] for c in t) for t in spec["model"]["vocab"] if all(c in letters for c in t)}
        self.ids = {raw[t]: i for t, i in spec["model"]["vocab"].items() if t in raw}
        self.longest = max(map(len, self.ids))
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}  # token: rank of the merge that makes it, left part, right part
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right = self.ids[raw[a]], self.ids[raw[b]]
            self.rank[left, right] = r
            self.made.setdefault(self.ids[raw[a] + raw[b]], (r, left, right))
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = set(special)
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.split, self.blank = regex.compile(SPLIT), regex.compile(r"\s+")
        self.pieces, self.totals = Remembered(REMEMBERED_PIECES), Remembered(REMEMBERED_TOTALS)
        self.apart: dict[tuple[int, int], bool] = {}

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether encoding a's bytes followed by b's gives just a, b.

        Follows the parts that touch at the boundary back in time. Merges run by rank, equal ranks from the left, so
        the touching parts are joined if their merge comes before either is taken into a longer part of its own token.
        """
        x, y, x_taken, y_taken = a, b, LATEST, LATEST
        while True:
            r = self.rank.get((x, y))
            if r is not None and r < x_taken and r <= y_taken:
                return False
            x_made, y_made = self.made.get(x), self.made.get(y)
            if x_made is None and y_made is None:
                return True
            if y_made is None or x_made is not None and x_made[0] > y_made[0]:
                x_taken, x = x_made[0], x_made[2]
            else:
                y_taken, y = y_made[0], y_made[1]

    def of_piece(self, piece: bytes) -> list[int]:
        """Counts of the piece's prefixes of 1, 2, ... bytes."""
        ids, apart, longest = self.ids, self.apart, self.longest
        counts, last = [0], [-1]
        for e in range(1, len(piece) + 1):
            for s in range(max(0, e - longest), e):
                t = ids.get(piece[s:e])
                if t is None:
                    continue
                if s:
                    if (p := last[s]) < 0:
                        continue
                    if (ok := apart.get((p, t))) is None:
                        if len(apart) >= REMEMBERED_PAIRS:
                            apart.clear()
                        ok = apart[p, t] = self.stay_apart(p, t)
                    if not ok:
                        continue
                counts.append(counts[s] + 1)
                last.append(t)
                break
            else:
                raise ValueError("the vocabulary lacks a single byte")
        return counts[1:]

    def counts_of(self, piece: str) -> tuple[int, ...]:
        """Counts of the piece's prefixes of 1, 2, ... characters, as texts of their own."""
        if not self.pieces.known(piece):
            by_byte = self.of_piece(piece.encode())
            known = tuple(by_byte) if len(by_byte) == len(piece) else tuple(by_byte[e - 1] for e in accumulate(len(c.encode()) for c in piece))
            if len(piece) == 3 and piece in ("'re", "'ve", "'ll"):
                known = (known[0], 2, known[2])  # "'r" is cut before its letter, "'re" isn't
            self.pieces.make_room()
            self.pieces[piece] = known
        return self.pieces[piece]

    def last_count(self, piece: str) -> int:
        """The count of the whole piece."""
        if not self.totals.known(piece):
            self.totals.make_room()
            self.totals[piece] = self.of_piece(piece.encode())[-1]
        return self.totals[piece]

    def parts(self, text: str) -> list[str]:
        """The text cut at special tokens; these are parts of their own."""
        if self.special_split is None or not any(s in text for s in self.special):
            return [text]
        return [p for p in self.special_split.split(text) if p]

    def total(self, text: str) -> int:
        """Tokens of the whole text: the count stored for its last prefix."""
        n = 0
        for part in self.parts(text):
            if part in self.special:
                n += 1
                continue
            cut = self.split.findall(part)
            try:
                n += sum(map(self.totals.__getitem__, cut))
            except KeyError:
                n += sum(map(self.last_count, cut))
        return n

    def prefixes(self, text: str) -> np.ndarray:
        """Counts of the prefixes of 1, 2, ... characters. A prefix that ends inside a special token's string holds it
        as ordinary text."""
        out: list[int] = []
        base, before = 0, ""
        for part in self.parts(text):
            if part in self.special:
                # Until the last character these are ordinary text, and may join the pieces right before them.
                known = base - self._plain(before)
                out += [known + self._plain(before + part[:k]) for k in range(1, len(part))] + [base + 1]
                base, before = base + 1, ""
                continue
            before = "".join(self.split.findall(part)[-2:])
            cut = self.split.findall(part)
            k = 0
            while k < len(cut):
                nxt = cut[k + 1] if k + 1 < len(cut) else ""
                if self.blank.fullmatch(cut[k]) and nxt and self.blank.match(nxt):
                    # A run of white space is one piece until a word follows, which takes its last character.
                    shared = len(self.blank.match(nxt)[0])
                    out += [base + c for c in self.counts_of(cut[k] + nxt[:shared])]
                    base += self.counts_of(cut[k])[-1]
                    out += [base + c for c in self.counts_of(nxt)[shared:]]
                    base += self.counts_of(nxt)[-1]
                    k += 2
                    continue
                known = self.counts_of(cut[k])
                out += [base + c for c in known]
                base += known[-1]
                k += 1
        return np.asarray(out, dtype=np.int32)

    def _plain(self, text: str) -> int:
        return sum(self.counts_of(p)[-1] for p in self.split.findall(text))

    def longest_fit(self, text: str, limit: int) -> int:
        """Characters of the longest prefix of at most limit tokens."""
        counts = self.prefixes(text)
        fits = np.flatnonzero(counts <= limit)
        return int(fits[-1]) + 1 if fits.size else 0


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One for each worker and file."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_bytes, n_tokens, over_limit.

    A null text counts as empty (0 bytes, 0 tokens); a null id is kept; repeated rows each give a row; other columns of
    docs are not read.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            for part in rows_of(batch):
                texts = [t or "" for t in part.column(1).to_pylist()]
                n = [c.total(t) for t in texts]
                size = [len(t.encode()) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(count, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def prefix_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, prefix_tokens, the token count of each prefix of 1, 2, ... characters (empty: no counts).

    The stored counts answer later questions with array functions alone: see truncation_points().
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            for part in rows_of(batch, 64):
                found = [c.prefixes(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tolist() for x in found], pa.list_(pa.int32()))], names=[id_col, "prefix_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(count, f"`{id_col}` {kind}, prefix_tokens array<int>")


def truncation_points(counts: DataFrame, limit: int) -> DataFrame:
    """Adds fit_chars to what prefix_counts() gives: characters of the longest prefix of at most limit tokens."""
    return counts.withColumn("fit_chars", F.coalesce(F.array_max(F.transform("prefix_tokens", lambda n, i: F.when(n <= limit, i + 1).otherwise(0))), F.lit(0)))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1024)
