"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

All texts of an Arrow batch lie in one run of bytes, documents by their byte offsets. Where tokens of A end, and where
tokens of B end, is counted once for the whole batch; where both do, the text is cut into groups. Prefix sums over groups
and documents then give each document's own figures. A pair of ids is linked in a document if two tokens with these ids
share a group.

How often a pair of ids is linked is counted over all documents. Each batch has its distinct pairs once, so what is
shuffled are the distinct pairs of batches, not the links of documents, and no pair has more rows than there are batches.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import rows_of, shared_dir, table
from seqloom.llm.token_counts import SPLIT, byte_letters

#: Bytes of text that are aligned at once (one longer text by itself).
BATCH_BYTES = 2 << 20
#: Bytes of distinct parts of texts that are encoded as one text.
JOINED_BYTES = 1 << 16
#: White space beyond ASCII, and the sign that stands for a blank in B's vocabulary: texts with these aren't cut.
UNUSUAL = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x2581, 0x3000)]
#: Links of one group that are written out one by one; larger groups pair their distinct ids.
PLAIN_LINKS = 1 << 12

class Vocabulary:
    """Bytes and decimals of each id's token, as tables."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int32)
        self.first, self.bytes = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids, end to end."""
        some = ids[self.size[ids] > 0]
        return self.bytes[_ranges(self.first[some], self.size[some].astype(np.int64))]


class Decimals:
    """The ids below n in decimals, each with room for a sign after it."""

    def __init__(self, n: int):
        width = len(str(n)) + 1
        self.table = np.frombuffer(b"".join(b"%*d," % (width - 1, k) for k in range(n)), np.uint8).reshape(n, width)
        self.size = width - (self.table == 32).sum(axis=1)
        self.used = self.table != 32

    def written(self, ids: np.ndarray, signs: np.ndarray) -> tuple[bytes, np.ndarray]:
        """ids in decimals, each with its sign after it, and where each begins (and the last ends)."""
        out = self.table[ids]
        out[:, -1] = signs
        return out[self.used[ids]].tobytes(), np.r_[0, np.cumsum(self.size[ids])]


class TwoTokenizers:
    """A: a byte-level byte pair encoder (a .json of tokenizers), of a blank and the text. B: a byte pair encoder with
    byte fallback (a .model of sentencepiece), which adds the blank by itself. Neither adds special tokens, and their
    strings in texts are ordinary text. A is run by tiktoken on the ranks of the .json, where these are in the order of
    its merges (then both libraries give the same ids), else by tokenizers.
    """

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        letters, added = byte_letters(), {t["id"]: t["content"] for t in spec["added_tokens"]}
        plain = {k: bytes(letters[c] for c in t) for t, k in spec["model"]["vocab"].items() if k not in added}
        self.of_a = Vocabulary([added[k].encode() if k in added else plain[k] for k in range(len(plain.keys() | added))])
        ids = {t: k for k, t in plain.items()}
        merges = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in spec["model"]["merges"]]
        made = [ids[bytes(letters[c] for c in x + y)] for x, y in merges]
        if made == sorted(set(made)):
            coder = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ids, special_tokens={})
            self.encode_a = lambda texts: list(map(coder.encode_ordinary, texts))
        else:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            library = Tokenizer.from_file(path_a)
            library.encode_special_tokens = True
            self.encode_a = lambda texts: [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)  # whether texts may be cut at blanks
        self.of_b = Vocabulary([bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)])
        self.decimals = Decimals(max(len(self.of_a.size), len(self.of_b.size)))

    def _strings(self, strings: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """By A and by B: ids of all strings, each with a blank before it, end to end, and their numbers; and whether the
        tokens' bytes are the string's."""
        texts = [t.decode() for t in strings]
        found = [self.encode_a(texts), self.b.encode([t[1:] for t in texts], num_threads=1)]
        count = [np.fromiter(map(len, x), np.int64, len(texts)) for x in found]
        ids = [np.fromiter(chain.from_iterable(x), np.int32, int(n.sum())) for x, n in zip(found, count, strict=True)]
        same = np.ones(len(texts), bool)
        for v, x, n in zip((self.of_a, self.of_b), ids, count, strict=True):
            data, cuts = v.joined(x).tobytes(), np.r_[0, np.cumsum(v.size[x], dtype=np.int64)][np.r_[0, np.cumsum(n)]].tolist()
            same &= np.array([data[s:e] == t for s, e, t in zip(cuts, cuts[1:], strings, strict=False)], bool)
        return ids, count, same

    def encode(self, texts: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """By A and by B: ids of all texts end to end, and how many each text has; and the bytes of each text with the
        blank before it. Empty texts, and those whose tokens' bytes differ from a blank and the text, have none.

        A text may be cut before a blank that has no white space beside it: A cuts words there before it merges, and no
        piece of B has a blank after another character. So each distinct part is encoded once for all texts, many of them
        joined into one string; those that begin or end with other white space are strings of their own.
        """
        data = b"".join([x for t in texts if t for x in (b" ", t)])
        size = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        ends, letters = np.cumsum(size), np.frombuffer(data, np.uint8)
        cut, solid = np.zeros(len(data) + 1, bool), (letters > 32) & (letters != 127)
        cut[1:-2] = (letters[1:-1] == 32) & solid[:-2] & solid[2:] if len(data) > 1 else False
        whole = np.full(len(data), not self.cuts)
        if unusual := [u for u in UNUSUAL if u in data]:
            for t, s, e in zip(texts, (ends - size).tolist(), ends.tolist(), strict=True):
                whole[s:e] = any(u in t for u in unusual)
        cut[:-1] &= ~whole
        cut[np.r_[ends - size, len(data)]] = True
        starts = np.flatnonzero(cut)
        starts, stops = starts[:-1], starts[1:]
        places = pa.array(np.r_[starts, len(data)], pa.int64())
        coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, places.buffers()[1], pa.py_buffer(data)]).dictionary_encode()
        of_part, first = coded.indices.to_numpy(), np.zeros(len(coded.dictionary), np.int64)
        first[of_part[::-1]] = np.arange(len(starts))[::-1]
        first, last = starts[first], stops[first]
        alone = whole[first] | ~solid[np.minimum(first + 1, len(data) - 1)] | ~solid[last - 1] if len(first) else np.zeros(0, bool)
        # Parts in the order in which they are encoded: those that are joined, by strings, and those that are alone.
        order = np.r_[np.flatnonzero(~alone), np.flatnonzero(alone)]
        parts = coded.dictionary.take(pa.array(order)).to_pylist()
        bytes_of = (last - first)[order]
        number = np.cumsum(bytes_of) // JOINED_BYTES
        number[len(order) - int(alone.sum()) :] = (number[len(order) - int(alone.sum()) - 1] if not alone.all() else -1) + 1 + np.arange(int(alone.sum()))
        cuts = np.r_[0, np.flatnonzero(np.diff(number)) + 1, len(order)].tolist() if len(order) else [0]
        ids, count, same = self._strings([b"".join(parts[s:e]) for s, e in pairwise(cuts)])
        if any(e - s > 1 for s, e, x in zip(cuts, cuts[1:], same, strict=False) if not x):  # one by one, to see which differ
            ids, count, same = self._strings(parts)
            cuts = list(range(len(parts) + 1))
        good = np.repeat(same, np.diff(cuts))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        of_part = place[of_part]
        text = np.searchsorted(ends, starts, side="right")
        size[text[~good[of_part]]] = 0
        of_part, text = of_part[size[text] > 0], text[size[text] > 0]
        out, n_tokens = [], []
        for v, x, n in zip((self.of_a, self.of_b), ids, count, strict=True):
            x = x[np.repeat(same, n)]
            at = np.r_[0, np.searchsorted(np.cumsum(v.size[x], dtype=np.int64), np.cumsum(bytes_of[good]), side="right")]
            number = np.cumsum(good) - 1  # of parts that have tokens
            begin, end = at[number[of_part]], at[number[of_part] + 1]
            out.append(x[_ranges(begin, end - begin)])
            n_tokens.append(np.bincount(text, weights=end - begin, minlength=len(texts)).astype(np.int64))
        return out, n_tokens, size


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each size (none is 0), end to end."""
    at = np.ones(int(size.sum()), np.int32)
    if len(first):
        at[np.cumsum(size) - size] = first - np.r_[0, first[:-1] + size[:-1] - 1]
    return np.cumsum(at, out=at)


_pairs: dict[tuple[str, str], TwoTokenizers] = {}


def two_tokenizers(path_a: str, path_b: str) -> TwoTokenizers:
    """One for each worker and pair of files."""
    if (path_a, path_b) not in _pairs:
        _pairs[path_a, path_b] = TwoTokenizers(path_a, path_b)
    return _pairs[path_a, path_b]


@dataclass
class Aligned:
    """A batch: for each text n_a, n_b, n_groups, n_links and the tokens with their groups; and the distinct pairs of ids
    (id of A * size of B's vocabulary + id of B), with links of texts to them: text, place of the pair, number of links.
    """

    figures: list[np.ndarray]
    groups: list[bytes]
    pair: np.ndarray
    text: np.ndarray
    at: np.ndarray
    links: np.ndarray


def _links(ids_a: np.ndarray, ids_b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, p: np.ndarray, q: np.ndarray, n_b: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Groups, pairs and numbers of links: small groups token by token, each large one by its distinct ids."""
    first_a, first_b = np.cumsum(p) - p, np.cumsum(q) - q
    small = p * q <= PLAIN_LINKS
    own = np.flatnonzero(small[of_a])
    group = of_a[own]
    times = q[group]
    each = np.repeat(np.arange(len(own)), times)
    other = np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first_b[group], times)
    yield group[each], ids_a[own][each].astype(np.int64) * n_b + ids_b[other], np.ones(len(each), np.int64)
    for g in np.flatnonzero(~small).tolist():
        a, times_a = np.unique(ids_a[first_a[g] : first_a[g] + p[g]], return_counts=True)
        b, times_b = np.unique(ids_b[first_b[g] : first_b[g] + q[g]], return_counts=True)
        step = max(1, (1 << 20) // len(b))
        for s in range(0, len(a), step):
            pair = (a[s : s + step, None].astype(np.int64) * n_b + b).ravel()
            yield np.full(len(pair), g), pair, (times_a[s : s + step, None] * times_b).ravel()


def align_texts(texts: list[bytes], both: TwoTokenizers) -> Aligned:
    """Aligns the texts of a batch. Those whose tokens' bytes differ from a blank and the text have no tokens."""
    ids, n_tokens, size = both.encode(texts)
    ends = [np.cumsum(v.size[i], dtype=np.int64) for v, i in zip((both.of_a, both.of_b), ids, strict=True)]
    total = int(size.sum())
    # Where tokens of both end, counted once for the whole batch; cuts before an end number the groups.
    cut = (np.bincount(ends[0], minlength=total + 1) > 0) & (np.bincount(ends[1], minlength=total + 1) > 0)
    cut[0] = False
    before = np.cumsum(cut)
    of = [before[e - 1] for e in ends]
    n_groups = int(before[-1])
    p, q = (np.bincount(x, minlength=n_groups) for x in of)
    # Each text's share of the running sums, from its byte offset to the next one's.
    places = before[np.cumsum(size)]
    sums = lambda x: np.diff(np.r_[0, np.r_[0, np.cumsum(x)][places]])
    figures = [*n_tokens, np.diff(np.r_[0, places]), sums(p * q)]
    # Tokens in decimals, group by group, A's before B's: each has one place, given by the tokens of both before it.
    place_a = np.arange(len(ids[0])) + np.r_[0, np.cumsum(q)][of[0]]
    place_b = np.arange(len(ids[1])) + np.cumsum(p)[of[1]]
    rows, signs = np.empty(len(ids[0]) + len(ids[1]), np.int32), np.full(len(ids[0]) + len(ids[1]), ord(","), np.uint8)
    rows[place_a], rows[place_b] = ids[0], ids[1]
    ends_of = np.cumsum(p + q)
    signs[ends_of - q - 1], signs[ends_of - 1] = ord("|"), ord(";")
    data, starts = both.decimals.written(rows, signs)
    cuts = starts[np.r_[0, np.r_[0, ends_of][places]]].tolist()
    groups = [data[s : e - 1] if e > s else b"" for s, e in pairwise(cuts)]
    group, pair, links = (np.concatenate(x) for x in zip(*_links(*ids, *of, p, q, len(both.of_b.size)), strict=True))
    own = np.searchsorted(places, group, side="right")
    coded = pa.array(pair).dictionary_encode()
    distinct, at = coded.dictionary.to_numpy(), coded.indices.to_numpy().astype(np.int64)
    key = own * max(1, len(distinct)) + at
    if (links == 1).all():
        key, links = np.unique(key, return_counts=True)
    else:
        key, of_key = np.unique(key, return_inverse=True)
        links = np.bincount(of_key, weights=links, minlength=len(key)).astype(np.int64)
    return Aligned(figures, groups, distinct, key // max(1, len(distinct)), key % max(1, len(distinct)), links)


_FIGURES = ("n_a", "n_b", "n_groups", "n_links")


def _packed(ids: pa.Array, found: Aligned) -> bytes:
    """A batch's documents as one compressed Arrow table, with each one's links as lists."""
    ends = np.r_[0, np.searchsorted(found.text, np.arange(len(ids)), side="right")].astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (np.diff(np.r_[0, found.at]), found.links)]
    sha = pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in found.groups], pa.string())
    columns = [ids, *(pa.array(x, pa.int64()) for x in found.figures), sha, *lists]
    batch = pa.RecordBatch.from_arrays(columns, names=["doc_id", *_FIGURES, "groups_sha256", "step", "links"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def token_groups(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_a, n_b, groups (ARRAY<STRUCT<a ARRAY<INT>, b ARRAY<INT>>>): the ids of both in each
    group, in order. Texts that are null, empty or not kept byte for byte by either tokenizer have no tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = two_tokenizers(path_a, path_b)
        for batch in batches:
            for part in rows_of(batch, most_bytes=BATCH_BYTES // 4):
                found = align_texts([t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()], both)
                said = [[{k: [int(i) for i in x.split(b",")] for k, x in zip("ab", g.split(b"|"), strict=True)} for g in t.split(b";")] if t else [] for t in found.groups]
                kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.figures[0], pa.int64()), pa.array(found.figures[1], pa.int64()), pa.array(said, kind)], names=[id_col, "n_a", "n_b", "groups"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_a bigint, n_b bigint, groups array<struct<a:array<int>,b:array<int>>>")


def _batches(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(batch, docs, pairs, n_docs) in the shared folder: a row per batch of documents, with its distinct pairs of ids and
    the number of its documents that hold each linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = two_tokenizers(path_a, path_b)
        for batch in batches:
            for part in rows_of(batch, 100_000, BATCH_BYTES):
                found = align_texts([t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()], both)
                n_docs = np.bincount(found.at, minlength=len(found.pair))
                row = [pa.array([uuid.uuid4().hex]), pa.array([_packed(part.column(0), found)], pa.binary()), pa.array([found.pair], pa.list_(pa.int64())), pa.array([n_docs], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(row, names=["batch", "docs", "pairs", "n_docs"])

    path = f"{shared_dir(docs.sparkSession).rstrip('/')}/aligned-{uuid.uuid4()}"
    docs.mapInArrow(run, "batch string, docs binary, pairs array<bigint>, n_docs array<int>").write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def pair_counts(batches: DataFrame) -> DataFrame:
    """(pair, count): the number of documents that hold each pair of ids linked."""
    one = batches.select(F.explode(F.arrays_zip("pairs", "n_docs")).alias("p")).select("p.pairs", "p.n_docs")
    return one.groupBy(F.col("pairs").alias("pair")).agg(F.sum("n_docs").alias("count"))


def alignment(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_a, n_b (tokens), n_groups, n_links, n_best (links whose count is the highest of their
    id of A; ties included), count_sum (of all links), groups_sha256 (of `a1,a2|b1;a3|b2,b3`; '' without tokens).

    Null and empty texts, and those whose tokens' bytes differ from a blank and the text, have zeros. Null ids are kept;
    rows that repeat are documents of their own; an empty table gives no rows; other columns aren't read. A very long text
    is a batch by itself: some hundred bytes of memory for each of its letters.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    batches = _batches(own, path_a, path_b)
    n_b = len(two_tokenizers(path_a, path_b).of_b.size)
    counts = pair_counts(batches)
    best = counts.groupBy(F.floor(F.col("pair") / n_b).alias("a")).agg(F.max("count").alias("best"))
    marked = counts.withColumn("a", F.floor(F.col("pair") / n_b)).join(F.broadcast(best), "a").select("pair", "count", (F.col("count") == F.col("best")).alias("is_best"))  # best: a row for each id of A at most
    pairs = batches.select("batch", F.posexplode("pairs").alias("at", "pair"))
    looked = pairs.join(marked, "pair").select("batch", "at", "count", "is_best")

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        count, is_best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, np.int64)
        at = right.column("at").to_numpy()
        count[at], is_best[at] = right.column("count").to_numpy(), right.column("is_best").to_numpy(zero_copy_only=False)
        rows = pa.ipc.open_stream(left.column("docs")[0].as_buffer()).read_all().combine_chunks()
        steps, links = rows.column("step").combine_chunks(), rows.column("links").combine_chunks().flatten().to_numpy()
        pair, cuts = np.cumsum(steps.flatten().to_numpy().astype(np.int64)), steps.offsets.to_numpy()
        sums = [np.diff(np.r_[0, np.cumsum(links * x[pair])][cuts]) for x in (is_best, count)]
        out = {id_col: rows.column("doc_id"), **{c: rows.column(c) for c in _FIGURES}, "n_best": pa.array(sums[0], pa.int64()), "count_sum": pa.array(sums[1], pa.int64()), "groups_sha256": rows.column("groups_sha256")}
        return pa.table(out)

    docs_of = batches.select(F.col("batch").alias("of_batch"), "docs")
    schema = f"`{id_col}` {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    return docs_of.groupBy("of_batch").cogroup(looked.groupBy("batch")).applyInArrow(run, schema)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
