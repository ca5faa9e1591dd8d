"""Packing: vector bin packing with the dot-product heuristic.

Examples have several sizes at once (tokens, segments, loss-bearing tokens) and so has each sequence's remaining room.
A sequence is filled by taking, again and again, the example that fits and whose sizes have the largest weighted dot
product with the room that is left, so that it takes most of what there is most of.
"""

from __future__ import annotations

import gc
import os
import zlib
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.llm.common import Remembered, free_name, rows_of, saved, table, words_of

#: Words that a worker remembers with their ids before it starts afresh; examples that are packed together.
REMEMBERED_WORDS, GROUP = 600_000, 8_192


#: Blanks and line ends become blanks, capital ASCII letters small ones: the tokenizer makes no difference between them.
_SAME = bytes.maketrans(b"\n\t\r" + bytes(range(65, 91)), b"   " + bytes(range(97, 123)))
_BLANK = bytes.maketrans(b"\n\t\r", b"   ")


#: Marks that may end a word; not those of contractions and special tokens.
MARKS = b".,;:!?%*$&#)"


class WordIds:
    """Ids of whole texts by a tokenizer that drops white space, encodes each word by itself and ignores case.

    Words between blanks and line ends are encoded by the library and remembered, as little-endian 32-bit ids. The
    library gets many words of letters at a time.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already has a task for each core
        from tokenizers import Tokenizer

        self.tokenizer, self.small = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.small.normalizer = None  # small ASCII letters are what the normalizer would make of them
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known = Remembered(REMEMBERED_WORDS)

    def _learn(self, new: set[bytes]) -> None:
        """Words that end with marks after a letter are put together from the word and the marks, which the tokenizer
        always parts."""
        known, marked, parts = self.known, [], set()
        known[b""] = b""
        small: list[bytes] = []
        latin: list[bytes] = []
        rest: list[bytes] = []

        def sorted_in(words: Iterable[bytes]) -> None:
            for w in words:
                if w.isalpha() and w.islower():
                    small.append(w)
                elif w[0] >= 65 and (t := w.decode()).isalpha() and max(t) < "\u0250" and "\u0130" not in t:
                    latin.append(w)
                else:
                    rest.append(w)

        for w in new:
            if w and w[-1] in MARKS and len(bare := w.rstrip(MARKS)) and bare[-1:].isalpha() and b"<|" not in bare:
                marked.append((w, bare, w[len(bare) :]))
                parts.update(marked[-1][1:])
        sorted_in(known.unknown(parts - new))
        sorted_in(new.difference([w for w, _, _ in marked], [b""]))
        for words, tokenizer in ((small, self.small), (latin, self.tokenizer)):
            rest += self._learn_letters(words, tokenizer)
        for w, e in zip(rest, self.tokenizer.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False), strict=True):
            known[w] = np.asarray(e.ids, "<u4").tobytes()
        known.update([(w, known[bare] + known[marks]) for w, bare, marks in marked])

    def _learn_letters(self, words: list[bytes], tokenizer) -> list[bytes]:
        """Words of letters alone, whose last id is the first that ends a word; gives back those left to learn."""
        left = []
        groups = [words[k : k + 200] for k in range(0, len(words), 200)]
        for k in range(0, len(groups), 20):
            encoded = tokenizer.encode_batch_fast([b" ".join(g).decode() for g in groups[k : k + 20]], add_special_tokens=False)
            for own, e in zip(groups[k : k + 20], encoded, strict=True):
                ids = np.asarray(e.ids, "<u4")
                at = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
                if len(at) != len(own):
                    left += own
                    continue
                self.known.update(zip(own, map(ids.tobytes().__getitem__, map(slice, [0, *at[:-1]], at)), strict=True))
        return left

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """Only the distinct words of these texts are looked up; Arrow puts their ids in place of the words."""
        words, place, ends = words_of([t.translate(_BLANK if b"<|" in t else _SAME) for t in texts])
        self.known.make_room()
        if new := self.known.unknown(words):
            self._learn(new)
        ids = pa.array(list(map(self.known.__getitem__, words)), pa.large_binary()).take(pa.array(place))
        _, at, raw = ids.buffers()
        cuts = np.frombuffer(at, np.int64)[ids.offset : ids.offset + len(ids) + 1][ends].tolist()
        view = memoryview(raw) if raw is not None else memoryview(b"")
        return [bytes(view[s:e]) for s, e in pairwise(cuts)]


_encoders: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    """One for each worker and file."""
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    gc.collect()
    gc.freeze()  # the remembered words hold no cycles, and need not be searched for any
    return _encoders[path]


def pieces(docs: DataFrame, path: str, end_id: int = 2, most: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's token ids and the end id, cut into pieces of most ids and a rest: (doc_id, start, length, ids_crc32,
    doc_tokens).

    Null and empty texts are the end id alone. Texts are encoded whole, in slices of bounded bytes (a text that is longer
    than these by itself). Null ids are kept, repeated rows give their own pieces each, no rows give none; other columns
    aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        end = np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            for part in rows_of(batch, 1000):
                found = []
                texts = [t or b"" for t in part.column(1).cast(pa.binary()).to_numpy(zero_copy_only=False)]
                for doc, ids in zip(part.column(0).to_pylist(), encode(texts), strict=True):
                    ids += end
                    n = len(ids) // 4
                    found += [(doc, at, min(most, n - at), zlib.crc32(ids[4 * at : 4 * (at + most)]), n) for at in range(0, n, most)]
                columns = list(zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], part.column(0).type), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def fill(sizes: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sequence of each example, and its place in it. sizes: a row per example, a column per limit; each row fits."""
    kinds, kind_of, left = np.unique(sizes, axis=0, return_inverse=True, return_counts=True)
    kind_of = kind_of.reshape(-1)
    share = kinds / limits
    weight = (sizes / limits).mean(axis=0)
    weighted = share * weight
    members = np.split(np.argsort(kind_of, kind="stable"), np.cumsum(left)[:-1])
    bins, place = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    b, room, at = 0, np.ones(len(limits)), 0
    open_kinds = np.flatnonzero(left)
    placed, slack = 0, 1e-9
    while placed < len(sizes):
        fits = open_kinds[(share[open_kinds] <= room + slack).all(axis=1)]
        if not fits.size:
            b, room, at = b + 1, np.ones(len(limits)), 0
            open_kinds = open_kinds[left[open_kinds] > 0]
            continue
        k = fits[np.argmax(weighted[fits] @ room)]
        left[k] -= 1
        row = members[k][left[k]]
        bins[row], place[row] = b, at
        room, at, placed = room - share[k], at + 1, placed + 1
        if not left[k]:
            open_kinds = open_kinds[left[open_kinds] > 0]
    return bins, place


def pack(examples: DataFrame, tokens: str = "length", loss: str = "loss_tokens", max_tokens: int = 4096, max_segments: int = 512, max_loss: int = 4096, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset (in tokens, gapless from 0) to examples, within all three limits per sequence.

    Each example must fit by itself, else an error names it. Examples are dealt evenly into groups of at most about
    `group` rows, and each is packed by itself; so no group grows with the input, whatever the keys are. Repeated rows
    are packed as rows of their own. Null sizes count as zero. No rows: no rows. Columns of examples named sequence_id
    or offset are replaced; all others stay, whatever their names.
    """
    examples = examples.drop("sequence_id", "offset")
    no, dealt = free_name(examples, "_no"), free_name(examples, "_group")
    rows = saved(examples).withColumn(no, F.monotonically_increasing_id())  # the saved rows keep their places
    n = rows.count()
    size = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))
    over = rows.where((size(tokens) > max_tokens) | (size(loss) > max_loss)).select(tokens, loss).first()
    if over:
        raise ValueError(f"an example of {over[0]} tokens, {over[1]} with loss, is over the limits; cut it first")
    full = rows.where(size(tokens) == max_tokens).select(*examples.columns, (F.col(no) * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    limits = np.array([max_tokens, max_segments, max_loss], float)

    def run(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(no, kind="stable")
        t = x[tokens].fillna(0).to_numpy(np.int64)
        bins, place = fill(np.stack([t, np.ones_like(t), x[loss].fillna(0).to_numpy(np.int64)], axis=1).astype(float), limits)
        order = np.lexsort([place, bins])
        ends = np.cumsum(t[order])
        new = np.r_[True, bins[order][1:] != bins[order][:-1]]
        before = ends - t[order]
        offset = np.empty(len(x), np.int64)
        offset[order] = before - before[np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))]
        x["sequence_id"], x["offset"] = (int(key[0]) * 2**32 + bins) * 2, offset
        return x.drop(columns=[no, dealt])

    groups = max(1, -(-n // group))
    rest = rows.where(size(tokens) < max_tokens).withColumn(dealt, F.pmod(F.xxhash64(no), F.lit(groups)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in examples.schema) + ", sequence_id bigint, offset bigint"
    return full.unionByName(rest.groupBy(dealt).applyInPandas(run, schema))


#: Turns of a conversation that are counted together before the counts are summed up over the conversation.
TURNS = 1_000


def conversation_pieces(turns: DataFrame, path: str, end_id: int = 2, most: int = 4096, learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """turns (conv_id, turn, role, text) to (conv_id, start, length, loss_tokens): each conversation's ids, each turn's
    with the end id after them, in the turns' order, cut into pieces of most ids and a rest. Ids of the learned roles'
    turns bear a loss, but for the first id of a conversation: nothing comes before it.

    Null texts are the end id alone, null roles bear no loss. Turns of one number (null: before all) are in the order of
    role and text. Running sums go over blocks of turns first, so that no task needs all turns of a conversation that
    has a large part of the rows. Other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            for part in rows_of(batch, 1000):
                texts = [t or b"" for t in part.column(3).cast(pa.binary()).to_numpy(zero_copy_only=False)]
                size = pa.array([len(ids) // 4 + 1 for ids in encode(texts)], pa.int64())
                mark = pa.array([zlib.crc32(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], size, mark], names=["conv_id", "turn", "role", "size", "mark"])

    kinds = [turns.schema[c].dataType.simpleString() for c in ("conv_id", "turn", "role")]
    own = turns.select("conv_id", "turn", "role", "text").mapInArrow(run, f"conv_id {kinds[0]}, turn {kinds[1]}, role {kinds[2]}, size bigint, mark bigint")
    own = saved(own.withColumn("block", F.coalesce(F.floor(F.col("turn") / TURNS), F.lit(-(2**62)))))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = own.groupBy("conv_id", "block").agg(F.sum("size").alias("n")).select(F.col("conv_id").alias("_conv"), F.col("block").alias("_block"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "size", "mark").rowsBetween(Window.unboundedPreceding, -1)
    at = own.withColumn("at", F.coalesce(F.sum("size").over(within), F.lit(0)))
    at = at.join(base, at.conv_id.eqNullSafe(base._conv) & (at.block == base._block)).withColumn("at", F.col("at") + F.col("base"))
    parts = at.withColumn("piece", F.explode(F.sequence(F.floor(F.col("at") / most), F.floor((F.col("at") + F.col("size") - 1) / most))))
    first, last = F.greatest("at", F.col("piece") * most), F.least(F.col("at") + F.col("size"), (F.col("piece") + 1) * most)
    bears = F.when(F.col("role").isin(*learned), last - first - F.when(first == 0, 1).otherwise(0)).otherwise(0)
    return parts.groupBy("conv_id", (F.col("piece") * most).alias("start")).agg(F.sum(last - first).alias("length"), F.sum(bears).alias("loss_tokens"))


def packed_documents(docs: DataFrame, path: str, most: int = 4096, max_segments: int = 512) -> DataFrame:
    """Pieces of documents in sequences. All ids but each piece's first have a loss: that one has nothing before it. So
    their limit can't bind here before that of tokens does; it does for conversations (see conversation_pieces)."""
    cut = pieces(docs, path, most=most).withColumn("loss_tokens", F.col("length") - 1)
    return pack(cut, max_tokens=most, max_segments=max_segments, max_loss=most).drop("loss_tokens")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
