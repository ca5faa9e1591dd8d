"""Benchmark decontamination by spaced seeds.

Fixed masks pick some of the words in a window and ignore the others, so a hash of the picked words survives
substitutions at ignored places. Hashes of the benchmark's windows are joined with those of the training texts'
windows; around each hit both texts are compared word by word along the diagonal, and an overlap counts if a stretch
of at least 13 words (or the whole item, if shorter) agrees in at least 80 % of its words.

Both sides of the join are made in executors. A Bloom filter of the benchmark's hashes keeps most windows of the training
texts out of it; its size has a bound, and beyond that more windows pass it, none is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import Remembered, rows_of, saved, table, without, words_of

STRETCH, SIMILARITY = 13, 0.8
#: Picked (1) and ignored (0) words, by the least number of words of the items that they are for. Each family leaves no
#: placement of the substitutions that misses all its masks: in stretches of 13 to 25 words (longer ones hold one of
#: these) for the last, in whole items of 5 to 12 words for the one before. Shorter items have no word to spare.
MASKS = {1: ("1",), 2: ("11",), 3: ("111",), 4: ("1111",), 5: ("1111", "11011", "11101", "10111"), 13: ("111111", "1101111", "1111011", "101010111")}
LONGEST = 9
#: Words that a worker remembers; the filter has at least so many bits for each hash, up to 2 to the power of the last.
REMEMBERED_WORDS, BITS_EACH, MOST_BITS = 150_000, 1_024, 28
ENDS = ".,;:!?%*$&|<>\"'()[]{}`-_/\\+“”‘’«»„–—…¿¡"
#: White space becomes blanks, capital ASCII letters small ones.
_SAME = bytes.maketrans(b"\t\n\r\x0b\x0c" + bytes(range(65, 91)), b"     " + bytes(range(97, 123)))
_FACTORS = [np.uint64(f) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D, 0x94D049BB133111EB, 0xBF58476D1CE4E5B9)]


class WordHashes(Remembered):
    """A 64-bit hash for each word, in lower case and without marks at its ends; zero for marks alone."""

    def __init__(self) -> None:
        super().__init__(REMEMBERED_WORDS)

    def __missing__(self, word: bytes) -> int:
        if not self.known(word):
            bare = word.decode("utf-8", "replace").lower().strip(ENDS)
            self[word] = xxhash.xxh64_intdigest(bare) | 1 if bare else 0
        return self[word]

    def of(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """The words of all texts, and where each text's end (the first is 0)."""
        self.make_room()
        words, place, ends = words_of([(t or b"").translate(_SAME) for t in texts])
        hashes = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))[place]
        kept = hashes != 0
        return hashes[kept], np.r_[0, np.cumsum(kept)][ends]


def family_of(n_words: int) -> int:
    return max((k for k in MASKS if k <= n_words), default=0)


def window_hashes(words: np.ndarray, family: int) -> list[np.ndarray]:
    """For each mask of the family the hashes of all windows that start in words and end there."""
    scaled: dict[int, np.ndarray] = {}
    out = []
    for number, mask in enumerate(MASKS[family]):
        n = max(0, len(words) - len(mask) + 1)
        h = np.full(n, (family << 8 | number) * 0x100000001B3, np.uint64)
        for k, c in enumerate(mask):
            if c == "1":
                if k not in scaled:
                    scaled[k] = words * _FACTORS[k]
                h += scaled[k][k : k + n]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        out.append(h)
    return out


class Filter:
    """A Bloom filter: two of its bits for each hash."""

    def __init__(self, words: np.ndarray, log_bits: int):
        self.bits, self.log_bits = words, log_bits

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (h >> np.uint64(64 - self.log_bits)), (h & np.uint64((1 << self.log_bits) - 1))

    def maybe(self, h: np.ndarray) -> np.ndarray:
        """Places in h that may be in the filter, and all that are."""
        one = h >> np.uint64(64 - self.log_bits)
        at = np.flatnonzero(self.bits[(one >> np.uint64(3)).astype(np.int64)] >> (one & np.uint64(7)).astype(np.uint8) & 1)
        two = h[at] & np.uint64((1 << self.log_bits) - 1)
        return at[(self.bits[(two >> np.uint64(3)).astype(np.int64)] >> (two & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]


def seed_filter(seeds: DataFrame) -> Filter:
    """seeds: hash. The bits are gathered in executors; the driver gets the filter, whose size has a bound."""
    log_bits = max(6, min(MOST_BITS, int(seeds.count() * BITS_EACH).bit_length()))
    one, two = F.shiftrightunsigned("hash", 64 - log_bits), F.col("hash").bitwiseAND((1 << log_bits) - 1)
    bits = seeds.select(F.explode(F.array(one, two)).alias("p")).groupBy(F.shiftright("p", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 31 AS INT))")).alias("bits"))
    rows = bits.toArrow()
    words = np.zeros(1 << log_bits >> 5, "<u4")
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().astype("<u4")
    return Filter(words.view(np.uint8), log_bits)


def _items(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, words): distinct items that have words, and their words' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part in rows_of(batch):
                words, ends = hashes.of(part.column(1).cast(pa.binary()).to_pylist())
                packed = [words[s:e].astype("<u8").tobytes() for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary())], names=["item_id", "words"])

    kind = benchmark.schema["item_id"].dataType.simpleString()
    found = benchmark.select("item_id", "text").mapInArrow(run, f"item_id {kind}, words binary").where(F.octet_length("words") > 0).distinct()
    return saved(found).select(F.monotonically_increasing_id().alias("item"), "item_id", "words")


def _seeds(items: DataFrame) -> DataFrame:
    """(item, family, hash), each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = np.frombuffer(packed, "<u8")
                family = family_of(len(words))
                found = np.unique(np.concatenate(window_hashes(words, family))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), item)), pa.array(np.full(len(found), family, np.int32)), pa.array(found)], names=["item", "family", "hash"])

    return items.select("item", "words").mapInArrow(run, "item bigint, family int, hash bigint")


def _hits(docs: DataFrame, families: list[int], filter_: Filter) -> DataFrame:
    """Rows of docs (doc_id, text) with a window that the filter lets pass: doc_id, words, hashes (of these windows)."""
    sent = docs.sparkSession.sparkContext.broadcast(filter_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, own = WordHashes(), sent.value
        for batch in batches:
            for part in rows_of(batch):
                words, ends = hashes.of(part.column(1).cast(pa.binary()).to_numpy(zero_copy_only=False).tolist())
                number = np.repeat(np.arange(part.num_rows, dtype=np.int32), np.diff(ends))
                rows, found = [], []
                for family in families:
                    for mask, h in zip(MASKS[family], window_hashes(words, family), strict=True):
                        at = own.maybe(h)
                        at = at[number[at] == number[at + len(mask) - 1]]  # windows within one text
                        rows.append(number[at])
                        found.append(h[at])
                row, h = np.concatenate(rows), np.concatenate(found)
                if not len(row):
                    continue
                order = np.lexsort([h, row])
                row, h = row[order], h[order]
                new = np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])]
                row, h = row[new], h[new].view(np.int64)
                hit, first = np.unique(row, return_index=True)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(row)], pa.int32()), pa.array(h))
                packed = [words[ends[k] : ends[k + 1]].astype("<u8").tobytes() for k in hit.tolist()]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(hit)), pa.array(packed, pa.binary()), lists], names=["doc_id", "words", "hashes"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, words binary, hashes array<bigint>")


class Searched:
    """A text's windows in order of their hashes, to find those of many items in."""

    def __init__(self, words: np.ndarray):
        self.words, self.by_family = words, {}

    def windows(self, family: int) -> list[tuple[np.ndarray, np.ndarray]]:
        if family not in self.by_family:
            own = window_hashes(self.words, family)
            orders = [np.argsort(h, kind="stable") for h in own]
            self.by_family[family] = [(h[o], o) for h, o in zip(own, orders, strict=True)]
        return self.by_family[family]

    def shifts(self, item: np.ndarray) -> np.ndarray:
        """Diagonals with a hit, in order: where in the text the item's first word would be. Each is marked once, however
        many windows agree on it, so repeated words take no more room than text and item."""
        n = len(item)
        marked = np.zeros(len(self.words) + n, bool)
        family = family_of(n)
        for (sorted_, place), h in zip(self.windows(family), window_hashes(item, family), strict=True):
            low, high = np.searchsorted(sorted_, h, "left"), np.searchsorted(sorted_, h, "right")
            for k in np.flatnonzero(high > low).tolist():
                marked[place[low[k] : high[k]] - k + n] = True
        return np.flatnonzero(marked) - n

    def overlap(self, item: np.ndarray, similarity: float, stretch: int) -> tuple[int, int, int] | None:
        """Length, matching words and start of the best stretch: of those with most matches the first."""
        words, n = self.words, len(item)
        least, best = min(stretch, n), None
        shifts = self.shifts(item)
        step = max(1, (1 << 20) // n)
        for s in range(0, len(shifts), step):
            at = shifts[s : s + step, None] + np.arange(n)
            inside = (at >= 0) & (at < len(words))
            same = inside & (words[np.clip(at, 0, len(words) - 1)] == item)
            # a stretch from i to j is similar enough if its sum of (match - similarity) isn't negative
            total = np.concatenate([np.zeros((len(at), 1)), np.cumsum(same - similarity, axis=1)], axis=1)
            low = np.minimum.accumulate(total, axis=1)
            good = total[:, least:] - low[:, : n - least + 1] >= -1e-9
            for r in np.flatnonzero(good.any(axis=1)).tolist():
                j = int(np.flatnonzero(good[r])[-1]) + least
                i = int(np.flatnonzero(total[r, : j - least + 1] <= total[r, j] + 1e-9)[0])
                matches = int(same[r, i:j].sum())
                if best is None or (matches, -int(at[r, i])) > (best[1], -best[2]):
                    best = (j - i, matches, max(0, int(at[r, i])))
        return best


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, stretch: int = STRETCH) -> DataFrame:
    """Pairs with an overlap, for each row of docs: doc_id, item_id, n_words (of the stretch), n_matches, start_word.

    Words are compared in lower case and without marks at their ends, and texts whole. Items of fewer than 5 words must
    be found word for word. Null texts and texts without words have no overlap; null ids are kept; rows that repeat a
    doc_id are looked up each by itself; of rows that repeat an item_id the one with most matches counts. Either table
    empty: no rows. Other columns aren't read. The masks are for similarities and stretches from 0.8 and 13 words up.
    """
    if similarity < SIMILARITY or stretch < STRETCH:
        raise ValueError(f"the masks find overlaps from a similarity of {SIMILARITY} and {STRETCH} words up")
    kinds = [docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, n_words bigint, n_matches bigint, start_word bigint"
    items = _items(benchmark)
    seeds = saved(_seeds(items))
    families = sorted(r.family for r in seeds.select("family").distinct().collect())  # at most as many as MASKS has
    if not families:
        return docs.sparkSession.createDataFrame([], schema)
    hits = saved(_hits(docs, families, seed_filter(seeds))).withColumn("doc", F.monotonically_increasing_id())
    pairs = hits.select("doc", F.explode("hashes").alias("hash")).join(seeds.select("item", "hash"), "hash").select("doc", "item").distinct()
    # A text comes first and then the items to look for in it, so a task holds one text, however many items there are.
    none = lambda kind: F.lit(None).cast(kind)
    sought = pairs.join(items, "item").select("doc", F.lit(1).alias("side"), none(kinds[0]).alias("doc_id"), "item", "item_id", "words")
    texts = hits.select("doc", F.lit(0).alias("side"), "doc_id", none("bigint").alias("item"), none(kinds[1]).alias("item_id"), "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, ids, doc = None, None, None
        for batch in batches:
            found, best = [], {}
            for k, (number, side) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                words = np.frombuffer(batch.column(5)[k].as_py(), "<u8")
                if side == 0:
                    text, ids, doc = Searched(words), batch.column(2).slice(k, 1), number
                elif number == doc and (x := text.overlap(words, similarity, stretch)):
                    found.append((ids, batch.column(4).slice(k, 1), number, *x))
            if found:
                c = list(zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(c[0]), pa.concat_arrays(c[1]), *(pa.array(x, pa.int64()) for x in c[2:])], names=["doc_id", "item_id", "doc", "n_words", "n_matches", "start_word"])

    both = texts.unionByName(sought).repartition("doc").sortWithinPartitions("doc", "side", "item")
    overlaps = both.mapInArrow(run, f"doc_id {kinds[0]}, item_id {kinds[1]}, doc bigint, n_words bigint, n_matches bigint, start_word bigint")
    best = overlaps.groupBy("doc", "doc_id", "item_id").agg(F.max(F.struct("n_matches", (-F.col("start_word")).alias("early"), "n_words")).alias("b"))
    return best.select("doc_id", "item_id", "b.n_words", "b.n_matches", (-F.col("b.early")).alias("start_word"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an overlap, decided for each text of a doc_id: null ids are ids like others, null texts have none,
    rows that repeat id and text have one verdict, an empty table or benchmark drops nothing, and other columns, whatever
    their names, are kept."""
    ids = docs.select(F.struct("doc_id", F.xxhash64("text").alias("key")).alias("doc_id"), "text")
    return without(docs, contaminated(ids, table(spark, sf_dir, "benchmark")).select(F.col("doc_id.doc_id").alias("id"), F.col("doc_id.key").alias("key")))
