"""SimHash near-duplicates: exact links between fingerprints by tiled comparison.

Fingerprints are compared in tiles with exclusive-or and bit counts; tiles are in order of population count, and pairs
of tiles whose population counts differ beyond the radius are skipped. So that this also holds for billions of
documents, equal fingerprints are merged first and the tiles are cut from fingerprints that agree on some blocks of
bits: two fingerprints within the radius r agree on at least n - r of n blocks, so every link is found.

The pipeline's stage has a setting of its own: sets of 5-word shingles of Jaccard similarity 0.8 or more. Such sets are
too far apart for blocks of bits, so its tiles are cut from sets that have a rare shingle in common, and its links are
verified by the sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import forget, free_name, least_hashed, rows_of, saved, table, without
from seqloom.llm.components import components

BITS = 64
TILE = 512


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Of the ASCII-lower-cased words' shingles, repeats included; fewer words than width: of all of them; none: zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, seed)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts, ends = (ends - size)[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    h = xxhash.xxh64_intdigest
    votes, n = np.zeros(BITS, np.int64), len(starts)
    for at in range(0, n, 8192):
        found = np.fromiter((h(joined[s:e], seed) for s, e in zip(starts[at : at + 8192], ends[at : at + 8192], strict=True)), np.uint64)
        votes += np.unpackbits(found.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for each row of docs; fp is the fingerprint's 64 bits as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rows_of(batch):
                found = np.fromiter((fingerprint(t, width, seed) for t in part.column(1).to_pylist()), np.uint64, part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp bigint")


def block_masks(n_fingerprints: int, radius: int) -> list[int]:
    """Bit masks of which two fingerprints within the radius agree on one at least. More fingerprints: more, wider masks,
    so that groups that agree on one stay small. Every choice finds every link."""
    blocks = radius + 1
    while blocks < BITS and blocks < radius + 5 and n_fingerprints / 2 ** (BITS * (blocks - radius) / blocks) > 64:
        blocks += 1
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    own = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(own, blocks - radius)]


def _roots(label: np.ndarray) -> np.ndarray:
    while not np.array_equal(label, label[label]):
        label = label[label]
    return label


def linked_in(group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what the radius joins in group (unsigned, distinct): at most one for each fingerprint."""
    count = np.bitwise_count(group)
    order = np.argsort(count, kind="stable")
    group, count = group[order], count[order].astype(np.int16)
    label = np.arange(len(group))
    for i in range(0, len(group), TILE):
        a = slice(i, min(i + TILE, len(group)))
        for j in range(i, len(group), TILE):
            b = slice(j, min(j + TILE, len(group)))
            if int(count[j]) - int(count[a.stop - 1]) > radius:
                break  # this and all later tiles hold larger population counts
            near = np.bitwise_count(group[a, None] ^ group[None, b]) <= radius
            first = near.argmax(axis=0)
            has = near[first, np.arange(near.shape[1])]
            for x, y in _unlike(label, i + first[has], j + np.flatnonzero(has)):
                _join(label, x, y)
            label = _roots(label)
            left = near & (label[a, None] != label[None, b])
            if left.any():
                x, y = np.nonzero(left)
                for u, v in _unlike(label, i + x, j + y):
                    _join(label, u, v)
                label = _roots(label)
    own = np.flatnonzero(label != np.arange(len(group)))
    return group[own], group[label[own]]


def _unlike(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """The distinct pairs of different labels among the pairs x, y."""
    lx, ly = label[x], label[y]
    apart = lx != ly
    low, high = np.minimum(lx, ly)[apart], np.maximum(lx, ly)[apart]
    pairs = np.unique(low * len(label) + high)
    return list(zip((pairs // len(label)).tolist(), (pairs % len(label)).tolist(), strict=True))


def _join(label: np.ndarray, x: int, y: int) -> None:
    while label[x] != x:
        x = label[x]
    while label[y] != y:
        y = label[y]
    label[max(x, y)] = min(x, y)


def _small_links(key: np.ndarray, fp: np.ndarray, radius: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between fp of equal key, for runs of equal key no longer than most."""
    a, b = [], []
    for d in range(1, most):
        same = key[:-d] == key[d:] if d < len(key) else np.zeros(0, bool)
        if not same.any():
            break
        at = np.flatnonzero(same)
        at = at[np.bitwise_count(fp[at] ^ fp[at + d]) <= radius]
        a.append(fp[at])
        b.append(fp[at + d])
    return (np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])


def links(prints: DataFrame, radius: int = 3) -> DataFrame:
    """prints: distinct fp. (u, v): links that join just what links of at most radius differing bits join.

    Not all pairs come out: in a group of m near copies there are at most m links for each block mask.
    """
    masks = block_masks(prints.count(), radius)
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    keyed = prints.select(F.explode(F.array(*[F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(signed)])).alias("k"), "fp").select("k.mask", "k.key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("mask", np.int32), ("key", np.int64), ("fp", np.uint64)]
        held: list[np.ndarray] = []  # of one mask and key, but for the last batch

        def out(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(rows):
                return
            new = np.flatnonzero(np.r_[True, (rows["mask"][1:] != rows["mask"][:-1]) | (rows["key"][1:] != rows["key"][:-1])])
            size = np.diff(np.r_[new, len(rows)])
            run_no = np.repeat(np.arange(len(new)), size)
            few = (size <= 32)[run_no]
            found = [_small_links(run_no[few], rows["fp"][few], radius, 33)]
            found += [linked_in(rows["fp"][new[k] : new[k] + size[k]], radius) for k in np.flatnonzero(size > 32)]
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["u", "v"])

        for batch in batches:
            rows = np.empty(batch.num_rows, kinds)
            if not len(rows):
                continue
            rows["mask"], rows["key"], rows["fp"] = batch.column(0), batch.column(1), np.asarray(batch.column(2)).view(np.uint64)
            last = np.flatnonzero((rows["mask"] != rows["mask"][-1]) | (rows["key"] != rows["key"][-1]))
            cut = last[-1] + 1 if last.size else 0
            if cut or held and (held[-1]["mask"][-1], held[-1]["key"][-1]) != (rows["mask"][0], rows["key"][0]):
                yield from out(np.concatenate([*held, rows[:cut]]))
                held = []
            held.append(rows[cut:])
        if held:
            yield from out(np.concatenate(held))

    return keyed.repartition("mask", "key").sortWithinPartitions("mask", "key").mapInArrow(run, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, radius: int = 3, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fp, component_id, the smallest doc_id reachable by links, its own included.

    Null and wordless texts have fingerprint zero and link like any other; texts of any length are taken whole, shingle by
    shingle. Repeated rows share a class. No rows: no rows. Null ids are no
    candidates for component_id; a class of null ids alone has a null one. Other columns are not read.
    """
    own = saved(fingerprints(docs, width, seed, id_col, text_col))
    prints = saved(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    found = components(links(prints.select("fp"), radius))
    rooted = saved(prints.join(found, prints.fp == found.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")))
    # Saved, so that the join deals rooted out by itself: Spark then splits a root that very many fingerprints share.
    classes = saved(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")))
    return own.join(rooted.join(classes, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: str) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_digits("fp").alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of op9 one row stays, decided for each text of a doc_id."""
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("key"))
    found = near_duplicates(docs.select(row.alias("doc_id"), "text"))
    return one_of_each(docs, found.select("doc_id.doc_id", "doc_id.key", F.col("component_id").alias("root")))


# --- the pipeline's stage --------------------------------------------------------------------------------------------

#: Near copies of the stage: texts whose sets of 5-word shingles have a Jaccard similarity of 4/5 or more.
WORDS, SIMILAR = 5, (4, 5)
#: At similarity 4/5 fingerprints of such sets differ in 9.7 bits of 64 on average, with a deviation of 2.9: WIDE is over
#: five deviations beyond. Pairs within TIGHT are verified first, as what they join needs no further comparisons.
WIDE, TIGHT = 25, 6
#: Documents in which shingles are counted, and the count from which on one is common; at most so many are common.
COUNTED, COMMON, COMMON_MOST = 20_000, 20, 200_000
#: Sets that share a rare shingle, beyond which their parities are compared too, so that few pairs are left to verify.
CROWD = 16
#: Words of parities that are compared at once.
MOST_WORDS = 1 << 20
#: Pairs that a task holds before it hands them on.
MOST_PAIRS = 100_000
#: Bytes of rows of rare shingles for each partition: their number grows with the input.
PART_BYTES = 16 << 20


def shingles(text: str | None, width: int = WORDS, seed: int = 42) -> np.ndarray:
    """Distinct hashes, in order; fewer words than width: one shingle of all of them; none: no shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h, joined = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= width:
        return np.array([h(joined, seed)] if words else [], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts, ends = (ends - size)[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    return np.unique(np.fromiter((h(joined[s:e], seed) for s, e in zip(starts, ends, strict=True)), np.uint64, len(starts)))


def set_fingerprint(found: np.ndarray) -> int:
    """SimHash of a set of hashes."""
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(found), 8192):
        votes += np.unpackbits(found[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(found), bitorder="little").view("<i8")[0])


def parities(found: np.ndarray) -> np.ndarray:
    """For each of a number of bits, a power of two and no fewer than the set has hashes, whether an odd number of hashes falls
    on it. Two sets differ in at least as many hashes as bits; of unlike numbers the larger one is folded first."""
    n = max(512, 1 << (len(found) - 1).bit_length())
    odd = np.bincount((found & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def rare(found: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first shingles of the set in an order that all texts share, common ones last: as many as it takes for any two
    sets of the least similarity to have one of them in common."""
    n = len(found)
    if not n:
        return found
    last = np.isin(found, common, assume_unique=True)
    return np.concatenate([found[~last], found[last]])[: n - -(-SIMILAR[0] * n // SIMILAR[1]) + 1]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return SIMILAR[1] * both >= SIMILAR[0] * (len(a) + len(b) - both)


def common_shingles(texts: DataFrame) -> np.ndarray:
    """texts: doc_id, key, text. Shingles that many texts of a sample of bounded size have. Only the order of shingles
    depends on them, not which pairs are found."""
    sample = F.broadcast(least_hashed(texts.select("doc_id", "key"), COUNTED, "doc_id", "key").distinct().select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rows_of(batch, 200):
                found = [shingles(t) for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["shingle"])

    own = texts.join(sample, texts.doc_id.eqNullSafe(sample._id) & (texts.key == sample._key)).select("text").distinct()
    counts = own.mapInArrow(run, "shingle bigint").groupBy("shingle").count().where(F.col("count") >= COMMON)
    rows = counts.orderBy(F.desc("count"), "shingle").limit(COMMON_MOST).select("shingle").collect()
    return np.sort(np.fromiter((r[0] for r in rows), np.int64, len(rows)).view(np.uint64))


def sketches(texts: DataFrame, common: np.ndarray) -> DataFrame:
    """For each row of texts: doc_id, key, node (a digest of its set), size (of the set), fp, its rare shingles (32 bits of
    each, packed: what they have in common by chance is told by verifying) and parities."""
    sent = texts.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rows_of(batch, 500):
                found = [shingles(t) for t in part.column(2).to_pylist()]
                node = np.fromiter((xxhash.xxh64_intdigest(s.tobytes(), 7) for s in found), np.uint64, len(found)).view(np.int64)
                first = [rare(s, sent.value).view(np.int64) for s in found]
                lists = pa.array([x.astype("<i8").astype("<u4").tobytes() for x in first], pa.binary())
                columns = [part.column(0), part.column(1), pa.array(node), pa.array([len(s) for s in found], pa.int32()), pa.array(map(set_fingerprint, found), pa.int64()), lists, pa.array([parities(s).tobytes() for s in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "node", "size", "fp", "rare", "parities"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "key", "text").mapInArrow(run, f"doc_id {kind}, key bigint, node bigint, size int, fp bigint, rare binary, parities binary")


def close_pairs(rows: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in rows (in order of size) of pairs of sizes that fit and within the radius, tile by tile."""
    fp, size = rows["fp"], rows["size"].astype(np.int64)
    for i in range(0, len(rows), TILE):
        a = slice(i, min(i + TILE, len(rows)))
        for j in range(i, len(rows), TILE):
            if SIMILAR[1] * size[a.stop - 1] < SIMILAR[0] * size[j]:
                break  # this and all later tiles hold larger sets
            b = slice(j, min(j + TILE, len(rows)))
            near = (np.bitwise_count(fp[a, None] ^ fp[None, b]) <= radius) & (SIMILAR[1] * size[a, None] >= SIMILAR[0] * size[None, b])
            x, y = np.nonzero(np.triu(near, 1) if i == j else near)
            yield i + x, j + y


def forest(rows: np.ndarray, radius: int, kept: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of close_pairs (those that are kept, if given) as many as join what they all join: fewer than there are rows. label:
    what is joined already; what the pairs join is added to it."""
    label, found = np.arange(len(rows)) if label is None else label, []
    for x, y in close_pairs(rows, radius):
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
        if kept is not None and len(x):
            good = kept(x, y)
            x, y = x[good], y[good]
        while True:
            apart = label[x] != label[y]
            x, y = x[apart], y[apart]
            if not len(x):
                break
            low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
            order = np.lexsort((low, high))
            first = order[np.r_[True, high[order][1:] != high[order][:-1]]]
            found.append((x[first], y[first]))
            label[high[first]] = low[first]
            label[:] = _roots(label)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (label[:0], label[:0])


def alike(rows: np.ndarray, held: list[np.ndarray]) -> Callable[..., np.ndarray]:
    """held: parities of rows (in order of size). A function of places x <= y: which pairs differ in no more bits than similar
    sets may differ in hashes, or in no more than a share of that. It drops no similar pair."""
    words = np.array([len(p) for p in held])
    size = rows["size"].astype(np.int64)
    own = {}
    for w in np.unique(words).tolist():
        at = np.flatnonzero((words == w) | (words == 2 * w))  # sizes that fit have such numbers
        place = np.zeros(len(held), np.int64)
        place[at] = np.arange(len(at))
        own[w] = place, np.stack([np.bitwise_xor.reduce(held[k].reshape(-1, w)) for k in at.tolist()])

    def of(x: np.ndarray, y: np.ndarray, share: float = 1) -> np.ndarray:
        good = np.zeros(len(x), bool)
        for w, (place, p) in own.items():
            at = np.flatnonzero(words[x] == w)
            for k in range(0, len(at), max(1, MOST_WORDS // w)):
                part = at[k : k + max(1, MOST_WORDS // w)]
                differ = np.bitwise_count(p[place[x[part]]] ^ p[place[y[part]]]).sum(axis=1, dtype=np.int64)
                good[part] = (SIMILAR[0] + SIMILAR[1]) * differ <= share * (SIMILAR[1] - SIMILAR[0]) * (size[x[part]] + size[y[part]])
        return good

    return of


_KEYED = [("shingle", "<u4"), ("size", "<i4"), ("node", "<i8"), ("fp", "<u8")]
_MEMBER = [("size", "<i4"), ("node", "<i8"), ("fp", "<u8"), ("root", "<i8")]


def meetings(nodes: DataFrame, parts: int) -> DataFrame:
    """nodes: node, size, fp, rare. (u, v, met): where two sets alone have a rare shingle (met 2), u and v are these, if they
    are close; where more have it, a row for each: u the shingle, v the set, met how many have it. Rows cross the shuffle
    packed, by bucket of shingles, and one bucket is held at a time."""
    buckets = parts  # a packed row for each bucket and slice of rows: their number must not grow with its square

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rows_of(batch):
                lists = [np.frombuffer(x, "<u4") for x in part.column(3).to_pylist()]
                number = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
                rows = np.empty(len(number), _KEYED)
                rows["shingle"] = np.concatenate(lists) if lists else 0
                for name, k in (("node", 0), ("size", 1), ("fp", 2)):
                    rows[name] = np.asarray(part.column(k)).astype(np.int64).view(np.uint64 if name == "fp" else np.int64)[number]
                to = rows["shingle"] % buckets
                order = np.argsort(to, kind="stable")
                rows, to = rows[order], to[order]
                cuts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.zeros(0, np.int64)
                data = [rows[s:e].tobytes() for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(rows)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(to[cuts].astype(np.int64)), pa.array(data, pa.binary())], names=["bucket", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[bytes]) -> Iterator[pa.RecordBatch]:
            rows = np.frombuffer(b"".join(held), _KEYED)
            rows = rows[np.lexsort([rows["node"], rows["size"], rows["shingle"]])]
            new = np.flatnonzero(np.r_[True, rows["shingle"][1:] != rows["shingle"][:-1]])
            size = np.diff(np.r_[new, len(rows)])
            x = new[size == 2]  # most runs
            near = (np.bitwise_count(rows["fp"][x] ^ rows["fp"][x + 1]) <= WIDE) & (SIMILAR[1] * rows["size"][x].astype(np.int64) >= SIMILAR[0] * rows["size"][x + 1].astype(np.int64))
            near &= rows["node"][x] != rows["node"][x + 1]
            u, v = _pairs(rows["node"][x[near]], rows["node"][x[near] + 1])
            met = np.repeat(size, size)
            more = met > 2
            u, v, met = np.r_[u, rows["shingle"][more].astype(np.int64)], np.r_[v, rows["node"][more]], np.r_[np.full(len(u), 2), met[more]]
            for at in range(0, len(u), MOST_PAIRS):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + MOST_PAIRS], t) for c, t in ((u, pa.int64()), (v, pa.int64()), (met, pa.int32()))], names=["u", "v", "met"])

        held, bucket = [], None
        for batch in batches:
            for b, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if b != bucket and held:
                    yield from out(held)
                    held = []
                bucket = b
                held.append(data.as_py())
        if held:
            yield from out(held)

    dealt = nodes.select("node", "size", "fp", "rare").mapInArrow(deal, "bucket bigint, data binary")
    return dealt.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "u bigint, v bigint, met int")


def _pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs, the smaller one first."""
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return both[:, 0], both[:, 1]


def _met_pairs(met: DataFrame, nodes: DataFrame, parts: int, of_run: Callable[..., Iterator[tuple[np.ndarray, np.ndarray]]]) -> DataFrame:
    """met: as meetings() gives it; nodes: node, size, fp, parities, root. Pairs (u, v) of what of_run gives for each shingle
    that more than two sets have: their rows, in order of size, and their parities (none unless the shingle is crowded). One
    shingle's sets are held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            u, v = _pairs(*(np.concatenate(c) for c in zip(*done, strict=True)))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        def told(parts: list[tuple[np.ndarray, list[bytes | None]]]) -> Iterator[pa.RecordBatch]:
            rows = np.concatenate([r for r, _ in parts]) if len(parts) > 1 else parts[0][0]
            bits = [np.frombuffer(b, "<u8") for _, held in parts for b in held] if len(rows) > CROWD else []
            for x, y in of_run(rows, bits):
                if len(x):
                    done.append((rows["node"][x], rows["node"][y]))
                    if sum(len(a) for a, _ in done) > MOST_PAIRS:
                        yield out()

        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            shingle = np.asarray(batch.column(0))
            rows = np.empty(len(shingle), _MEMBER)
            for k, name in enumerate(("node", "size", "fp", "root"), 1):
                rows[name] = np.asarray(batch.column(k)).astype(np.int64).view(np.uint64 if name == "fp" else np.int64)
            bits = batch.column(5)
            cuts = np.r_[0, np.flatnonzero(shingle[1:] != shingle[:-1]) + 1, len(shingle)].tolist()
            for s, e in zip(cuts, cuts[1:], strict=False):
                if held and shingle[s] != last:
                    yield from told(held)
                    held = []
                last = shingle[s]
                held.append((rows[s:e], bits.slice(s, e - s).to_pylist()))
        if held:
            yield from told(held)
        if done:
            yield out()

    own = met.where("met > 2").select(F.col("u").alias("shingle"), F.col("v").alias("node"), "met")
    rows = own.join(nodes, "node").select("shingle", "node", "size", "fp", "root", F.when(F.col("met") > CROWD, F.col("parities")).alias("parities"))
    return rows.repartition(parts, "shingle").sortWithinPartitions("shingle", "size", "node").mapInArrow(run, "u bigint, v bigint")


def _first_pairs(rows: np.ndarray, bits: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As many close pairs as join what all of them join: the closest ones first."""
    label = np.arange(len(rows))
    if bits:
        like = alike(rows, bits)
        yield forest(rows, WIDE, lambda x, y: like(x, y, 0.75), label)
        yield forest(rows, WIDE, like, label)
    else:
        for radius in (TIGHT, WIDE):
            yield forest(rows, radius, label=label)


def _other_pairs(rows: np.ndarray, bits: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All close pairs that aren't joined yet."""
    if (rows["root"] == rows["root"][0]).all():
        return
    like = alike(rows, bits) if bits else None
    for x, y in close_pairs(rows, WIDE):
        apart = rows["root"][x] != rows["root"][y]
        x, y = x[apart], y[apart]
        if like is not None and len(x):
            good = like(x, y)
            x, y = x[good], y[good]
        yield x, y


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs (u, v) whose sets (node, words) are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lambda b: np.frombuffer(b.as_buffer(), "<u8")
        for batch in batches:
            good = [similar(of(a), of(b)) for a, b in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    one, two = (sets.select(F.col("node").alias(n), F.col("words").alias(f"words_{n}")) for n in ("u", "v"))
    both = pairs.join(one, "u").join(two, "v")
    return both.select("u", "v", "words_u", "words_v").mapInArrow(run, "u bigint, v bigint")


def similar_classes(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, key (a hash of its text), node (a digest of its set of shingles), root: equal for
    texts that links of similar sets join.

    Similar sets have a rare shingle in common. Fingerprints of the sets that have it are compared in tiles (of many sets
    their parities too), and pairs that are close enough are verified by their sets: first pairs that join what all of
    them would, then those of the others that are not joined yet. Shuffle files are given up after each step, so that
    few take room at once.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    own = saved(sketches(texts, common_shingles(texts)))
    nodes = saved(own.groupBy("node").agg(F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("rare").alias("rare"), F.first("parities").alias("parities"), F.min(F.struct("doc_id", "key")).alias("who")))
    forget(spark)
    size = nodes.agg(F.sum(F.octet_length("rare"))).first()[0] or 0  # a rare shingle takes four bytes here, a row less than 32
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-8 * size // PART_BYTES))
    met = saved(meetings(nodes, parts))
    forget(spark)
    alone = met.where("met = 2").select("u", "v")
    pairs = saved(alone.unionByName(_met_pairs(met, nodes.withColumn("root", F.col("node")), parts, _first_pairs)).distinct())
    forget(spark)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rows_of(batch, 500):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t).astype("<u8").tobytes() for t in part.column(1).to_pylist()], pa.binary())], names=["node", "words"])

    def sets(pairs: DataFrame) -> DataFrame:
        paired = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        who = nodes.join(paired, "node").select("node", F.col("who.doc_id").alias("_id"), F.col("who.key").alias("_key"))
        found = texts.join(who, texts.doc_id.eqNullSafe(who._id) & (texts.key == who._key)).select("node", "text")
        return saved(found.mapInArrow(packed, "node bigint, words binary").dropDuplicates(["node"]))

    def similar_pairs(pairs: DataFrame) -> DataFrame:
        held = sets(pairs)
        forget(spark)
        out = saved(verified(pairs, held))
        forget(spark)
        return out

    links = similar_pairs(pairs)
    roots = components(links)
    rooted = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    others = saved(_met_pairs(met, rooted, parts, _other_pairs).distinct().join(pairs, ["u", "v"], "left_anti"))
    forget(spark)
    if not others.isEmpty():
        more = similar_pairs(others)
        if not more.isEmpty():
            roots = components(links.unionByName(more))
    forget(spark)
    return own.join(roots, "node", "left").select("doc_id", "key", "node", F.coalesce("root", "node").alias("root"))


def one_of_each(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """rows: doc_id, key and root of each row of docs. Of each root one row stays: of those with the smallest doc_id (null
    if all are null) one of a text. Other rows with its doc_id have roots of their own."""
    rows = rows.groupBy("root", "doc_id", "key").count()
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key", "count")).alias("first"))
    kept = saved(first.select(F.col("first.doc_id").alias("id"), F.col("first.key").alias("key"), F.col("first.count").alias("n")))
    out = without(docs, kept, "left_semi")
    if kept.where("n > 1").isEmpty():
        return out
    mark = free_name(docs, "_mark")
    return out.withColumn(mark, F.xxhash64("text")).dropDuplicates(["doc_id", mark]).drop(mark)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: of each class of similar_classes one row stays. Texts without a word are one class; null ids are
    the last choice; of rows that repeat id and text one stays; an empty table stays empty; other columns, whatever their
    names, are kept."""
    return one_of_each(docs, similar_classes(docs))
