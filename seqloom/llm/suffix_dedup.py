"""Suffix-array dedup: bytes covered by a long enough string that also starts earlier in the corpus are removed.

Every string of `least` bytes holds an anchor, chosen from its content alone: the leftmost of its 32-byte windows with
the least hash. So equal strings hold equal anchors at equal places, and only what lies around equal anchors needs to
be compared. Of occurrences with equal surroundings (as far as a string around the anchor can reach) all but the first
are covered whole. The firsts of different surroundings are sorted as suffixes, to the right from the anchor and to
the left of it, by deep-shallow sorting: multikey quicksort to a shallow depth, then blind tries for groups with longer
common prefixes. The two orders and their common prefixes tell for each way to place a string around the anchor which
surroundings agree on it.

No task holds all occurrences of an anchor: each batch of documents sends one for each surrounding, and anchors with
very many different surroundings are split by more of the text next to them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import forget, free_name, saved, table

ANCHOR = 32
#: Bytes of text that are hashed at once, and bits for a place in them.
CHUNK, PLACE_BITS = 1 << 18, 20
#: Anchors with more surroundings than this are split by 34 more bytes to either side.
CROWD = 2000
SHALLOW = 16
#: Bytes of text for each partition of anchors: their number grows with the input, so no task does.
PART_BYTES = 32 << 20
#: Anchors that a task holds before it sends them on.
HELD = 400_000
MIX = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD]


# --- anchors ---------------------------------------------------------------------------------------------------------


def _window_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each window of ANCHOR bytes, by doubling."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(MIX[0])
    h ^= h >> np.uint64(29)
    width = 1
    for m in MIX:
        h = h[:-width] * np.uint64(m) + (h[width:] ^ (h[width:] >> np.uint64(31)))
        width *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(MIX[1])
    h ^= h >> np.uint64(29)
    return h


def anchors(text: bytes, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of all strings of `least` bytes in text."""
    places, hashes = [], []
    span = least - ANCHOR + 1  # windows in a string
    for at in range(0, len(text) - least + 1, CHUNK):
        data = np.frombuffer(text, np.uint8, min(CHUNK + least - 1, len(text) - at), at)
        h = _window_hashes(data)
        key = (h & ~np.uint64((1 << PLACE_BITS) - 1)) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        if width < span:
            key = np.minimum(key[: len(h) - span + 1], key[span - width : span - width + len(h) - span + 1])
        place = (key & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        place = place[np.r_[True, place[1:] != place[:-1]]]
        places.append(place + at)
        hashes.append(h[place])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    place, h = np.concatenate(places), np.concatenate(hashes)
    new = np.r_[True, place[1:] != place[:-1]]
    return place[new], h[new]


def surroundings(text: bytes, place: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Start and end of what a string of `least` bytes that holds the anchor can reach."""
    reach = least - ANCHOR
    return [(max(0, p - reach), min(len(text), p + least)) for p in place.tolist()]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


# --- deep-shallow sorting --------------------------------------------------------------------------------------------


class BlindTrie:
    """Sorted strings with the common prefix of neighbours. A branch stores only how deep it is and its next byte, so a
    search goes down blindly and then compares once."""

    def __init__(self, first: bytes, item: int):
        self.root: list = [first, [item]]  # a leaf: the string and its items; a branch: [None, depth, {byte: node}]

    @staticmethod
    def _leaf(node: list) -> list:
        while node[0] is None:
            node = next(iter(node[2].values()))
        return node

    def add(self, text: bytes, item: int) -> None:
        node = self.root
        while node[0] is None:
            depth = node[1]
            child = node[2].get(text[depth] if depth < len(text) else -1)
            node = child if child is not None else next(iter(node[2].values()))
        other = node[0]
        common = common_prefix(text, other)
        if common == len(text) == len(other):
            node[1].append(item)
            return
        parent, node = None, self.root
        while node[0] is None and node[1] <= common:
            if node[1] == common:
                node[2][text[common] if common < len(text) else -1] = [text, [item]]
                return
            parent, node = node, node[2][text[node[1]]]
        branch = [None, common, {(other[common] if common < len(other) else -1): node, (text[common] if common < len(text) else -1): [text, [item]]}]
        if parent is None:
            self.root = branch
        else:
            parent[2][text[parent[1]]] = branch

    def walk(self) -> Iterator[tuple[int, int]]:
        """Items in order, each with the common prefix of its string and the one before (-1: the first)."""
        stack: list[tuple[list, int]] = [(self.root, -1)]
        while stack:
            node, depth = stack.pop()
            if node[0] is not None:
                for item in node[1]:
                    yield item, depth
                    depth = len(node[0])
                continue
            keys = sorted(node[2], reverse=True)
            stack += [(node[2][k], node[1] if k != keys[-1] else depth) for k in keys]


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def deep_shallow_sort(texts: list[bytes], shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """The order of texts, and for each place in it the common prefix with the text before (0 at the first).

    Three-way partition by one byte after another to the shallow depth; what is still equal there goes into a blind
    trie.
    """
    order: list[int] = []
    common: list[int] = []
    # Each entry: texts that agree on `depth` bytes, and their first one's common prefix with what comes before.
    stack: list[tuple[list[int], int, int]] = [(list(range(len(texts))), 0, 0)]
    while stack:
        rows, depth, before = stack.pop()
        if len(rows) == 1:
            order.append(rows[0])
            common.append(before)
            continue
        if depth >= shallow:
            trie = BlindTrie(texts[rows[0]], rows[0])
            for r in rows[1:]:
                trie.add(texts[r], r)
            for r, c in trie.walk():
                order.append(r)
                common.append(before if c < 0 else c)
            continue
        pivot = texts[rows[len(rows) // 2]][depth : depth + 1]
        low, same, high = [], [], []
        for r in rows:
            c = texts[r][depth : depth + 1]
            (same if c == pivot else low if c < pivot else high).append(r)
        parts = [(low, depth), (same, depth + 1 if pivot else shallow), (high, depth)]
        parts = [p for p in parts if p[0]]
        stack += [(rows, d, before if k == 0 else depth) for k, (rows, d) in reversed(list(enumerate(parts)))]
    return order, common


# --- comparing surroundings ------------------------------------------------------------------------------------------


def repeated_spans(left: list[bytes], right: list[bytes], least: int) -> list[tuple[int, int] | None]:
    """Surroundings of one anchor in corpus order; left: what is before it, backwards; right: from it on. For each the
    bytes before the anchor and from it on that strings of `least` bytes cover which an earlier surrounding holds too."""
    n = len(left)
    if n == 2:
        r, lft = common_prefix(right[0], right[1]), common_prefix(left[0], left[1])
        return [None, (lft, r) if lft + r >= least else None]
    reach = least - ANCHOR
    orders = []
    for texts in (left, right):
        order, common = deep_shallow_sort(texts)
        orders.append((np.array(order), np.array(common)))
    size_l, size_r = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    most_l, most_r = np.full(n, -1), np.full(n, -1)
    # Which are equal, and long enough, changes with the bytes before the anchor (b) only at these numbers of them.
    (_, common_l), (_, common_r) = orders
    starts = np.unique(np.concatenate([[0], common_l + 1, least - common_r, size_l + 1, least - size_r]))
    starts = starts[(starts >= 0) & (starts <= reach)].tolist()
    for b, end in zip(starts, [*starts[1:], reach + 1], strict=True):
        fits = np.flatnonzero((size_l >= b) & (size_r >= least - b))
        if len(fits) < 2:
            continue
        cls = np.zeros(n, np.int64)
        for (order, common), depth in zip(orders, (b, least - b), strict=True):
            own = np.empty(n, np.int64)
            own[order] = np.cumsum(common < depth)
            cls = cls * (n + 1) + own
        _, first, inverse = np.unique(cls[fits], return_index=True, return_inverse=True)
        again = fits[first[inverse.reshape(-1)] != np.arange(len(fits))]
        most_l[again] = np.maximum(most_l[again], end - 1)
        most_r[again] = np.maximum(most_r[again], least - b)
    return [(int(a), int(b)) if a >= 0 else None for a, b in zip(most_l, most_r, strict=True)]


# --- Spark -----------------------------------------------------------------------------------------------------------

_KEY = "doc_id bigint, mark bigint"


def _documents(docs: DataFrame) -> DataFrame:
    """doc_id (null: the least number), mark (a hash of the text, for rows that share an id), text as bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).alias("doc_id"), F.xxhash64(text).alias("mark"), F.encode(text, "UTF-8").alias("text"))


def _first_pass(least: int, buckets: int):
    """For each batch of documents: anchors by bucket, packed; and spans that the batch itself shows to be repeated."""
    reach = least - ANCHOR

    def flushed(docs: list[tuple[int, int, int]], parts: list[tuple]) -> pa.RecordBatch:
        number = np.repeat(np.arange(len(docs)), [len(p[0]) for p in parts])
        place, h, c = (np.concatenate(x) for x in zip(*parts, strict=True))
        ids, marks, sizes = (np.array(x, np.int64) for x in zip(*docs, strict=True))
        order = np.lexsort([place, number, c, h])
        number, place, h, c = number[order], place[order], h[order], c[order]
        again = np.r_[False, (h[1:] == h[:-1]) & (c[1:] == c[:-1])]
        rows = np.empty(int((~again).sum()), _ROW)
        for name, x in (("h", h), ("c", c), ("doc", ids[number]), ("mark", marks[number]), ("place", place)):
            rows[name] = x[~again]
        to = (rows["h"] >> np.uint64(40)) % np.uint64(buckets)
        order = np.lexsort([rows["place"], rows["mark"], rows["doc"], to])
        rows, to = rows[order], to[order]
        cuts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
        out = [(int(to[s]), None, None, _packed(rows[s:e])) for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(rows)], strict=True)]
        number, place = number[again], place[again]
        order = np.lexsort([place, number])
        number, place = number[order], place[order]
        spans = np.stack([np.maximum(0, place - reach), np.minimum(sizes[number], place + least)], axis=1).astype("<i4")
        new = np.ones(len(number), bool)
        new[1:] = (number[1:] != number[:-1]) | (spans[1:, 0] > spans[:-1, 1])
        first = np.flatnonzero(new)
        runs = np.stack([spans[first, 0], spans[np.r_[first[1:], len(number)] - 1, 1]], axis=1) if len(first) else spans[:0]
        owner = number[first]
        for k in np.unique(owner).tolist():
            d, m, _ = docs[k]
            out.append(((d * 31 + m) % buckets, d, m, runs[np.searchsorted(owner, k) : np.searchsorted(owner, k, "right")].tobytes()))
        cols = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary())], names=["bucket", "doc_id", "mark", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[tuple[int, int, int]] = []
        parts: list[tuple] = []
        seen: set[tuple[int, int]] = set()
        held = 0
        for batch in batches:
            for k, own in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if own in seen:
                    continue  # the same row again: one document
                seen.add(own)
                text = batch.column(2)[k].as_py()
                place, h = anchors(text, least)
                if not len(place):
                    continue
                view = memoryview(text)
                c = [xxhash.xxh64_intdigest(view[s:e], (p - s) * 256 + e - p) for p, (s, e) in zip(place.tolist(), surroundings(text, place, least), strict=True)]
                docs.append((*own, len(text)))
                parts.append((place, h, np.array(c, np.uint64)))
                held += len(place)
                if held >= HELD:
                    # what is flushed together is in corpus order
                    order = sorted(range(len(docs)), key=docs.__getitem__)
                    yield flushed([docs[k] for k in order], [parts[k] for k in order])
                    docs, parts, held = [], [], 0
                    seen.clear()
        if docs:
            order = sorted(range(len(docs)), key=docs.__getitem__)
            yield flushed([docs[k] for k in order], [parts[k] for k in order])

    return run


_ROW = np.dtype([("h", "<u8"), ("c", "<u8"), ("doc", "<i8"), ("mark", "<i8"), ("place", "<i4")])


def _packed(rows: np.ndarray) -> bytes:
    """The rows column by column, documents once each, compressed."""
    new = np.r_[True, (rows["doc"][1:] != rows["doc"][:-1]) | (rows["mark"][1:] != rows["mark"][:-1])]
    parts = [rows["doc"][new], rows["mark"][new], np.diff(np.r_[np.flatnonzero(new), len(rows)]).astype("<i4"), rows["place"], rows["h"], rows["c"]]
    return np.array([len(rows), int(new.sum())], "<i4").tobytes() + b"".join(np.ascontiguousarray(p).tobytes() for p in parts)


def _unpacked(data: bytes) -> np.ndarray:
    n, docs = np.frombuffer(data, "<i4", 2).tolist()
    at = 8

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    doc, mark, size = take("<i8", docs), take("<i8", docs), take("<i4", docs)
    rows = np.empty(n, _ROW)
    rows["doc"], rows["mark"] = np.repeat(doc, size), np.repeat(mark, size)
    rows["place"], rows["h"], rows["c"] = take("<i4", n), take("<u8", n), take("<u8", n)
    return rows


def _second_pass(least: int):
    """Within a bucket: spans of occurrences that aren't their surroundings' first, and firsts that are to be compared.
    Rows come by bucket, and one bucket is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        bucket = None
        for batch in batches:
            passed = batch.filter(batch.column(1).is_valid())
            if passed.num_rows:
                yield _requests([(d, m, None, 0, data) for d, m, data in zip(*(passed.column(c).to_pylist() for c in (1, 2, 3)), strict=True)])
            rest = batch.filter(batch.column(1).is_null())
            for b, data in zip(rest.column(0).to_pylist(), (x.as_py() for x in rest.column(3)), strict=True):
                if b != bucket and held:
                    yield from of_bucket(held)
                    held = []
                bucket = b
                held.append(_unpacked(data))
        if held:
            yield from of_bucket(held)

    def of_bucket(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate(held)
        rows = rows[np.lexsort([rows["place"], rows["mark"], rows["doc"], rows["c"], rows["h"]])]
        rows = rows[np.r_[True, rows[1:] != rows[:-1]]]  # rows that repeat a document
        same_h = np.r_[False, rows["h"][1:] == rows["h"][:-1]]
        same_c = same_h & np.r_[False, rows["c"][1:] == rows["c"][:-1]]
        for part in _blocks(rows[same_c]):
            spans = np.stack([part["place"] - (least - ANCHOR), part["place"] + least], axis=1).astype("<i4")
            yield _requests([(d, m, None, 0, s.tobytes()) for d, m, s in zip(part["doc"].tolist(), part["mark"].tolist(), spans, strict=True)])
        first, same_h = rows[~same_c], same_h[~same_c]
        group = np.cumsum(~same_h) - 1
        size = np.bincount(group)[group] if len(group) else group
        many = size > 1
        for part, n in zip(_blocks(first[many]), _blocks(size[many]), strict=True):
            yield _requests([(d, m, h, n_, np.asarray([p], "<i4").tobytes()) for d, m, h, n_, p in zip(part["doc"].tolist(), part["mark"].tolist(), part["h"].view(np.int64).tolist(), n.tolist(), part["place"].tolist(), strict=True)])

    return run


def _blocks(rows: np.ndarray, size: int = 20_000) -> list[np.ndarray]:
    return [rows[k : k + size] for k in range(0, len(rows), size)]


def _requests(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.binary())], names=["doc_id", "mark", "anchor", "crowd", "data"])


def _cut_out(least: int, crowd: int):
    """For each document with anchors to compare: what surrounds them."""
    reach = least - ANCHOR
    half = (reach + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                doc, mark, text, wanted = (batch.column(c)[k].as_py() for c in range(4))
                for w in wanted:
                    h, p = w["anchor"], int.from_bytes(w["data"], "little")
                    s, e = max(0, p - reach), min(len(text), p + least)
                    row = (doc, mark, p, p - s, text[s:e])
                    if w["crowd"] <= crowd:
                        out.append((h, *row))
                        continue
                    # Strings of `least` bytes reach `half` bytes beyond the anchor on one side at least.
                    if e - p >= ANCHOR + half:
                        out.append((xxhash.xxh64_intdigest(text[p : p + ANCHOR + half], h & 0xFFFF) - 2**63, *row))
                    if p - s >= half:
                        out.append((xxhash.xxh64_intdigest(text[p - half : p + ANCHOR], 1 + (h & 0xFFFF)) - 2**63, *row))
                if len(out) > 20_000:
                    yield _cuts(out)
                    out = []
            if out:
                yield _cuts(out)

    return run


def _cuts(rows: list[tuple]) -> pa.RecordBatch:
    c = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int64()), pa.array(c[4], pa.int64()), pa.array(c[5], pa.binary())], names=["anchor", "doc_id", "mark", "place", "before", "data"])


def _compare(least: int):
    """Sorted by anchor and corpus order: spans that an earlier surrounding holds too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out(rows: list[tuple]) -> list[tuple]:
            found, s = [], 0
            while s < len(rows):
                e = s + 1
                while e < len(rows) and rows[e][0] == rows[s][0]:
                    e += 1
                if e - s > 1:
                    own = rows[s:e]
                    spans = repeated_spans([r[5][: r[4]][::-1] for r in own], [r[5][r[4] :] for r in own], least)
                    found += [(r[1], r[2], None, 0, np.asarray([r[3] - x[0], r[3] + x[1]], "<i4").tobytes()) for r, x in zip(own, spans, strict=True) if x]
                s = e
            return found

        for batch in batches:
            held += zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True)
            cut = len(held)
            while cut and held[cut - 1][0] == held[-1][0]:
                cut -= 1
            if cut and (found := out(held[:cut])):
                yield _requests(found)
            held = held[cut:]
        if held and (found := out(held)):
            yield _requests(found)

    return run


def repeated(docs: DataFrame, least: int = 100, crowd: int = CROWD) -> DataFrame:
    """(doc_id, mark, spans): for each document with some, the bytes' spans to remove, packed and not yet merged."""
    own = _documents(docs)
    spark = docs.sparkSession
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    buckets = max(64, 4 * parts)
    request = "doc_id bigint, mark bigint, anchor bigint, crowd bigint, data binary"
    packed = own.where(F.length("text") >= least).mapInArrow(_first_pass(least, buckets), "bucket bigint, doc_id bigint, mark bigint, data binary")
    found = saved(packed.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_second_pass(least), request))
    forget(spark)  # the shuffled anchors are not read again
    asked = found.where("anchor is not null").groupBy("doc_id", "mark").agg(F.collect_list(F.struct("anchor", "crowd", "data")).alias("wanted"))
    # One row for each document: rows that repeat one are dropped before their texts are read.
    texts = own.where(F.length("text") >= least).join(asked, ["doc_id", "mark"]).select("doc_id", "mark", "text", "wanted")
    cut = texts.mapInArrow(_cut_out(least, crowd), "anchor bigint, doc_id bigint, mark bigint, place bigint, before bigint, data binary")
    compared = cut.repartition(parts, "anchor").dropDuplicates(["anchor", "doc_id", "mark", "place"]).sortWithinPartitions("anchor", "doc_id", "mark", "place").mapInArrow(_compare(least), request)
    spans = found.where("anchor is null").unionByName(compared).select("doc_id", "mark", "data")
    out = saved(spans.groupBy("doc_id", "mark").agg(F.collect_list("data").alias("spans")))
    forget(spark)
    return out


def _whole_characters(text: bytes, s: int, e: int) -> tuple[int, int]:
    """The bytes from s to e, with the other bytes of the characters at both ends."""
    while 0 < s < len(text) and text[s] & 0xC0 == 0x80:
        s -= 1
    while e < len(text) and text[e] & 0xC0 == 0x80:
        e += 1
    return s, e


def _kept(text: bytes, spans: list[bytes] | None, characters: bool = False) -> tuple[bytes, int, int]:
    """What is left, bytes removed, runs removed. characters: those that lose some of their bytes go whole."""
    if not spans:
        return text, 0, 0
    cut = [(max(0, s), min(len(text), e)) for s, e in np.concatenate([np.frombuffer(x, "<i4").reshape(-1, 2) for x in spans]).tolist()]
    cut = merged(sorted(_whole_characters(text, s, e) for s, e in cut) if characters else cut)
    out, at = [], 0
    for s, e in cut:
        out.append(text[at:s])
        at = e
    out.append(text[at:])
    return b"".join(out), sum(e - s for s, e in cut), len(cut)


def _with_spans(docs: DataFrame, least: int, crowd: int = CROWD) -> DataFrame:
    """docs, and as the last column their spans, under a name that docs has not."""
    doc, mark, found = (free_name(docs, x) for x in ("_doc", "_mark", "_spans"))
    own = docs.select("*", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).alias(doc), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias(mark))
    spans = repeated(docs.select("doc_id", "text"), least, crowd).select(F.col("doc_id").alias(doc), F.col("mark").alias(mark), F.col("spans").alias(found))
    return own.join(spans, [doc, mark], "left").select(*docs.columns, found)


def removals(docs: DataFrame, least: int = 100, crowd: int = CROWD) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans (maximal runs removed), kept_sha256.

    Texts are UTF-8 bytes, null is empty; matches don't cross documents. Texts shorter than `least` bytes lose nothing, and
    texts of any length are searched whole, a chunk at a time. The order is by doc_id (null first), then
    start; documents that share an id are in the order of a hash of their texts, and rows that repeat id and text are
    one document, each with its result. Other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for k in range(batch.num_rows):
                text = (batch.column(1)[k].as_py() or "").encode()
                kept, removed, runs = _kept(text, batch.column(2)[k].as_py())
                found.append((len(text), removed, runs, hashlib.sha256(kept).hexdigest()))
            c = list(zip(*found, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in c[:3]), pa.array(c[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _with_spans(docs.select("doc_id", "text"), least, crowd).mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without their repeated bytes; characters that lose some of their bytes go whole. n_chars is counted anew.

    Null texts stay null and lose nothing; null doc_ids come first; rows that repeat doc_id and text lose the same; an empty
    table stays empty; other columns, whatever their names, are kept.
    """
    both = _with_spans(docs, 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = []
            for k in range(batch.num_rows):
                text, spans = batch.column(at)[k].as_py(), batch.column(batch.num_columns - 1)[k].as_py()
                texts.append(_kept(text.encode(), spans, characters=True)[0].decode() if spans else text)
            columns = [pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    out = both.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
