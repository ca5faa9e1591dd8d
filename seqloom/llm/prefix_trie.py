"""Conversation prefix trie: which conversations begin alike, and how many tokens sharing their beginnings would save.

Turns are dictionary-encoded first: each distinct (role, text) has an id, so a conversation is a list of ids. Equal lists
are merged. The trie is then the order of these lists by most significant digit: a bucket holds all lists with the same
first d ids, and a bucket that is too large for one task is parted by the id that follows (MSD radix partitioning). Its
rows stay where they are; only small buckets are moved, each whole to one task, where a multikey quicksort orders them and
emits their nodes on the way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import median_low

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import saved, table

#: A bucket is parted while it has more turn ids than this and than this share of all, and more than FEW lists: so large
#: buckets are few (1 / SHARE of one depth at most), and a task never sorts more than that, or than FEW conversations.
LOCAL_IDS, SHARE, FEW = 1024, 1 / 65536, 64
#: A turn with more than this share of all rows gets its id by broadcast: there are at most 1 / HOT such turns.
HOT = 1 / 1024
#: Ids of conversations whose digest is taken at once; longer lists are cut into runs of this length first.
RUN = 4096
WORD = "[^\\x20\\x09-\\x0D]+"
NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, turn_id bigint, ends_key string"


def encoded(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """turns (conv_id, turn, role, text) as (sequences, dictionary). Sequences: conv_id, ids, n_words (of each turn), in the
    order of turn (null first, equal ones by the digest of role and text). Dictionary: turn_id, digest, n_words, n_rows.

    Null roles and texts become empty. Rows with a null conv_id belong to no conversation and are left out; repeated rows
    are turns of their own. A conversation is one row of 12 bytes a turn. Other columns aren't read.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    own = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint"), "turn", F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"), F.regexp_count(text, F.lit(WORD)).alias("n_words")
    )
    own = saved(own)
    # The number is of a row's place, so it holds only for the rows that are saved.
    dictionary = saved(own.groupBy("digest").agg(F.first("n_words").alias("n_words"), F.count("*").alias("n_rows")).withColumn("turn_id", F.monotonically_increasing_id()))
    most = max(1, int(own.count() * HOT))
    of = dictionary.select(F.col("digest").alias("_digest"), "turn_id")
    often = F.broadcast(dictionary.where(F.col("n_rows") > most).select(F.col("digest").alias("_digest"), F.col("turn_id").alias("hot_id")))
    marked = own.join(often, F.col("digest") == F.col("_digest"), "left").drop("_digest")
    rest = marked.where("hot_id IS NULL").join(of, F.col("digest") == F.col("_digest")).select("conv_id", "turn", "digest", "n_words", "turn_id")
    coded = rest.unionByName(marked.where("hot_id IS NOT NULL").select("conv_id", "turn", "digest", "n_words", F.col("hot_id").alias("turn_id")))
    row = F.struct("turn", F.xxhash64("digest").alias("tie"), "turn_id", "n_words")
    return saved(coded.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("t")).select("conv_id", F.col("t.turn_id").alias("ids"), F.col("t.n_words").alias("n_words"))), dictionary


def rebuilt(sequences: DataFrame) -> DataFrame:
    """Each conversation c with the first h ids of conversation c - c % 20 (all, if it has fewer; none, if there is no such
    conversation) in place of its own first h, where h is the CRC-32 of c in decimals, modulo 4."""
    base = F.col("conv_id") - F.col("conv_id") % 20
    heads = sequences.where(F.col("conv_id") % 20 == 0).select(F.col("conv_id").alias("base"), F.slice("ids", 1, 3).alias("head_ids"), F.slice("n_words", 1, 3).alias("head_words"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    both = sequences.withColumn("h", h).join(heads, base == F.col("base"), "left")

    def joined(head: str, own: str) -> Column:
        first = F.coalesce(F.slice(head, F.lit(1), F.col("h")), F.array().cast(sequences.schema[own].dataType))
        return F.concat(first, F.slice(own, F.col("h") + 1, F.size(own)))

    return both.select("conv_id", joined("head_ids", "ids").alias("ids"), joined("head_words", "n_words").alias("n_words"))


@dataclass
class Trie:
    """nodes: conv_id (smallest member; with depth it names the node), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, turn_id (of its last turn; root: null), ends_key (of conversations that end there; else null).
    members: conv_id, ends_key, for every conversation."""

    nodes: DataFrame
    members: DataFrame


def _sorted_nodes(rows: list[tuple[int, int, list[int], list[int], str]], depth: int) -> Iterator[list]:
    """Nodes of a bucket, whose lists (smallest conversation, number of conversations, ids, words, key) are distinct and
    begin alike up to depth. Each: [conv_id, depth, place of its parent, n_convs, n_children, n_leaves, saved, turn_id, key].

    Multikey quicksort: lists are parted in three by their next id against a middle one; the equal ones share one more
    node and are parted by the id after. Those that end come first.
    """
    nodes: list[list] = []

    def node(group: list, at: int, above: int) -> int:
        """Adds the node of a group that agrees up to at."""
        n = sum(r[1] for r in group)
        nodes.append([min(r[0] for r in group), at, above, n, 0, 0, (n - 1) * group[0][3][at - 1] if at else 0, group[0][2][at - 1] if at else None, None])
        if above >= 0:
            nodes[above][4] += 1
        return len(nodes) - 1

    todo = [(rows, depth, node(rows, depth, -1))]
    while todo:
        group, at, above = todo.pop()
        if len(group) == 1:  # one list: the rest is a path
            least, n, ids, words, key = group[0]
            for d in range(at + 1, len(ids) + 1):
                above = node(group, d, above)
            nodes[above][8] = key
            continue
        ended = [r for r in group if len(r[2]) == at]
        if ended:
            nodes[above][8] = ended[0][4]
            group = [r for r in group if len(r[2]) > at]
        if group:
            pivot = median_low([r[2][at] for r in group])
            parts = [r for r in group if r[2][at] < pivot], [r for r in group if r[2][at] == pivot], [r for r in group if r[2][at] > pivot]
            todo += [(part, at, above) for part in (parts[0], parts[2]) if part]
            todo.append((parts[1], at + 1, node(parts[1], at + 1, above)))
    for x in reversed(nodes):  # children come after their parents
        x[5] = x[5] or 1
        if x[2] >= 0:
            nodes[x[2]][5] += x[5]
            nodes[x[2]][6] += x[6]
    return nodes


def _local(rows: DataFrame) -> DataFrame:
    """Nodes of buckets (depth, bucket, digit) that are local; up, the large bucket above, is set at their tops."""

    def emit(group: list, depth: int, up: tuple[int, int], up_conv: int | None) -> pa.RecordBatch:
        nodes = _sorted_nodes(group, depth)
        columns = list(zip(*nodes, strict=True))
        parent = [up_conv if p < 0 else columns[0][p] for p in columns[2]]
        top = [p < 0 for p in columns[2]]
        arrays = [columns[0], columns[1], parent, *columns[3:8]]
        return pa.RecordBatch.from_arrays(
            [pa.array(x, pa.int64()) for x in arrays] + [pa.array(columns[8], pa.string()), *(pa.array([u if t else None for t in top], pa.int64()) for u in up)],
            names=[c.split()[0] for c in NODE.split(", ")] + ["up_depth", "up_bucket"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group, above = None, [], None
        for batch in batches:
            for depth, bucket, digit, up_conv, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (depth, bucket, digit) != at:
                    if group:
                        yield emit(group, at[0], at[:2] if at[0] else (None, None), above)
                    at, group, above = (depth, bucket, digit), [], up_conv
                group.append(tuple(row))
        if group:
            yield emit(group, at[0], at[:2] if at[0] else (None, None), above)

    own = rows.select("depth", "bucket", "digit", "up_conv", "conv_id", "n", "ids", "n_words", "ends_key")
    own = own.repartition("depth", "bucket", "digit").sortWithinPartitions("depth", "bucket", "digit")
    return own.mapInArrow(run, NODE + ", up_depth bigint, up_bucket bigint")


def prefix_trie(sequences: DataFrame) -> Trie:
    """The trie of sequences (conv_id, unique; ids; n_words): a node for each distinct list of first ids, the root for none.

    n_convs: conversations that begin with the node's list (those without a turn are in the root alone); n_children; n_leaves:
    childless nodes below, itself included; saved_tokens: over the nodes below, itself included, of (n_convs - 1) times the
    words of the last turn. No sequences: no nodes. Large buckets are parted depth by depth, one job each, so a beginning
    that a large part of all conversations share costs as many jobs as it has turns.
    """
    spark = sequences.sparkSession
    keyed = sequences.withColumn("ends_key", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256))
    # Copies of one conversation are merged before rows are moved; lists that differ have different keys.
    distinct = saved(keyed.groupBy("ends_key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), F.first("ids").alias("ids"), F.first("n_words").alias("n_words")))
    members = keyed.select("conv_id", "ends_key")
    size = F.size("ids").cast("bigint") + 1
    total = distinct.agg(F.sum(size), F.min("conv_id"), F.sum("n"), F.count("*")).first()
    if total[0] is None:
        return Trie(spark.createDataFrame([], NODE), members)
    most = max(LOCAL_IDS, int(total[0] * SHARE))
    live = distinct.withColumns({"bucket": F.lit(0).cast("bigint"), "up_conv": F.lit(None).cast("bigint")})
    if total[0] <= most or total[3] <= FEW:
        nodes = _local(live.withColumns({"depth": F.lit(0).cast("bigint"), "digit": F.lit(None).cast("bigint")}))
        return Trie(nodes.drop("up_depth", "up_bucket"), members)
    # Large buckets of one depth are at most 1 / SHARE: their figures are held by the driver, and joined by broadcast.
    large: list[list[dict]] = [[{"conv_id": total[1], "parent": None, "n": total[2], "words": 0, "turn_id": None, "up": None}]]
    local = []
    while large[-1]:
        depth = len(large) - 1
        live = live.withColumn("digit", F.get("ids", F.lit(depth)))
        for r in live.where("digit IS NULL").select("bucket", "ends_key").collect():  # one for each bucket: distinct lists
            large[-1][r.bucket]["ends_key"] = r.ends_key
        live = live.where("digit IS NOT NULL")
        grown = live.groupBy("bucket", "digit").agg(F.sum(size).alias("size"), F.min("conv_id").alias("conv_id"), F.sum("n").alias("n"), F.first(F.get("n_words", F.lit(depth))).alias("words"), F.count("*").alias("lists")).where((F.col("size") > most) & (F.col("lists") > FEW))
        found = grown.orderBy("bucket", "digit").collect()
        large.append([{"conv_id": r.conv_id, "parent": large[-1][r.bucket]["conv_id"], "n": r.n, "words": r.words, "turn_id": r.digit, "up": r.bucket} for r in found])
        convs = spark.createDataFrame([(k, x["conv_id"]) for k, x in enumerate(large[-2])], "_bucket bigint, _conv bigint")
        live = live.drop("up_conv").join(F.broadcast(convs), F.col("bucket") == F.col("_bucket")).withColumnRenamed("_conv", "up_conv").drop("_bucket")
        number = spark.createDataFrame([(r.bucket, r.digit, k) for k, r in enumerate(found)], "_bucket bigint, _digit bigint, number bigint")
        live = live.join(F.broadcast(number), (F.col("bucket") == F.col("_bucket")) & (F.col("digit") == F.col("_digit")), "left").drop("_bucket", "_digit")
        live = saved(live) if found and depth % 8 == 7 else live
        local.append(live.where("number IS NULL").withColumn("depth", F.lit(depth + 1).cast("bigint")))
        live = live.where("number IS NOT NULL").withColumn("bucket", F.col("number")).drop("number")
    small = local[0]
    for more in local[1:]:
        small = small.unionByName(more)
    below = saved(_local(small))
    sums = below.where("up_depth IS NOT NULL").groupBy("up_depth", "up_bucket").agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    of = {(r.up_depth - 1, r.up_bucket): r for r in sums.collect()}
    rows = []
    for depth in reversed(range(len(large) - 1)):
        by_up: dict[int, list] = {}
        for y in large[depth + 1]:
            by_up.setdefault(y["up"], []).append(y)
        for k, x in enumerate(large[depth]):
            from_small, own = of.get((depth, k)), by_up.get(k, [])
            x["leaves"] = (from_small.leaves if from_small else 0) + sum(y["leaves"] for y in own) or 1
            x["saved"] = (x["n"] - 1) * x["words"] + (from_small.saved if from_small else 0) + sum(y["saved"] for y in own)
            rows.append((x["conv_id"], depth, x["parent"], x["n"], (from_small.children if from_small else 0) + len(own), x["leaves"], x["saved"], x["turn_id"], x.get("ends_key")))
    return Trie(below.drop("up_depth", "up_bucket").unionByName(spark.createDataFrame(rows, NODE)), members)


def end_digests(members: DataFrame) -> DataFrame:
    """(ends_key, ends_sha256): the digest of each key's conversations in decimals, ascending, parted by commas.

    Ids are dealt out by ranges of key and id, so that a key with very many is sorted by many tasks; each gives runs, and
    a key's runs are digested one after the other, whatever their number.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([own[0]], pa.int64()), pa.array([",".join(map(str, own))])], names=["ends_key", "first", "ids"])

        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own and (k != key or len(own) == RUN):
                    yield out()
                    own = []
                key = k
                own.append(c)
        if own:
            yield out()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None

        def out() -> tuple:
            return key, sha.hexdigest()

        for batch in batches:
            found = []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k == key:
                    sha.update(b",")
                else:
                    if sha:
                        found.append(out())
                    key, sha = k, hashlib.sha256()
                sha.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.string()) for c in (0, 1)], names=["ends_key", "ends_sha256"])
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in out()], names=["ends_key", "ends_sha256"])

    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = members.select("ends_key", "conv_id").repartitionByRange(n, "ends_key", "conv_id").sortWithinPartitions("ends_key", "conv_id")
    parts = ranged.mapInArrow(runs, "ends_key string, first bigint, ids string")
    own = parts.repartition("ends_key").sortWithinPartitions("ends_key", "first").select("ends_key", "ids")
    return own.mapInArrow(digests, "ends_key string, ends_sha256 string")


def with_turns(trie: Trie, dictionary: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes with role and text of their last turn (the root's are null)."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    texts = turns.select(digest.alias("digest"), role.alias("role"), text.alias("text"))
    first = texts.groupBy("digest").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    return trie.nodes.join(dictionary.select("turn_id", "digest").join(first, "digest").drop("digest"), "turn_id", "left")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    sequences, _ = encoded(table(spark, sf_dir, "conversations"))
    trie = prefix_trie(saved(rebuilt(sequences)))
    ends = end_digests(trie.members)
    none = hashlib.sha256(b"").hexdigest()
    columns = [c.split()[0] for c in NODE.split(", ")][:7]
    # Most nodes end no conversation: they aren't joined, as all would have one key.
    ended = trie.nodes.where("ends_key IS NOT NULL").join(ends, "ends_key").select(*columns, "ends_sha256")
    return ended.unionByName(trie.nodes.where("ends_key IS NULL").select(*columns, F.lit(none).alias("ends_sha256")))
