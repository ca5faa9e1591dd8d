"""Reading and writing sequence pairs with Spark's own text readers, so any store that Spark reaches will do.

Formats by file extension: .seq (lines in turn '>A' and '<B'), .txt (lines in turn A and B), .fna/.fa/.fasta (records in
turn). Large files are split among tasks; a line's number in its file comes from counts of the blocks before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FORMATS = {"seq": "seq", "txt": "txt", "fna": "fasta", "fa": "fasta", "fasta": "fasta"}


def _extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds n, each row's number in its file. A block is read in order by one task, so a row's number in it is how far its id
    is from the block's first; no row is moved. One row for each block goes to all tasks."""
    at = rows.withColumn("at", F.monotonically_increasing_id())
    blocks = at.groupBy("file", "block").agg(F.count("*").alias("size"), F.min("at").alias("first"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("file", "block", (F.coalesce(F.sum("size").over(before), F.lit(0)) - F.col("first")).alias("base"))
    return at.join(F.broadcast(starts), ["file", "block"]).withColumn("n", F.col("at") + F.col("base")).drop("base", "at")


def _lines(spark: SparkSession, path: str, separator: str, pattern: str) -> DataFrame:
    rows = spark.read.option("lineSep", separator).option("pathGlobFilter", pattern).text(path)
    return rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


_PAIR = "file string, pair bigint, a string, b string, name_a string, name_b string, sides bigint"


def _side_by_side(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (file, n, value, name), each file's in the order of n, to pairs of an even n and the next. Sides whose partner
    another task has are rows of their own, with nulls for it."""
    names = [c.split()[0] for c in _PAIR.split(", ")]

    def pairs(rows: pa.Table) -> pa.RecordBatch:
        n = rows["n"].to_numpy()
        file = rows["file"].combine_chunks().dictionary_encode().indices.to_numpy()
        met = np.zeros(len(n), bool)
        met[:-1] = (n[:-1] % 2 == 0) & (n[1:] == n[:-1] + 1) & (file[1:] == file[:-1])
        second = np.r_[False, met[:-1]]
        at = np.flatnonzero(~second)
        even = n[at] % 2 == 0
        left, right = pa.array(at, mask=~even), pa.array(np.where(met[at], at + 1, at), mask=even & ~met[at])
        side = lambda c, k: rows[c].combine_chunks().take(k)
        columns = [side("file", pa.array(at)), pa.array(n[at] // 2), side("value", left), side("value", right), side("name", left), side("name", right), pa.array(1 + met[at].astype(np.int64))]
        return pa.RecordBatch.from_arrays(columns, names=names)

    kept = None  # the last row, whose partner may be in the next batch
    for batch in batches:
        if batch.num_rows:
            rows = pa.Table.from_batches([batch] if kept is None else [kept, batch])
            kept = batch.slice(batch.num_rows - 1)
            whole = rows["n"][-1].as_py() % 2 == 1
            yield pairs(rows if whole else rows.slice(0, len(rows) - 1))
            kept = None if whole else kept
    if kept is not None:
        yield pairs(pa.Table.from_batches([kept]))


def _paired(rows: DataFrame, strict: bool, prefixed: bool) -> DataFrame:
    rows = _numbered(rows)
    value, side = F.col("value"), F.col("n") % 2
    if prefixed:
        mark = F.when(side == 0, ">").otherwise("<")
        fits = F.substring(value, 1, 1) == mark
        value = F.when(fits, F.substring(value, 2, 2**31 - 1)).otherwise(F.raise_error(F.concat(F.lit("a .seq line must start with > and < in turn: "), F.substring(value, 1, 40))))
    sides = rows.withColumn("value", value).select("file", "n", "value", "name").mapInArrow(_side_by_side, _PAIR)
    one = lambda c: F.max(c).alias(c)
    halves = sides.where("sides = 1").groupBy("file", "pair").agg(*map(one, ("a", "b", "name_a", "name_b")), F.sum("sides").alias("sides"))
    out = sides.where("sides = 2").unionByName(halves)
    if strict:
        return out.withColumn("b", F.when(F.col("sides") == 2, F.col("b")).otherwise(F.raise_error(F.concat(F.lit("the last line of "), F.col("file"), F.lit(" has no partner"))))).drop("sides")
    return out.where("sides = 2").drop("sides")


def read_pairs(spark: SparkSession, path: str, mode: str = "PERMISSIVE", kind: str | None = None) -> DataFrame:
    """(file, pair, a, b, name_a, name_b) of one file or of all files of a folder; names are those of FASTA records. kind
    (seq, txt or fasta) takes the place of the files' extensions.

    An empty line of a .txt file is an empty sequence. A last line or record without a partner is dropped, or an error
    with mode FAILFAST. Files of other kinds are an error, as is a .seq line without its prefix, an empty one included.
    """
    if mode not in ("PERMISSIVE", "FAILFAST"):
        raise ValueError("mode is PERMISSIVE or FAILFAST")
    if kind:
        kinds = {kind}
    else:
        files = spark.read.format("binaryFile").load(path).select("path").withColumn("kind", _extension(F.col("path")))
        kinds = {r.kind for r in files.select("kind").distinct().collect()}
    if other := kinds - FORMATS.keys():
        raise ValueError(f"unknown extension {sorted(other)[0]!r}; known are {', '.join(FORMATS)}")
    parts = []
    for name in sorted(kinds):
        pattern = "*" if kind else f"*.{name}"
        if FORMATS[name] == "fasta":
            rows = _lines(spark, path, "\n>", pattern).withColumn("value", F.regexp_replace("value", "^>", ""))
            head = F.substring_index(F.col("value"), "\n", 1)
            body = F.regexp_replace(F.substr("value", F.length(head) + 1), r"\s+", "")
            rows = rows.select("file", "block", F.split(head, r"\s")[0].alias("name"), body.alias("value"))
        else:
            rows = _lines(spark, path, "\n", pattern).select("file", "block", F.lit(None).cast("string").alias("name"), F.regexp_replace("value", "\r$", "").alias("value"))
        parts.append(_paired(rows, mode == "FAILFAST", FORMATS[name] == "seq"))
    if not parts:
        return spark.createDataFrame([], "file string, pair bigint, a string, b string, name_a string, name_b string")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("file", "pair", "a", "b", "name_a", "name_b")


def write_costs(aligned: DataFrame, path: str, order: list[str]) -> None:
    """Lines 'cost,cigar' without a header, in the given order across the files."""
    aligned.orderBy(*order).select(F.concat_ws(",", F.col("cost").cast("string"), "cigar")).write.text(path)


def write_seq(pairs: DataFrame, path: str, order: list[str]) -> None:
    """Pairs as lines '>a' and '<b' in turn: the .seq format. Both lines of a pair stay in one file."""
    pairs.orderBy(*order).select(F.concat(F.lit(">"), "a", F.lit("\n<"), "b")).write.text(path)


def simulated_pairs(reads: DataFrame, reference: DataFrame, strip: bool = False, count: int | None = None) -> DataFrame:
    """Simulated reads and the part of the reference that each comes from: (name, id, a, b).

    reads: (header, sequence), headers name_start_aligned_id_strand_prefix_length_suffix; reference: (name, sequence).
    a is the part of the reference and b the read. Reads of the reverse strand and headers without those eight parts are
    an error; reads whose part has an N are dropped. strip drops the read's letters
    before and after the aligned part.
    """
    part = F.split("header", "_")
    number = lambda k: part[k].cast("int")
    strand = F.when(part[4] == "F", part[4]).otherwise(F.raise_error(F.concat(F.lit("a read of the reverse strand: "), F.col("header"))))
    name = F.when(F.size(part) == 8, part[0]).otherwise(F.raise_error(F.concat(F.lit("a read's header doesn't have eight parts: "), F.col("header"))))
    own = reads.select(name.alias("name"), number(1).alias("start"), part[3].alias("id"), strand.alias("strand"), number(5).alias("prefix"), number(6).alias("length"), number(7).alias("suffix"), F.col("sequence").alias("read"))
    joined = own.join(reference.select("name", F.col("sequence").alias("ref")), "name").where("strand = 'F'")
    a = F.substr("ref", F.col("start") + 1, F.col("length"))
    b = F.substr("read", F.col("prefix") + 1, F.length("read") - F.col("prefix") - F.col("suffix")) if strip else F.col("read")
    out = joined.select("name", "id", a.alias("a"), b.alias("b")).where(~F.contains("a", F.lit("N")))
    return out if count is None else out.limit(count)
