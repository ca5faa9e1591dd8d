"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import time
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.expr import let
from seqloom.sources.scratch import shared_dir

__all__ = ["Remembered", "forget", "free_name", "least_hashed", "let", "rows_of", "saved", "shared_dir", "table", "without", "words_of"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame) -> DataFrame:
    """df, computed once into the shared checkpoint folder, with its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def forget(spark: SparkSession) -> None:
    """Has Spark delete shuffle files that no plan refers to any more, such as those of stages that were saved.

    Its cleaner learns of them when the driver collects garbage, and runs beside it; one round frees what refers to
    the next one's.
    """
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def without(docs: DataFrame, dropped: DataFrame, how: str = "left_anti") -> DataFrame:
    """docs without (or with, left_semi) the rows whose doc_id and hash of text are in dropped (id, key); null ids are equal.
    docs keeps its columns, whatever their names."""
    mark, own = free_name(docs, "_mark"), free_name(docs, "_own")
    keyed = docs.select("*", F.xxhash64("text").alias(mark))
    found = dropped.select(F.col("id").alias(own), F.col("key").alias("_" + mark)).distinct()
    return keyed.join(found, keyed["doc_id"].eqNullSafe(found[own]) & (keyed[mark] == found["_" + mark]), how).drop(mark)


def least_hashed(rows: DataFrame, n: int, *key: str) -> DataFrame:
    """The n rows with the least hash of their key columns (all rows, if fewer): a sample of bounded size that doesn't
    depend on how the rows lie. Rows whose hash is too large to be among them are dropped first, so that few reach the
    sort, whatever the size of the input."""
    total = rows.count()
    hashed = rows.withColumn("_hash", F.xxhash64(*key))
    if total > 2 * n:
        share = min(1.0, 1.5 * n / total + 100 / total)
        low = hashed.where(F.col("_hash") <= int(-(2**63) + share * (2**64 - 1)))
        if low.count() >= n:
            hashed = low
    return hashed.orderBy("_hash", *key).limit(n).drop("_hash")


def rows_of(batch: pa.RecordBatch, rows: int = 2000, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most `rows` rows and about `most_bytes` bytes (or one row, if it has more), to bound what
    is held as Python objects at once."""
    if not batch.num_rows:
        return
    step = max(1, min(rows, int(most_bytes * batch.num_rows / max(1, batch.nbytes))))
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        if part.nbytes > 4 * most_bytes and part.num_rows > 1:
            yield from (x for half in (part.slice(0, part.num_rows // 2), part.slice(part.num_rows // 2)) for x in rows_of(half, rows, most_bytes))
        else:
            yield part


def words_of(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """texts have their words parted by single blanks. The distinct words of all texts (two blanks part an empty one), the
    place among them of each text's each word, and where the texts' words end (the first end is 0). Arrow's hash table
    tells the words apart, each with the blank after it, so Python sees the distinct ones alone."""
    data = b"".join([x for t in texts for x in (t, b" ")])
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    places = pa.array(np.r_[0, ends + 1], pa.int64())
    found = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, places.buffers()[1], pa.py_buffer(data)]).dictionary_encode()
    words = pc.binary_slice(found.dictionary, 0, -1).to_numpy(zero_copy_only=False).tolist()
    last = np.searchsorted(ends, np.cumsum([len(t) + 1 for t in texts]) - 1) + 1
    return words, found.indices.to_numpy(), np.r_[0, last]


class Remembered(dict):
    """A dictionary of bounded size: when full, its entries become the previous generation, and those of it that are
    asked for again move back. So what is frequent stays, whatever order the keys come in."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.before = most, {}

    def known(self, key) -> bool:
        """Whether key has a value, which is then in the dictionary itself."""
        if key in self:
            return True
        if key in self.before:
            self[key] = self.before[key]
            return True
        return False

    def unknown(self, keys: Iterable) -> set:
        """Those of keys without a value; the others' values are then in the dictionary itself."""
        new = {k for k in keys if k not in self}
        back = {k for k in new if k in self.before}
        self.update(zip(back, map(self.before.__getitem__, back), strict=True))
        return new - back

    def make_room(self) -> None:
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
