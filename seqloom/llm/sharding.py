"""Sharding by extendible hashing, with SQL functions alone.

The directory is indexed by the first bits of a hash of the key. A bucket over its byte limit is split on one more bit,
the others stay, until every bucket fits; each bucket is a shard. Sizes are summed once for short hash prefixes and
rolled up to all shorter ones, so finding the directory needs no pass over the rows for each split.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.llm.common import saved, table

BITS = 60
LIMIT = 16 * 2**20
#: Of the query: small enough that tables of a few megabytes are split.
QUERY_LIMIT = 2**20


def key_hash(key: Column) -> Column:
    """The first 60 bits of the key's MD5 digest; a null key hashes as an empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("bigint")


def _prefix(h: str, depth: int) -> Column:
    return F.shiftright(h, BITS - depth)


def _depths(rows: DataFrame, limit: int, low: int, high: int) -> DataFrame:
    """(p, depth): for each prefix p of `high` bits, how many of the buckets on its way from `low` bits on must split.

    A bucket must split if it is over the limit and holds more than one hash.
    """
    fine = rows.groupBy(_prefix("h", high).alias("p")).agg(F.sum("n_bytes").alias("b"), F.min("h").alias("lo"), F.max("h").alias("hi"))
    levels = fine.select("p", "b", "lo", "hi", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("level"))
    nodes = levels.groupBy("level", F.expr(f"shiftright(p, {high} - level)").alias("node")).agg(F.sum("b").alias("b"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    split = nodes.where((F.col("b") > limit) & (F.col("lo") < F.col("hi"))).select("level", "node")
    own = fine.select("p", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("level")).withColumn("node", F.expr(f"shiftright(p, {high} - level)"))
    return own.join(split.withColumn("split", F.lit(1)), ["level", "node"], "left").groupBy("p").agg(F.coalesce(F.sum("split"), F.lit(0)).cast("int").alias("depth"))


def shards(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """rows: key and n_bytes (null: 0). Adds shard, depth (bits of its hash prefix), shard_bytes and shard_rows.

    shard is 's' and the prefix's bits. Rows that repeat one key past the limit are not told apart by any bit; these are
    parted by their places, as -0, -1, ... after the bits, so which row of a hot key is in which part depends on how the
    rows lie. A single row over the limit is a shard by itself. Null keys share the empty key's hash. No rows: no rows.
    Other columns of rows aren't read, whatever their names.
    """
    own = saved(rows.select("key", F.coalesce(F.col("n_bytes"), F.lit(0)).cast("bigint").alias("n_bytes"), key_hash(F.col("key")).alias("h")))
    total, n = own.agg(F.sum("n_bytes"), F.count("*")).first()
    high = min(BITS, max(1, math.ceil(math.log2(max(1, (total or 0) / limit))) + 6), math.ceil(math.log2(n + 2)) + 6)
    placed, left, low = None, own, 0
    while True:
        found = _depths(left, limit, low, high)
        joined = left.withColumn("p", _prefix("h", high)).join(found, "p")
        done = joined.where(F.col("depth") <= high - low).select("key", "n_bytes", "h", (F.col("depth") + low).alias("depth"))
        placed = done if placed is None else placed.unionByName(done)
        left = joined.where(F.col("depth") > high - low).select("key", "n_bytes", "h")
        if high == BITS or left.isEmpty():
            break
        left, low, high = saved(left), high + 1, min(BITS, high + 8)
    placed = placed.withColumn("shard", F.concat(F.lit("s"), F.expr(f"substr(lpad(bin(h), {BITS}, '0'), 1, depth)")))
    sizes = placed.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"), F.count("*").alias("shard_rows"))
    out = placed.join(sizes, "shard")
    over = (F.col("shard_bytes") > limit) & (F.col("shard_rows") > 1)
    crowded = out.where(over)
    columns = ["key", "n_bytes", "shard", "depth", "shard_bytes", "shard_rows"]
    if crowded.isEmpty():
        return out.select(columns)
    return out.where(~over).select(columns).unionByName(_parted(saved(crowded.select("key", "n_bytes", "shard", "depth")), limit).select(columns))


def _parted(rows: DataFrame, limit: int) -> DataFrame:
    """Parts each shard's rows by their places: rows over half the limit alone, the others by sums up to half the limit.
    Sums run within each stored partition first and then over the partitions, so no task needs all rows of a key."""
    at = rows.withColumn("at", F.monotonically_increasing_id()).withColumn("store", F.shiftright("at", 33))
    large = F.col("n_bytes") * 2 > limit
    at = at.withColumn("small", F.when(large, 0).otherwise(F.col("n_bytes"))).withColumn("one", large.cast("bigint"))
    stores = at.groupBy("shard", "store").agg(F.sum("small").alias("small"), F.sum("one").alias("one"))
    before = Window.partitionBy("shard").orderBy("store").rowsBetween(Window.unboundedPreceding, -1)
    base = stores.select("shard", "store", F.coalesce(F.sum("small").over(before), F.lit(0)).alias("small_base"), F.coalesce(F.sum("one").over(before), F.lit(0)).alias("one_base"))
    earlier = Window.partitionBy("shard", "store").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    run = at.join(base, ["shard", "store"])
    small = F.col("small_base") + F.coalesce(F.sum("small").over(earlier), F.lit(0))
    one = F.col("one_base") + F.coalesce(F.sum("one").over(earlier), F.lit(0))
    half = max(1, limit // 2)
    part = F.when(large, F.concat(F.lit("-L"), one.cast("string"))).otherwise(F.concat(F.lit("-"), F.floor(small / half).cast("string")))
    run = run.select("key", "n_bytes", "depth", F.concat("shard", part).alias("shard"))
    sizes = run.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"), F.count("*").alias("shard_rows"))
    return run.join(sizes, "shard")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = shards(docs.select(F.col("doc_id").alias("key"), F.octet_length(F.coalesce(F.col("text"), F.lit(""))).alias("n_bytes")), QUERY_LIMIT)
    return found.withColumnRenamed("key", "doc_id")


#: The same directory, for keys that fit without parting rows of one key.
OP2_SQL = f"""
WITH d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
l AS (SELECT d.*, v.level::INT AS level, h >> ({BITS} - v.level)::INT AS node FROM d, (SELECT unnest(range(0, {BITS} + 1)) AS level) v),
n AS (SELECT level, node FROM l GROUP BY level, node HAVING sum(n_bytes) > {QUERY_LIMIT} AND min(h) < max(h)),
p AS (
  SELECT l.doc_id, l.n_bytes, l.h, count(n.level)::INT AS depth
  FROM l LEFT JOIN n ON l.level = n.level AND l.node = n.node GROUP BY l.doc_id, l.n_bytes, l.h),
s AS (SELECT *, 's' || left(lpad(bin(h), {BITS}, '0'), depth) AS shard FROM p)
SELECT doc_id, n_bytes, shard, depth, (sum(n_bytes) OVER (PARTITION BY shard))::BIGINT AS shard_bytes,
       count(*) OVER (PARTITION BY shard) AS shard_rows
FROM s
"""
