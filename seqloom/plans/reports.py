"""Reports over aligned pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udtf

from seqloom.functions import align as A
from seqloom.functions import cigar, expr, kernels
from seqloom.functions.cost_model import CostModel
from seqloom.functions.expr import ColumnOrName
from seqloom.sources.generate import grid


def statistics(a: ColumnOrName, b: ColumnOrName, cost: ColumnOrName, script: ColumnOrName) -> Column:
    """STRUCT<len_a, len_b, distance, matches, substitutions, insertions, deletions, runs> of an aligned pair."""
    count = {"matches": "=", "substitutions": "X", "insertions": "I", "deletions": "D"}
    return F.struct(expr.n_bytes(a).alias("len_a"), expr.n_bytes(b).alias("len_b"), expr.col(cost).alias("distance"), *[cigar.count_of(script, op).alias(n) for n, op in count.items()], F.size(expr.col(script)).alias("runs"))


def alignment_statistics(pairs: DataFrame, *by: str) -> DataFrame:
    """Averages by group: lengths, distance, matched and edited letters, edits in percent of a."""
    r = pairs.withColumn("_r", A.align("a", "b"))
    rows = r.select(*by, statistics("a", "b", "_r.cost", "_r.cigar").alias("s")).select(*by, "s.*")
    names = [n for n in rows.columns if n not in by]
    error = F.avg(F.when(F.col("len_a") > 0, 100.0 * F.col("distance") / F.col("len_a"))).alias("error_percent")
    return rows.groupBy(*by).agg(F.count("*").alias("pairs"), *[F.avg(n).alias(n) for n in names], error)


def cost_scaling(spark: SparkSession, models: list[CostModel], lengths: list[int], error_rates: list[float], each: int = 3) -> DataFrame:
    """Cost for each letter, and for each letter and error, by cost model, error model, length and rate."""
    pairs = grid(spark, lengths, error_rates, each=each)
    out = None
    for m in models:
        d = expr.distance("a", "b") if m.is_unit else A.alignment_cost("a", "b", m)
        rows = pairs.select(F.lit(m.name).alias("cost_model"), "error_model", "n", "error_rate", d.alias("cost"))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("cost_model", "error_model", "n", "error_rate").agg(F.avg("cost").alias("cost")).withColumn("cost_per_letter", F.col("cost") / F.col("n")).withColumn("cost_per_error", F.col("cost") / (F.col("n") * F.nullif(F.col("error_rate"), F.lit(0.0))))


def explain_alignment(pairs: DataFrame) -> DataFrame:
    """(id, step, i, j, cost, op): every position of each pair's path, for drawing."""
    r = pairs.select("id", A.align("a", "b")["cigar"].alias("s"))
    steps = r.select("id", F.explode(cigar.path("s")).alias("w"), F.flatten(F.transform("s", lambda e: F.array_repeat(e["op"], e["cnt"]))).alias("ops"))
    return steps.select("id", "w.step", "w.i", "w.j", "w.cost", F.get("ops", F.col("w.step") - 1).alias("op"))


class ExplainAlignment:
    """Table function over a table of pairs (id, a, b): id, step, i, j, cost and op of every position of their paths, as
    explain_alignment() gives them. Whole batches of pairs are aligned at once; no rows where a side is null."""

    def eval(self, pairs: pa.RecordBatch) -> Iterator[pa.Table]:
        known = pairs.filter(pc.and_(pc.is_valid(pairs.column("a")), pc.is_valid(pairs.column("b"))))
        found = kernels.aligns(*(known.column(c).cast(pa.binary()).to_pylist() for c in "ab"))
        row = np.repeat(np.arange(known.num_rows), np.diff(np.r_[0, found.end]))
        row, op = np.repeat(row, found.count), np.repeat(found.op, found.count)
        # Before a pair's ops comes its first position, which no op leads to.
        first = np.searchsorted(row, np.arange(known.num_rows))
        row, op = np.insert(row, first, np.arange(known.num_rows)), np.insert(op.astype(np.int64), first, -1)
        begin = np.searchsorted(row, row)
        out = {"id": known.column("id").take(pa.array(row)), "step": pa.array(np.arange(len(row)) - begin, pa.int32())}
        for name, still in (("i", "I"), ("j", "D"), ("cost", "=")):
            moved = np.cumsum((op >= 0) & (op != kernels.OPS.index(still)))
            out[name] = pa.array(moved - moved[begin], pa.int32())
        yield pa.table(out | {"op": pa.array(list(kernels.OPS)).take(pa.array(op, mask=op < 0))})


def register(spark: SparkSession) -> None:
    """seq_explain(TABLE(pairs)) for SQL, as in: SELECT * FROM seq_explain(TABLE(SELECT id, a, b FROM p))."""
    spark.udtf.register("seq_explain", arrow_udtf(ExplainAlignment, returnType="id bigint, step int, i int, j int, cost int, op string"))


class Observed:
    """Metrics of a plan that are gathered while its rows pass by, in the one pass that computes them."""

    def __init__(self, aligned: DataFrame, name: str = "alignment"):
        """aligned: a, b, cost and cigar, as Aligner.align() gives them."""
        from pyspark.sql import Observation

        self.observation = Observation(name)
        stats = statistics("a", "b", "cost", "cigar")
        sums = [F.sum(stats[n]).alias(n) for n in ("len_a", "len_b", "distance", "matches", "substitutions", "insertions", "deletions", "runs")]
        # Bits of the columns that a bit-parallel grid fills, in whole words of 64.
        cells = F.sum(expr.n_bytes("a").cast("bigint") * 64 * F.ceil(expr.n_bytes("b") / 64)).alias("cells")
        self.rows = aligned.observe(self.observation, F.count("*").alias("pairs"), F.count("cost").alias("aligned"), *sums, cells)

    def metrics(self) -> dict:
        """Counts and sums over all rows; waits until an action on `rows` has ended."""
        return self.observation.get
