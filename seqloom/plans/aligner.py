"""Aligners by name, as plans over a DataFrame of pairs. All strategies give the same costs; they differ in what is
checked before a pair is scored."""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import align as A
from seqloom.functions import cigar, expr
from seqloom.functions.cost_model import CostModel, named, unit
from seqloom.operators import heuristics
from seqloom.plans import reports
from seqloom.sources.generate import generate
from seqloom.sources.pairs import read_pairs, write_costs


@dataclass(frozen=True)
class Aligner:
    """model: the cost model; bound: pairs beyond it have no cost (null: no bound); bounds: lower bounds that are
    checked first, of zero, gap, count, pair_count, sh, csh, gcsh (with k and r, which those from seeds need)."""

    model: CostModel
    bound: int | None = None
    bounds: tuple[str, ...] = ()
    k: int = 12
    r: int = 1
    look_ahead: int = 0
    doubling: int = 0

    def costs(self, pairs: DataFrame) -> DataFrame:
        """pairs (id, a, b) with cost. With lower bounds, pairs beyond the bound never reach the cost; without a bound, they
        tell which bounds needn't be tried. All are columns of the pair's own row, so ids may be null or repeat."""
        if (self.doubling or self.bounds) and self.bound is None and self.model.is_unit:
            return self._doubled(pairs)
        if self.bound is None and self.model.is_unit:
            return pairs.withColumn("cost", A.long_distance("a", "b"))
        near = self._near()
        if near is None:
            return pairs.withColumn("cost", A.alignment_cost("a", "b", self.model, self.bound))
        return pairs.withColumn("cost", A.alignment_cost(F.when(near, F.col("a")), "b", self.model, self.bound))

    def _lower(self, a: Column, names: tuple[str, ...]) -> Column:
        """The largest of these lower bounds, of a (which may be null) and b."""
        cheap = {"zero": expr.zero_bound, "gap": expr.gap_bound, "count": expr.count_bound, "pair_count": expr.pair_count_bound}
        found = [cheap[x](a, "b") if x in cheap else heuristics.column(x, a, "b", self.k, self.r, self.look_ahead) for x in names]
        return F.greatest(*found) if len(found) > 1 else found[0]

    def _doubled(self, pairs: DataFrame) -> DataFrame:
        """The distance by bounds that grow until one holds, so that near pairs are told from few diagonals. Those below the
        lower bounds are passed over; the last has no bound. Lower bounds from seeds cost more than the first bounds, so only
        pairs have them that no bound of the first ones holds for."""
        first = 4 * (self.doubling or 2)
        seeded = tuple(x for x in self.bounds if x in _OF_SEEDS)
        lower = self._lower(F.col("a"), tuple(dict.fromkeys(("gap", *(x for x in self.bounds if x not in _OF_SEEDS)))))
        if not seeded:
            return pairs.withColumn("cost", A.doubled_distance("a", "b", lower, first))
        near = pairs.withColumn("_near", A.doubled_distance("a", "b", lower, first, range(UNSEEDED)))
        far = F.when(F.col("_near").isNull(), F.col("a"))
        cost = A.doubled_distance(far, "b", F.greatest(lower, self._lower(far, seeded)), first, range(UNSEEDED, 7))
        return near.withColumn("cost", F.coalesce("_near", cost)).drop("_near")

    def _near(self) -> Column | None:
        """Whether all lower bounds are within the bound: expressions first; those from seeds see the pairs that are left."""
        if self.bound is None or not self.bounds:
            return None
        if not self.model.is_unit:
            raise ValueError("lower bounds hold for unit costs only")
        seeded = tuple(x for x in self.bounds if x in _OF_SEEDS)
        cheap = tuple(x for x in self.bounds if x not in _OF_SEEDS)
        near = self._lower(F.col("a"), cheap) <= self.bound if cheap else F.col("a").isNotNull()
        return self._lower(F.when(near, F.col("a")), seeded) <= self.bound if seeded else near

    def align(self, pairs: DataFrame) -> DataFrame:
        """pairs (id, a, b) with cost and cigar (an array of runs). Pairs that lower bounds tell to be beyond the bound aren't
        aligned."""
        near = self._near()
        a = F.col("a") if near is None else F.when(near, F.col("a"))
        if self.model.is_unit:
            found = A.align(a, "b") if self.bound is None else A.bounded_align(a, "b", self.bound)
            return pairs.withColumn("_r", found).select(*pairs.columns, "_r.cost", "_r.cigar")
        found = pairs.withColumn("_r", A.affine_align(a, "b", self.model, self.bound)).select(*pairs.columns, "_r.cost", F.col("_r.cigar").alias("affine_cigar"))
        return found.withColumn("cigar", F.when(F.col("cost").isNotNull(), cigar.to_base("affine_cigar")))

    def align_with_statistics(self, pairs: DataFrame) -> DataFrame:
        """align() with STRUCT stats of each pair: len_a, len_b, distance, matches, substitutions, insertions, deletions,
        runs."""
        return self.align(pairs).withColumn("stats", reports.statistics("a", "b", "cost", "cigar"))


_OF_SEEDS = ("sh", "csh", "gcsh")
#: Doubled bounds that are tried before lower bounds from seeds.
UNSEEDED = 4
STRATEGIES = {"plain": (), "banded": ("gap", "count"), "seeded": ("gap", "count", "sh"), "chained": ("gap", "count", "gcsh")}
#: Parameter sets by name. bounds, k and r steer which pairs are dropped before they are scored; look_ahead
#: (seeds) the local pruning of matches; doubling the growth of a bound from the first lower bound on (0: none).
PRESETS = {
    "default": {"bounds": ("gcsh",), "k": 15, "r": 2, "look_ahead": 0, "doubling": 0},
    "nw": {"bounds": (), "k": 12, "r": 1, "look_ahead": 0, "doubling": 0},
    "simple": {"bounds": ("gap",), "k": 12, "r": 1, "look_ahead": 0, "doubling": 2},
    "full": {"bounds": ("gcsh",), "k": 12, "r": 1, "look_ahead": 14, "doubling": 2},
}


def aligner(strategy: str = "plain", model: str | CostModel | None = None, **options) -> Aligner:
    """By name of a strategy or a preset; options (bound, k, r, look_ahead, doubling) override the preset's. Unknown ones
    are an error, as is an r other than 1 and 2 and a k below 1."""
    if strategy not in STRATEGIES and strategy not in PRESETS:
        raise ValueError(f"no strategy {strategy!r}; there are {', '.join([*STRATEGIES, *PRESETS])}")
    if unknown := options.keys() - {"bound", "k", "r", "look_ahead", "doubling"}:
        raise ValueError(f"unknown options: {', '.join(sorted(unknown))}")
    preset = PRESETS.get(strategy, {"bounds": STRATEGIES.get(strategy)})
    out = Aligner(named(model) if isinstance(model, str) else model or unit(), **(preset | options))
    if out.r not in (1, 2) or out.k < 1:
        raise ValueError("r is 1 or 2, and k at least 1")
    return out


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="seqloom", description="Align pairs of sequences: lines cost,cigar in input order.")
    source = parser.add_mutually_exclusive_group(required=True)
    source.add_argument("--input", help="a .seq, .txt or FASTA file, or a folder of them")
    source.add_argument("--length", type=int, help="align generated pairs of this length")
    parser.add_argument("--count", type=int, default=1, help="number of generated pairs")
    parser.add_argument("--error-rate", type=float, default=0.05)
    parser.add_argument("--error-model", default="uniform")
    parser.add_argument("--seed", type=int, default=31415)
    parser.add_argument("--strategy", choices=sorted({*STRATEGIES, *PRESETS}), default="plain")
    parser.add_argument("--model", default="unit", help="unit, affine(1,2,1), and the like")
    parser.add_argument("--bound", type=int)
    parser.add_argument("--output", required=True, help="a folder for the result")
    given = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if given.input:
        pairs, order = read_pairs(spark, given.input), ["file", "pair"]
    else:
        pairs, order = generate(spark, given.count, given.length, given.error_rate, given.error_model, given.seed), ["id"]
    found = aligner(given.strategy, given.model, bound=given.bound).align(pairs)
    write_costs(found.withColumn("cigar", cigar.to_text("cigar")), given.output, order)


if __name__ == "__main__":
    main()
