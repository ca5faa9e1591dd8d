"""Seeds, k-mers and matches as relations. Seeds and windows are matched bit by bit, or by sorting their codes where b is
long, many pairs at a time and where the pairs are: nothing is shuffled.

pairs: (id, a, b) of A, C, G, T. Seeds are the disjoint k-letter pieces of a; k-mers all windows of b.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions import expr, kernels

#: Letters of the pairs that are matched at once (one longer pair by itself).
LETTERS = 1 << 18
MATCH = ["id", "start_i", "start_j", "end_i", "end_j"]


def _places(last: Column) -> Column:
    """0..last, none below 0 (sequence() would count down)."""
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def seeds(pairs: DataFrame, k: int, r: int = 1) -> DataFrame:
    """(id, start, end, seed_potential, seed_cost, q); a tail shorter than k is no seed."""
    at = pairs.select("id", "a", F.explode(_places(F.floor(F.length("a") / k).cast("int") - 1)).alias("t"))
    return at.select("id", (F.col("t") * k).alias("start"), ((F.col("t") + 1) * k).alias("end"), F.lit(r).alias("seed_potential"), F.lit(r).alias("seed_cost"), F.substr("a", F.col("t") * k + 1, F.lit(k)).alias("q"))


def kmers(pairs: DataFrame, k: int) -> DataFrame:
    """(id, j, q) for every window of k letters of b."""
    at = pairs.select("id", "b", F.explode(_places(F.length("b") - k)).alias("j"))
    return at.select("id", "j", F.substr("b", F.col("j") + 1, F.lit(k)).alias("q"))


def mutations(q: Column, k: int) -> Column:
    """ARRAY<STRUCT<kind, q>>: what one deletion, substitution or insertion makes of q (length k), each kind's once."""
    letters = F.array(*[F.lit(c) for c in "ACGT"])
    before = lambda i: F.substr(q, F.lit(1), i)
    after = lambda i: F.substr(q, i + 1)
    dels = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.concat(before(i), after(i + 1)))
    subs = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.transform(letters, lambda c: F.concat(before(i), c, after(i + 1)))))
    inss = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(k)), lambda i: F.transform(letters, lambda c: F.concat(before(i), c, after(i)))))

    def marked(kind: str, found: Column) -> Column:
        return F.transform(F.array_distinct(found), lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("q")))

    return F.concat(marked("del", dels), marked("sub", F.array_remove(subs, q)), marked("ins", inss))


def _checked(k: int, r: int) -> None:
    if r not in (1, 2):
        raise ValueError("r is 1 (exact matches) or 2 (one edit)")
    if not 1 <= k <= 30:
        raise ValueError("k is from 1 to 30")


def matched(a: pa.Array, b: pa.Array, k: int, r: int, look_ahead: int = 0, find: Callable[..., dict[str, np.ndarray]] = kernels.batch_matches) -> Iterator[tuple[np.ndarray, list[bytes], list[bytes], dict[str, np.ndarray]]]:
    """Pairs of an Arrow batch, so many at a time: their places, sequences and matches (or what find() finds). Pairs with a
    null side are left out."""
    _checked(k, r)
    for known, x, y in _some(a, b):
        found = find(x, y, k, r)
        if look_ahead:
            found = kernels.locally_pruned(x, y, found, k, r, look_ahead)
        yield known, x, y, found


def _some(a: pa.Array, b: pa.Array) -> Iterator[tuple[np.ndarray, list[bytes], list[bytes]]]:
    """Pairs of an Arrow batch, so many at a time: their places and sequences. Pairs with a null side are left out."""
    letters = np.cumsum(sum(pc.fill_null(pc.binary_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b)))
    cuts = np.unique(np.searchsorted(letters, np.arange(0, int(letters[-1]) if len(letters) else 0, LETTERS)).tolist() + [0, len(a)])
    whole = pc.and_(pc.is_valid(a), pc.is_valid(b)).to_numpy(zero_copy_only=False)
    for s, e in pairwise(cuts.tolist()):
        x, y = a.slice(s, e - s).to_pylist(), b.slice(s, e - s).to_pylist()
        known = np.flatnonzero(whole[s:e])
        yield known + s, *((x, y) if len(known) == e - s else ([z[n] for n in known] for z in (x, y)))


def in_batches(pairs: DataFrame, k: int, r: int, of: Callable[..., tuple[np.ndarray, list]], columns: str, look_ahead: int = 0, more: Column | None = None, find: Callable[..., dict[str, np.ndarray]] = kernels.batch_matches) -> DataFrame:
    """pairs (id, a, b) to id and columns. A pair's seeds and windows are both in its own row, so they are matched there,
    batch by batch, and no row is moved. of() gets a batch's sequences and matches (or what find() finds; and `more`, if
    given), and gives rows' places in the batch and their columns. Pairs with a null side have no rows.
    """
    _checked(k, r)
    types = [{"int": pa.int32(), "string": pa.string()}[c.split()[1]] for c in columns.split(", ")]
    names, with_more = ["id", *(c.split()[0] for c in columns.split(", "))], more is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for known, a, b, found in matched(batch.column(1), batch.column(2), k, r, look_ahead, find):
                extra = [batch.column(3).take(pa.array(known))] if with_more else []
                row, values = of(a, b, found, *extra)
                at = known[row] if len(row) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *(pa.array(v, t) for v, t in zip(values, types, strict=True))], names=names)

    kind = pairs.schema["id"].dataType.simpleString()
    own = pairs.select("id", F.col("a").cast("binary").alias("a"), F.col("b").cast("binary").alias("b"), *([more.alias("more")] if more is not None else []))
    return own.mapInArrow(run, f"id {kind}, {columns}")


MATCH_COLUMNS = "start_i int, start_j int, end_i int, end_j int, match_cost int"


def _sized(pairs: DataFrame, k: int, r: int, look_ahead: int) -> DataFrame:
    """Matches, and the lengths n and m of their pair."""

    def of(a: list[bytes], b: list[bytes], found: dict[str, np.ndarray]) -> tuple[np.ndarray, list]:
        n, m = (np.array([len(x) for x in y], np.int64)[found["row"]] for y in (a, b))
        return found["row"], [found[c] for c in MATCH[1:]] + [found["match_cost"], n, m]

    return in_batches(pairs, k, r, of, f"{MATCH_COLUMNS}, n int, m int", look_ahead)


def matches(pairs: DataFrame, k: int, r: int = 1, look_ahead: int = 0) -> DataFrame:
    """Seeds found in b: (id, start_i, start_j, end_i, end_j, match_cost, seed_potential), each start and end once, with its
    least cost. r 1: unchanged; r 2: or one edit away. look_ahead: of so many seeds, for local pruning (0: none): a match
    stays only if these, its own included, can be covered for less than their potential (kernels.locally_pruned).

    Null sequences have none; letters other than A, C, G, T are an error.
    """
    return _sized(pairs, k, r, look_ahead).select(*MATCH, "match_cost", F.lit(r).alias("seed_potential"))


def matches_exact(pairs: DataFrame, k: int) -> DataFrame:
    return matches(pairs, k, 1)


def matches_inexact(pairs: DataFrame, k: int) -> DataFrame:
    return matches(pairs, k, 2)


def transformed(pairs: DataFrame, k: int, r: int = 1, look_ahead: int = 0) -> DataFrame:
    """matches() with the start's and end's coordinates in the gap-cost domain, and those of the target."""
    out = _sized(pairs, k, r, look_ahead).withColumn("seed_potential", F.lit(r))
    for at in ("start", "end"):
        i, j = f"{at}_i", f"{at}_j"
        p = expr.potential("n", i, k, r)
        out = out.withColumn(f"{at}_ti", expr.transformed_i(i, j, p)).withColumn(f"{at}_tj", expr.transformed_j(i, j, p))
    return out.withColumn("target_ti", F.col("n") - F.col("m")).withColumn("target_tj", F.col("m") - F.col("n"))


def target_filter(pairs: DataFrame, k: int, r: int = 1, look_ahead: int = 0) -> DataFrame:
    """Matches from whose start the target can be reached without gaps that cost more than is left."""
    kept = transformed(pairs, k, r, look_ahead).where("start_ti <= target_ti AND start_tj <= target_tj")
    return kept.select(*MATCH, "match_cost", "seed_potential")


def built(pairs: DataFrame, k: int, r: int = 1, gaps: bool = False, look_ahead: int = 0) -> DataFrame:
    """The chain that prepares matches: those that pass target_filter (with gaps), those that local pruning keeps (with
    look_ahead), and for each the least cost of those left of its seed as seed_cost. Windows are by seed."""
    kept = target_filter(pairs, k, r, look_ahead) if gaps else matches(pairs, k, r, look_ahead)
    return kept.withColumn("seed_cost", F.min("match_cost").over(Window.partitionBy("id", "start_i")))


def in_order(found: DataFrame) -> DataFrame:
    """Matches by pair, start, end and cost, and the number of each in its pair's order, from 0."""
    order = ["start_i", "start_j", "end_i", "end_j", "match_cost"]
    return found.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(*order)) - 1)


def consistent(found: DataFrame) -> DataFrame:
    """Adds, for matches that may cost one more, those with start or end one letter of b earlier or later that are
    missing. Both are grouped by place at once, so rows are moved once."""
    shifts = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(e).alias("e"), F.lit(c).alias("c")) for s, e, c in ((0, 0, 0), (0, 1, 1), (0, -1, 1), (1, 0, 1), (-1, 0, 1))])
    near = found.withColumn("d", F.explode(shifts)).where("d.c = 0 OR match_cost + 1 < seed_potential")
    near = near.select("id", "start_i", (F.col("start_j") + F.col("d.s")).alias("start_j"), "end_i", (F.col("end_j") + F.col("d.e")).alias("end_j"), (F.col("match_cost") + F.col("d.c")).alias("match_cost"), "seed_potential", F.col("d.c"))
    grouped = near.groupBy(*MATCH, "match_cost").agg(F.first("seed_potential").alias("seed_potential"), F.sum(F.when(F.col("c") == 0, 1).otherwise(0)).alias("own"), F.count("*").alias("all"))
    copies = F.when(F.col("own") > 0, F.col("own")).otherwise(F.col("all"))
    return grouped.withColumn("_", F.explode(F.array_repeat(F.lit(0), copies.cast("int")))).select(found.columns)


def consistent_matches(pairs: DataFrame, k: int, r: int = 2) -> DataFrame:
    """consistent() of matches(): they are added where the pair is, so no row is moved."""

    def of(a: list[bytes], b: list[bytes], found: dict[str, np.ndarray]) -> tuple[np.ndarray, list]:
        every = kernels.consistent(a, b, found, k, r)
        return every["row"], [every[c] for c in (*MATCH[1:], "match_cost")]

    return in_batches(pairs, k, r, of, MATCH_COLUMNS).withColumn("seed_potential", F.lit(r))


def seed_costs(pairs: DataFrame, k: int, r: int = 1) -> DataFrame:
    """(id, start, end, seed_potential, seed_cost): seeds with the least cost of their matches (the potential where there
    is none)."""

    def of(a: list[bytes], b: list[bytes], found: dict[str, np.ndarray]) -> tuple[np.ndarray, list]:
        start = found["start_i"]
        return found["row"], [start, start + k, np.full(len(start), r), found["match_cost"]]

    return in_batches(pairs, k, r, of, "start int, end int, seed_potential int, seed_cost int", find=kernels.seed_costs)


def least_costs(a: list[bytes], found: dict[str, np.ndarray], k: int, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pair, start and least match cost of every seed."""
    count = np.array([len(x) // k for x in a], np.int64)
    first = np.cumsum(count) - count
    row = np.repeat(np.arange(len(a)), count)
    cost = np.full(len(row), r, np.int64)
    np.minimum.at(cost, first[found["row"]] + found["start_i"] // k, found["match_cost"])
    return row, (np.arange(len(row)) - first[row]) * k, cost


def _grown(pairs: DataFrame, most: int, part: int, names: str, columns: str) -> DataFrame:
    if most < 0:
        raise ValueError("a seed can't have fewer than no hits")
    wanted, names_out = names.split(), ["id", *(c.split()[0] for c in columns.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for known, a, b in _some(batch.column(1), batch.column(2)):
                found = kernels.grown_seeds(a, b, most)[part]
                at = known[found["row"]] if len(known) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *(pa.array(found[c], pa.int32()) for c in wanted)], names=names_out)

    kind = pairs.schema["id"].dataType.simpleString()
    own = pairs.select("id", F.col("a").cast("binary").alias("a"), F.col("b").cast("binary").alias("b"))
    return own.mapInArrow(run, f"id {kind}, {columns}")


def grown_seeds(pairs: DataFrame, max_matches: int) -> DataFrame:
    """(id, start, end, n_matches, seed_potential): seeds of unequal lengths, from a's end on each as short as it can be
    with at most max_matches exact hits in b (kernels.grown_seeds). Null sides have none; letters other than A, C, G, T
    are an error."""
    return _grown(pairs, max_matches, 0, "start end hits", "start int, end int, n_matches int").withColumn("seed_potential", F.lit(1))


def grown_matches(pairs: DataFrame, max_matches: int) -> DataFrame:
    """(id, start_i, start_j, end_i, end_j, match_cost, seed_potential): the hits of grown_seeds()."""
    found = _grown(pairs, max_matches, 1, "start_i start_j end_i end_j", "start_i int, start_j int, end_i int, end_j int")
    return found.withColumns({"match_cost": F.lit(0), "seed_potential": F.lit(1)})


#: Places of b to a bin of matches_in_cone().
CONE_BIN = 64


def matches_in_cone(pairs: DataFrame, k: int) -> DataFrame:
    """Exact matches from whose start the target can be reached without gaps that cost more than is left (target_filter), for
    pairs whose seeds and windows are too many for one task: both are rows, joined across tasks.

    From a seed at i so many places of b are near enough as its potential allows. Windows are in bins of places, seeds in
    each bin that they can reach, and both are joined by pair, letters and bin; so letters that repeat very often are
    split among bins, and none outside a seed's bins is looked at.
    """
    at = pairs.select("id", "a", F.length("a").alias("n"), F.length("b").alias("m"), F.explode(_places(F.floor(F.length("a") / k).cast("int") - 1)).alias("t"))
    own = at.select("id", "n", "m", (F.col("t") * k).alias("start"), F.substr("a", F.col("t") * k + 1, F.lit(k)).alias("q"))
    p = expr.potential("n", "start", k)
    centre = F.col("start") - (F.col("n") - F.col("m"))
    low, high = F.greatest(F.lit(0), centre - p), F.least(F.col("m") - k, centre + p)
    reach = own.select("id", "start", "q", low.alias("low"), high.alias("high")).where("low <= high")
    reach = reach.withColumn("bin", F.explode(F.sequence(F.floor(F.col("low") / CONE_BIN), F.floor(F.col("high") / CONE_BIN))))
    windows = kmers(pairs, k).withColumn("bin", F.floor(F.col("j") / CONE_BIN))
    # Both sides are merged by key: before rows are made of lists they look small enough to send to every task.
    met = reach.join(windows.hint("merge"), ["id", "q", "bin"]).where("j BETWEEN low AND high")
    return met.select("id", F.col("start").alias("start_i"), F.col("j").alias("start_j"), (F.col("start") + k).alias("end_i"), (F.col("j") + k).alias("end_j"), F.lit(0).alias("match_cost"), F.lit(1).alias("seed_potential"))


def suffix_potentials(rows: DataFrame) -> DataFrame:
    """Adds to seeds of any lengths the sum of potentials from each on, by a window over each pair's seeds."""
    after = Window.partitionBy("id").orderBy(F.desc("start")).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("potential", F.sum("seed_potential").over(after))


def covering_seed(i: Column, n: Column, k: int) -> Column:
    """Start of the seed that covers place i, null in a tail without one."""
    return F.when(F.floor(i / k) < F.floor(n / k), F.floor(i / k) * k).cast("int")


def ending_seed(i: Column, n: Column, k: int) -> Column:
    """Start of the seed that covers the letter before place i, null at 0 and after a tail's letter."""
    return F.when(i > 0, covering_seed(i - 1, n, k))


def is_seed_start(i: Column, n: Column, k: int) -> Column:
    return F.coalesce(covering_seed(i, n, k) == i, F.lit(False))


def is_seed_end(i: Column, n: Column, k: int) -> Column:
    return F.coalesce(ending_seed(i, n, k) + k == i, F.lit(False))
