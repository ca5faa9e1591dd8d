"""Lower bounds of the distance from seeds, for whole pairs or from any place on: each is at most the next, and at most the
distance.

SH counts seeds without a match; CSH counts those outside the best chain of matches; GCSH charges chains for gaps too.
They serve to drop pairs before exact scoring.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from seqloom.functions import expr, kernels
from seqloom.functions.expr import ColumnOrName
from seqloom.operators import seeds as S


Places = tuple[np.ndarray, np.ndarray, np.ndarray]


def _sizes(texts: list[bytes]) -> np.ndarray:
    return np.array([len(x) for x in texts], np.int64)


def _sh(a: list[bytes], b: list[bytes], found: dict[str, np.ndarray], k: int, r: int, at: Places, whole: bool = False) -> np.ndarray:
    """The seeds' least costs, summed from each place on."""
    _, _, cost = S.least_costs(a, found, k, r)
    count = _sizes(a) // k
    last = np.cumsum(count)
    sums, row = np.r_[0, np.cumsum(cost)], at[0]
    return sums[last[row]] - sums[(last - count)[row] + np.minimum(-(-at[1] // k), count[row])]


def _csh(a: list[bytes], b: list[bytes], found: dict[str, np.ndarray], k: int, r: int, at: Places, whole: bool = False) -> np.ndarray:
    row, score = found["row"], r - found["match_cost"]
    some = score > 0
    start, end = (tuple(found[f"{x}_{c}"][some] for c in "ij") for x in ("start", "end"))
    best = kernels.chains(len(a), row[some], start, end, score[some], at[0], at[1:])
    return kernels.potential(_sizes(a)[at[0]], at[1], k, r) - best


def _gcsh(a: list[bytes], b: list[bytes], found: dict[str, np.ndarray], k: int, r: int, at: Places, whole: bool = False) -> np.ndarray:
    n, m = _sizes(a), _sizes(b)

    def moved(row: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = kernels.potential(n[row], i, k, r)
        return i - j - p, j - i - p

    row, score = found["row"], r - found["match_cost"]
    p = r * ((n // k)[row] - found["start_i"] // k)  # a seed's end has one seed's potential less
    (si, sj), (ei, ej) = ((x - q, -x - q) for x, q in ((found["start_i"] - found["start_j"], p), (found["end_i"] - found["end_j"], p - r)))
    gap = (n - m)[row]
    some = (score > 0) & (si <= gap) & (sj <= -gap) & (ei <= gap) & (ej <= -gap)
    # Of a whole pair all chains count; from a place, those that start where its gaps cost less than is left.
    places = (np.full(len(a), -(1 << 40)),) * 2 if whole else moved(*at)
    best = kernels.chains(len(a), row[some], (si[some], sj[some]), (ei[some], ej[some]), score[some], at[0], places)
    p = kernels.potential(n[at[0]], at[1], k, r)
    left = abs((n[at[0]] - at[1]) - (m[at[0]] - at[2]))
    return np.where(best == 0, np.maximum(left, p), p - best)


_OF = {"sh": _sh, "csh": _csh, "gcsh": _gcsh}


def at_places(pairs: DataFrame, at: Column, kind: str = "gcsh", k: int = 15, r: int = 2, look_ahead: int = 0) -> DataFrame:
    """(id, i, j, h): the bound of the distance from each place (i, j) of `at`, an ARRAY<STRUCT<i, j>> over pairs, to the
    pair's end. Nothing is shuffled: a pair's matches, chains and places are in one row. No places, or a null side: no
    rows; places beyond a pair's ends are an error."""

    def of(a: list[bytes], b: list[bytes], found: dict[str, np.ndarray], places: pa.Array) -> tuple[np.ndarray, list]:
        row = pc.list_parent_indices(places).to_numpy()
        i, j = (pc.struct_field(places.flatten(), c).to_numpy().astype(np.int64) for c in "ij")
        if ((i < 0) | (i > _sizes(a)[row]) | (j < 0) | (j > _sizes(b)[row])).any():
            raise ValueError("a place lies beyond its pair's ends")
        return row, [i, j, _OF[kind](a, b, found, k, r, (row, i, j))]

    return S.in_batches(pairs, k, r, of, "i int, j int, h int", look_ahead, more=at)


def column(kind: str, a: ColumnOrName, b: ColumnOrName, k: int, r: int = 1, look_ahead: int = 0) -> Column:
    """The bound for whole pairs as a column; null where a side is."""

    @arrow_udf("int")
    def h(x: pa.Array, y: pa.Array) -> pa.Array:
        out = np.zeros(len(x), np.int64)
        none = np.ones(len(x), bool)
        for known, p, q, found in S.matched(x, y, k, r, look_ahead):
            out[known] = _OF[kind](p, q, found, k, r, (np.arange(len(p)), *np.zeros((2, len(p)), np.int64)), whole=True)
            none[known] = False
        return pa.array(out, pa.int32(), mask=none)

    return h(*(expr.col(c).cast("binary") for c in (a, b)))


def sh(pairs: DataFrame, k: int, r: int = 1, look_ahead: int = 0) -> DataFrame:
    """(id, h): potential not regained by each seed's best match; pairs without seeds have 0, null sides null."""
    return pairs.select("id", column("sh", "a", "b", k, r, look_ahead).alias("h"))


def csh(pairs: DataFrame, k: int, r: int = 1, look_ahead: int = 0) -> DataFrame:
    """(id, h): potential less the best chain of matches that follow each other in both sequences."""
    return pairs.select("id", column("csh", "a", "b", k, r, look_ahead).alias("h"))


def gcsh(pairs: DataFrame, k: int, r: int = 1, look_ahead: int = 0) -> DataFrame:
    """(id, h): as csh, with chains in the gap-cost domain; without a match at least the difference of lengths."""
    return pairs.select("id", column("gcsh", "a", "b", k, r, look_ahead).alias("h"))


def kept_by_path(pairs: DataFrame, k: int, r: int = 1, kind: str = "csh") -> DataFrame:
    """Matches (see seeds.matches) without those that a best path shows to be of no use: those that start on the pair's path
    where the bound from there is less than what the path still costs, so that they don't bring the bound up to it.

    Path, bounds and matches of a pair come from its own row, so nothing is joined or shuffled. Null sides have no matches.
    """

    def of(a: list[bytes], b: list[bytes], found: dict[str, np.ndarray]) -> tuple[np.ndarray, list]:
        scripts = kernels.aligns(a, b)
        row, i, j, cost = kernels.positions(scripts)
        row, i, j, cost = (x[i % k == 0] for x in (row, i, j, cost))
        useless = _OF[kind](a, b, found, k, r, (row, i, j)) < scripts.cost[row] - cost
        n, m = (int(_sizes(x).max(initial=0)) + 1 for x in (a, b))
        kept = ~np.isin((found["row"] * n + found["start_i"]) * m + found["start_j"], ((row * n + i) * m + j)[useless])
        return found["row"][kept], [found[c][kept] for c in (*S.MATCH[1:], "match_cost")]

    return S.in_batches(pairs, k, r, of, S.MATCH_COLUMNS).withColumn("seed_potential", F.lit(r))


KINDS = {"sh": sh, "csh": csh, "gcsh": gcsh}


def mirrored(kind: str, pairs: DataFrame, k: int, r: int = 1) -> DataFrame:
    """The bound with the sequences' roles swapped."""
    return KINDS[kind](pairs.select("id", F.col("b").alias("a"), F.col("a").alias("b")), k, r)


def symmetric(kind: str, pairs: DataFrame, k: int, r: int = 1) -> DataFrame:
    """The larger of the bound and its mirror image."""
    both = KINDS[kind](pairs, k, r).unionByName(mirrored(kind, pairs, k, r))
    return both.groupBy("id").agg(F.max("h").alias("h"))


def bound(pairs: DataFrame, kind: str = "gcsh", k: int = 15, r: int = 2, look_ahead: int = 0) -> DataFrame:
    """(id, h) by name: none, zero, gap, count, pair_count, sh, csh, gcsh."""
    simple = {"none": expr.zero_bound, "zero": expr.zero_bound, "gap": expr.gap_bound, "count": expr.count_bound, "pair_count": expr.pair_count_bound}
    if kind in simple:
        return pairs.select("id", simple[kind]("a", "b").alias("h"))
    if kind not in KINDS:
        raise ValueError(f"no bound {kind!r}; there are {', '.join([*simple, *KINDS])}")
    return KINDS[kind](pairs, k, r, look_ahead)
