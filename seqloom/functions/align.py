"""Column functions that need a kernel: edit scripts, affine costs, search. Arrow batches cross to Python, never rows.

Cost-only plans with unit costs should use expr.distance, which doesn't leave the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf
from pyspark.sql.types import ArrayType, DataType, IntegerType, StructField, StructType

from seqloom.functions import cigar, kernels, wavefront
from seqloom.functions.cost_model import FORBIDDEN, CostModel, named
from seqloom.functions.expr import ColumnOrName, bounded_distance, col, distance

INT, INTS = IntegerType(), ArrayType(IntegerType())


def _struct(**fields: DataType) -> StructType:
    return StructType([StructField(n, t) for n, t in fields.items()])


def _binary(x: ColumnOrName) -> Column:
    return col(x).cast("binary")


def _known(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, list[bytes], list[bytes]]:
    """Places of pairs without a null, and their sequences as bytes."""
    there = pc.and_(pc.is_valid(a), pc.is_valid(b))
    return np.flatnonzero(there.to_numpy(zero_copy_only=False)), *(x.filter(there).cast(pa.binary()).to_pylist() for x in (a, b))


def _spread(values: pa.Array, places: np.ndarray, rows: int) -> pa.Array:
    """values at their places among so many rows, which else are null."""
    at = np.full(rows, -1)
    at[places] = np.arange(len(places))
    return values.take(pa.array(at, pa.int64(), mask=at < 0))


def _results(cost: pa.Array, scripts: pa.Array, places: np.ndarray, rows: int) -> pa.Array:
    return pa.StructArray.from_arrays([_spread(x, places, rows) for x in (cost, scripts)], ["cost", "cigar"])


def _scripts(a: pa.Array, b: pa.Array) -> pa.Array:
    """STRUCT<cost, cigar> of all pairs, as Arrow arrays from the start: no run becomes a Python object."""
    places, x, y = _known(a, b)
    found = kernels.aligns(x, y)
    ops = pa.DictionaryArray.from_arrays(pa.array(found.op, pa.int8()), pa.array(list(kernels.OPS))).cast(pa.string())
    runs = pa.StructArray.from_arrays([ops, pa.array(found.count, pa.int32())], ["op", "cnt"])
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, found.end].astype(np.int32)), runs)
    return _results(pa.array(found.cost, pa.int32()), lists, places, len(a))


def _layered(rows: list[tuple[int | None, list]], places: np.ndarray, n: int) -> pa.Array:
    """STRUCT<cost, cigar> with layers of rows (cost, script), with nulls for (None, [])."""
    flat = [run for _, script in rows for run in script]
    op, layer, count = zip(*flat, strict=True) if flat else ((), (), ())
    runs = pa.StructArray.from_arrays([pa.array(op, pa.string()), pa.array(layer, pa.int32()), pa.array(count, pa.int32())], ["op", "layer", "cnt"])
    none = np.array([c is None for c, _ in rows], bool)
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(s) for _, s in rows])].astype(np.int32), mask=np.r_[none, False]), runs)
    return _results(pa.array([c for c, _ in rows], pa.int32()), lists, places, n)


@arrow_udf(_struct(cost=INT, cigar=cigar.TYPE))
def _align(a: pa.Array, b: pa.Array) -> pa.Array:
    return _scripts(a, b)


def align(a: ColumnOrName, b: ColumnOrName) -> Column:
    """STRUCT<cost, cigar>: the distance and one best edit script (see kernels.align for ties); nulls if either is null."""
    return _align(_binary(a), _binary(b))


def bounded_align(a: ColumnOrName, b: ColumnOrName, bound: int) -> Column:
    """align() where the distance is at most bound, else null. Pairs beyond it are told in the JVM and not sent."""
    near = bounded_distance(a, b, bound).isNotNull()
    found = _align(F.when(near, _binary(a)), F.when(near, _binary(b)))
    return F.when(found["cost"].isNotNull(), found)


@arrow_udf(INT)
def _distance(a: pa.Array, b: pa.Array) -> pa.Array:
    places, x, y = _known(a, b)
    return _spread(pa.array(kernels.distances(x, y), pa.int32()), places, len(a))


def long_distance(a: ColumnOrName, b: ColumnOrName) -> Column:
    """expr.distance by the bit-parallel kernel, many pairs at once: for pairs of hundreds of letters, which take the JVM
    milliseconds each. Null if either is."""
    return _distance(_binary(a), _binary(b))


def doubled_distance(a: ColumnOrName, b: ColumnOrName, lower: Column, bound: int, tries: range = range(7)) -> Column:
    """long_distance() by bounds that double, those below the lower bound passed over (kernels.doubled). Null where none of
    the tries holds."""

    @arrow_udf(INT)
    def run(x: pa.Array, y: pa.Array, h: pa.Array) -> pa.Array:
        places, p, q = _known(x, y)
        found = kernels.doubled(p, q, h.take(pa.array(places)).to_numpy(zero_copy_only=False), bound, tries)
        return _spread(pa.array(found, pa.int32(), mask=found < 0), places, len(x))

    return run(_binary(a), _binary(b), lower)


def alignment_cost(a: ColumnOrName, b: ColumnOrName, model: CostModel | str, bound: int | None = None) -> Column:
    """Cost under any model; null if there is no alignment, or it costs more than bound. Pairs are computed together,
    those of like lengths at a time; the work grows with the cost."""
    model = named(model) if isinstance(model, str) else model
    if model.is_unit:
        return distance(a, b) if bound is None else bounded_distance(a, b, bound)

    @arrow_udf(INT)
    def cost(x: pa.Array, y: pa.Array) -> pa.Array:
        return _costs(x, y, model, bound)

    return cost(_binary(a), _binary(b))


def _costs(x: pa.Array, y: pa.Array, model: CostModel, bound: int | None) -> pa.Array:
    places, a, b = _known(x, y)
    found = wavefront.distances(a, b, model, bound)
    return _spread(pa.array(found, pa.int32(), mask=found >= FORBIDDEN), places, len(x))


def affine_align(a: ColumnOrName, b: ColumnOrName, model: CostModel | str, bound: int | None = None) -> Column:
    """STRUCT<cost, cigar> with layers, under any model; nulls if there is no alignment, or none within the bound. The
    work grows with the cost, and so does the memory of one pair (see wavefront)."""
    model = named(model) if isinstance(model, str) else model

    @arrow_udf(_struct(cost=INT, cigar=cigar.AFFINE_TYPE))
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        places, p, q = _known(x, y)
        return _layered(wavefront.affine_aligns(p, q, model, bound), places, len(x))

    return run(_binary(a), _binary(b))


def flat(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values, end to end, and how many each has; nulls have none."""
    x = pc.fill_null(x.cast(pa.large_binary()), b"")
    starts = np.frombuffer(x.buffers()[1], np.int64)[x.offset : x.offset + len(x) + 1] if len(x) else np.zeros(1, np.int64)
    data = np.frombuffer(x.buffers()[2] or b"", np.uint8)[starts[0] : starts[-1]]
    return data, np.diff(starts)


#: Rows of an Arrow batch that are searched or traced at once.
SOME = 2000


def _in_parts(of: Callable[..., pa.Array], *sides: pa.Array) -> pa.Array:
    """of() some rows at a time, so that what is held beside a batch and its result is bounded."""
    return pa.concat_arrays([of(*(x.slice(s, SOME) for x in sides)) for s in range(0, max(1, len(sides[0])), SOME)])


def _searches(p: pa.Array, t: pa.Array, unmatched: float) -> pa.Array:
    def some(p: pa.Array, t: pa.Array) -> pa.Array:
        there = pc.and_(pc.is_valid(p), pc.is_valid(t))
        costs, size = kernels.search_costs(*flat(p.filter(there)), *flat(t.filter(there)), unmatched)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()), pa.array(costs, pa.int32()))
        return _spread(lists, np.flatnonzero(there.to_numpy(zero_copy_only=False)), len(p))

    return _in_parts(some, p, t)


def search(pattern: ColumnOrName, text: ColumnOrName, unmatched: float = 0.0) -> Column:
    """ARRAY<INT>: costs of the pattern's best match at each place of text (kernels.search_costs)."""

    @arrow_udf(INTS)
    def run(p: pa.Array, t: pa.Array) -> pa.Array:
        return _searches(p, t, unmatched)

    return run(col(pattern), col(text))


def index_position(index: ColumnOrName, pattern: ColumnOrName, text: ColumnOrName) -> Column:
    """STRUCT<i, j>: letters of text and of the pattern before that place of search()'s result."""
    at, p, t = col(index), F.length(col(pattern)), F.length(col(text))
    return F.when(at.between(0, p + t), F.struct(F.least(at, t).alias("i"), F.when(at <= t, p).otherwise(p - (at - t)).alias("j")))


def trace_path(trace: Column) -> Column:
    """ARRAY<STRUCT<i, j>>: the places in text and pattern that a search_trace() leads through."""
    return F.transform(cigar.path(trace["cigar"]), lambda w: F.struct((w["i"] + trace["text_start"]).alias("i"), (w["j"] + trace["pattern_start"]).alias("j")))


def search_trace(pattern: ColumnOrName, text: ColumnOrName, index: ColumnOrName, unmatched: float = 0.0) -> Column:
    """STRUCT<text_start, pattern_start, cigar> of the match at a place of search()."""

    kind = pa.list_(pa.struct([("op", pa.string()), ("cnt", pa.int32())]))

    def some(p: pa.Array, t: pa.Array, k: pa.Array) -> pa.Array:
        rows = [(None, None, None) if x is None or y is None or i is None else kernels.search_trace(x, y, i, unmatched) for x, y, i in zip(*(c.to_pylist() for c in (p, t, k)), strict=True)]
        ops, counts = (pa.array([run[c] for r in rows for run in r[2] or ()], kind.value_type[c].type) for c in (0, 1))
        ends = np.cumsum([0, *(len(r[2] or ()) for r in rows)])
        none = np.array([r[2] is None for r in rows], bool)
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.r_[none, False]), pa.StructArray.from_arrays([ops, counts], ["op", "cnt"]))
        return pa.StructArray.from_arrays([*(pa.array([r[c] for r in rows], pa.int32()) for c in (0, 1)), lists], ["text_start", "pattern_start", "cigar"])

    @arrow_udf(_struct(text_start=INT, pattern_start=INT, cigar=cigar.TYPE))
    def run(p: pa.Array, t: pa.Array, k: pa.Array) -> pa.Array:
        return _in_parts(some, p, t, k)

    return run(col(pattern), col(text), col(index))


def _checked(r: int | None, k: int | None) -> None:
    if r not in (1, 2) or not k or k < 1:
        raise ValueError("r is 1 or 2, and k at least 1")


def register(spark: SparkSession) -> None:
    """SQL functions over STRING or BINARY sequences, null where an argument is:

    * seq_align(a, b), and with the presets' names seq_align_simple(a, b) and seq_align_full(a, b): STRUCT<cost, cigar>
    * seq_align_seeded(a, b, r, k, prune_end): the same; what its parameters steer changes the work, never the result
    * seq_model_align(a, b, model) and seq_model_cost(a, b, model), as in 'affine(1,2,1)'; seq_affine_cost(a, b) for that
    * seq_search(pattern, text): ARRAY<INT>
    * seq_distance(a, b), as an SQL expression
    """

    @arrow_udf(_struct(cost=INT, cigar=cigar.TYPE))
    def seeded(a: pa.Array, b: pa.Array, r: pa.Array, k: pa.Array, prune_end: pa.Array) -> pa.Array:
        for pair in set(zip(r.to_pylist(), k.to_pylist(), strict=True)):
            _checked(*pair)
        return _scripts(a, b)

    @arrow_udf(INTS)
    def seq_search(p: pa.Array, t: pa.Array) -> pa.Array:
        return _searches(p, t, 0.0)

    def by_model(x: pa.Array, y: pa.Array, model: pa.Array, of: Callable, kind: pa.DataType) -> pa.Array:
        """of() pairs and a model, for each model's rows."""
        parts, places = [pa.nulls(len(x), kind)], np.arange(len(x))
        names = np.array(model.to_pylist(), object)
        for name in set(names.tolist()) - {None}:
            rows = np.flatnonzero(names == name)
            places[rows] = sum(map(len, parts)) + np.arange(len(rows))
            parts.append(of(x.take(pa.array(rows)), y.take(pa.array(rows)), named(name)))
        return pa.concat_arrays(parts).take(pa.array(places))

    @arrow_udf(INT)
    def seq_model_cost(x: pa.Array, y: pa.Array, model: pa.Array) -> pa.Array:
        return by_model(x, y, model, lambda p, q, m: _costs(p, q, m, None), pa.int32())

    @arrow_udf(_struct(cost=INT, cigar=cigar.AFFINE_TYPE))
    def seq_model_align(x: pa.Array, y: pa.Array, model: pa.Array) -> pa.Array:
        def of(p: pa.Array, q: pa.Array, m: CostModel) -> pa.Array:
            places, a, b = _known(p, q)
            return _layered(wavefront.affine_aligns(a, b, m), places, len(p))

        return by_model(x, y, model, of, _layered([], np.zeros(0, np.int64), 0).type)

    for name in ("seq_align", "seq_align_simple", "seq_align_full"):
        spark.udf.register(name, _align)
    spark.udf.register("seq_align_seeded", seeded)
    spark.udf.register("seq_search", seq_search)

    @arrow_udf(INT)
    def seq_affine_cost(x: pa.Array, y: pa.Array) -> pa.Array:
        return _costs(x, y, named("affine(1,2,1)"), None)

    spark.udf.register("seq_affine_cost", seq_affine_cost)
    spark.udf.register("seq_model_cost", seq_model_cost)
    spark.udf.register("seq_model_align", seq_model_align)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION seq_distance(a STRING, b STRING) RETURNS INT RETURN levenshtein(decode(cast(a AS BINARY), 'ISO-8859-1'), decode(cast(b AS BINARY), 'ISO-8859-1'))")
