"""Edit scripts as columns: ARRAY<STRUCT<op, cnt>> with ops '=', 'X', 'I', 'D'. Built-in functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from seqloom.functions.expr import ColumnOrName, as_bytes, col, let

TYPE = ArrayType(StructType([StructField("op", StringType()), StructField("cnt", IntegerType())]))
AFFINE_TYPE = ArrayType(StructType([StructField("op", StringType()), StructField("layer", IntegerType()), StructField("cnt", IntegerType())]))


def to_text(script: ColumnOrName) -> Column:
    """Extended CIGAR text: a count and an op each, as in 3=1X2=."""
    return F.array_join(F.transform(col(script), lambda e: F.concat(e["cnt"].cast("string"), e["op"])), "")


def from_text(text: ColumnOrName) -> Column:
    return F.transform(F.regexp_extract_all(col(text), F.lit("[0-9]+[=XID]"), F.lit(0)), lambda x: F.struct(F.right(x, F.lit(1)).alias("op"), F.substr(x, F.lit(1), F.length(x) - 1).cast("int").alias("cnt")))


def merged(script: ColumnOrName) -> Column:
    """Equal neighbours joined, empty runs left out. Where joined runs begin is told once; each sums its own part."""

    def joined(runs: Column) -> Column:
        begins = F.filter(F.transform(runs, lambda e, k: F.when((k == 0) | (F.get(runs, k - 1)["op"] != e["op"]), k)), lambda k: k.isNotNull())
        return let(begins, lambda at: F.transform(at, lambda k, x: F.struct(
            F.get(runs, k)["op"].alias("op"),
            F.aggregate(F.slice(runs, k + 1, F.coalesce(F.get(at, x + 1), F.size(runs)) - k), F.lit(0), lambda n, e: n + e["cnt"]).alias("cnt"),
        )))

    return let(F.filter(col(script), lambda e: e["cnt"] > 0), joined)


def appended(first: ColumnOrName, second: ColumnOrName) -> Column:
    return merged(F.concat(col(first), col(second)))


def reversed_(script: ColumnOrName) -> Column:
    return F.reverse(col(script))


def to_base(affine: ColumnOrName) -> Column:
    """An affine script without its layers and their open and close marks."""
    plain = F.filter(col(affine), lambda e: ~e["op"].isin("O", "C"))
    return merged(F.transform(plain, lambda e: F.struct(e["op"].alias("op"), e["cnt"].alias("cnt"))))


def to_base_strictly(affine: ColumnOrName) -> Column:
    """to_base() of scripts without layers; others are an error."""
    s = col(affine)
    plain = ~F.exists(s, lambda e: (e["layer"] >= 0) | e["op"].isin("O", "C"))
    return F.when(plain, to_base(s)).otherwise(F.when(s.isNotNull(), F.raise_error(F.lit("the script has affine parts"))))


def to_affine(script: ColumnOrName) -> Column:
    return F.transform(col(script), lambda e: F.struct(e["op"].alias("op"), F.lit(-1).alias("layer"), e["cnt"].alias("cnt")))


def count_of(script: ColumnOrName, ops: str) -> Column:
    """Characters under the given ops."""
    return F.aggregate(F.filter(col(script), lambda e: e["op"].isin(*ops)), F.lit(0), lambda a, e: a + e["cnt"])


def cost(script: ColumnOrName, sub: int = 1, ins: int = 1, dele: int = 1) -> Column:
    return count_of(script, "X") * sub + count_of(script, "I") * ins + count_of(script, "D") * dele


def path(script: ColumnOrName) -> Column:
    """ARRAY<STRUCT<step, i, j, cost>>: the positions from (0, 0) on, with unit costs so far. Where each run starts is
    summed up once, and its positions follow from there."""
    runs = F.filter(col(script), lambda e: e["cnt"] > 0)
    per = lambda op: (F.when(op != "I", 1).otherwise(0), F.when(op != "D", 1).otherwise(0), F.when(op != "=", 1).otherwise(0))

    def moved(at: Column, op: Column, n: Column) -> Column:
        di, dj, dc = per(op)
        return F.struct((at["i"] + di * n).alias("i"), (at["j"] + dj * n).alias("j"), (at["cost"] + dc * n).alias("cost"))

    zero = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("cost")))
    starts = F.aggregate(runs, zero, lambda acc, e: F.concat(acc, F.array(moved(F.element_at(acc, -1), e["op"], e["cnt"]))))
    places = F.zip_with(F.slice(starts, F.lit(1), F.size(runs)), runs, lambda at, e: F.transform(F.sequence(F.lit(1), e["cnt"]), lambda n: moved(at, e["op"], n)))
    inner = F.flatten(places)
    return F.transform(F.concat(zero, inner), lambda w, t: F.struct(t.alias("step"), w["i"].alias("i"), w["j"].alias("j"), w["cost"].alias("cost")))


def valid(script: ColumnOrName, a: ColumnOrName, b: ColumnOrName) -> Column:
    """Whether the script leads from a to b: '=' over equal letters, 'X' over different ones, and both ends reached."""
    x, y = as_bytes(a), as_bytes(b)

    def step(acc: Column, e: Column) -> Column:
        n_a = F.when(e["op"] == "I", 0).otherwise(e["cnt"])
        n_b = F.when(e["op"] == "D", 0).otherwise(e["cnt"])
        part_a, part_b = F.substr(x, acc["i"] + 1, n_a), F.substr(y, acc["j"] + 1, n_b)
        equal = F.size(F.filter(F.sequence(F.lit(1), F.greatest(e["cnt"], F.lit(1))), lambda k: F.substr(part_a, k, F.lit(1)) == F.substr(part_b, k, F.lit(1))))
        fits = F.when(e["op"] == "=", part_a == part_b).when(e["op"] == "X", equal == 0).otherwise(e["op"].isin("I", "D"))
        whole = (F.length(part_a) == n_a) & (F.length(part_b) == n_b)
        return F.struct((acc["i"] + n_a).alias("i"), (acc["j"] + n_b).alias("j"), (acc["ok"] & fits & whole & (e["cnt"] > 0)).alias("ok"))

    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(True).alias("ok"))
    return F.aggregate(col(script), start, step, lambda s: s["ok"] & (s["i"] == F.length(x)) & (s["j"] == F.length(y)))
