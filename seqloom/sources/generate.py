"""Deterministic sequence pairs from SQL functions: equal arguments give equal pairs, on any number of executors.

Our own error models: uniform (substitution, insertion, deletion alike), noisy_insert and noisy_delete (one long gap
besides half the errors), symmetric_repeat (both sequences repeat one unit, with uniform errors).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MODELS = ("uniform", "noisy_insert", "noisy_delete", "symmetric_repeat")


def _draw(what: str, *at: Column) -> Column:
    """A number from 0 to 1, from a hash of the row's seed and places."""
    return F.pmod(F.xxhash64(F.col("seed"), F.lit(what), *at), F.lit(1 << 30)) / float(1 << 30)


def _letter(what: str, *at: Column) -> Column:
    return F.substr(F.lit("ACGT"), F.floor(_draw(what, *at) * 4).cast("int") + 1, F.lit(1))


def _word(n: Column, make) -> Column:
    return F.array_join(F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), make), "")


def pairs_of(rows: DataFrame) -> DataFrame:
    """rows (id, n, error_rate, error_model, seed) with a of n letters and b made from it."""
    i, n, rate, model = (F.col(c) for c in ("id", "n", "error_rate", "error_model"))
    unit = F.greatest(F.lit(1), F.floor(n / 10).cast("int"))
    noisy = model.isin("noisy_insert", "noisy_delete")
    e = F.when(noisy, rate / 2).otherwise(rate)
    out = rows.withColumn("a", _word(n, lambda k: _letter("a", i, F.when(model == "symmetric_repeat", F.pmod(k, unit)).otherwise(k))))

    def mutated(k: Column) -> Column:
        c, x = F.substr("a", k, F.lit(1)), _draw("kind", i, k)
        other = F.substr(F.replace(F.lit("ACGT"), c, F.lit("")), F.floor(_draw("sub", i, k) * 3).cast("int") + 1, F.lit(1))
        return F.when(x < e / 3, other).when(x < 2 * e / 3, F.concat(c, _letter("ins", i, k))).when(x < e, F.lit("")).otherwise(c)

    out = out.withColumn("b", _word(n, mutated))
    gap = F.floor(n * rate / 2).cast("int")
    at = F.floor(_draw("gap", i) * (F.length("b") + 1)).cast("int")
    inserted = F.when(model == "noisy_insert", _word(gap, lambda k: _letter("noise", i, k))).otherwise("")
    skipped = F.when(model == "noisy_delete", gap).otherwise(0)
    return out.withColumn("b", F.when(noisy, F.concat(F.substr("b", F.lit(1), at), inserted, F.substr("b", at + skipped + 1))).otherwise(F.col("b")))


def _checked(lengths: list[int], rates: list[float], models: tuple[str, ...]) -> None:
    if unknown := set(models) - set(MODELS):
        raise ValueError(f"no error model {min(unknown)!r}; there are {', '.join(MODELS)}")
    if min(lengths, default=0) < 0 or not all(0 <= e <= 1 for e in rates):
        raise ValueError("lengths must not be negative, error rates from 0 to 1")


def generate(spark: SparkSession, count: int, length: int, error_rate: float, model: str = "uniform", seed: int = 31415) -> DataFrame:
    """(id, a, b) with a of the given length and b made from it."""
    _checked([length], [error_rate], (model,))
    rows = spark.range(count).select("id", F.lit(length).alias("n"), F.lit(float(error_rate)).alias("error_rate"), F.lit(model).alias("error_model"), F.lit(seed).alias("seed"))
    return pairs_of(rows).select("id", "a", "b")


def grid(spark: SparkSession, lengths: list[int], error_rates: list[float], models: tuple[str, ...] = MODELS, each: int = 1, seed: int = 31415) -> DataFrame:
    """(n, error_rate, error_model, id, a, b) for every combination, from one table of parameters."""
    _checked(lengths, error_rates, models)
    parameters = [(n, float(e), m, seed + k) for k, (n, e, m) in enumerate((n, e, m) for n in lengths for e in error_rates for m in models)]
    table = spark.createDataFrame(parameters, "n int, error_rate double, error_model string, seed int")
    rows = table.withColumn("id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(each - 1).cast("long")))) if each > 0 else table.withColumn("id", F.lit(0).cast("long")).limit(0)
    return pairs_of(rows).select("n", "error_rate", "error_model", "id", "a", "b")
