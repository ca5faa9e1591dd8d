"""Similarity joins: pairs of texts within a distance, without comparing all with all.

Of bound + 1 disjoint pieces of a text, an alignment within the bound leaves one unchanged, and shifts it by at most
the bound. So texts that share no piece at such a place are never paired. Texts are compared once each, however many
rows hold them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions import expr


def _pieces(text: Column, bound: int) -> Column:
    """(number, start, piece) of bound + 1 pieces of nearly equal length."""
    n = F.length(text)
    cut = lambda t: F.floor(n * t / (bound + 1)).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(bound)), lambda t: F.struct(t.alias("t"), cut(t).alias("start"), F.substr(text, cut(t) + 1, cut(t + 1) - cut(t)).alias("piece")))


def near_texts(left: DataFrame, right: DataFrame, bound: int) -> DataFrame:
    """left, right: (text). (text_a, text_b, cost): all pairs of distinct texts within the bound, null texts apart.

    Lengths differ by at most the bound, so each text of the right is cut as texts of each such length are: pieces are
    joined on their number, that length and their letters, at each place within the bound.
    """
    a = left.select(expr.as_bytes("text").alias("a")).where("a is not null").distinct()
    b = right.select(expr.as_bytes("text").alias("b")).where("b is not null").distinct()
    own = a.select("a", F.length("a").alias("n"), F.explode(_pieces(F.col("a"), bound)).alias("p")).select("a", "n", "p.t", "p.start", "p.piece")
    lengths = b.withColumn("n", F.explode(F.sequence(F.greatest(F.lit(0), F.length("b") - bound), F.length("b") + bound)))
    slots = lengths.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(bound))))
    low, high = F.floor(F.col("n") * F.col("t") / (bound + 1)).cast("int"), F.floor(F.col("n") * (F.col("t") + 1) / (bound + 1)).cast("int")
    size = high - low
    first, last = F.greatest(F.lit(0), low - bound), F.least(F.length("b") - size, low + bound)
    places = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    theirs = slots.select("b", "n", "t", F.explode(F.array_distinct(F.transform(places, lambda s: F.substr(F.col("b"), s + 1, size)))).alias("piece"))
    # sizes are estimated before pieces are exploded: no broadcast on their word
    candidates = own.join(theirs.hint("merge"), ["n", "t", "piece"]).select("a", "b").distinct()
    d = F.levenshtein("a", "b", bound)
    back = lambda c: F.encode(c, "ISO-8859-1").cast("string")
    return candidates.withColumn("cost", d).where("cost >= 0").select(back("a").alias("text_a"), back("b").alias("text_b"), "cost")


def near_pairs(pairs: DataFrame, bound: int) -> DataFrame:
    """Rows of pairs within the bound, with cost. The distance is computed once a row, and only its diagonals within the
    bound: generating it in an array keeps the filter from repeating it."""
    cost = F.explode(F.filter(F.array(expr.bounded_distance("a", "b", bound)), lambda d: d.isNotNull()))
    return pairs.select("*", cost.alias("cost"))
