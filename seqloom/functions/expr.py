"""Distances and lower bounds as plain Spark expressions: nothing here leaves the JVM.

Sequences are byte strings. Spark's levenshtein counts characters, so both sides are read as Latin-1 first, which has
one character for each byte.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_bytes(x: ColumnOrName) -> Column:
    """A text with a character for each byte of x (string or binary)."""
    return F.decode(col(x).cast("binary"), "ISO-8859-1")


def n_bytes(x: ColumnOrName) -> Column:
    return F.octet_length(col(x))


def distance(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Unit-cost edit distance; null if either is."""
    return F.levenshtein(as_bytes(a), as_bytes(b))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row (a lambda variable is bound once, a repeated expression is not)."""
    return F.transform(F.array(value), body)[0]


def bounded_distance(a: ColumnOrName, b: ColumnOrName, bound: int) -> Column:
    """The distance if it is at most bound, else null: only diagonals within the bound are filled. The sequences are
    computed once, and their lengths tried first."""

    def cost(p: Column) -> Column:
        d = F.when(F.abs(F.length(p["a"]) - F.length(p["b"])) <= bound, F.levenshtein(p["a"], p["b"], bound))
        return F.get(F.filter(F.array(d), lambda x: x >= 0), F.lit(0))

    return let(F.struct(as_bytes(a).alias("a"), as_bytes(b).alias("b")), cost)


# --- lower bounds ----------------------------------------------------------------------------------------------------


def zero_bound(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.when(col(a).isNotNull() & col(b).isNotNull(), F.lit(0))


def gap_bound(a: ColumnOrName, b: ColumnOrName) -> Column:
    """At least the difference of lengths."""
    return F.abs(n_bytes(a) - n_bytes(b))


def max_length(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Not a lower bound of the distance, but an upper one."""
    return F.greatest(n_bytes(a), n_bytes(b))


def _occurrences(x: ColumnOrName, letter: str) -> Column:
    return F.length(col(x)) - F.length(F.replace(col(x), F.lit(letter), F.lit("")))


def count_bound(a: ColumnOrName, b: ColumnOrName, alphabet: str = "ACGT") -> Column:
    """Letters that a has more of, or b, whichever are more: each costs an edit."""
    diffs = [_occurrences(a, c) - _occurrences(b, c) for c in alphabet]
    over = sum((F.greatest(d, F.lit(0)) for d in diffs), F.lit(0))
    under = sum((F.greatest(-d, F.lit(0)) for d in diffs), F.lit(0))
    return F.greatest(over, under).cast("int")


def pair_count_bound(a: ColumnOrName, b: ColumnOrName, alphabet: str = "ACGT") -> Column:
    """As count_bound for two letters in a row. An edit changes at most two of these, so half the surplus, rounded up."""
    of = lambda x, p: F.regexp_count(col(x), F.lit(f"(?={p})"))
    diffs = [of(a, x + y) - of(b, x + y) for x in alphabet for y in alphabet]
    over = sum((F.greatest(d, F.lit(0)) for d in diffs), F.lit(0))
    under = sum((F.greatest(-d, F.lit(0)) for d in diffs), F.lit(0))
    return F.greatest(count_bound(a, b, alphabet), F.ceil(F.greatest(over, under) / 2)).cast("int")


def best_bound(*bounds: Column) -> Column:
    """The largest of lower bounds is one too."""
    return F.greatest(*bounds)


def suffix_distance(a: ColumnOrName, b: ColumnOrName, i: ColumnOrName, j: ColumnOrName) -> Column:
    """The exact distance of what follows (i, j): the perfect heuristic."""
    rest = lambda x, k: F.substr(as_bytes(x), col(k) + 1)
    return F.levenshtein(rest(a, i), rest(b, j))


# --- seeds' potential and coordinates --------------------------------------------------------------------------------


def potential(n: ColumnOrName, i: ColumnOrName, k: int, r: int = 1) -> Column:
    """r for each seed of k letters that starts at i or later, in a sequence of n letters."""
    return (r * F.greatest(F.lit(0), F.floor(col(n) / k) - F.ceil(col(i) / k))).cast("int")


def potential_distance(n: ColumnOrName, i: ColumnOrName, to: ColumnOrName, k: int, r: int = 1) -> Column:
    """Potential between i and the start of the seed that covers `to` (or `to`, where none does)."""
    start = F.when(F.floor(col(to) / k) < F.floor(col(n) / k), F.floor(col(to) / k) * k).otherwise(col(to))
    return potential(n, i, k, r) - potential(n, start, k, r)


def transformed_i(i: ColumnOrName, j: ColumnOrName, p: ColumnOrName) -> Column:
    return col(i) - col(j) - col(p)


def transformed_j(i: ColumnOrName, j: ColumnOrName, p: ColumnOrName) -> Column:
    return col(j) - col(i) - col(p)


def inverse_transformed(x: ColumnOrName, y: ColumnOrName, n: ColumnOrName, k: int, r: int = 1) -> Column:
    """STRUCT<i, j>: the place whose transformed coordinates are x and y, of places at a seed's start or the end of n."""
    p = F.floor(-(col(x) + col(y)) / 2)
    i = F.when(p == 0, col(n)).otherwise((F.floor(col(n) / k) - F.ceil(p / r)) * k)
    return F.struct(i.cast("int").alias("i"), (i - F.floor((col(x) - col(y)) / 2)).cast("int").alias("j"))


def affine_gap_bound(i: ColumnOrName, j: ColumnOrName, to_i: ColumnOrName, to_j: ColumnOrName, k: int) -> Column:
    """Whole seeds between i and to_i, and the change of diagonal."""
    return (F.floor(col(to_i) / k) - F.ceil(col(i) / k) + F.abs((col(to_i) - col(i)) - (col(to_j) - col(j)))).cast("int")


def gap_cost(model, delta: ColumnOrName) -> Column:
    """CostModel.gap_cost as an expression."""
    d = col(delta)

    def cost(kind: str, size: Column) -> Column:
        options = [F.lit(o) + size * e for o, e in model.gaps(kind)]
        return F.least(*options) if len(options) > 1 else options[0] if options else F.lit(None)

    return F.when(d == 0, 0).when(d < 0, cost("ins", -d)).otherwise(cost("del", d)).cast("int")


def extend_cost(model, delta: ColumnOrName) -> Column:
    """CostModel.extend_cost as an expression."""
    d = col(delta)
    least = lambda kind: min((e for _, e in model.gaps(kind)), default=None)
    return F.when(d == 0, 0).when(d < 0, -d * F.lit(least("ins"))).otherwise(d * F.lit(least("del"))).cast("int")


def most_for_cost(model, kind: str, cost: ColumnOrName, opened: bool = False) -> Column:
    """CostModel.most_for_cost as an expression."""
    c = col(cost)
    sizes = [F.floor(F.greatest(F.lit(0), c - (0 if opened else o)) / e).cast("int") for o, e in model.gaps(kind)]
    return F.greatest(*sizes) if len(sizes) > 1 else sizes[0] if sizes else F.lit(0)


# --- letters ---------------------------------------------------------------------------------------------------------


def check_dna(x: ColumnOrName) -> Column:
    """x, or an error where it has other letters than A, C, G, T."""
    return F.when(col(x).rlike("^[ACGT]*$") | col(x).isNull(), col(x)).otherwise(F.raise_error(F.concat(F.lit("not a sequence of A, C, G, T: "), F.substring(col(x), 1, 40))))


def kmer_code(x: ColumnOrName) -> Column:
    """Two bits a letter, the first letter highest: A 0, C 1, T 2, G 3. For up to 31 letters."""
    return F.conv(F.translate(col(x), "ACTG", "0123"), 4, 10).cast("bigint")


def letter_matches(pattern: ColumnOrName, text: ColumnOrName) -> Column:
    """Whether a pattern letter (ACGT, N or * for any, Y for C or T, R for A or G) stands for a text letter."""
    sets = F.create_map(*[F.lit(x) for p, s in (("A", "A"), ("C", "C"), ("G", "G"), ("T", "T"), ("N", "ACGT"), ("*", "ACGT"), ("Y", "CT"), ("R", "AG")) for x in (p, s)])
    return F.contains(sets[F.upper(col(pattern))], F.upper(col(text)))


def common_prefix(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Letters that both begin with."""
    x, y = as_bytes(a), as_bytes(b)
    n = F.least(F.length(x), F.length(y))
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    first = F.filter(places, lambda k: F.substr(x, k, F.lit(1)) != F.substr(y, k, F.lit(1)))
    return F.coalesce(F.get(first, F.lit(0)) - 1, n)
