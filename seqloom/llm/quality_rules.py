"""Quality rules: an ordered list of learned threshold rules, as one Spark conditional expression.

Statistics of every whole text are computed with SQL functions alone. Rules come from labelled rows by sequential
covering: a rule is grown condition by condition on two thirds of the rows that no earlier rule covers, then pruned
from its end on the other third, and kept if it is precise enough there. Applying them is a CASE expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import least_hashed, let, saved, table

BLANK = "[\\x20\\x09-\\x0D]+"
WINDOW = 5


def _repeat_words(words: Column) -> Column:
    """Words in windows of 5 words that are found twice or more in the text. Windows are compared by 64-bit hashes of
    their words' 64-bit hashes."""

    def windows(h: Column) -> Column:
        return F.when(F.size(h) < WINDOW, F.array().cast("array<bigint>")).otherwise(
            F.slice(F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + d) for d in range(1, WINDOW)])), F.lit(1), F.size(h) - (WINDOW - 1))
        )

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - p, F.lit(WINDOW)))), F.lit(0).cast("bigint"), lambda a, x: a + x)

    def repeated(s: Column) -> Column:
        equal = lambda e, j: F.coalesce(F.get(s, j)["k"] == e["k"], F.lit(False))
        return let(F.array_sort(F.transform(F.filter(s, lambda e, j: equal(e, F.when(j > 0, j - 1).otherwise(F.size(s))) | equal(e, j + 1)), lambda e: e["p"])), covered)

    def count(w: Column) -> Column:
        places = F.array_sort(F.transform(w, lambda k, p: F.struct(k.alias("k"), p.alias("p"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("bigint")).otherwise(let(places, repeated))

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(windows(h), count))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id and counts of the whole text (null: no words); other columns aren't read. Texts of
    any length are counted whole; rows that repeat a doc_id give a row each; no rows give none.

    n_words, word_chars (code points in words), n_symbols (of #*$%&|<>), n_dup_lines (lines with a word that equal an
    earlier line), n_repeat_words (see above), and for rules: n_lines (with a word), n_upper (capital letters), n_marks
    (of .,;:!?), n_distinct_words.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    number = lambda c: c.cast("bigint")

    def counts(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
        return F.struct(
            number(F.size(words)).alias("n_words"),
            number(F.length(F.array_join(words, ""))).alias("word_chars"),
            number(F.regexp_count(text, F.lit("[#*$%&|<>]"))).alias("n_symbols"),
            let(lines, lambda x: F.struct(number(F.size(x)).alias("n"), number(F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("lines"),
            _repeat_words(words).alias("n_repeat_words"),
            number(F.regexp_count(text, F.lit("\\p{Lu}"))).alias("n_upper"),
            number(F.regexp_count(text, F.lit("[.,;:!?]"))).alias("n_marks"),
            number(F.size(F.array_distinct(words))).alias("n_distinct_words"),
        )

    words = F.array_remove(F.split(text, BLANK), "")
    s = docs.select(F.col(id_col).alias("doc_id"), let(words, counts).alias("s"))
    return s.select("doc_id", "s.n_words", "s.word_chars", "s.n_symbols", F.col("s.lines.dup").alias("n_dup_lines"), "s.n_repeat_words", F.col("s.lines.n").alias("n_lines"), "s.n_upper", "s.n_marks", "s.n_distinct_words")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _per(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


#: What rules may test.
FEATURES = {
    "n_words": lambda: F.col("n_words").cast("double"),
    "word_length": lambda: _per("word_chars", "n_words"),
    "symbol_share": lambda: _per("n_symbols", "word_chars"),
    "dup_line_share": lambda: _per("n_dup_lines", "n_lines"),
    "repeat_share": lambda: _per("n_repeat_words", "n_words"),
    "line_words": lambda: _per("n_words", "n_lines"),
    "upper_share": lambda: _per("n_upper", "word_chars"),
    "mark_share": lambda: _per("n_marks", "n_words"),
    "distinct_share": lambda: _per("n_distinct_words", "n_words"),
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        f = FEATURES[self.feature]()
        return f > F.lit(self.threshold) if self.above else f <= F.lit(self.threshold)

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _holds(rule: Rule, x: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
    for c in rule:
        rows = rows & c.holds(x)
    return rows


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray, most: int, cuts: int) -> Rule:
    """Adds the condition with the largest information gain over what is covered, while good rows are."""
    rule: Rule = ()
    while len(rule) < most:
        p, n = int((rows & bad).sum()), int((rows & ~bad).sum())
        if not p or not n:
            break
        best, gain = None, 1e-9
        for name, v in x.items():
            seen = np.unique(np.quantile(v[rows], np.linspace(0, 1, cuts)))
            for t in ((seen[1:] + seen[:-1]) / 2).tolist():
                over = rows & (v > t)
                p1, n1 = int((over & bad).sum()), int((over & ~bad).sum())
                for above, a, b in ((True, p1, n1), (False, p - p1, n - n1)):
                    if a and (g := a * (np.log2(a / (a + b)) - np.log2(p / (p + n)))) > gain:
                        best, gain = Condition(name, above, t), g
        if best is None:
            break
        rule += (best,)
        rows = rows & best.holds(x)
    return rule


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray) -> tuple[Rule, float, int]:
    """The shortest beginning of rule with the best (p - n) / (p + n), its precision and what it covers of bad."""
    best: tuple[Rule, float, int] = ((), 0.0, 0)
    worth = -2.0
    for k in range(1, len(rule) + 1):
        held = _holds(rule[:k], x, rows)
        p, n = int((held & bad).sum()), int((held & ~bad).sum())
        if p + n and (p - n) / (p + n) > worth + 1e-12:
            worth, best = (p - n) / (p + n), (rule[:k], p / (p + n), p)
    return best


def learn(x: dict[str, np.ndarray], bad: np.ndarray, max_rules: int = 16, max_conditions: int = 4, min_precision: float = 0.95, min_covered: int = 2, cuts: int = 48) -> list[Rule]:
    """Rules for bad rows, in order. x: values by feature. Every third row prunes, the others grow."""
    left, prunes, rules = np.ones(len(bad), bool), np.arange(len(bad)) % 3 == 2, []
    while len(rules) < max_rules and (left & bad).any():
        grown = _grow(x, bad, left & ~prunes, max_conditions, cuts)
        rule, precision, covered = _prune(grown, x, bad, left & prunes)
        if not rule or precision < min_precision or covered < min_covered:
            break
        rules.append(rule)
        left &= ~_holds(rule, x, left)
    return rules


def rule_number(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1; null if none does."""
    out = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules, 1))):
        held = F.lit(True)
        for c in rule:
            held = held & c.column()
        out = F.when(held, F.lit(k)).otherwise(out)
    return out


def train(stats: DataFrame, labels: DataFrame, sample: int = 20_000, **options) -> list[Rule]:
    """Learns from at most `sample` labelled rows (those with the least hash of their id), which go to the driver as
    numbers. A doc_id labelled twice counts as bad if any of its labels is. Null labels and ids don't count. Documents that
    repeat a doc_id are rows of their own. Without labelled rows there are no rules."""
    known = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    joined = stats.where(~base_failed()).join(known, "doc_id").select("doc_id", *[f().alias(n) for n, f in FEATURES.items()], (F.col("_quality") == 0).alias("bad"))
    rows = least_hashed(joined, sample, "doc_id", "n_words").collect()
    x = {n: np.array([r[n] for r in rows], float) for n in FEATURES}
    return learn(x, np.array([r["bad"] for r in rows], bool), **options) if rows else []


def judged(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds base_failed, rule (number of the first that holds, null if none or base_failed) and kept."""
    out = stats.withColumn("base_failed", base_failed())
    out = out.withColumn("rule", F.when(~F.col("base_failed"), rule_number(rules)))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = saved(statistics(table(spark, sf_dir, "documents")))
    return judged(stats, train(stats, table(spark, sf_dir, "labels")))
