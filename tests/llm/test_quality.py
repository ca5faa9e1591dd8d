import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import quality_classifier as Q
from seqloom.llm import quality_rules as R
from seqloom.llm.common import least_hashed

SF = "/root/testdata/sf0.001"


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    n = Counter(windows)
    covered = {j for k, w in enumerate(windows) if n[w] > 1 for j in range(k, k + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_statistics_equal_brute_force(spark):
    r = random.Random(0)
    texts = [None, "", " ", "a b c d e", "a a a a a a", "a a a a a", "x\n\nx\n x\nx", "\x1f \x0b\x0ca|b <é 🙂> a|b <é", "a b c d e a b c d e f", "a\nb\na\n", "\na b\r\na b\r\n", " x y z"]
    texts += ["".join(r.choice(["a", "b", "c", " ", " ", "\n", "é", "|", "$"]) for _ in range(r.randint(0, 200))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' AS s", "1 AS n_words", "'y' AS lines")
    for row in R.statistics(df).collect():
        assert base(texts[row.doc_id]) == (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words), texts[row.doc_id]


def test_rules_are_learned_and_applied(spark):
    rng = np.random.default_rng(1)
    x = {n: rng.random(3000) for n in R.FEATURES}
    bad = (x["symbol_share"] > 0.8) & (x["upper_share"] <= 0.5) | (x["word_length"] > 0.95)
    rules = R.learn(x, bad)
    caught = np.zeros(3000, bool)
    for rule in rules:
        caught |= R._holds(rule, x, np.ones(3000, bool))
    assert (caught & bad).sum() > 0.9 * bad.sum() and (caught & ~bad).sum() < 0.03 * (~bad).sum()
    assert {c.feature for rule in rules for c in rule} >= {"symbol_share", "word_length"}
    assert R.learn({n: np.zeros(9) for n in R.FEATURES}, np.zeros(9, bool)) == []


def test_the_conditional_expression_equals_the_rules(spark):
    """Rules of several conditions, learned from data that need them, over a table: the first rule that holds counts."""
    rng = np.random.default_rng(3)
    n = 2000
    rows = [(k, *map(int, rng.integers(0, 100, 9))) for k in range(n)]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_distinct_words"]
    df = spark.createDataFrame(rows, "doc_id long, " + ", ".join(f"{c} long" for c in names))
    table = {c: np.array([r[k + 1] for r in rows], float) for k, c in enumerate(names)}
    per = lambda a, b: table[a] / np.maximum(table[b], 1)
    x = {"n_words": table["n_words"], "word_length": per("word_chars", "n_words"), "symbol_share": per("n_symbols", "word_chars"), "dup_line_share": per("n_dup_lines", "n_lines"), "repeat_share": per("n_repeat_words", "n_words"), "line_words": per("n_words", "n_lines"), "upper_share": per("n_upper", "word_chars"), "mark_share": per("n_marks", "n_words"), "distinct_share": per("n_distinct_words", "n_words")}
    assert x.keys() == R.FEATURES.keys()
    bad = (x["n_words"] > 50) & (x["symbol_share"] > 0.8) & (x["mark_share"] <= 1) | (x["line_words"] <= 0.3) & (x["upper_share"] > 1)
    rules = R.learn(x, bad)
    assert len(rules) >= 2 and max(map(len, rules)) >= 3
    first = np.zeros(n, int)
    for number, rule in reversed(list(enumerate(rules, 1))):
        first[R._holds(rule, x, np.ones(n, bool))] = number
    failed = (table["n_words"] < 10) | (100 * table["n_repeat_words"] > 20 * table["n_words"])
    for r in R.judged(df, rules).collect():
        assert r.rule == (None if failed[r.doc_id] or not first[r.doc_id] else first[r.doc_id])
        assert r.kept == (not failed[r.doc_id] and not first[r.doc_id])


def test_rules_query(spark):
    rows = R.op3(spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        n, chars, symbols, dup, repeat = base(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 10 or 100 * repeat > 20 * n)
        assert r.kept == (not r.base_failed and r.rule is None)


def test_rules_without_labels_or_documents(spark):
    stats = R.statistics(spark.read.parquet(f"{SF}/documents.parquet"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert R.train(stats, none) == []
    assert R.judged(stats, []).where("kept = base_failed").count() == 0
    assert R.judged(stats.limit(0), R.train(stats.limit(0), none)).count() == 0


def test_rules_hold_on_labels_not_seen(spark):
    sf = "/root/testdata/sf0.1"
    stats, labels = R.statistics(spark.read.parquet(f"{sf}/documents.parquet")), spark.read.parquet(f"{sf}/labels.parquet")
    rules = R.train(stats, labels.where("doc_id % 3 <> 0"))
    out = R.judged(stats, rules).where("NOT base_failed").join(labels.where("doc_id % 3 = 0"), "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in out}
    assert n[1, True] > 0.99 * (n[1, True] + n.get((1, False), 0))
    assert n[0, False] > 0.85 * (n[0, False] + n.get((0, True), 0))


def test_plan_is_native(spark):
    plan = R.statistics(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_sample_is_bounded_and_does_not_depend_on_layout(spark):
    df = spark.range(5000).select(F.col("id").alias("k"))
    one = sorted(r.k for r in least_hashed(df, 100, "k").collect())
    two = sorted(r.k for r in least_hashed(df.repartition(7), 100, "k").collect())
    assert one == two and len(one) == 100 and least_hashed(df, 10_000, "k").count() == 5000


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.2
    right = [0.95, 0.9, 0.85, 0.98]
    votes = np.stack([np.where(rng.random(20_000) < 0.3, Q.NOTHING, np.where((rng.random(20_000) < r) == truth, Q.BAD, Q.GOOD)) for r in right], axis=1)
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    p, share = Q.expectation_maximisation(patterns, counts.astype(float))
    assert ((p[inverse.reshape(-1)] > 0.5) == truth).mean() > 0.95
    assert abs(share[0, 1, Q.BAD] / (share[0, 1, Q.BAD] + share[0, 1, Q.GOOD]) - 0.95) < 0.05


@pytest.fixture(scope="module")
def judged(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = Q.fit(docs, labels.where("doc_id % 3 <> 0"))
    return model, docs, Q.scored(docs, model).join(labels.where("doc_id % 3 = 0"), "doc_id").toPandas()


def test_classifier_on_labels_not_seen(judged):
    model, _, x = judged
    clean = x[(x.quality == 1) & (x.toxic == 0)]
    assert clean.accepted.mean() > 0.99
    assert x[x.quality == 0].accepted.mean() < 0.05
    assert x[x.toxic == 1].accepted.mean() < 0.25
    assert all(0 <= a <= 1 for own in model.accuracy.values() for a in own)


def test_scores_equal_brute_force(spark, judged):
    """Scores from the weights alone, feature by feature, for texts of every kind."""
    model, docs, _ = judged
    texts = {r.doc_id: r.text for r in docs.where("doc_id < 300").collect()} | {-1: None, -2: "", -3: "Idiot, IDIOT! é É | $$ " * 30}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in Q.scored(df, model).collect()}
    assert got.keys() == texts.keys()
    for k, t in texts.items():
        words = set(re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()))
        bare = [w.strip(Q.ENDS) for w in words]
        hits = sum(any(s in model.toxic_stems for s in [b, *(b[:n] + "*" for n in Q.STEM_LETTERS if len(b) > n)]) for b in bare)
        votes = [Q.BAD if any(b in Q.INSULTS for b in bare) else Q.NOTHING, Q.BAD if hits >= 2 else Q.NOTHING if hits else Q.GOOD]
        marks = [f"style {n} {sum(s > x for x in Q.STYLE_STEPS)}" for n, s in enumerate(Q.style(t or ""))] + [f"vote {n} {v}" for n, v in enumerate(votes)]
        for head, score in ((model.quality, got[k].quality_score), (model.toxic, got[k].toxic_score)):
            of = lambda name: float(head.weights[zlib.crc32(name.encode()) % Q.BUCKETS])  # noqa: E731, B023
            sums = sum(of(b) + sum(of(b[:n] + "*") for n in Q.STEM_LETTERS if len(b) > n) for b in bare)
            assert abs(sums / max(1, len(words)) ** Q.LENGTH_POWER + sum(map(of, marks)) + head.bias - score) < 1e-6
        assert got[k].accepted == (got[k].quality_score <= model.quality.threshold and got[k].toxic_score <= model.toxic.threshold)


def test_many_texts_at_once_equal_one_by_one():
    r = random.Random(8)
    texts = [None, "", "  ", "a", "A a\x0ba\n\nB", "Ünï ÜNÏ ünï", "x | x || $$ !? ??"] + ["".join(r.choice(["idiot ", "Loser! ", "Σας ", "ΣΑΣ\t", "a b ", "|", "\n", "é", "TRASH", " "]) for _ in range(r.randint(0, 80))) for _ in range(60)]
    marks = Q.WordMarks(frozenset(["tras*", "σας"]))
    both = Q.Texts(texts)
    for k, t in enumerate(texts):
        words = Q.distinct_words(t or "")
        assert {both.words[w].decode() for w in both.word[both.row == k]} == words and both.n_words[k] == len(words)
        assert both.shares[k].tolist() == pytest.approx(list(Q.style(t or "")))
        assert both.quality_votes()[k].tolist() == Q.quality_votes(Q.style(t or ""))
        assert both.toxic_votes(marks)[k].tolist() == Q.toxic_votes(words, marks)


def test_few_bytes_of_features_still_fit(spark, monkeypatch):
    monkeypatch.setattr(Q, "FEATURE_BYTES", 20_000)
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    assert Q.scored(docs, Q.fit(docs, labels)).count() == docs.count()


def test_classifier_takes_any_row(spark, judged):
    model, docs, _ = judged
    rows = [(1, None), (1, None), (None, ""), (2, "idiot " * 40_000), (3, "İ ß 日本 🙂")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS quality", "'x' AS accepted")
    assert Q.scored(df, model).count() == 5
    assert Q.scored(df.limit(0), model).count() == 0


def test_fit_without_rows(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for d in (docs, docs.limit(0)):
        assert Q.scored(d, Q.fit(d, labels)).where("NOT accepted").count() == 0


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_thresholds_are_from_annotated_clean_documents_at_every_size(spark, size):
    docs, labels = (spark.read.parquet(f"/root/testdata/{size}/{t}.parquet") for t in ("documents", "labels"))
    seen = labels.where("doc_id % 3 <> 0")
    model = Q.fit(docs, seen)
    x = Q.scored(docs, model).join(labels, "doc_id").toPandas()
    clean = x[(x.doc_id % 3 != 0) & (x.quality == 1) & (x.toxic == 0)]
    for head, c in ((model.quality, "quality_score"), (model.toxic, "toxic_score")):
        assert head.threshold <= max(0, clean[c].max()) + 1e-9
    held = x[x.doc_id % 3 == 0]
    toxic = held[(held.toxic == 1) & (held.quality == 1)]
    print(size, len(clean), "clean; held-out toxic:", len(toxic), "accepted", toxic.accepted.mean(), "clean accepted", held[(held.quality == 1) & (held.toxic == 0)].accepted.mean())
    assert len(toxic) == 0 or toxic.accepted.mean() < 0.6
    assert held[(held.quality == 1) & (held.toxic == 0)].accepted.mean() > 0.9


def test_query_equals_fit_and_score(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    key = lambda r: (r.doc_id, r.accepted)
    assert sorted(map(key, Q.op6(spark, SF).collect())) == sorted(map(key, Q.scored(docs, Q.fit(docs, labels)).collect()))
