import hashlib

import public_tokenizers
from pyspark.sql import functions as F
from test_simhash import classes, similar_by_brute_force
from test_suffix_dedup import brute
from test_tokens import check_packed
from tokenizers import Tokenizer

import corpus_pipeline
from seqloom.llm import decontamination as D
from seqloom.llm import quality_classifier as Q

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "SimHash near-dedup", "suffix-array dedup", "benchmark decontamination", "packing"]

    def stage(name, df):
        out = stages[name](spark, df, SF)
        out.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    one = stage("quality classifier", docs)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    accepted = {r.doc_id for r in Q.scored(docs, Q.fit(docs, labels)).where("accepted").collect()}
    assert {r.doc_id for r in one.collect()} == accepted and one.columns == COLUMNS

    two = stage("SimHash near-dedup", one)
    texts = {r.doc_id: r.text for r in one.collect()}
    ids = sorted(texts)
    first = classes(similar_by_brute_force([texts[k] for k in ids]), range(len(ids)))
    assert sorted(r.doc_id for r in two.collect()) == sorted({ids[k] for k in first.values()}) and two.columns == COLUMNS

    three = stage("suffix-array dedup", two)
    before = {r.doc_id: (r.text or "").encode() for r in two.collect()}
    expected = brute(list(before.items()), 100)
    after = {r.doc_id: r for r in three.collect()}
    assert after.keys() == before.keys() and three.columns == COLUMNS
    for k, r in after.items():
        if expected[k][1] == 0:
            assert r.text.encode() == before[k]
        whole = r.text.encode()
        if len(whole) == expected[k][0] - expected[k][1]:
            assert hashlib.sha256(whole).hexdigest() == expected[k][3]
        assert r.n_chars == len(r.text) or expected[k][1] == 0

    four = stage("benchmark decontamination", three)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    dirty = {r.doc_id for r in D.contaminated(three, bench).collect()}
    assert {r.doc_id for r in four.collect()} == after.keys() - dirty and four.columns == COLUMNS
    assert D.contaminated(four, bench).count() == 0

    five = stage("packing", four)
    words = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    check_packed(five.collect(), {r.doc_id: r.text for r in four.collect()}, (None, words), 4096)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert out.count() > 100 and corpus_pipeline.ORACLE_SQL is None


def test_stages_decide_by_row_not_by_id(spark, monkeypatch):
    stages = dict(corpus_pipeline.STAGES)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    item = max((r.text for r in bench.collect()), key=lambda x: len(x or ""))
    rows = [(None, "some words that nobody else says here at all"), (None, item), (7, "other words that nobody else says here at all"), (7, item), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.text) for r in stages["benchmark decontamination"](spark, df, SF).collect()}
    assert got == {r for r in rows if r[1] != item}

    monkeypatch.setattr(Q, "judged", lambda docs, labels, ids=None: (docs if ids is None else ids).select("doc_id", (~F.coalesce(F.contains("text", F.lit("bad")), F.lit(False))).alias("accepted")))
    rows = [(None, "bad words"), (None, "calm words"), (7, "calm"), (7, "bad"), (7, None), (8, "bad")]
    kept = {(r.doc_id, r.text) for r in stages["quality classifier"](spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()}
    assert kept == {r for r in rows if "bad" not in (r[1] or "")}


def test_stages_keep_columns_of_any_name(spark, monkeypatch):
    monkeypatch.setattr(Q, "judged", lambda docs, labels, ids=None: (docs if ids is None else ids).select("doc_id", F.lit(True).alias("accepted")))
    text = " ".join(f"word{k}" for k in range(40))
    df = spark.createDataFrame([(1, text), (2, text + " more"), (2, text + " more"), (None, "calm é words"), (3, None)], "doc_id long, text string")
    names = ["_text", "_doc", "_mark", "_own", "__mark", "_spans", "_id", "_key", "_rows", "id", "key", "n", "node", "root"]
    df = df.selectExpr("*", *[f"concat('x', doc_id, '{n}') AS `{n}`" for n in names])
    for name, run in list(dict(corpus_pipeline.STAGES).items())[:4]:
        got = run(spark, df, SF)
        assert got.columns == df.columns, name
        assert all(r[n] == (None if r.doc_id is None else f"x{r.doc_id}{n}") for r in got.collect() for n in names), name
        assert run(spark, df.limit(0), SF).count() == 0 or name == "quality classifier"


def test_suffix_stage_cuts_between_characters(spark):
    """A lead byte that is left over and a tail byte that is left over make no letter of their own."""
    same = "".join(f"{k:03d}" for k in range(60))
    rows = [(1, "é" + same + "î"), (2, "ĩ" + same + "ã"), (3, "ab" + same + "cd")]
    got = {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)["suffix-array dedup"](spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()}
    assert got[1] == rows[0][1] and got[3] == "abcd" and set(got[2]) <= set("ĩã")
