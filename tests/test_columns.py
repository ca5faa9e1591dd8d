import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from seqloom.functions import align as A
from seqloom.functions import cigar, expr
from seqloom.functions import cost_model as C
from seqloom.operators import heuristics as H
from seqloom.operators import seeds as S
from seqloom.operators import similarity
from seqloom.plans.aligner import PRESETS, STRATEGIES, aligner, main
from seqloom.plans.reports import alignment_statistics, cost_scaling, explain_alignment
from seqloom.sources.generate import MODELS, generate, grid
from seqloom.sources.pairs import read_pairs, simulated_pairs, write_costs, write_seq
from seqloom.streaming.ingest import align_stream, pair_stream, seq_stream

PAIRS = [(1, "", ""), (2, "", "ACG"), (3, "ACGT", ""), (4, None, "A"), (5, "ACGTACGT", "ACGACGT"), (6, "AAAA", "TTTT"), (7, "AC", "ACGTACGTA")]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(PAIRS, "id long, a string, b string")


def test_nulls_and_empty(spark, pairs):
    costs = {r.id: r.d for r in pairs.select("id", expr.distance("a", "b").alias("d")).collect()}
    assert costs == {1: 0, 2: 3, 3: 4, 4: None, 5: 1, 6: 4, 7: 7}
    found = {r.id: r.r for r in pairs.select("id", A.align("a", "b").alias("r")).collect()}
    assert {k: r.cost for k, r in found.items()} == costs and found[1].cigar == [] and found[4].cigar is None
    for m in (C.lcs(), C.affine(1, 2, 1)):
        got = {r.id: r.c for r in pairs.select("id", A.alignment_cost("a", "b", m).alias("c")).collect()}
        assert got[1] == 0 and got[4] is None and got[2] == (3 if m.name == "lcs" else 5)
    assert [r.c for r in pairs.limit(0).select(A.alignment_cost("a", "b", "affine(1,2,1)").alias("c")).collect()] == []


def test_bytes_not_characters(spark):
    df = spark.createDataFrame([("é", "e"), ("é", "è")], "a string, b string")
    assert [r.d for r in df.select(expr.distance("a", "b").alias("d")).collect()] == [2, 1]


def test_scripts(spark):
    df = spark.createDataFrame([("2=1X1I0D3=",)], "t string").select(cigar.from_text("t").alias("s"))
    row = df.select(cigar.to_text(cigar.merged("s")).alias("m"), cigar.to_text(cigar.reversed_("s")).alias("r"), cigar.valid("s", F.lit("AACGGG"), F.lit("AATTGGG")).alias("zero"), cigar.valid(cigar.merged("s"), F.lit("AACGGG"), F.lit("AATTGGG")).alias("ok"), cigar.valid(cigar.merged("s"), F.lit("AACGGGA"), F.lit("AATTGGG")).alias("short")).first()
    assert tuple(row) == ("2=1X1I3=", "3=0D1I1X2=", False, True, False)


def test_bounds_hold(spark):
    p = grid(spark, [0, 3, 17, 40], [0.0, 0.1, 0.5], each=2).withColumn("id", F.monotonically_increasing_id()).select("id", "a", "b")
    p = spark.createDataFrame(p.toPandas(), "id long, a string, b string")
    out = p.select("id", expr.distance("a", "b").alias("d"))
    for r, k in ((1, 3), (2, 4)):
        for kind in ("gap", "count", "pair_count", "sh", "csh", "gcsh"):
            assert out.join(H.bound(p, kind, k, r), "id").where("h > d").count() == 0, (kind, r)
        assert out.join(H.symmetric("csh", p, k, r), "id").where("h > d").count() == 0


def test_local_pruning_keeps_true_matches(spark):
    p = spark.createDataFrame([(1, "ACGTTGCAACGT", "ACGTTGCAACGT"), (2, "ACGTTGCAACGT", "ACGTCCCCCCCC")], "id long, a string, b string")
    kept = S.matches(p, 4, 1, look_ahead=2)
    on_diagonal = kept.where("start_i = start_j").groupBy("id").count().collect()
    assert {r.id: r["count"] for r in on_diagonal}.get(1) == 3
    assert kept.where("id = 2 AND start_i = 0 AND start_j = 0").count() == 0
    with pytest.raises(ValueError):
        S.matches(p, 4, 3)


def test_letters(spark):
    df = spark.createDataFrame([("N", "g"), ("Y", "T"), ("Y", "A"), ("R", "A"), ("A", "A")], "p string, t string")
    assert [r.m for r in df.select(expr.letter_matches("p", "t").alias("m")).collect()] == [True, True, False, True, True]
    code = spark.createDataFrame([("ACGT",), ("TGCA",)], "q string").select(expr.kmer_code("q").alias("c")).collect()
    assert [r.c for r in code] == [0b00011110, 0b10110100]
    with pytest.raises(PySparkException):
        spark.createDataFrame([("ACNT",)], "q string").select(expr.check_dna("q")).collect()


def test_mutations_of_one_word(spark):
    # Codes of all that one edit makes of the word with code 0b00011011.
    word = spark.createDataFrame([("ACTG",)], "q string")
    rows = word.select(F.explode(S.mutations(F.col("q"), 4)).alias("m")).select("m.kind", expr.kmer_code("m.q").alias("c")).collect()
    found = {k: sorted({r.c for r in rows if r.kind == k}) for k in ("del", "sub", "ins")}
    assert found["del"] == [6, 7, 11, 27]
    assert found["sub"] == [11, 19, 23, 24, 25, 26, 31, 43, 59, 91, 155, 219]
    assert found["ins"] == [27, 75, 91, 99, 103, 107, 108, 109, 110, 111, 123, 155, 219, 283, 539, 795]


def test_similar_texts_equal_all_with_all(spark):
    import random

    random.seed(5)
    texts = ["", "a", "ab", None, "é", "ab"] + ["".join(random.choice("ab") for _ in range(random.randint(0, 12))) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    every = df.where("text is not null").distinct()
    for bound in (0, 1, 3):
        expected = every.select(F.col("text").alias("x")).crossJoin(every.select(F.col("text").alias("y"))).select("x", "y", expr.distance("x", "y").alias("d")).where(f"d <= {bound}")
        assert sorted(map(tuple, similarity.near_texts(df, df, bound).collect())) == sorted(map(tuple, expected.collect()))


@pytest.mark.parametrize("strategy", sorted(STRATEGIES))
def test_strategies_agree(spark, strategy):
    p = generate(spark, 60, 40, 0.2, seed=7)
    plain = {r.id: r.c for r in p.select("id", expr.distance("a", "b").alias("c")).collect()}
    got = {r.id: r.cost for r in aligner(strategy, bound=9, k=5).costs(p).collect()}
    assert got == {k: c if c <= 9 else None for k, c in plain.items()}
    rows = aligner(strategy).align(p).select("id", "cost", cigar.valid("cigar", "a", "b").alias("ok")).collect()
    assert {r.id: r.cost for r in rows} == plain and all(r.ok for r in rows)


def test_affine_aligner_and_options(spark):
    p = generate(spark, 20, 30, 0.3, seed=9)
    rows = aligner(model="affine(1,2,1)").align(p).select("cost", cigar.valid("cigar", "a", "b").alias("ok")).collect()
    assert all(r.ok for r in rows)
    for bad in (lambda: aligner("other"), lambda: aligner(width=3), lambda: aligner("banded", "affine(1,2,1)", bound=3).costs(p)):
        with pytest.raises(ValueError):
            bad()


def test_generators(spark):
    for m in MODELS:
        one, two = (generate(spark, 5, 50, 0.2, m, 3).collect() for _ in range(2))
        assert one == two and all(len(r.a) == 50 and set(r.a + r.b) <= set("ACGT") for r in one)
        assert [r.a for r in generate(spark, 5, 50, 0.0, m).collect()] == [r.b for r in generate(spark, 5, 50, 0.0, m).collect()]
    with pytest.raises(ValueError):
        generate(spark, 1, 1, 0.1, "other")


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.seq").write_text(">ACGT\n<ACGA\n>AA\n<TT\n>odd\n")
    (tmp_path / "in" / "y.txt").write_text("AC\nAG\n")
    (tmp_path / "in" / "z.fa").write_text(">r1 first\nACGT\nAC\n>r2\nACG\n>r3\nA\n")
    got = sorted((r.a, r.b, r.name_a) for r in read_pairs(spark, str(tmp_path / "in")).collect())
    assert got == [("AA", "TT", None), ("AC", "AG", None), ("ACGT", "ACGA", None), ("ACGTAC", "ACG", "r1")]
    with pytest.raises(PySparkException):
        read_pairs(spark, str(tmp_path / "in"), "FAILFAST").collect()
    (tmp_path / "bad.seq").write_text("ACGT\n<ACGA\n")
    with pytest.raises(PySparkException):
        read_pairs(spark, str(tmp_path / "bad.seq")).collect()
    (tmp_path / "bad.dat").write_text("x\n")
    with pytest.raises(ValueError):
        read_pairs(spark, str(tmp_path / "bad.dat"))
    p = read_pairs(spark, str(tmp_path / "in" / "x.seq"))
    write_seq(p, str(tmp_path / "out"), ["pair"])
    again = read_pairs(spark, str(tmp_path / "in" / "y.txt"))
    assert again.count() == 1
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert lines == [">ACGT", "<ACGA", ">AA", "<TT"]


def test_empty_lines_are_sequences(spark, tmp_path):
    (tmp_path / "e.txt").write_text("AC\nAG\n\nTT\nC\n\n\r\nG\n")
    rows = read_pairs(spark, str(tmp_path / "e.txt"), "FAILFAST").orderBy("pair").collect()
    assert [(r.a, r.b) for r in rows] == [("AC", "AG"), ("", "TT"), ("C", ""), ("", "G")]
    (tmp_path / "e.seq").write_text(">AC\n\n<AG\n")
    with pytest.raises(PySparkException):
        read_pairs(spark, str(tmp_path / "e.seq")).collect()


def test_block_numbers_cross_splits(spark, tmp_path):
    lines = [f"{'ACGT'[k % 4] * (k % 50 + 1)}" for k in range(4000)]
    (tmp_path / "big.txt").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        rows = read_pairs(spark, str(tmp_path / "big.txt")).orderBy("pair").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.a, r.b) for r in rows] == list(zip(lines[::2], lines[1::2], strict=True))


def test_command_line(spark, tmp_path):
    (tmp_path / "x.seq").write_text(">ACTCGCT\n<AACTCGTT\n>A\n<A\n")
    main(["--input", str(tmp_path / "x.seq"), "--output", str(tmp_path / "out")])
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert [x.split(",")[0] for x in lines] == ["2", "0"] and lines[1] == "0,1="


def test_simulated_reads(spark):
    reads = spark.createDataFrame([("c1_2_aligned_0_F_1_4_2", "TACGTGG"), ("c1_6_aligned_1_F_0_3_0", "ACG")], "header string, sequence string")
    ref = spark.createDataFrame([("c1", "GGACGTNNAC")], "name string, sequence string")
    assert [(r.id, r.a, r.b) for r in simulated_pairs(reads, ref, strip=True).collect()] == [("0", "ACGT", "ACGT")]
    whole = simulated_pairs(reads.limit(1), ref).first()
    assert (whole.a, whole.b) == ("ACGT", "TACGTGG")  # the reference's part first, then the read
    for bad in ("c1_2_aligned_0_R_1_4_2", "c1_2_aligned_0_F_1_4", "x"):
        back = spark.createDataFrame([(bad, "TACGTGG")], "header string, sequence string")
        with pytest.raises(PySparkException):
            simulated_pairs(back, ref).collect()


def test_reports(spark):
    p = spark.createDataFrame([(1, "ACGT", "AGT")], "id long, a string, b string")
    r = alignment_statistics(p.withColumn("g", F.lit(1)), "g").first()
    assert (r.pairs, r.distance, r.matches, r.deletions, r.error_percent) == (1, 1.0, 3.0, 1.0, 25.0)
    assert [(x.i, x.j, x.cost, x.op) for x in explain_alignment(p).orderBy("step").collect()] == [(0, 0, 0, None), (1, 1, 0, "="), (2, 1, 1, "D"), (3, 2, 1, "="), (4, 3, 1, "=")]
    s = cost_scaling(spark, [C.unit(), C.affine(1, 2, 1)], [20], [0.0, 0.2], each=2)
    assert s.count() == 2 * 4 * 2 and s.where("error_rate = 0 AND cost <> 0").count() == 0


def test_stream_equals_batch(spark, tmp_path):
    p = generate(spark, 40, 20, 0.2).repartition(4)
    p.write.parquet(str(tmp_path / "in"))
    align_stream(pair_stream(spark, str(tmp_path / "in"), 2), aligner(), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {r.id: r.cost for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r.id: r.c for r in p.select("id", expr.distance("a", "b").alias("c")).collect()}
    (tmp_path / "seq").mkdir()
    (tmp_path / "seq" / "x.seq").write_text(">ACGT\n<ACGA\n>AA\n<TT\n")
    q = seq_stream(spark, str(tmp_path / "seq")).writeStream.format("memory").queryName("seqs").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("seqs").collect())) == [("AA", "TT"), ("ACGT", "ACGA")]


def test_sql_functions(spark):
    A.register(spark)
    row = spark.sql("SELECT seq_align('ACTCGCT', 'AACTCGTT').cost AS c, seq_align(cast('ACTCGCT' AS BINARY), cast('AACTCGTT' AS BINARY)).cost AS d, seq_distance('ACTCGCT', 'AACTCGTT') AS e, seq_affine_cost('ACGT', 'AT') AS f, seq_model_cost('ACGT', 'AT', 'linear(1,3)') AS g, seq_search('AC', 'CTTACTTA') AS s").first()
    assert (row.c, row.d, row.e, row.f, row.g, row.s) == (2, 2, 2, 4, 6, [0, 0, 1, 2, 1, 0, 1, 2, 1, 0, 0])
    presets = spark.sql("SELECT seq_align_simple('ACTCGCT', 'AACTCGTT').cost AS c, seq_align_full('', 'AA').cost AS d, seq_align_seeded('ACTCGCT', 'AACTCGTT', 2, 15, true).cost AS e").first()
    assert tuple(presets) == (2, 2, 2)
    nulls = spark.sql("SELECT seq_align(a, 'A') AS c, seq_affine_cost(a, 'A') AS d, seq_search(a, 'A') AS e, seq_align_seeded('A', a, 1, 9, false).cost AS f, seq_model_align(a, 'A', 'unit').cost AS g, seq_distance(a, 'A') AS h, seq_model_cost('A', 'A', a) AS i FROM VALUES (cast(NULL AS STRING)), ('A') t(a) WHERE a IS NULL").first()
    assert nulls.c.cost is None and list(nulls)[1:] == [None] * 6
    for bad in ("seq_align_seeded('A', 'A', 3, 9, false)", "seq_align_seeded('A', 'A', 1, 0, false)", "seq_model_cost('A', 'A', 'other')"):
        with pytest.raises(PySparkException):
            spark.sql(f"SELECT {bad} AS x").collect()


def test_matching_moves_no_rows(spark, pairs):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for df in (S.matches(pairs, 4), S.matches(pairs, 4, 2), S.transformed(pairs, 4), S.seed_costs(pairs, 4), H.bound(pairs, "sh", 4, 1), H.bound(pairs, "csh", 4, 1), H.bound(pairs, "gcsh", 4, 2)):
        assert "Exchange" not in plan(df)
    assert plan(S.consistent(S.matches(pairs, 4, 2))).count("Exchange") == 1
    near = plan(similarity.near_pairs(pairs, 5))
    assert near.count("levenshtein") == 1


def test_matches_take_any_pair(spark):
    rows = [(None, "ACGTACGT", "ACGT"), (1, None, "ACGT"), (1, "ACGT", None), (2, "", ""), (3, "AC", "ACGTACGT"), (3, "ACGT" * 70_000, "ACGT"), (3, "ACGT" * 70_000, "ACGT")]
    p = spark.createDataFrame(rows, "id long, a string, b string").selectExpr("*", "1 AS start_i", "'x' AS n", "2 AS h")
    assert {(r.id, r.start_i) for r in S.matches(p, 4).where("id is null or id < 3").collect()} == {(None, 0), (None, 4)}
    assert S.matches(p, 4).where("id = 3").count() == 140_000
    assert sorted((r.id or 0, -1 if r.h is None else r.h) for r in H.bound(p, "sh", 4, 1).collect()) == [(0, 0), (1, -1), (1, -1), (2, 0), (3, 0), (3, 0), (3, 0)]
    assert S.matches(p.limit(0), 4).count() == 0
    with pytest.raises(PySparkException):
        S.matches(spark.createDataFrame([(1, "ACGU", "ACGT")], "id long, a string, b string"), 2).collect()


def test_presets_and_doubling_agree(spark, pairs):
    expected = {r.id: r.d for r in pairs.select("id", expr.distance("a", "b").alias("d")).collect()}
    for name in PRESETS:
        assert {r.id: r.cost for r in aligner(name, k=3).costs(pairs).collect()} == expected
    assert aligner("full").look_ahead == 14 and (aligner("default").k, aligner("default").r) == (15, 2)
    for bad in ({"r": 3}, {"k": 0}, {"width": 1}):
        with pytest.raises(ValueError):
            aligner("full", **bad)


def test_scan_reads_only_what_it_needs(spark):
    from seqloom import registry

    plan = registry.queries()["unit_distance"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint>" in plan and "Python" not in plan and "Exchange" not in plan


def test_write_costs(spark, tmp_path):
    df = spark.createDataFrame([(2, 1, "1X"), (1, 0, "1=")], "id long, cost int, cigar string")
    write_costs(df, str(tmp_path / "o"), ["id"])
    assert [r.value for r in spark.read.text(str(tmp_path / "o")).collect()] == ["0,1=", "1,1X"]


def test_cone_is_joined_by_keys(spark, capsys):
    """No product of seeds and windows, no range alone: pair, letters and bin are the join's keys."""
    from seqloom.operators import seeds as S

    p = spark.createDataFrame([(1, "ACGT" * 200, "ACGT" * 190)], "id long, a string, b string")
    found = S.matches_in_cone(p, 4)
    found.explain()
    plan = capsys.readouterr().out
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "SortMergeJoin [id" in plan.replace("BroadcastHashJoin [id", "SortMergeJoin [id").replace("ShuffledHashJoin [id", "SortMergeJoin [id")
    kept = S.target_filter(p, 4)
    assert found.select(*kept.columns).exceptAll(kept).count() == 0 == kept.exceptAll(found.select(*kept.columns)).count() and kept.count() > 1000


def test_metrics_come_with_the_rows(spark, pairs):
    """One pass: the sums are those of a query over the rows."""
    from seqloom.plans.reports import Observed, statistics

    seen = Observed(aligner().align(pairs), "test")
    rows = seen.rows.select("*", statistics("a", "b", "cost", "cigar").alias("s")).collect()
    got = seen.metrics()
    known = [r for r in rows if r.cost is not None]
    assert got["pairs"] == len(rows) and got["aligned"] == len(known)
    assert all(got[n] == sum(r.s[n] for r in known) for n in ("distance", "matches", "substitutions", "insertions", "deletions"))
    assert got["cells"] == sum(len(r.a.encode()) * 64 * -(-len(r.b.encode()) // 64) for r in known)


def test_explained_in_sql_takes_nulls(spark):
    from seqloom.plans import reports

    reports.register(spark)
    df = spark.createDataFrame([(1, "AC", "AG"), (2, None, "A"), (3, "", "")], "id long, a string, b string")
    rows = spark.sql("SELECT * FROM seq_explain(TABLE(SELECT id, a, b FROM {p}))", p=df).collect()
    assert sorted(map(tuple, rows)) == [(1, 0, 0, 0, 0, None), (1, 1, 1, 1, 0, "="), (1, 2, 2, 2, 1, "X"), (3, 0, 0, 0, 0, None)]


def test_pairs_as_a_data_source(spark, tmp_path):
    from seqloom.sources import datasource

    datasource.register(spark)
    root = tmp_path / "in"
    root.mkdir()
    (root / "x.txt").write_text("AC\n\nGG\nT\nodd\n")
    (root / "y.fa").write_text(">r1 one\nAC\nGT\n>r2\n\n>r3\nA\n>r4\nC\n>r5\nT\n")
    many = [("ACGT"[: k % 5] * (k % 7), "TT" * (k % 3)) for k in range(60)]
    (root / "z.seq").write_text("".join(f">{a}\n<{b}\n" for a, b in many))
    read = lambda path, **o: sorted((r.a, r.b) for r in spark.read.format("seqpairs").options(**o).load(str(path)).collect())
    assert read(root) == sorted([("AC", ""), ("GG", "T"), ("ACGT", ""), ("A", "C"), *many])
    for split in (9, 100):
        assert read(root / "z.seq", splitBytes=split) == sorted(many)
    rows = spark.read.format("seqpairs").option("splitBytes", 50).load(str(root / "z.seq")).orderBy("at").collect()
    assert [(r.a, r.b) for r in rows] == many
    assert read(root / "x.txt", kind="txt") == [("AC", ""), ("GG", "T")]
    (tmp_path / "w.xyz").write_text("A\nB\n")
    (tmp_path / "v.seq").write_text("A\n<B\n")
    for path, options in ((root / "x.txt", {"mode": "FAILFAST"}), (root / "x.txt", {"width": "3"}), (tmp_path / "w.xyz", {}), (tmp_path / "v.seq", {}), (root / "x.txt", {"mode": "other"})):
        with pytest.raises(Exception, match="partner|unknown|must start|mode is"):
            read(path, **options)
    out = tmp_path / "out"
    df = spark.createDataFrame(many, "a string, b string").repartition(3)
    df.write.format("seqpairs").mode("append").save(str(out))
    assert read(out) == sorted(many) and len(list(out.glob("part-*.seq"))) == 3
    df.limit(2).write.format("seqpairs").option("kind", "txt").mode("overwrite").save(str(out))
    assert len(read(out)) == 2
    query = spark.readStream.format("seqpairs").load(str(root)).select("a", "b").writeStream.format("memory").queryName("seq_in").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("seq_in").count() == 64


def test_parameters_change_the_plan_and_no_cost(spark, pairs):
    """Lower bounds from seeds are functions in the plan, with or without a bound, and where scripts are asked for."""

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    calls = lambda df: plan(df).count("ArrowEvalPython")
    plain, full = aligner("nw"), aligner("full", k=3)
    assert calls(plain.costs(pairs)) == 0 < calls(full.costs(pairs)) and calls(aligner("default", k=3, r=1).costs(pairs)) > 0
    assert calls(aligner("full", k=3, bound=4).costs(pairs)) > 0 == calls(aligner("nw", bound=4).costs(pairs))
    assert calls(aligner("full", k=3, bound=4).align(pairs)) > calls(aligner("nw", bound=4).align(pairs))
    assert "levenshtein" in plan(aligner("simple").costs(pairs)) and calls(aligner("simple").costs(pairs)) == 0
    expected = {r.id: r.cost for r in plain.costs(pairs).collect()}
    for k, r, look in ((3, 1, 0), (5, 2, 0), (3, 1, 2)):
        for name in ("default", "full", "chained"):
            own = aligner(name, k=k, r=r, look_ahead=look)
            assert {x.id: x.cost for x in own.costs(pairs).collect()} == expected
    twice = pairs.unionByName(pairs).unionByName(pairs.selectExpr("CAST(NULL AS BIGINT) AS id", "a", "b"))
    assert aligner("chained", k=3, bound=9).costs(twice).count() == twice.count()
    near = {(r.id, r.cost) for r in aligner("chained", k=3, bound=4).costs(twice).collect() if r.id is not None}
    assert near == {(k, c if c is not None and c <= 4 else None) for k, c in expected.items()}
