"""Plans and kernels whose work must grow no faster than the tables."""

import random

import numpy as np
import pyarrow as pa
import pytest

from seqloom import registry
from seqloom.functions import align as A
from seqloom.functions import cost_model, wavefront
from seqloom.functions import kernels as K
from seqloom.operators import heuristics as H
from seqloom.operators import seeds as S
from seqloom.plans.aligner import aligner
from seqloom.sources.pairs import read_pairs

TINY = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_long_pairs_are_dealt_to_all_tasks(spark):
    """a small file of keys has one row group."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert registry.long_pairs(spark, TINY).rdd.getNumPartitions() == registry.very_long_pairs(spark, TINY).rdd.getNumPartitions() == parts


def test_presets_score_by_the_kernel(spark):
    """F1"""
    p = registry.long_pairs(spark, TINY)
    assert all("levenshtein" not in plan(aligner(x).costs(p)) for x in ("nw", "simple", "full", "default"))


def test_cone_is_not_broadcast(spark):
    """F3"""
    assert "Broadcast" not in plan(S.matches_in_cone(registry.pairs(spark, TINY), 4))


def test_path_filter_joins_nothing(spark):
    """F4"""
    found = plan(H.kept_by_path(registry.pairs(spark, TINY), 4))
    assert "Join" not in found and "Exchange" not in found


def test_closure_where_the_pair_is(spark):
    """F12"""
    p = registry.pairs(spark, TINY)
    own = S.consistent_matches(p, 5)
    assert "Exchange" not in plan(own)
    assert sorted(own.collect()) == sorted(S.consistent(S.matches(p, 5, 2)).select(own.columns).collect())


@pytest.mark.parametrize("kind", ["txt", "seq"])
def test_lines_are_numbered_without_a_sort(spark, tmp_path, kind):
    """pairs cut by block ends, in many blocks."""
    rows = [("A" * (n % 7), "C" * (n % 11)) for n in range(300)]
    for f in range(2):
        text = "".join(f">{a}\n<{b}\n" if kind == "seq" else f"{a}\n{b}\n" for a, b in rows[f:])
        (tmp_path / f"x{f}.{kind}").write_text(text)
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "97b")
        spark.conf.set("spark.sql.files.openCostInBytes", "0b")
        df = read_pairs(spark, str(tmp_path))
        assert "row_number" not in plan(df)
        got = sorted((r.file[-5:], r.pair, r.a, r.b) for r in df.collect())
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert got == sorted((f"{f}.{kind}", n, *x) for f in range(2) for n, x in enumerate(rows[f:]))


def test_one_edit_between_words():
    """F9, F16: against all words that an edit makes."""
    rng, letters = random.Random(2), "ACTG"
    code = lambda w: int("".join(str(letters.index(c)) for c in w), 4)
    for k in (4, 5, 15, 30):
        x = "".join(rng.choice(letters) for _ in range(k))
        near = {k: {x[:p] + c + x[p + 1 :] for p in range(k) for c in letters}, k - 1: {x[:p] + x[p + 1 :] for p in range(k)}, k + 1: {x[:p] + c + x[p:] for p in range(k + 1) for c in letters}}
        for length, words in near.items():
            words = sorted(words | {"".join(rng.choice(letters) for _ in range(length)) for _ in range(50)} | {w[:-1] + rng.choice(letters) for w in words})
            found = K._edits(np.full(len(words), code(x)), k, np.array([code(w) for w in words]), length)
            assert [f < 2 for f in found] == [w in near[length] for w in words]


def test_pruning_follows_a_match_to_the_next_one_only(monkeypatch):
    """F1 of round 3: matches of one diagonal were each followed through their whole window."""
    looked, own = [], K.potential
    monkeypatch.setattr(K, "potential", lambda n, i, k, r: looked.append(len(i)) or own(n, i, k, r))
    a = "".join(random.Random(3).choices("ACGT", k=1200)).encode()
    found = K.batch_matches([a], [a], 12, 1)
    assert len(K.locally_pruned([a], [a], found, 12, 1, 14)["row"]) == len(found["row"]) >= 100
    assert sum(looked) < 8 * len(found["row"])


def test_first_bounds_are_tried_without_seeds():
    """F1 of round 3: lower bounds from seeds were computed for all pairs."""
    a, b = [b"A" * 100, b"A" * 100], [b"A" * 90, b"C" * 100]
    assert K.doubled(a, b, np.array([10, 0]), 8, range(4)).tolist() == [10, -1]
    assert K.doubled(a, b, np.array([10, 90]), 8, range(4, 7)).tolist() == [10, 100]


def test_searches_hold_some_rows_at_a_time(monkeypatch):
    """F7, F8, F10, F11, F14, F17 of round 3: a batch's results were Python objects, pair by pair."""
    rows, own = [], K.search_costs
    monkeypatch.setattr(K, "search_costs", lambda *x: rows.append(len(x[1])) or own(*x))
    letters = random.Random(5)
    texts = ["".join(letters.choices("ACGT", k=k % 40)) for k in range(5000)]
    patterns = [None if k % 7 == 0 else "ACNY"[: k % 5] for k in range(5000)]
    found = A._searches(pa.array(patterns), pa.array(texts), 0.5)
    assert max(rows) <= A.SOME and found.type == pa.list_(pa.int32())
    assert found.to_pylist()[:300] == [None if p is None else K.search(p, t, 0.5) for p, t in zip(patterns[:300], texts[:300], strict=True)]


def test_pairs_of_a_search_share_its_work(monkeypatch):
    """A grid holds as many pairs as its cells and costs allow, and gives what it gives of each pair alone."""
    grids, own = [], K._searched
    monkeypatch.setattr(K, "_searched", lambda *x: grids.append(len(x[2])) or own(*x))
    pairs = [("ACGTN"[: k % 6], "ACGGT" * (k % 4), k % 2 > 0) for k in range(600)]
    whole = K.searches([p for p, _, _ in pairs], [t for _, t, _ in pairs], 0.5, [i for _, _, i in pairs])
    assert len(grids) == 6
    monkeypatch.setattr(K, "SEARCHED_COSTS", 100)
    few = K.searches([p for p, _, _ in pairs], [t for _, t, _ in pairs], 0.5, [i for _, _, i in pairs])
    assert len(grids) > 12 and all((x == y).all() for x, y in zip(whole, few, strict=True))


def test_pairs_read_again_are_grouped_in_parts_by_size(spark, tmp_path):
    """F13, F15 of round 3: the number of parts was fixed, so a task's share grew with the input."""
    path = str(tmp_path / "lines")
    spark.range(4000).selectExpr("concat('line ', id % 2000) AS value").coalesce(1).write.text(path)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 5000)
        found = registry._counted(spark.read.text(path), path, "value")
        assert found.rdd.getNumPartitions() >= 8 * 8
        assert {r.n for r in found.collect()} == {2} and found.count() == 2000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_a_large_gap_is_traced_with_the_others(monkeypatch):
    """F6 of round 3: pairs of 5,000 letters with a large gap cost some 370, and were cut and solved again one by one."""
    cut = []
    monkeypatch.setattr(wavefront, "_cut", lambda *x: cut.append(x))
    a = "".join(random.Random(7).choices("ACGT", k=5000))
    b = a[:900] + "ACGTTTGACA" * 30 + a[1399:]
    cost, script = wavefront.affine_align(a.encode(), b.encode(), cost_model.affine(1, 2, 1))
    assert not cut and 256 < cost == sum({"O": 2, "X": 1, "I": 1, "D": 1}.get(op, 0) * n for op, _, n in script)


def _known_pairs():
    r = random.Random(9)
    a = ["".join(r.choices("ACGT", k=n % 90)).encode() for n in range(120)]
    b = [bytes(r.choice(b"ACGT") if r.random() < 0.1 else c for c in x)[n % 3 :] for n, x in enumerate(a)]
    return a, b


@pytest.mark.parametrize("k, seeds", [(1, 2), (3, 2), (4, 1), (5, 2), (15, 2)])
def test_short_sides_are_matched_bit_by_bit(monkeypatch, k, seeds):
    """F16: windows and seeds of all pairs were sorted and joined, whatever their length."""
    a, b = _known_pairs()
    found = []
    for near in (512, 40, -1):  # all, some and no pairs bit by bit
        joined, own = [], K._by_codes
        monkeypatch.setattr(K, "NEAR", near)
        monkeypatch.setattr(K, "WORDS", 50)
        monkeypatch.setattr(K, "_by_codes", lambda *x, own=own, joined=joined: joined.append(len(x[0])) or own(*x))
        found.append(K.batch_matches(a, b, k, seeds))
        monkeypatch.setattr(K, "_by_codes", own)
        assert bool(joined) == (near < 512)
    rows = [np.stack(list(x.values())) for x in found]
    assert rows[0].shape[1] > 100 and all(x.shape == rows[0].shape and (x == rows[0]).all() for x in rows)


def test_seed_costs_sort_no_matches(monkeypatch):
    """F16: matches were sorted and told apart only to find each seed's least cost."""
    a, b = _known_pairs()
    expected = S.least_costs(a, K.batch_matches(a, b, 5, 2), 5, 2)
    monkeypatch.delattr(K, "_ordered")
    found = K.seed_costs(a, b, 5, 2)
    assert all((found[c] == x).all() for c, x in zip(("row", "start_i", "match_cost"), expected, strict=True)) and set(expected[2]) == {0, 1, 2}


def test_numbers_too_large_to_sort_as_one():
    high, low = np.array([1 << 40, 1, 1 << 40, 1]), np.array([5, 1 << 30, 3, 2])
    assert [x.tolist() for x in K._ordered(high, low)] == [[1, 1, 1 << 40, 1 << 40], [2, 1 << 30, 3, 5]]


def test_few_matches_are_compared_not_swept(monkeypatch):
    """every start and end of a match was a step of its own."""
    a, b = _known_pairs()
    found = K.batch_matches(a, b, 5, 2)
    at = np.arange(len(a)), *np.zeros((2, len(a)), np.int64)
    swept, own = [], K._swept
    monkeypatch.setattr(K, "_swept", lambda *x: swept.append(x[0]) or own(*x))
    got = {}
    for few in (1 << 20, 20, 0):
        monkeypatch.setattr(K, "FEW", few)
        got[few] = [H._OF[kind](a, b, found, 5, 2, at, whole=True).tolist() for kind in ("csh", "gcsh")]
        assert bool(swept) == (few < 1 << 20)
    assert got[1 << 20] == got[20] == got[0]
    monkeypatch.setattr(K, "FEW", 1 << 20)
    far = 1 << 33  # coordinates that 32 bits don't hold
    assert K.chains(1, np.array([0, 0]), (np.array([far, 2]),) * 2, (np.array([far + 2, 4]),) * 2, np.array([2, 1]), np.array([0, 0, 0]), (np.array([0, 3, far + 1]),) * 2).tolist() == [3, 2, 0]
