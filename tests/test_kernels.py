import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqloom.functions import cost_model as C
from seqloom.functions import kernels as K
from seqloom.functions import wavefront as V

MODELS = [
    C.lcs(),
    C.unit(),
    C.linear(1, 2),
    C.linear(1, 3),
    C.linear_asymmetric(1, 2, 3),
    C.affine(1, 2, 1),
    C.linear_affine(1, 3, 2, 1),
    C.double_affine(1, 4, 2, 10, 1),
    C.affine_asymmetric(1, 2, 2, 3, 1),
    C.CostModel("del layer", 1, 1, None, (C.Layer("del", 2, 2),)),
    C.CostModel("ins layer", 1, None, 1, (C.Layer("ins", 2, 2),)),
]
DNA = st.text("ACGT", max_size=24).map(str.encode)


def plain_cost(a, b, m):
    """Cell by cell."""
    big = 10**9
    main = [[big] * (len(b) + 1) for _ in range(len(a) + 1)]
    gaps = [[[big] * (len(b) + 1) for _ in range(len(a) + 1)] for _ in m.layers]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            best = 0 if i == j == 0 else big
            for g, x in enumerate(m.layers):
                pi, pj = (i, j - 1) if x.kind == "ins" else (i - 1, j)
                if pi >= 0 and pj >= 0:
                    gaps[g][i][j] = min(main[pi][pj] + x.open, gaps[g][pi][pj]) + x.extend
                best = min(best, gaps[g][i][j])
            if i and j:
                best = min(best, main[i - 1][j - 1] + (0 if a[i - 1] == b[j - 1] else big if m.sub is None else m.sub))
            if j and m.ins is not None:
                best = min(best, main[i][j - 1] + m.ins)
            if i and m.dele is not None:
                best = min(best, main[i - 1][j] + m.dele)
            main[i][j] = best
    return main[-1][-1]


def script_cost(a, b, m, script):
    i = j = total = 0
    layer = -1
    for op, at, n in script:
        if op == "O":
            assert layer == -1
            layer, total = at, total + m.layers[at].open
        elif op == "C":
            assert layer == at
            layer = -1
        elif op in "ID":
            assert layer == at
            total += n * (m.layers[at].extend if at >= 0 else m.ins if op == "I" else m.dele)
            i, j = (i, j + n) if op == "I" else (i + n, j)
        else:
            for _ in range(n):
                assert (a[i] == b[j]) == (op == "=")
                total += 0 if op == "=" else m.sub
                i, j = i + 1, j + 1
    assert (i, j, layer) == (len(a), len(b), -1)
    return total


@settings(max_examples=40, deadline=None)
@given(DNA, DNA, st.sampled_from(MODELS))
def test_costs_and_scripts(a, b, m):
    cost = plain_cost(a, b, m)
    assert V.distances([a], [b], m).tolist() == [cost]
    found, script = V.affine_align(a, b, m)
    assert found == cost == script_cost(a, b, m, script)
    if m.is_unit:
        found, script = K.align(a, b)
        assert K.distance(a, b) == found == cost == script_cost(a, b, m, [(o, -1, n) for o, n in script])


def test_known_pairs():
    # Pairs with their distances.
    known = [
        ("TTGGGTCAATCAGCCAGTTTTTA", "TTTGAGTGGGTCATCACCGATTTTAT", 10),
        ("ACTGACCAGT", "CCGACAGGA", 5),
        ("AGTTTTAT", "ACCGATTTTTA", 5),
        ("CTCTCTTCTCTCTCTA", "CCTCTCTCTCTCCTCTC", 4),
        ("AGTGGGTTGCCTTCATTCCG", "AGTGGTGTCTTCAGGCCTTCATTCCG", 6),
        ("GCACGTCGCCCCCCGCCCGCG", "GCCCGCCCGCCCGCCCCCGCCCCC", 8),
        ("ACTCGCT", "AACTCGTT", 2),
        ("TCTCTCTCTCTG", "GTCTCTCTTCTG", 2),
    ]
    for a, b, d in known:
        assert K.distance(a.encode(), b.encode()) == d


def test_long_pairs_against_duckdb():
    import duckdb

    random.seed(1)
    for n, e in ((255, 0.1), (256, 0.5), (257, 1.0), (512, 0.05), (3000, 0.2)):
        a = "".join(random.choice("ACGT") for _ in range(n))
        b = "".join(random.choice(["", "ACGT"[random.randrange(4)], c + "A"]) if random.random() < e else c for c in a)
        assert K.align(a.encode(), b.encode())[0] == duckdb.execute("SELECT levenshtein(?, ?)", [a, b]).fetchone()[0]


def test_search():
    assert K.search("AC", "CTTACTTA", 0) == [0, 0, 1, 2, 1, 0, 1, 2, 1, 0, 0]
    assert K.search("CT", "ACTG", 1) == [2, 2, 1, 0, 1, 2, 2]
    assert K.search("NRY*", "ACGT", 0)[4] == 1
    assert K.search("", "ACGT") == [0] * 5
    assert K.search("ACG", "", 1.0) == [3, 3, 3, 3]
    with pytest.raises(ValueError):
        K.search("AZ", "ACGT")
    with pytest.raises(ValueError):
        K.search("A", "AN")


@settings(max_examples=40, deadline=None)
@given(st.text("ACGTNYR", min_size=1, max_size=8), st.text("ACGT", max_size=12))
def test_search_trace_has_the_cost(pattern, text):
    costs = K.search(pattern, text, 0.0)
    for index, cost in enumerate(costs[: len(text) + 1]):
        i, j, script = K.search_trace(pattern, text, index, 0.0)
        assert sum(n for op, n in script if op != "=") + 0 * j == cost
        assert i + sum(n for op, n in script if op in "=XD") == index


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 8)] * 2, *[st.integers(1, 3)] * 2, st.integers(1, 3), st.integers(0, 2)), max_size=14), st.lists(st.tuples(st.integers(0, 2), *[st.integers(0, 12)] * 2), max_size=6))
def test_chains_from_places(matches, places):
    def best(pair, i, j):
        return max([0, *(w + best(pair, si + di, sj + dj) for si, sj, di, dj, w, x in matches if x == pair and si >= i and sj >= j)])

    x, at = np.array(matches, np.int64).reshape(-1, 6), np.array(places, np.int64).reshape(-1, 3)
    for layers in (1 << 21, 4):
        before, K.LAYERS = K.LAYERS, layers
        try:
            got = K.chains(3, x[:, 5], (x[:, 0], x[:, 1]), (x[:, 0] + x[:, 2], x[:, 1] + x[:, 3]), x[:, 4], at[:, 0], (at[:, 1], at[:, 2]))
        finally:
            K.LAYERS = before
        assert got.tolist() == [best(*p) for p in places]


def test_models():
    m = C.named("affine(1, 2, 1)")
    assert m == C.affine(1, 2, 1) and m.gap_cost(3) == 5 and m.gap_cost(-1) == 3 and m.gap_cost(0) == 0 and m.extend_cost(-4) == 4
    assert m.most_for_cost("ins", 5) == 3 and m.most_for_cost("ins", 1) == 0 and m.most_for_cost("del", 5, opened=True) == 5
    assert C.from_parts(1, 0, 2) == C.linear(1, 2) and C.from_parts(1, 2, 1) == C.affine(1, 2, 1)
    for bad in ("affine(1,0,1)", "nothing(1)", "linear(0,1)"):
        with pytest.raises(ValueError):
            C.named(bad)


CUT_MODELS = (C.lcs(), C.affine(1, 2, 1), C.linear_affine(1, 3, 2, 1), C.double_affine(1, 4, 2, 10, 1), C.affine_asymmetric(1, 2, 2, 3, 1), C.CostModel("one side", 1, 1, None, (C.Layer("del", 2, 2),)), C.CostModel("none", 1, 1, None))


@settings(max_examples=50, deadline=None)
@given(st.text("ACGT", max_size=40).map(str.encode), st.text("ACGT", max_size=40).map(str.encode), st.integers(0, 60))
def test_bounds_and_cuts_change_no_cost(a, b, bound):
    for model in CUT_MODELS:
        whole = min(plain_cost(a, b, model), C.FORBIDDEN)
        within = whole if whole <= bound else C.FORBIDDEN
        assert V.distances([a, b, a], [b, a, b], model, bound).tolist()[::2] == [within, within]
        for traced in (256, 6):
            before, V.TRACED = V.TRACED, traced
            try:
                cost, script = V.affine_align(a, b, model)
                assert (cost if cost is not None else C.FORBIDDEN) == whole and (cost is None or script_cost(a, b, model, script) == whole)
                assert V.affine_align(a, b, model, bound)[0] == (whole if whole <= bound else None)
            finally:
                V.TRACED = before


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("ACGT", max_size=140).map(str.encode), st.text("ACGT", max_size=140).map(str.encode)), max_size=6))
def test_scripts_together_and_alone(pairs):
    """Walking back over the whole grid, a match comes first, then I, D, X; at any size, alone or with others."""

    def plain(a, b):
        grid = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                grid[i][j] = min(grid[i - 1][j] + 1, grid[i][j - 1] + 1, grid[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        i, j, script = len(a), len(b), []
        while i or j:
            if i and j and a[i - 1] == b[j - 1]:
                op, i, j = "=", i - 1, j - 1
            elif j and grid[i][j] == grid[i][j - 1] + 1:
                op, j = "I", j - 1
            elif i and grid[i][j] == grid[i - 1][j] + 1:
                op, i = "D", i - 1
            else:
                op, i, j = "X", i - 1, j - 1
            K.pushed(script, op)
        return grid[-1][-1], script[::-1]

    a, b = [x for x, _ in pairs], [y for _, y in pairs]
    expected = [plain(x, y) for x, y in pairs]
    for most in (512, 70, -1):
        before, K.TOGETHER = K.TOGETHER, most
        try:
            found = K.aligns(a, b)
        finally:
            K.TOGETHER = before
        assert [(int(found.cost[k]), found.script(k)) for k in range(len(pairs))] == expected


def _long_pair(n, e, r):
    a = bytes(r.choice(b"ACGT") for _ in range(n))
    b = bytearray()
    for c in a:
        x = r.random()
        b += b"" if x < e / 3 else bytes([c, r.choice(b"ACGT")]) if x < 2 * e / 3 else bytes([r.choice(b"ACGT") if x < e else c])
    return a, bytes(b)


def test_long_pairs():
    """20,000 letters at 5 % with unit costs, and under affine models 20,000 at 5 % and 3,000 at 20 %, in bounded memory."""
    import tracemalloc

    r = random.Random(1)
    a, b = _long_pair(20_000, 0.05, r)
    cost, script = K.align(a, b)
    assert cost == K.distance(a, b) == script_cost(a, b, C.unit(), [(o, -1, n) for o, n in script])
    for model, (x, y) in ((C.affine(1, 2, 1), (a, b)), (C.double_affine(1, 4, 2, 10, 1), _long_pair(3000, 0.2, r))):
        tracemalloc.start()
        cost, script = V.affine_align(x, y, model)
        assert tracemalloc.get_traced_memory()[1] < 40 << 20
        tracemalloc.stop()
        assert cost == int(V.distances([x], [y], model)[0]) == script_cost(x, y, model, script)


def test_local_pruning_by_definition():
    """Whole grids of costs, match by match from the last start on."""
    r = random.Random(4)
    k = 4
    dropped = 0
    for trial in range(60):
        seeds = 1 + trial % 2
        a = "".join(r.choice("ACGT") for _ in range(r.randrange(0, 44))).encode()
        b = bytes(r.choice(b"ACGT") if r.random() < 0.2 else c for c in a)[r.randrange(4) :] + b"ACGT"[: r.randrange(4)]
        others = [(b"ACGTACGTTGCA", b"ACGTTGCAACGT"), (b"", b"ACG")]
        found = K.batch_matches([others[0][0], a, others[1][0]], [others[0][1], b, others[1][1]], k, seeds)
        look = r.choice([1, 2, 4, 20])
        kept = K.locally_pruned([others[0][0], a, others[1][0]], [others[0][1], b, others[1][1]], found, k, seeds, look)
        rows = lambda x: sorted(zip(*(x[c][x["row"] == 1].tolist() for c in ("start_i", "start_j", "end_i", "end_j", "match_cost")), strict=True))
        p = lambda i: seeds * max(0, len(a) // k - -(-i // k))
        expected = []
        for si, sj, ei, ej, c in reversed(rows(found)):
            stop = min(si // k + look, len(a) // k) * k
            cost = {(ei, ej): c}
            for i in range(ei, stop + 1):
                for j in range(ej, len(b) + 1):
                    ways = [cost[x, y] + w for x, y, w in ((i - 1, j - 1, a[i - 1] != b[j - 1] if j else 1), (i - 1, j, 1), (i, j - 1, 1)) if (x, y) in cost]
                    cost[i, j] = min(ways, default=cost.get((i, j)))
            there = {(x[0], x[1]) for x in expected}
            if any(g < p(si) - p(i) for (i, j), g in cost.items() if i == stop or (i, j) in there):
                expected.append((si, sj, ei, ej, c))
        assert rows(kept) == sorted(expected)
        dropped += len(rows(found)) - len(expected)
    assert dropped > 20
    before, K.AHEAD = K.AHEAD, 40
    try:
        again = K.locally_pruned([a], [b], K.batch_matches([a], [b], k, seeds), k, seeds, look)
    finally:
        K.AHEAD = before
    assert rows(again | {"row": again["row"] + 1}) == rows(kept)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("ACGT", max_size=30).map(str.encode), st.text("ACG", max_size=40).map(str.encode)), max_size=5), st.integers(0, 4))
def test_grown_seeds_by_definition(pairs, most):
    seeds, matches = K.grown_seeds([a for a, _ in pairs], [b for _, b in pairs], most)
    expected, hits = [], []
    for row, (a, b) in enumerate(pairs):
        end = len(a)
        for i in reversed(range(len(a))):
            s = a[i:end]
            places = [j for j in range(len(b) - len(s) + 1) if b[j : j + len(s)] == s]
            if len(places) <= most:
                expected.append((row, i, end, len(places)))
                hits += [(row, i, j, end, j + len(s)) for j in places]
                end = i
    assert sorted(zip(*(x.tolist() for x in seeds.values()), strict=True)) == sorted(expected)
    assert list(zip(*(x.tolist() for x in matches.values()), strict=True)) == sorted(hits)


@settings(max_examples=60, deadline=None)
@given(st.text("ACGTNYR", min_size=1, max_size=6), st.text("ACGT", min_size=1, max_size=60), st.sampled_from([0.0, 0.5, 1.0]), st.integers(1, 9))
def test_blocks_have_the_costs_of_the_text(pattern, text, u, block):
    whole = K.search(pattern, text, u)
    for first in range(0, len(text), block):
        before = max(0, first - 2 * len(pattern))
        part = text[before : first + block]
        got = K.searches([pattern], [part], u, [before > 0])[0].tolist()
        own = got[first - before : len(part) + 1]
        assert own == whole[first : first + len(own)]
    assert got[len(part) + 1 :] == whole[len(text) + 1 :]


@settings(max_examples=60, deadline=None)
@given(st.text("ACGTNYR", min_size=1, max_size=5), st.text("ACGT", max_size=40), st.sampled_from([0.0, 0.5, 1.0]))
def test_traces_look_at_what_a_match_can_span(pattern, text, u):
    """The same script as from the grid of the whole text."""
    rows, sets = K._search_rows(pattern, text, u), K._letters(pattern)
    for index in range(len(text) + len(pattern) + 1):
        i, j = K.index_position(index, len(pattern), len(text))
        script = []
        while i and j:
            if text[i - 1] in sets[j - 1] and rows[i - 1, j - 1] == rows[i, j]:
                op, i, j = "=", i - 1, j - 1
            elif rows[i - 1, j] + 1 == rows[i, j]:
                op, i = "D", i - 1
            elif rows[i, j - 1] + 1 == rows[i, j]:
                op, j = "I", j - 1
            else:
                op, i, j = "X", i - 1, j - 1
            K.pushed(script, op)
        assert K.search_trace(pattern, text, index, u) == (i, j, script[::-1])


@pytest.mark.parametrize("bound", [None, 0, 1, 5, 63, 64, 65, 130])
def test_distances_of_many_pairs(bound):
    """Lengths around words' ends, letters that only one side has, ends inside and outside the band."""
    random, a, b = np.random.default_rng(5), [], []
    for n in (0, 1, 2, 63, 64, 65, 127, 128, 129, 200, 300):
        for m in (0, 1, 62, 64, 66, 128, 130, 190, 257, 300):
            x = bytes(random.choice(list(b"ACGT"), n).tolist())
            a.append(x)
            b.append((x + bytes(random.choice(list(b"ACGTN"), m).tolist()))[:m])
            a.append(x)
            b.append(b"".join(x[s : s + 1] if random.random() > 0.1 else b"AC" for s in range(n)))
    expected = [K.distance(x, y) for x, y in zip(a, b, strict=True)]
    found = K.distances(a, b, bound).tolist()
    assert bound is None or any(x <= bound for x in expected) and any(x > bound for x in expected)
    assert [x if bound is None or x <= bound else -1 for x in found] == [x if bound is None or x <= bound else -1 for x in expected]
    assert K.doubled(a, b, np.array([abs(len(x) - len(y)) for x, y in zip(a, b, strict=True)]), 2).tolist() == expected


def test_distances_of_no_pairs():
    assert K.distances([], []).tolist() == [] and K.doubled([], [], np.zeros(0, int), 8).tolist() == []
