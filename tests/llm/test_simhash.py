import random

import numpy as np
import xxhash

import corpus_pipeline
from seqloom.llm import simhash as S
from seqloom.llm.components import components


def plain(text):
    """Bit by bit."""
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


TEXTS = [None, "", " \t\n", "one", "One two", "ONE two three", "one two\x1cthree", "É a b c d", "é a b c d", "a " * 500]


def test_fingerprints_equal_definition(spark):
    r = random.Random(0)
    texts = TEXTS + [" ".join(r.choice(["x", "y", "Zed", "ü"]) for _ in range(r.randint(0, 40))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS first_id")
    got = {r.doc_id: r.fp % 2**64 for r in S.fingerprints(df).collect()}
    assert got == {k: plain(t) for k, t in enumerate(texts)}


def near_group(seed, n=300):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    flip = lambda x: x ^ (np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64))
    return np.unique(np.concatenate([flip(flip(base)) for _ in range(n // 12)]))


def all_pairs(fp, radius=3):
    return [(int(a), int(b)) for a, b in np.argwhere(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius) if a < b]


def test_tiles_join_what_the_radius_joins(monkeypatch):
    monkeypatch.setattr(S, "TILE", 16)
    fp = near_group(1)
    u, v = S.linked_in(fp, 3)
    index = {x: k for k, x in enumerate(fp.tolist())}
    assert len(u) < len(fp)
    assert classes([(index[a], index[b]) for a, b in zip(u.tolist(), v.tolist(), strict=True)], range(len(fp))) == classes(all_pairs(fp), range(len(fp)))


def test_block_masks_find_every_link():
    for n in (10, 10**6, 10**9, 10**11):
        masks = S.block_masks(n, 3)
        r = random.Random(n)
        for _ in range(300):
            x = 0
            for b in r.sample(range(64), 3):
                x |= 1 << b
            assert any(x & m == 0 for m in masks)


def test_links_and_classes(spark):
    fp = near_group(2, 400)
    signed = fp.view(np.int64)
    df = spark.createDataFrame([(int(x),) for x in signed], "fp long")
    index = {int(x): k for k, x in enumerate(signed)}
    expected = classes(all_pairs(fp), range(len(fp)))
    links = S.links(df)
    assert classes([(index[r.u], index[r.v]) for r in links.collect()], range(len(fp))) == expected
    found = {index[r.node]: index[r.root] for r in components(links).collect()}
    groups = lambda m: sorted(sorted(k for k in range(len(fp)) if m.get(k, k) == v) for v in set(m.get(k, k) for k in range(len(fp))))
    assert groups(found) == groups(expected)


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(300)] + [(5000, 5000), (7, 6)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(201)}, **{1000 + k: 1000 for k in range(300)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates(spark):
    r = random.Random(5)
    base = [" ".join(f"w{r.randrange(10**6)}" for _ in range(120)) for _ in range(8)]
    texts = [b if r.random() < 0.5 else b + " tail" for b in base * 6] + TEXTS
    rows = [(len(texts) - k, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[:5], "doc_id long, text string").repartition(4)
    fp = np.array([plain(t) for _, t in rows], np.uint64)
    own = classes(all_pairs(fp), range(len(rows)))
    expected = {rows[k][0]: min(rows[j][0] for j in own if own[j] == own[k]) for k in own}
    got = S.near_duplicates(df).collect()
    assert len(got) == len(rows) + 5 and all(expected[r.doc_id] == r.component_id for r in got)
    full = df.selectExpr("*", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    kept = S.stage(spark, full, "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(expected.values()))
    assert S.stage(spark, full.limit(0), "").count() == 0


def test_query_equals_brute_force(spark):
    rows = S.op9(spark, "/root/testdata/sf0.001").collect()
    ids = [r.doc_id for r in rows]
    fp = np.array([int(r.fingerprint, 16) for r in rows], np.uint64)
    own = classes(all_pairs(fp), range(len(rows)))
    assert all(r.component_id == min(ids[j] for j in own if own[j] == own[k]) for k, r in enumerate(rows))


def jaccard(a, b):
    def own(text):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()

    a, b = own(a), own(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def similar_by_brute_force(texts):
    return [(x, y) for y in range(len(texts)) for x in range(y) if jaccard(texts[x], texts[y]) >= 0.8]


def edited(r, words, n):
    words = list(words)
    for k in r.sample(range(len(words)), n):
        words[k] = f"new{r.randrange(10**6)}"
    return words


def near_copies(seed):
    """Near copies of similarity about 0.7 to 0.95, short ones too, most of which differ in more than 3 bits."""
    r = random.Random(seed)
    texts = list(TEXTS)
    for n in (5, 8, 30, 120, 120, 300):
        base = [f"w{r.randrange(10**6)}" for _ in range(n)]
        texts += [" ".join(edited(r, base, r.randint(0, max(1, n // 45)))) for _ in range(6)] + [" ".join(base[: n - n // 8]), " ".join(base[: n - n // 4])]
    r.shuffle(texts)
    return texts


def test_stage_keeps_one_of_near_copies_by_brute_force_jaccard(spark, monkeypatch):
    texts = near_copies(3)
    own = classes(similar_by_brute_force(texts), range(len(texts)))
    fp = np.array([plain(t) for t in texts], np.uint64)
    assert sorted(set(classes(all_pairs(fp), range(len(texts))).values())) != sorted(set(own.values()))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' AS key", "2 AS node").repartition(3)
    stage = dict(corpus_pipeline.STAGES)["SimHash near-dedup"]
    for common in (20, 4):  # the second: more shingles are common
        monkeypatch.setattr(S, "COMMON", common)
        kept = stage(spark, df, "")
        assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(own.values()))


def test_forest_joins_what_close_pairs_join(monkeypatch):
    monkeypatch.setattr(S, "TILE", 16)
    fp = near_group(4)
    rows = np.zeros(len(fp), [("fp", np.uint64), ("size", np.int32)])
    rows["fp"], rows["size"] = fp, np.sort(np.random.default_rng(4).integers(50, 90, len(fp)))
    fits = [(a, b) for a, b in all_pairs(fp, 6) if 5 * rows["size"][a] >= 4 * rows["size"][b]]
    assert sorted((int(a), int(b)) for x, y in S.close_pairs(rows, 6) for a, b in zip(x, y, strict=True)) == fits
    x, y = S.forest(rows, 6)
    assert len(x) < len(rows) and classes(zip(x.tolist(), y.tolist(), strict=True), range(len(fp))) == classes(fits, range(len(fp)))


def test_stage_decides_by_row_not_by_id(spark):
    say = lambda k, n=40: " ".join(f"w{k}x{j}" for j in range(n))
    rows = [(None, say(0)), (None, say(1)), (None, say(1)), (1, say(2)), (1, say(3)), (2, say(3)), (3, say(3)), (4, say(1)), (5, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for stage in (S.near_copy_stage, S.stage):
        got = sorted(map(tuple, stage(spark, df, "").collect()), key=str)
        assert got == sorted([(None, say(0)), (4, say(1)), (1, say(2)), (1, say(3)), (5, None)], key=str)


def test_long_texts_null_ids_and_ties(spark):
    r = random.Random(9)
    long = " ".join(f"W{r.randrange(5000)}" for _ in range(20_000))
    rows = [(None, "a b c d"), (None, "a b c d"), (None, long), (7, long), (9, long + " tail"), (3, None), (4, ""), (4, "  ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "'x' AS component_id").repartition(3)
    got = sorted((-1 if x.doc_id is None else x.doc_id, x.fp, -1 if x.component_id is None else x.component_id) for x in S.near_duplicates(df).collect())
    signed = lambda t: int(np.array([plain(t)], np.uint64).view(np.int64)[0])
    assert signed(long) == signed(long + " tail") or bin(plain(long) ^ plain(long + " tail")).count("1") <= 3
    expected = [(-1, signed("a b c d"), -1)] * 2 + [(-1, signed(long), 7), (7, signed(long), 7), (9, signed(long + " tail"), 7), (3, 0, 3), (4, 0, 3), (4, 0, 3)]
    assert got == sorted(expected)
    assert S.near_duplicates(df.limit(0)).count() == 0


def test_parities_drop_no_similar_pair():
    rng = np.random.default_rng(6)
    sets = []
    for n in (3, 90, 460, 500, 515, 900, 1030, 3000):
        base = rng.integers(0, 2**63, n, dtype=np.uint64)
        for share in (0.0, 0.02, 0.05, 0.09, 0.12, 0.3, 0.6):
            k = int(share * n)
            sets.append(np.unique(np.r_[base[k:], rng.integers(0, 2**63, rng.integers(0, k + 1), dtype=np.uint64)]))
    sets.sort(key=len)
    rows = np.zeros(len(sets), S._MEMBER)
    rows["size"] = [len(x) for x in sets]
    x, y = np.array([(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if 5 * len(sets[a]) >= 4 * len(sets[b])]).T
    true = np.array([S.similar(sets[a], sets[b]) for a, b in zip(x, y, strict=True)])
    passed = S.alike(rows, [S.parities(s) for s in sets])(x, y)
    assert passed[true].all() and len({len(S.parities(s)) for s in sets}) > 3
    assert (passed & ~true).sum() < (~true).sum() / 4


def test_large_group_of_near_copies_hands_on_few_pairs(spark, monkeypatch):
    """Copies about as alike as the least similarity: many pairs are near by fingerprint and not similar."""
    r = random.Random(11)
    base = [f"w{r.randrange(10**6)}" for _ in range(150)]
    texts = [" ".join(edited(r, base, r.randint(2, 5))) for _ in range(160)]
    own = classes(similar_by_brute_force(texts), range(len(texts)))
    assert 5 < len(set(own.values())) < len(texts)
    handed, plain_verified = [], S.verified

    def counted(pairs, sets):
        handed.append(pairs.count())
        return plain_verified(pairs, sets)

    monkeypatch.setattr(S, "verified", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = S.near_copy_stage(spark, df, "").collect()
    assert sorted(x.doc_id for x in kept) == sorted(set(own.values()))
    assert len(handed) == 2 and handed[1] < 2 * len(texts), handed
