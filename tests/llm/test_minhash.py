"""Components against all pairs; signatures, bands and the block search by themselves."""
import numpy as np
import pytest
from test_jaccard import brute, corpus

from quarry.llm import minhash as M
from quarry.llm.jaccard import NULL_ID


def rows_of(df):
    return sorted(((r.id, r.n, NULL_ID if r.component is None else r.component) for r in df.collect()), key=str)


@pytest.mark.parametrize("n,num,den,turns,unit", [(3, 85, 100, 1, 1000), (5, 8, 10, 3, 1000), (5, 8, 10, 0, 1000), (5, 8, 10, 0, 5)])
def test_components_equal_all_pairs(spark, monkeypatch, n, num, den, turns, unit):
    monkeypatch.setattr(M, "TURNS", turns)  # 0: buckets go to the block search at once
    monkeypatch.setattr(M, "UNIT", unit)  # 5: several blocks a bucket
    rows = corpus(n + unit)
    # Columns named like the operator's own are not read.
    df = spark.createDataFrame(rows, "x long, text string").selectExpr("x AS doc_id", "text", "x AS s", "x AS n", "text AS key").repartition(4)
    found = M.near_duplicates(df, n, num, den)
    assert rows_of(found) == brute(rows, n, num, den)
    for r in found.collect():
        key = NULL_ID if r.id is None else r.id
        assert r.kept == (key == (NULL_ID if r.component is None else r.component))


def test_variants_of_a_hub_that_are_not_alike(spark):
    """Links run through one text only: 60 variants that differ from each other."""
    words = [f"w{k}" for k in range(200)]
    rows = [(500, " ".join(words))]
    for d in range(60):
        w = list(words)
        for k in range(3):
            w[3 * (d + 1) + k - 1] = f"v{d}_{k}"
        rows.append((d, " ".join(w)))
    rows += [(600 + d, " ".join(f"u{d}_{k}" for k in range(50))) for d in range(20)]
    assert rows_of(M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, 100)) == brute(rows, 3, 85, 100)


def test_empty_table_and_texts_without_words(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert M.near_duplicates(none).collect() == []
    rows = [(1, None), (2, ""), (3, " \n"), (None, None), (4, "a"), (5, "A")]
    got = {(r.id, r.n, r.component, r.kept) for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (None, 0, None, True), (4, 1, 4, True), (5, 1, 4, False)}


def test_signatures_estimate_similarity_without_bias():
    rng = np.random.default_rng(5)
    factors = rng.integers(1, 1 << 62, 2000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    pool = rng.integers(1, 1 << 63, 300, dtype=np.uint64)
    for share in (30, 150, 270):
        a, b = np.sort(pool[:share + (300 - share) // 2]), np.sort(np.concatenate([pool[:share], pool[share + (300 - share) // 2:]]))
        s = M.min_max(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), factors)
        assert s.shape == (2, 2000, 2)
        assert abs((s[0] == s[1]).mean() - share / 300) < 0.03
        assert (s[:, :, 0] <= s[:, :, 1]).all()


def test_bands_agree_only_on_all_their_values():
    rng = np.random.default_rng(1)
    s = rng.integers(0, 1 << 62, (3, 8, 2), dtype=np.uint64)
    s[1] = s[0]
    s[1, 3, 1] += np.uint64(1)  # one value of band 1
    keys = M.bands(s, 2)
    assert keys.shape == (3, 4)
    assert (keys[0] == keys[1]).tolist() == [True, False, True, True] and not (keys[0] == keys[2]).any()
    s[0, :2] = s[0, 2:4]
    assert len(set(M.bands(s, 2)[0].tolist())) == 4  # equal values in two bands: different keys


def test_block_search_spans_all_components():
    rng = np.random.default_rng(2)
    base = [np.unique(rng.integers(0, 10 ** 6, 40).astype(np.uint64)) for _ in range(6)]
    sets = [np.unique(np.append(np.delete(base[k % 6], rng.integers(0, 30, 2)), rng.integers(0, 10 ** 6, 1).astype(np.uint64))) for k in range(60)]
    links = {(x, y) for x in range(60) for y in range(x)
             if 10 * (o := len(np.intersect1d(sets[x], sets[y]))) >= 8 * (len(sets[x]) + len(sets[y]) - o)}

    def joined(pairs):
        root = list(range(60))
        for x, y in pairs:
            old = root[x]
            root = [root[y] if r == old else r for r in root]
        return {frozenset(k for k in range(60) if root[k] == r) for r in root}

    for left in (np.ones(60, bool), np.arange(60) < 30):
        pairs = {(x, y) for x, y in links if left.all() or left[x] != left[y]}
        found = M.apart_links(sets, left, np.arange(60), 8, 10)
        assert all((max(p), min(p)) in pairs for p in found) and joined(found) == joined(pairs)
    assert M.apart_links(sets, np.ones(60, bool), np.zeros(60, int), 8, 10) == []


def test_units_hold_every_pair_of_every_bucket(spark, monkeypatch):
    monkeypatch.setattr(M, "UNIT", 3)
    rng = np.random.default_rng(9)
    rows = [(b, int(x), 5, int(x) % 7) for b in range(30) for x in rng.choice(20 * (1 + b // 10), int(rng.integers(2, 9)), replace=False) + 100 * (b // 10)]
    rows += [(100 + b, 900 + k, 5, k) for b in range(6) for k in range(12)]  # six bands of the same sets
    units = M.search_units(spark.createDataFrame(rows, "key long, s long, n long, root long")).collect()
    held, pairs = {}, set()
    for r in units:
        held.setdefault((r.grouped, r.unit), set()).add(r.s)
        assert r.root == next(x[3] for x in rows if x[1] == r.s)
    for b in {r[0] for r in rows}:
        mine = {r[1] for r in rows if r[0] == b}
        assert any(mine <= h for h in held.values())
    assert len([h for h in held.values() if 900 in h]) == 1
    assert len(units) == len({(r.grouped, r.unit, r.s) for r in units})
