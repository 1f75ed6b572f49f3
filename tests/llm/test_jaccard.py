"""Components against all pairs; the parts of the search by themselves."""
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import jaccard as J


def brute(rows, n, num, den):
    key = lambda d: J.NULL_ID if d is None else d
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b, o = sets[j], len(a & sets[j])
            if o and o * den >= num * (len(a) + len(b) - o):
                root[find(i)] = find(j)
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), J.NULL_ID), key(rows[i][0]))
    return sorted(((d, len(s), least[find(i)] if s else key(d)) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["The", "of", "é"] + [f"w{k}" for k in range(400)])
    rows, base = [], [[word() for _ in range(rng.randrange(20, 120))] for _ in range(12)]
    passage = [word() for _ in range(30)]
    for d in range(260):
        w = list(rng.choice(base)) if d % 4 else [word() for _ in range(rng.randrange(0, 80))]
        for _ in range(rng.randrange(4)):
            if w:
                w[rng.randrange(len(w))] = word()
        if d % 5 == 0:
            w += passage
        rows.append((d, rng.choice([" ", "\n"]).join(w)))
    rows += [(None, None), (None, "a b"), (1000, ""), (1001, " \n"), (1002, "a B"), (1003, "a b c d e"), rows[5], rows[5],
             (7, "other text with id seven"), (1004, "x " * 5000), (1005, "x " * 4000)]
    return rows


@pytest.mark.parametrize("n,num,den,unit", [(4, 85, 100, 2000), (5, 8, 10, 2000), (5, 8, 10, 7)])
def test_components_equal_all_pairs(spark, monkeypatch, n, num, den, unit):
    monkeypatch.setattr(J, "UNIT", unit)  # 7: groups are cut into pairs of blocks
    rows = corpus(n + unit)
    df = spark.createDataFrame(rows, "s long, grams string").selectExpr("s AS doc_id", "grams AS text", "s", "grams").repartition(4)
    got = sorted(((r.id, r.n, r.component) for r in J.linked_classes(df, n, num, den).collect()), key=str)
    assert got == brute(rows, n, num, den)


def test_empty_table_and_one_row_a_component(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert J.linked_classes(none).count() == 0 and J.keep_one(none).count() == 0
    rows = corpus(3)
    kept = J.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    want = {c for d, n, c in brute(rows, 5, 8, 10) if n}
    got = [(r.doc_id, r.text) for r in kept.collect()]
    worded = [J.NULL_ID if d is None else d for d, t in got if (t or "").split()]
    assert len(worded) == len(brute_roots(rows)) and set(worded) <= want
    assert len(got) - len(worded) == sum(not (t or "").split() for _, t in rows)


def test_kept_rows_do_not_depend_on_the_bit_arrays(spark, monkeypatch):
    rows = corpus(11)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, J.keep_one(df).collect()), key=str)
    monkeypatch.setattr(J, "possible_members", lambda keys: lambda k, h: J.F.lit(True))
    assert sorted(map(tuple, J.keep_one(df).collect()), key=str) == want


def brute_roots(rows):
    """One entry a component (components of repeated ids may share their least id)."""
    numbered = [(k, t) for k, (_, t) in enumerate(rows)]
    return {c for _, n, c in brute(numbered, 5, 8, 10) if n}


def test_divide_skip_and_probe_count_overlaps():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 40)) for _ in range(80)]
    index = J._Index(sets)
    for q in sets:
        for t in (1, 10, 25):
            place, count, long = J.divide_skip(index.lists(q), t)
            got = {p: o for p, o in zip(place.tolist(), J.probe(place, count, long).tolist()) if o >= t}
            assert got == {k: o for k, s in enumerate(sets) if (o := len(np.intersect1d(q, s))) >= t}


def test_components_of_long_chains(spark):
    edges = [(k, k + 1) for k in range(1, 60)] + [(100, 101), (7, 3), (200, 200)]
    got = {r.node: r.root for r in J.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(2, 61)}, 101: 100}


def test_shared_passages_alone_make_no_group(spark, monkeypatch):
    """Each text is two passages, each of them in two texts: all n-grams are shared, no sets link."""
    rng = random.Random(5)
    passages = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(60)]
    rows = [(d, f"{p} {q}") for d, (p, q) in enumerate(zip(passages, passages[1:] + passages[:1]))]
    rows += [(100 + d, rows[d][1] + " end") for d in range(3)]
    sizes, components = [], J.components

    def seen(edges):
        found = components(edges)
        sizes.append(max([r["count"] for r in found.groupBy("root").count().collect()], default=0))
        return found

    monkeypatch.setattr(J, "components", seen)
    got = {r.id: r.component for r in J.linked_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d % 100 for d, _ in rows}
    assert sizes == [1, 1]  # of candidate groups and of components, besides the root


@pytest.mark.parametrize("slices", [8, 64])
def test_counts_of_keys_equal_plain_counts(spark, slices):
    rng = random.Random(slices)
    rows = [(d, sorted(rng.sample(range(2000), rng.randrange(300)))) for d in range(50)] + [(50, []), (51, [1 << 62, 5 << 40])]
    mixed = lambda k: int(J.W.mix(np.array([k], np.uint64)).view(np.int64)[0])
    keys = [(d, [mixed(k) for k in x]) for d, x in rows]
    times = Counter(k for _, x in keys for k in x)
    df = spark.createDataFrame(keys, "s long, grams array<long>").repartition(3)

    def shared(longs, sizes, _, found):
        return pa.RecordBatch.from_arrays([*map(pa.array, (longs[0], sizes, found))], ["s", "n", "c"])

    def levels(longs, sizes, grams, level):
        return pa.RecordBatch.from_arrays([pa.array(longs[0].repeat(sizes)), pa.array(grams.view(np.int64)), pa.array(level.astype(np.int64))], ["s", "g", "v"])

    got = {(r.s, r.n, r.c) for r in J.counted(df, slices, 4, False, shared, "s long, n long, c long").collect()}
    assert got == {(s, len(x), sum(times[k] > 1 for k in x)) for s, x in keys}
    got = sorted(tuple(r) for r in J.counted(df, slices, 4, True, levels, "s long, g long, v long").collect())
    assert got == sorted((s, k, math.ceil(math.log2(times[k]))) for s, x in keys for k in x)


def test_bounds_let_every_link_pass():
    rng = np.random.default_rng(2)
    base = [rng.integers(0, 1 << 63, m).astype(np.uint64) for m in (3, 40, 700, 3000)]
    sets = [np.unique(np.concatenate([x[rng.random(len(x)) > p], rng.integers(0, 1 << 63, int(p * len(x))).astype(np.uint64)]))
            for x in base for p in (0, 0.02, 0.05, 0.08, 0.1, 0.3) for _ in range(3)]
    sets = [x for x in sets if len(x)]
    n = np.array([len(x) for x in sets])
    signs = J._signs(np.concatenate(sets), n)
    passed = 0
    for i, a in enumerate(sets):
        may = J.may_link(n[i], n, signs[i], signs, 8, 10)
        passed += may.sum()
        for j, b in enumerate(sets):
            o = len(np.intersect1d(a, b))
            assert may[j] or o * 10 < 8 * (len(a) + len(b) - o)
    assert passed < len(sets) ** 2 / 2
    pairs = J.connected(n, signs, 8, 10)
    root = list(range(len(n)))
    for x, y in pairs:
        root = [root[x] if r == root[y] else r for r in root]
    assert all(root[i] == root[j] for i in range(len(n)) for j in np.flatnonzero(J.may_link(n[i], n, signs[i], signs, 8, 10)))
