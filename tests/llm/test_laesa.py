"""Codes against a plain k-means by parts; pruning by itself."""
import hashlib
import math
import random

import numpy as np
import pytest

from quarry.llm import laesa as L


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    ok = lambda v: v is not None and all(x is not None and math.isfinite(x) and abs(x) < L.LARGEST for x in v)
    kept = sorted((r for r in rows if ok(r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], hashlib.sha256(b"").hexdigest()
    dim = len(kept[0][1])
    first = [r for r in kept[:entries] if len(r[1]) == dim]
    kept = [r for r in kept if len(r[1]) == dim]
    cut = [p * dim // parts for p in range(parts + 1)]
    part = lambda v, p: [math.floor(scale * x) for x in v[cut[p]:cut[p + 1]]]
    books = [[part(r[1], p) for r in first] for p in range(parts)]

    def assign(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(part(v, p), e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for r in kept:
                groups.setdefault(assign(r[1], p)[1], []).append(part(r[1], p))
            for k, g in groups.items():
                books[p][k] = [sum(c) // len(g) for c in zip(*g)]
    out, labels = [], {}
    for r in kept:
        found = [assign(r[1], p) for p in range(parts)]
        out.append((r[0], "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), r[2]))
        labels[r[2]] = labels.get(r[2], 0) + out[-1][2]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, labels[x]) for i, c, e, x in out), key=str), sha


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "i long, x array<float>, y int").selectExpr(
        "i AS vec_id", "x AS embedding", "y AS label", "i AS id", "x AS v", "y AS c", "x AS d").repartition(3)
    found, books, work = L.compressed(df, **more)
    got = L.with_label_sums(found)
    return sorted(((r.id, r.code, r.error, r.label_error) for r in got.collect()), key=str), L.books_sha256(books), work


def vectors(n, dim, seed):
    rng = random.Random(seed)
    near = lambda x: float(np.float32(x))
    centre = [[rng.uniform(-1, 1) for _ in range(dim)] for _ in range(9)]
    return [(k, [near(c + rng.gauss(0, 0.05)) for c in rng.choice(centre)], rng.choice([None, 0, 1, 2])) for k in range(n)]


@pytest.mark.parametrize("n,dim,parts,entries", [(150, 32, 8, 16), (60, 20, 8, 5), (40, 3, 8, 16), (6, 16, 4, 16)])
def test_equals_plain_rounds(spark, n, dim, parts, entries):
    rows = vectors(n, dim, n)
    rows += [(900, None, 1), (901, [None] * dim, 1), (902, [float("nan")] * dim, 1), (903, [float("inf")] + [0.0] * (dim - 1), 1),
             (904, [3e4] * dim, 1), (905, [1.0] * (dim + 1), 1), (None, [0.5] * dim, 3), (0, [0.25] * dim, 3), rows[2], rows[2]]
    assert run(spark, rows, parts=parts, entries=entries)[:2] == plain(rows, parts, entries)


def test_hot_label_takes_both_ways_of_the_join(spark, monkeypatch):
    monkeypatch.setattr(L, "HOT_SHARE", 3)  # only labels with a third of the rows count as hot
    rows = [(k, v, 7 if k % 2 else k) for k, v, _ in vectors(80, 16, 1)]
    assert run(spark, rows)[:2] == plain(rows)


def test_empty_table(spark):
    assert run(spark, [])[:2] == ([], hashlib.sha256(b"").hexdigest())
    assert run(spark, [(1, None, 1)])[0] == []


def test_pruning_never_changes_the_nearest_entry_and_saves_work():
    rng = np.random.default_rng(0)
    centre = rng.integers(-4000, 4000, (16, 8))
    x = centre[rng.integers(0, 16, 3000)] + rng.integers(-60, 60, (3000, 8))
    entries = np.concatenate([centre[:15], centre[:1]])  # the last repeats the first: ties
    pivots = L.choose_pivots(entries, 4)
    index, best, evaluated = L.nearest(x, entries, L.distances(x, pivots), L.distances(entries, pivots))
    d = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (index == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
    assert evaluated < 0.35 * d.size


def test_bounds_hold_for_large_and_equal_integers():
    rng = np.random.default_rng(1)
    x = rng.integers(-2 ** 26, 2 ** 26, (500, 4))
    entries = np.concatenate([x[:8], x[:8] + 1])
    pivots = L.choose_pivots(entries, 4)
    index, best, _ = L.nearest(x, entries, L.distances(x, pivots), L.distances(entries, pivots))
    d = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (index == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


def test_pivots_are_far_apart():
    entries = np.array([[0, 0], [1, 0], [100, 0], [0, 90], [99, 1]])
    assert L.choose_pivots(entries, 3).tolist() == [[0, 0], [100, 0], [0, 90]]
    assert len(L.choose_pivots(entries[:2], 4)) == 2
