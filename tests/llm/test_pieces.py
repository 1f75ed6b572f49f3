"""Segmentations against enumeration; round trips."""
import random

import numpy as np
import pytest

from quarry.llm import pieces as P


@pytest.fixture(scope="module")
def v():
    with open(P.MODEL_PATH, "rb") as f:
        return P.Vocabulary(f.read())


def every_path(unit, v):
    arcs = P.arcs_of(unit, v)
    into = {}
    for a in arcs:
        into.setdefault(a.begin, []).append(a)

    def walk(at):
        if at == len(unit):
            yield 0.0, []
        for a in into.get(at, []):
            for s, p in walk(a.end):
                yield a.score + s, [a.id, *p]

    return sorted(walk(0), key=lambda x: -x[0])


UNITS = [" the", " hello", "  a", " ", "   ", "é", " ▁x", "x▁", "\n", " día", "\U0001F600!", " ￿", "￿▁a", " thtion", "rrrr"]


def test_viterbi_and_a_star_equal_enumeration(v):
    for u in UNITS:
        want = every_path(u, v)
        got = P.n_best(len(u), P.arcs_of(u, v), 4)
        assert [s for s, _ in got] == [s for s, _ in want[:4]]
        assert all((s, p) in want for s, p in got)
        score, loss, ids, n = P._same_length([u, u], v)
        assert score[0] == score[1] == want[0][0] and (want[0][0], ids[:n[0]].tolist()) in want
        assert len(want) == 1 or loss[0] == want[0][0] - want[1][0]


def test_texts_n_best_and_round_trip(v):
    rng = random.Random(4)
    texts = ["", " ", "  two  spaces  ", "a\tb\nc", "▁ raw ▁▁ mark", "x" * 100, "￿"]
    texts += ["".join(rng.choice(["the ", "é", "tion", " ", "\n", "Zug", "▁", "1"]) for _ in range(rng.randrange(1, 8))) for _ in range(60)]
    whole = P.Segmenter(v, 4)
    for t, (ids, scores) in zip(texts, whole.texts(texts)):
        assert P.decode(ids.tolist(), v) == t
        if not t:
            assert scores == [0.0] and not len(ids)
            continue
        units, arcs, length = P._UNITS.findall(" " + t), [], 0
        for u in units:  # the whole text's lattice, searched by itself
            arcs += [P.Arc(a.begin + length, a.end + length, a.id, a.score) for a in P.arcs_of(u, v)]
            length += len(u)
        want = P.n_best(length, arcs, 4)
        assert scores == [s for s, _ in want]
        assert scores[0] == sum(v.score[i] if i >= 0 else v.spell for i in want[0][1])


def test_long_unit_and_long_text(v):
    t = "abc" * 5000 + " " + "word " * 40000
    (ids, scores), = P.Segmenter(v, 3).texts([t])
    assert P.decode(ids.tolist(), v) == t and len(scores) == 3 and scores[0] >= scores[1] >= scores[2]


def test_query(spark, tmp_path):
    rows = [(1, "hello world", 5), (1, "hello world", 5), (None, None, 1), (3, "", 1), (4, "día\n▁", 2)]
    spark.createDataFrame(rows, "doc_id long, text string, ids int").write.parquet(f"{tmp_path}/documents.parquet")
    out = P.op9_pieces(spark, str(tmp_path)).collect()
    assert len(out) == 5 and all(r.round_trip for r in out)
    assert sorted(r.n_pieces for r in out if r.doc_id in (None, 3)) == [0, 0]
    assert np.unique([r.ids_sha256 for r in out if r.doc_id == 1]).size == 1


@pytest.mark.parametrize("ch", [" ", "#"])
@pytest.mark.parametrize("length", [255, 5000])
def test_runs_with_very_many_equal_paths(v, ch, length, monkeypatch):
    pushed, push = [0], P.heapq.heappush

    def counted(heap, x):
        pushed[0] += 1
        assert pushed[0] <= 4 * length * v.longest
        push(heap, x)

    monkeypatch.setattr(P.heapq, "heappush", counted)
    arcs = P.arcs_of(ch * length, v)
    got = P.n_best(length, arcs, 4)
    assert len({tuple(p) for _, p in got}) == 4
    assert all(s == sum(v.score[i] if i >= 0 else v.spell for i in p) for s, p in got)
    # The scores of the four best by dynamic programming over whole lists.
    best = [[0.0]] + [[] for _ in range(length)]
    for a in sorted(arcs, key=lambda a: a.begin):
        best[a.end] = sorted(best[a.end] + [x + a.score for x in best[a.begin]], reverse=True)[:4]
    assert [s for s, _ in got] == best[length]
    pushed[0] = 0
    (ids, scores), = P.Segmenter(v, 4).texts(["x" + ch * length])
    assert P.decode(ids.tolist(), v) == "x" + ch * length and len(scores) == 4


def test_all_n_paths(v):
    texts = ["", " ", "hello world", "a\tb\nc", "▁ raw ▁▁ mark é", "rrrr the thtion", "#" * 60 + " x", "￿", " ".join(["tion"] * 200)]
    for n in (1, 2, 4):
        for t, (found, same) in zip(texts, P.Segmenter(v, n).paths(texts)):
            assert len({tuple(i.tolist()) for _, i in found}) == len(found) <= n
            assert same and all(P.decode(i.tolist(), v) == t for _, i in found)
            if t and len(t) <= 11:
                every = [(0.0, [])]
                for u in P._UNITS.findall(" " + t):
                    every = [(s + x, p + q) for s, p in every for x, q in every_path(u, v)]
                every.sort(key=lambda x: -x[0])
                want = {tuple(spelled(p, v)): s for s, p in every}
                assert [s for s, _ in found] == [s for s, _ in every[:n]]
                assert all(want[tuple(i.tolist())] == s for s, i in found)
    assert len(found) == 4


def spelled(path, v):
    return [x for i in path for x in ([i] if i >= 0 else [v.bytes[b] for b in chr(-1 - i).encode()])]


def test_query_gives_all_paths(spark, tmp_path):
    rows = [(1, "hello world"), (2, "hello world"), (3, "hello  world"), (4, None), (5, "é▁ " * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    with open(P.MODEL_PATH, "rb") as f:
        want = list(P.Segmenter(P.Vocabulary(f.read()), 4).paths([t or "" for _, t in rows]))
    got = {r.id: r for r in P.encode(docs).collect()}
    for (k, _), (paths, _) in zip(rows, want):
        assert [(b.score, b.ids) for b in got[k].best] == [(s, i.tolist()) for s, i in paths] and got[k].round_trip
    out = {r.doc_id: r for r in P.op9_pieces(spark, str(tmp_path)).collect()}
    assert out[1].n_best == 4 and out[4].n_best == 1 and out[4].scores == "0.0"
    assert out[1].n_best_sha256 == out[2].n_best_sha256 != out[3].n_best_sha256
    # The digest changes with any of the N.
    cut = P.digest(P.encode(docs.filter("doc_id = 1"), 3)).first()
    assert cut.ids_sha256 == out[1].ids_sha256 and cut.n_best_sha256 != out[1].n_best_sha256


def test_units_are_segmented_once(v, monkeypatch):
    """A segmenter keeps the units of its last batches, a bounded number, with the same results."""
    texts = ["the quick brown fox", "the lazy dog  jumps", "", "the quick dog", "a ▁ mark " + "x" * 60, "the quick brown fox"]
    want = [next(iter(P.Segmenter(v, 4).paths([t]))) for t in texts]
    done, group = [], P._same_length
    monkeypatch.setattr(P, "_same_length", lambda units, v: done.extend(units) or group(units, v))

    def same(got, want):
        return all(s == r and np.array_equal(i, j) for (s, i), (r, j) in zip(got[0], want[0], strict=True)) and got[1] == want[1]

    kept = P.Segmenter(v, 4)
    assert all(same(got, w) for t, w in zip(texts, want) for got in kept.paths([t]))
    assert len(done) == len(set(done)) == len({u for t in texts if t for u in P._UNITS.findall(" " + t) if len(u) <= P.TOGETHER})
    monkeypatch.setattr(P, "KEPT_UNITS", 3)
    little = P.Segmenter(v, 4)
    assert all(same(got, w) for t, w in zip(texts, want) for got in little.paths([t]))
    assert len(little.place) <= 8


def test_find_equals_the_table(v):
    """Hashes of pieces, of strings one character off, and of none."""
    for n in (1, 2, 5, v.longest, 200):
        h = np.array([[0, 1 << 63, (1 << 64) - 1]], dtype=np.uint64)
        if n in v.table:
            known, ids, scores = v.table[n]
            s, i = v.find(n, known)
            assert np.array_equal(s, scores) and np.array_equal(i, ids)
            h = np.concatenate([known + np.uint64(1), h[0]])[None]
            h = h[~np.isin(h, known)]
        s, i = v.find(n, h)
        assert (s == P.NONE).all() and not i.any() and s.shape == h.shape
