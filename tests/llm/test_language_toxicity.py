"""Profiles against a plain implementation; restoration and scores."""
import itertools
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import grams as G
from quarry.llm import language as L
from quarry.llm import toxicity as T


def packed_grams(text):
    b = bytes([32, *G.FOLD[np.frombuffer(text.encode(), np.uint8)].tolist(), 32])
    out = Counter()
    for n in L.SIZES:
        for k in range(len(b) - n + 1):
            g = b[k:k + n]
            if (n == 1 and g != b" ") or (n > 1 and g != b" " * n and b" " not in g[1:-1] and b"  " not in g):
                out[int.from_bytes(g, "little")] += 1
    return out


def test_grams_equal_plain_counts(monkeypatch):
    text = "the quick  brown été zug, 12 a b " * 30
    for piece in (1 << 20, 37):
        monkeypatch.setattr(G, "PIECE", piece)
        codes, n = G.grams(np.frombuffer(text.encode(), np.uint8), L.SIZES)
        assert dict(zip(codes.tolist(), n.tolist())) == dict(packed_grams(text))


def test_predictions(spark, tmp_path):
    en, de = "the house and the garden of the king " * 5, "das haus und der garten des königs ist schön " * 5
    rows = [(k, (en if k % 2 else de) + str(k), "en" if k % 2 else "de") for k in range(40)]
    rows += [(100, None, None), (101, "", "en"), (102, "12 !!", "de"), (None, en, "en"), (103, "a " * 200000, None), (3, en, "en"), (3, en, "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    out = L.op3_language(spark, str(tmp_path)).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    by = {r.doc_id: r.lang_pred for r in out}
    assert all(by[k] == ("en" if k % 2 else "de") for k in range(40))
    assert by[100] == by[101] == by[102] == "und" and by[None] == "en"
    assert L.predict(spark.createDataFrame([], "doc_id long, text string"), {}).count() == 0


def model_of(words):
    counts = Counter()
    for w in words:
        b = f" {w} ".encode()
        for n in (2, 3):
            for k in range(len(b) - n + 1):
                counts[int.from_bytes(b[k:k + n], "little")] += 50
    return T.CharModel(np.array(list(counts)), np.array(list(counts.values())))


def test_restoration():
    r = T.Restorer(model_of(["idiot", "stupid", "loser", "garden", "house"]))
    assert [r.word(x) for x in ("1d10t", "$tup1d", "looooser", "Garden,", "h0use!!", "123")] == [
        "idiot", "stupid", "loser", "garden", "house", ""]
    assert "idiot" in r.words("such an i d i o t here") and "idiot" in r.words("x i.d.1.o.t y")


def test_scores(spark, tmp_path):
    words = ["garden", "house", "river", "letter", "winter", "summer", "table", "window"]
    text = lambda k, bad: " ".join(words[(k * 7 + j * j) % 8] + str(k) * 0 for j in range(12)) + f" n{k} " + bad
    rows = [(k, text(k, "vilest" if k % 4 == 0 else "kind")) for k in range(400)]
    rows += [(1000, None), (1001, ""), (1002, text(5, "v1l3st")), (None, text(6, "vilest"))]
    labels = [(k, int(k % 4 == 0)) for k in range(400)] + [(None, 1), (9000, 1)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = {r.doc_id: r for r in T.op7_toxicity(spark, str(tmp_path)).collect()}
    assert len(out) == 404 and all(0 <= r.score <= 1 for r in out.values())
    assert all(out[k].predicted == int(k % 4 == 0) for k in range(400))
    assert out[1000].score == out[1001].score < 0.3 and out[1002].predicted == 1
    docs = spark.createDataFrame([(1, "x", 0.5)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.p for r in T.score(docs, T.fit(docs, none), score_col="p").collect()][0] < 0.01


def test_stage_keeps_what_the_operator_calls_clean(spark, tmp_path, monkeypatch):
    import corpus_pipeline as C
    rows, scores = [(k, str(k)) for k in range(6)], [0.0, 0.29, 0.3, 0.4, 0.5, 1.0]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(T, "score", lambda d, m, score_col="score", **k: d.withColumn(
        score_col, F.element_at(F.array(*map(F.lit, scores)), F.col("doc_id").cast("int") + 1)))
    clean = {r.doc_id for r in T.op7_toxicity(spark, str(tmp_path)).collect() if not r.predicted}
    assert {r.doc_id for r in C.drop_toxic(spark, docs, str(tmp_path)).collect()} == clean == {0, 1}


def test_decoding_is_exact():
    rng = np.random.default_rng(7)
    letters = "abcdefghilost"
    counts = {}
    for a in " " + letters:
        for b in letters:
            counts[ord(a) | ord(b) << 8] = int(rng.choice([10, 5000]))
            for c in letters + " ":
                counts[ord(a) | ord(b) << 8 | ord(c) << 16] = int(rng.choice([0, 0, 0, 5000]))
    model = T.CharModel(np.array(list(counts)), np.array(list(counts.values())))
    model.tables()[0][-1] = 3000

    def cost_of(token, text):
        return min(c for c, t in every(token) if t == text)

    def every(token):
        for path in itertools.product(*T.lattice(token)):
            text, cost, a, b = b"".join(x for x, _ in path), sum(c for _, c in path), -1, 0x20
            for c in text:
                cost += model.cost(a, b, c)
                a, b = b, c
            yield cost + (model.cost(a, b, 0x20) if a >= 0 else 0.0), text

    tokens = ["".join(rng.choice(list("1|6035(9"), 8)) for _ in range(80)]
    for t in tokens:
        best, _ = min(every(t))
        assert abs(cost_of(t, T.decode(t, model).encode()) - best) < 1e-9


def plain_profiles(rows):
    """Language -> n-grams (bytes), most frequent first, then by packed code."""
    found = {}
    for _, text, lang in rows:
        if lang is not None:
            found.setdefault(lang, Counter()).update(plain_grams(text))
    return {k: ordered(c) for k, c in sorted(found.items())}


def plain_grams(text):
    b = b" " + bytes(x if 97 <= x < 123 or x >= 128 else 32 for x in (text or "").lower().encode()) + b" "
    out = Counter()
    for n in (1, 2, 3, 4):
        for k in range(len(b) - n + 1):
            g = b[k:k + n]
            if (g != b" " if n == 1 else b" " not in g[1:-1] and g != b"  "):
                out[g] += 1
    return out


def ordered(counts):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], int.from_bytes(x[0], "little")))][:L.PROFILE]


def test_language_equals_a_plain_rank_order_comparison(spark, tmp_path):
    import zlib
    rng = np.random.default_rng(11)
    syllables = {"de": ["ich", "und", "schü", "ver"], "en": ["the", "ing", "and", "wh"], "fr": ["que", "é", "ou", "le"]}
    text = lambda lang, n: " ".join("".join(rng.choice(syllables[lang] + ["ta"], 2)) for _ in range(n)) + rng.choice([".", " 1!", ""])
    rows = [(k, text(lang, int(rng.integers(1, 60))), lang) for k in range(90) for lang in [rng.choice(list(syllables))]]
    rows += [(500, None, "en"), (501, " \t12", "de"), (502, "zzz", None), (503, "É " * 3000, "fr"), (504, "", None), (505, "the", None), rows[4]]
    fields = "doc_id long, text string, lang string"
    spark.createDataFrame(rows, fields).selectExpr("*", "'x' AS t", "1 AS letters", "'y' AS lang_pred", "0 AS code").write.parquet(f"{tmp_path}/documents.parquet")
    profiles = plain_profiles([r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2])
    want = []
    for i, t, _ in rows:
        if t is None or not any(ch.isalpha() for ch in t):
            want.append((i, "und", 0.0))
            continue
        own, far = ordered(plain_grams(t)), []
        for k, (lang, p) in enumerate(profiles.items()):
            place = {g: n for n, g in enumerate(p)}
            far.append((sum(abs(place[g] - n) if g in place else L.PROFILE for n, g in enumerate(own)), k, lang))
        far.sort()
        want.append((i, far[0][2], far[1][0] / (far[0][0] + far[1][0]) if far[0][0] + far[1][0] else 0.5))
    got = L.op3_language(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.lang_pred, round(r.score, 9)) for r in got) == sorted((i, p, round(s, 9)) for i, p, s in want)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def test_classifier_equals_a_plain_version(spark, tmp_path, monkeypatch):
    """Counts, weights, regression and score without Spark, from the same definitions."""
    import math
    import zlib
    monkeypatch.setattr(T, "LEAST_SIGMA", 1.0)
    rng = np.random.default_rng(5)
    words = ["garden", "house", "river", "letter", "winter", "summer", "table", "window", "h0use", "stone"]
    bad = ["vilest", "v1lest", "scumbag", "garden"]
    rows = [(k, " ".join(rng.choice(words, 8)) + " " + " ".join(rng.choice(bad if k % 3 == 0 else words, 2)) + f" n{k}") for k in range(240)]
    rows += [(900, None), (901, ""), (902, "vilest " * 3000), (903, rows[0][1])]
    labels = [(k, int(k % 3 == 0)) for k in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.selectExpr("*", "'x' AS y", "0 AS score", "1 AS i").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    grams = Counter()
    for _, t in rows:
        for w in "".join(ch if "a" <= ch <= "z" or ord(ch) > 127 else " " for ch in (t or "").lower()).split():
            b = f" {w} ".encode()
            for n in (2, 3):
                grams.update(int.from_bytes(b[k:k + n], "little") for k in range(len(b) - n + 1))
    model = T.CharModel(np.array(list(grams)), np.array(list(grams.values())))
    restore = T.Restorer(model)
    feats = lambda t: {f for w in restore.words(t or "") for f in T.features(w)}
    fold = lambda i: zlib.crc32(str(i).encode()) % 4
    text = dict(rows)
    learn = [(text[i], y) for i, y in labels if fold(i) < 2]
    n = [sum(y == c for _, y in learn) for c in (0, 1)]
    count = [Counter(f for t, y in learn if y == c for f in feats(t)) for c in (0, 1)]
    weights = {}
    for f, pos in count[1].items():
        neg = count[0][f]
        w = math.log((pos + 0.5) / (n[1] + 1)) - math.log((neg + 0.5) / (n[0] + 1))
        expected = (pos + neg) * n[1] / sum(n)
        if pos >= T.LEAST_TEXTS and w >= T.LEAST_WEIGHT and pos - expected >= math.sqrt(expected):
            weights[f] = w
    assert weights
    row = lambda t: T.evidence(restore.words(t or ""), weights)
    x = np.array([row(text[i]) for i, _ in labels if fold(i) == 3])
    y = np.array([y for i, y in labels if fold(i) == 3], dtype=float)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    coef = np.zeros(6)
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    ridge = np.diag([1e-6] + [1.0] * 5)
    for _ in range(2000):  # plain gradient steps scaled by a bound of the curvature
        p = 1 / (1 + np.exp(-z @ coef))
        coef += np.linalg.solve(z.T @ z / 4 + ridge, z.T @ (y - p) - ridge @ coef)
    want = {i: 1 / (1 + math.exp(-(coef[0] + ((np.array(row(t)) - mean) / scale) @ coef[1:]))) for i, t in rows}
    got = {r.doc_id: r for r in T.op7_toxicity(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    assert all(abs(got[i].score - s) < 1e-6 for i, s in want.items())
    assert all(r.predicted == int(r.score >= 0.3) and r.held_out == (fold(i) == 2) for i, r in got.items())
