"""Substring removal and contamination against plain Python."""
import hashlib
import random
import re

from quarry.llm import decontaminate as dc
from quarry.llm import substring as sub


def brute_repeats(rows, window):
    """n_words, n_removed, kept hash per (id, text)."""
    key = lambda d: (1 << 63) - 1 if d is None else d
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (d, _), w in zip(rows, words):
        for k in range(len(w) - window + 1):
            g = tuple(w[k:k + window])
            least[g] = min(least.get(g, key(d)), key(d))
    out = []
    for (d, _), w in zip(rows, words):
        gone = set()
        for k in range(len(w) - window + 1):
            if least[tuple(w[k:k + window])] < key(d):
                gone |= set(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n, hot):
    rng = random.Random(seed)
    vocab = ["the", "of", "é", "a", "Zug", "x y", "lorem", "ipsum", "dolor", "sit"] + [f"w{k}" for k in range(60)]
    words = lambda k: [rng.choice(vocab) for _ in range(k)]
    passages = [words(rng.randrange(5, 30)) for _ in range(6)]
    rows = []
    for d in range(n):
        w = words(rng.randrange(0, 40))
        for _ in range(rng.randrange(3)):
            w[len(w) // 2:len(w) // 2] = passages[0 if d % 3 == 0 and hot else rng.randrange(6)]
        rows.append((rng.choice([d, d, d, d // 2]), rng.choice([" ", "\n", "\t ", "\x0b"]).join(w)))
    rows += [(None, None), (None, rows[3][1]), (7, ""), rows[5], rows[5], (1, "a " * 400), (n + 1, "a " * 300)]
    return rows


def run_repeats(spark, rows, window, gram, **more):
    df = spark.createDataFrame(rows, "k long, h string").repartition(5).select(
        "k", "h", "h", "k").toDF("id", "body", "t", "spans")  # names that clash with the operator's own
    got = sub.remove_repeats(df, window, "id", "body", gram, **more).collect()
    return sorted(((r.id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got), key=str)


def test_repeats_equal_brute_force(spark, monkeypatch):
    rows = corpus(1, 300, hot=True)
    want = brute_repeats(rows, 8)
    assert run_repeats(spark, rows, 8, 3) == want
    monkeypatch.setattr(sub, "HOT", 4)  # most repeats take the path of frequent anchors
    assert run_repeats(spark, rows, 8, 3) == want


def test_a_full_sketch_loses_nothing(spark):
    rows = corpus(2, 150, hot=False)
    assert run_repeats(spark, rows, 8, 8, most_cells=1 << 16) == brute_repeats(rows, 8)


def test_long_text_and_empty_table(spark):
    long = " ".join(f"v{k}" for k in range(300_000))
    rows = [(1, long), (2, long + " tail"), (3, "short")]
    assert run_repeats(spark, rows, 50, 25) == brute_repeats(rows, 50)
    assert run_repeats(spark, [], 50, 25) == []


def brute_hits(rows, items, window):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    phrases = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            phrases.setdefault(tuple(w[k:k + window]), set()).add("" if i is None else str(i))
    out = []
    for d, t in rows:
        w, hit, named = words(t), set(), set()
        for n in range(1, window + 1):
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in phrases:
                    hit |= set(range(k, k + n))
                    named |= phrases[tuple(w[k:k + n])]
        out.append((d, len(w), len(hit), tuple(sorted(named))))
    return sorted(out, key=str)


def test_contamination_equals_brute_force(spark):
    rng = random.Random(5)
    vocab = ["the", "OF", "é", "Été", "a1", "zug"] + [f"w{k}" for k in range(25)]
    words = lambda k: [rng.choice(vocab) for _ in range(k)]
    items = [(k, rng.choice([" ", "-", ". "]).join(words(rng.randrange(0, 9)))) for k in range(25)]
    items += [(None, "the of w1"), (3, None), (4, ""), items[2], (99, "solo word" * 1)]
    rows = []
    for d in range(200):
        w = words(rng.randrange(0, 60))
        if d % 2:
            w += (items[rng.randrange(20)][1] or "").split() + words(3)
        rows.append((d, rng.choice([" ", ", ", "\n"]).join(w)))
    rows += [(None, None), (None, "THE of W1 w1"), rows[3], rows[3], (5, ""), (6, "the of w1 " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("items", dc.F.lit(1)).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_hits(rows, items, 4)
    for per_pass in (10**6, 7):  # in one pass, and block by block
        got = sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]))
                      for r in dc.contamination(docs, bench, 4, per_pass=per_pass).collect()), key=str)
        assert got == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:3] for r in dc.contamination(docs, none).collect()] == [(1, 2, 0)]
    assert dc.contamination(docs.limit(0), none).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red big fox"), (2, "red fox"), (3, "red one two three fox")],
                                 "doc_id long, text string")
    items = spark.createDataFrame([(1, "red fox")], "item_id long, text string")
    hits = lambda slop: {r.doc_id for r in dc.contamination(docs, items, slop=slop).collect() if r.n_hit}
    assert hits(0) == {2} and hits(1) == {1, 2} and hits(3) == {1, 2, 3}
