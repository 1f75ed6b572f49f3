"""Resampling against a plain version: CRCs, totals, weights, noise and ranks."""
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from quarry.llm import resample as R
from quarry.llm import words as W

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, target, max_run, buckets, share, least, seed):
    def feats(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        return len(w), [zlib.crc32(" ".join(w[k:k + r]).encode()) % buckets for r in range(1, max_run + 1) for k in range(len(w) - r + 1)]

    s, t = [0] * buckets, [0] * buckets
    for total, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            for b in feats(x)[1]:
                total[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for i, x in docs:
        n, f = feats(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32)))])
    long_enough = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = long_enough[:len(long_enough) * share // 100]
    ranks = {id(r): k + 1 for k, r in enumerate(drawn)}
    return sorted(((*r, ranks.get(id(r))) for r in rows), key=str)


def corpus():
    rng = random.Random(4)
    word = lambda: rng.choice(["the", "The", "of", "ÄRA", "x1y", "naïve"] + [f"w{k}" for k in range(50)] if rng.random() < 0.7
                              else ["z" * rng.randrange(1, 120) + "é"])
    docs = [(d, rng.choice([" ", ", ", "\n"]).join(word() for _ in range(rng.randrange(0, 60)))) for d in range(150)]
    docs += [(None, "a b c " * 10), (None, None), (200, ""), (201, "12 ..."), (202, "long " * 40_000), (7, "the of w1 " * 9), docs[3]]
    return [(None if d is None else d, t) for d, t in docs], [" ".join(word() for _ in range(40)) for _ in range(5)] + [None, ""]


@pytest.mark.parametrize("max_run,buckets,share", [(1, 10_000, 10), (2, 500, 30), (3, 97, 100)])
def test_equals_the_plain_version(spark, monkeypatch, max_run, buckets, share):
    monkeypatch.setattr(R, "HEAD", 64)
    docs, target = corpus()
    df = spark.createDataFrame(docs, "d long, t string").selectExpr("d AS doc_id", "t AS text", "d AS id", "t AS rank", "d AS _part").repartition(5)
    items = spark.createDataFrame([(t,) for t in target], "text string")
    got = R.resampled(df, items, max_run, buckets, share, 20, 2024)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(docs, target, max_run, buckets, share, 20, 2024)


def test_head_holds_only_frequent_features_with_their_exact_crc(spark):
    texts = [("common pair here " * 50 + " ".join(f"rare{d}_{k}" for k in range(20)),) for d in range(30)]
    head = R.frequent(spark.createDataFrame(texts, "t string").repartition(3), 2, 1000, head=20)
    data, offsets = W.utf8(R.pa.array(["common pair here common"]))
    w = W.words_of(data, offsets, W.ALNUM, W.FOLDED)
    known, state = R.Head.find(head.word, head.state, w.hash)
    assert known.all() and len(head.word) == 3
    assert state.tolist() == [zlib.crc32(x) for x in (b"common", b"pair", b"here", b"common")]
    known, bucket = R.Head.find(head.pair, head.bucket, W.runs_hash(w.hash, 2))
    assert known.all() and len(head.pair) == 3
    assert bucket.tolist() == [zlib.crc32(x) % 1000 for x in (b"common pair", b"pair here", b"here common")]


@pytest.mark.parametrize("max_run", [1, 2, 3])
def test_head_and_tail_give_the_same_buckets(max_run):
    data, offsets = W.utf8(R.pa.array(["a b c a b", "", "B c " + "y" * 200, None]))
    w = W.words_of(data, offsets, W.ALNUM, W.FOLDED)
    none = R.Head({}, {})
    crc = R.word_crc(data, w, none)
    full = R.Head({int(h): int(c) for h, c in zip(w.hash.view(np.int64), crc)}, {})
    pairs = {int(W.runs_hash(w.hash, 2).view(np.int64)[k]): zlib.crc32(x) % 77 for k, x in ((0, b"a b"), (1, b"b c"))}
    both = R.Head({int(w.hash.view(np.int64)[0]): int(crc[0])}, pairs)
    want = R.feature_buckets(data, w, none, max_run, 77)
    for head in (full, both):
        for x, y in zip(want, R.feature_buckets(data, w, head, max_run, 77)):
            assert x.tolist() == y.tolist()


def test_crc_of_words_of_any_length():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 3000, dtype=np.uint8)
    start = rng.integers(0, 2000, 200)
    end = start + rng.integers(0, 100, 200)
    seed = rng.integers(0, 1 << 32, 200, dtype=np.uint32)
    want = [zlib.crc32(R._FOLD[data[s:e]].tobytes(), int(c)) for s, e, c in zip(start, end, seed)]
    assert R.crc_words(data, start, end, seed).tolist() == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert R.resampled(none, some).collect() == [] and R.resampled(none, none).collect() == []
    (r,) = R.resampled(some, none, least_words=1, share=100).collect()
    assert (r.id, r.n_features, r.rank) == (1, 3, 1)


def test_position_is_gapless_over_partitions(spark):
    df = spark.range(0, 997, 1, 7).selectExpr("id", "id % 10 AS v")
    got = R.with_position(df, R.F.desc("v"), "id", name="place").orderBy("place").collect()
    assert [r.place for r in got] == list(range(997))
    assert [r.id for r in got] == sorted(range(997), key=lambda i: (-(i % 10), i))
