"""Fingerprints against a plain implementation; radius search against all pairs."""
import hashlib
import random
import re
import struct

import pytest
import xxhash

from quarry.llm import fingerprint as fp


def plain(text):
    votes, total = [0] * 128, 0
    for w in re.split(r"[\x20\x09-\x0D]+", text):
        weight = min(len(w), fp.MOST_WEIGHT)
        a = xxhash.xxh64_intdigest(w.encode(), seed=42)
        for half, h in enumerate((a, xxhash.xxh64_intdigest(struct.pack("<i", 1), seed=a))):
            for b in range(64):
                votes[64 * half + b] += weight * (h >> b & 1)
        total += weight
    words = [sum(1 << b for b in range(64) if 2 * votes[64 * half + b] > total) for half in (0, 1)]
    return (words[0] << 64) | words[1]


def likeness(a, b):
    return 1 - (a ^ b).bit_count() / 128


def run(spark, rows, tmp_path):
    spark.createDataFrame(rows, "doc_id long, text string, k long").write.parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(r) for r in fp.op5_fingerprint(spark, str(tmp_path)).collect()), key=str)


def expect(rows):
    texts = sorted(rows, key=lambda r: ((1 << 63) - 1 if r[0] is None else r[0],
                                        struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest((r[1] or "").encode(), seed=42)))[0]))
    out, every = [], {plain(t or "") for _, t, _ in rows}
    for i, (d, t, _) in enumerate(texts):
        t, n = t or "", texts[(i + 1) % len(texts)][1] or ""
        half = len(t) // 2
        e = t[:len(t) - half] + n[:half]
        near = None if d is None or d % 20 else sum(0 < (x ^ plain(t)).bit_count() <= fp.RADIUS for x in every)
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), f"{plain(t):032x}", f"{plain(e):032x}",
                    likeness(plain(t), plain(e)), likeness(plain(t), plain(n)), near))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [4096, 3])
def test_query_equals_plain(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(fp, "MOST_CUTS", most)  # 3: each range is cut again
    rng = random.Random(2)
    rows = [(k * 7, " ".join(rng.choice(["the", "é", "lorem", "x\ny", "Zug", "abc%d" % rng.randrange(40)])
                             for _ in range(rng.randrange(40))), 1) for k in range(120)]
    rows += [(3, None, 1), (None, "a b", 1), (5, "same", 1), (5, "same", 1), (5, "same", 1), (9, "", 1),
             (11, "long word " * 30000, 1), (12, "   ", 1), (13, "𝔘𝔫𝔦 " * 5, 1)]
    long = " ".join(f"word{k}" for k in range(400))
    rows += [(2000 + 10 * k, long + " extra" * k, 1) for k in range(6)]  # neighbours of each other
    monkeypatch.setattr(fp, "RANGE_ROWS", 10)
    assert run(spark, rows, tmp_path) == expect(rows)


def test_many_cuts(spark):
    cuts = sorted(random.Random(1).sample(range(10_000), 300))
    got = spark.range(0, 10_050, 7).select("id", fp._cell("id", cuts).alias("c")).collect()
    assert all(r.c == sum(c <= r.id for c in cuts) for r in got)


def test_one_and_no_document(spark, tmp_path):
    assert run(spark, [(4, "abcd", 1)], tmp_path / "one") == expect([(4, "abcd", 1)])
    assert run(spark, [], tmp_path / "none") == []


def test_radius_search_finds_all(spark):
    rng = random.Random(8)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    base = [rng.getrandbits(128) for _ in range(30)]
    prints = base + [b ^ sum(1 << i for i in rng.sample(range(128), rng.randrange(1, 6))) for b in base for _ in range(6)]
    prints += prints[:5]
    df = spark.createDataFrame([(signed(p >> 64), signed(p & (1 << 64) - 1)) for p in prints], "hi long, lo long")
    for radius in (0, 3):
        got = {(r.query_hi, r.query_lo, r.hi, r.lo, r.distance) for r in fp.within_radius(df, df.limit(60), radius).collect()}
        q = {(r.hi, r.lo) for r in df.limit(60).collect()}
        full = lambda x: ((x[0] % (1 << 64)) << 64) | x[1] % (1 << 64)
        every = {(signed(p >> 64), signed(p & (1 << 64) - 1)) for p in prints}
        want = {(*a, *b, d) for a in q for b in every if (d := (full(a) ^ full(b)).bit_count()) <= radius}
        assert got == want


def test_edited_copies_are_nearer(spark):
    import pyspark.sql.functions as F
    rows = fp.op5_fingerprint(spark, "/root/testdata/sf0.001").agg(F.avg("near_edited"), F.avg("near_next")).first()
    assert rows[0] > rows[1] + 0.08
