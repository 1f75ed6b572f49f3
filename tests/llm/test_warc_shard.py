"""WARC round trips and exact shard sizes."""
import hashlib

import numpy as np
import pytest

from quarry.llm import shard, warc


def page_rows():
    big = "x" * 1000
    return [(1, "u", big), (5, "u", big), (3, None, big), (2, "u", "small"), (7, "u", "small"), (None, "u", big),
            (8, "u\r\nX: y", None), (8, "u", None), (9, "u", "é" * 500), (10, "u", "é" * 500), (11, "u", "y" * 999)]


def test_write_and_read_back(spark, tmp_path):
    rows = page_rows()
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((tuple(r) for r in warc.op8_warc(spark, str(tmp_path)).collect()), key=str)
    want = []
    for pid, _, html in rows:
        body = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == body and p is not None]
        kept = max(same, default=None) if len(body) >= 1000 else None
        revisit = kept is not None and pid != kept
        want.append((pid, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response",
                     kept if revisit else None))
    assert got == sorted(want, key=str)


def test_empty_pages(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(empty)).count() == 0


def test_damaged_members_are_reported_and_skipped(spark):
    parts = [warc._member("response", k, None, "u", hashlib.sha1(b"p%d" % k).hexdigest(), 2, b"p%d" % k) for k in range(3)]
    broken = parts[0] + parts[1][:20] + b"\0\0\0" + parts[1][23:] + parts[2]
    rows = warc.read_archives(spark.createDataFrame([("a", bytearray(broken)), ("b", bytearray(parts[2][:-9])), ("c", None)],
                                                    "archive string, content binary")).collect()
    good = [(r.archive, r.page_id, bytes(r.payload)) for r in rows if r.error is None]
    assert good == [("a", 0, b"p0"), ("a", 2, b"p2")]
    assert any(r.error for r in rows if r.archive == "a") and any(r.error for r in rows if r.archive == "b")


def test_wrong_digest_is_found():
    bad = warc._member("response", 1, None, "u", "0" * 40, 1, b"p")
    (_, record), = warc.members(bad)
    with pytest.raises(ValueError):
        warc.parse(record)


def test_communication_matrix_is_exact_and_uniform():
    counts = [5, 0, 17, 3, 100]
    m = shard.communication_matrix(counts, 8, 1)
    assert m.sum(axis=1).tolist() == counts
    assert sorted(set(m.sum(axis=0).tolist())) == [15, 16] and m.sum() == 125
    mean = np.mean([shard.communication_matrix(counts, 8, s) for s in range(400)], axis=0)
    assert np.abs(mean - np.outer(counts, m.sum(axis=0)) / 125).max() < 0.6


def test_large_draw_follows_the_law():
    rng = np.random.default_rng(1)
    good, bad, n = 3 * 10**9, 7 * 10**9, 1000
    x = np.array([shard._hypergeometric(rng, good, bad, n) for _ in range(3000)])
    assert abs(x.mean() - 300) < 1.5 and abs(x.std() - np.sqrt(210)) < 0.8


@pytest.mark.parametrize("n", [0, 1, 7, 8, 1003])
def test_shards_are_balanced_and_gapless(spark, n):
    rows = [(k % 50 if k % 9 else None, None if k % 7 == 0 else "t%d" % (k % 13)) for k in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, n string").repartition(3)
    out = shard.shard_rows(df, 8, staged=True, block_rows=20).collect()
    assert sorted(map(str, ((r.doc_id, r.n) for r in out))) == sorted(map(str, rows))
    slots = {s: sorted(r.slot for r in out if r.shard == s) for s in range(8)}
    assert all(v == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_same_seed_same_shards(spark):
    df = spark.range(500).repartition(4, "id")
    a, b = ({(r.id, r.shard, r.slot) for r in shard.shard_rows(df, 8, seed=3).collect()} for _ in range(2))
    c = {(r.id, r.shard, r.slot) for r in shard.shard_rows(df, 8, seed=4).collect()}
    assert a == b and a != c
