import os

import pytest

from pyspark.sql import functions as F

from quarry.operators import retrieval as ret
from quarry.streaming.jobs import run_rates_to_table, stream_ingest


def test_stream_rates_drops_late_rows(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "src")
    rows = [(1, "2024-01-01 00:10:00", "a"), (2, "2024-01-01 01:10:00", "a"), (3, "2024-01-01 05:00:00", "a")]
    df = spark.createDataFrame(rows, "id long, ts string, event_type string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(os.path.join(src, "b1"))
    late = spark.createDataFrame([(4, "2024-01-01 00:20:00", "a")], "id long, ts string, event_type string") \
        .withColumn("ts", F.to_timestamp("ts"))
    out, ck = os.path.join(tmpdir_path, "out"), os.path.join(tmpdir_path, "ck")
    run_rates_to_table(spark, os.path.join(src, "*"), df.schema, out, ck)
    late.write.parquet(os.path.join(src, "b2"))
    run_rates_to_table(spark, os.path.join(src, "*"), df.schema, out, ck)
    res = {str(r.window_start): r.n for r in spark.read.parquet(out).collect()}
    # the 00:00 window closed with one row; the late row behind the watermark is dropped
    assert res.get("2024-01-01 00:00:00") == 1


def test_stream_ingest_idempotent(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "code")
    os.makedirs(src)
    with open(os.path.join(src, "a.py"), "w") as fh:
        fh.write("def f(x):\n    return x\n")
    idx, ck = os.path.join(tmpdir_path, "idx"), os.path.join(tmpdir_path, "ck2")
    stream_ingest(spark, src, idx, ck)
    with open(os.path.join(src, "b.py"), "w") as fh:
        fh.write("class C:\n    def m(self):\n        pass\n")
    stream_ingest(spark, src, idx, ck)
    names = sorted(r.name for r in spark.read.parquet(idx).collect())
    assert names == ["C", "f", "m"]


def test_vector_topk_scores_and_ties(spark):
    idx = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [2.0, 0.0])],
                                "id long, embedding array<float>")
    q = spark.createDataFrame([(10, [0.0, 0.0])], "qid long, embedding array<float>")
    top = ret.vector_topk(q, idx, 3).collect()
    assert [(r.id, r.distance, r.score) for r in top] == [(1, 0.0, 1.0), (2, 1.0, 0.0), (3, 1.0, 0.0)]
    f = ret.vector_topk(q, idx, 5, where=F.col("id") >= 4).collect()
    assert [(r.id, r.score) for r in f] == [(4, -3.0)]
    empty = ret.vector_topk(q, idx.filter("id > 100"), 5)
    goals = q.select("qid")
    r = ret.retrieve(goals, empty, "qid", ("id",)).collect()
    assert len(r) == 1 and r[0].context == []


def test_hybrid_and_glob(spark):
    sim = spark.createDataFrame([(1, 7, 0.5)], "qid long, doc_id long, similarity double")
    kw = spark.createDataFrame([(1, 7, 1.0), (1, 8, 0.5)], "qid long, doc_id long, keyword_score double")
    h = {r.doc_id: r.score for r in ret.hybrid_topk(sim, kw).collect()}
    assert h == {7: 0.65, 8: 0.15}
    assert ret.glob_regex("src/*.py") == r"(?s)^src\/.*\.py$"
    df = spark.createDataFrame([("src/a.py",), ("src/b.txt",), ("lib/c.py",)], "p string")
    assert [r.p for r in ret.glob_filter(df, "p", "src/*.py").collect()] == ["src/a.py"]


def test_upsert_and_stats(spark):
    idx = spark.createDataFrame([(1, "A"), (2, None)], "id long, entity_type string")
    new = spark.createDataFrame([(2, "B"), (3, "C"), (3, "D")], "id long, entity_type string")
    u = ret.upsert_index(idx, new, order="entity_type")
    assert sorted((r.id, r.entity_type) for r in u.collect()) == [(1, "A"), (2, None), (3, "C")]
    st = {r.entity_type: r.n for r in ret.index_stats(u).collect()}
    assert st == {"A": 1, "UNKNOWN": 1, "C": 1}


def test_vector_topk_exact_across_batches(spark):
    import numpy as np
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, "37")
    try:
        rng = np.random.default_rng(5)
        X = rng.integers(0, 4, size=(400, 3)).astype(float)       # many exact ties
        idx = spark.createDataFrame([(i, X[i].tolist()) for i in range(400)], "id long, embedding array<float>")
        Q = X[:25]
        q = spark.createDataFrame([(i, Q[i].tolist()) for i in range(25)], "qid long, embedding array<float>")
        got = {(r.qid, r.rank): r.id for r in ret.vector_topk(q, idx.coalesce(2), 5).collect()}
        for i in range(25):
            d = ((X - Q[i]) ** 2).sum(1)
            want = sorted(range(400), key=lambda j: (d[j], j))[:5]
            assert [got[(i, r)] for r in range(1, 6)] == want
    finally:
        spark.conf.set(key, old)


@pytest.mark.parametrize("block,part,together", [(2048, 1 << 20, 256), (3, 50, 2)])
def test_vector_grid_of_many_cells_equals_all_pairs(spark, monkeypatch, block, part, together):
    import numpy as np
    monkeypatch.setattr(ret, "QUERY_BLOCK", block)
    monkeypatch.setattr(ret, "PART_ROWS", part)
    monkeypatch.setattr(ret, "QUERIES_TOGETHER", together)
    X = np.random.default_rng(8).integers(0, 3, size=(300, 4)).astype(float)
    rows = [(i, X[i].tolist()) for i in range(300)]
    idx = spark.createDataFrame(rows + [(900, None)], "id long, embedding array<double>").repartition(5)
    q = spark.createDataFrame(rows[:20] + rows[:1] + [(800, None)], "qid long, embedding array<double>")
    got = {(r.qid, r["rank"]): r.id for r in ret.vector_topk(q, idx, 4).collect()}
    assert len(got) == 80
    for i in range(20):
        d = ((X - X[i]) ** 2).sum(1)
        assert [got[i, r] for r in range(1, 5)] == sorted(range(300), key=lambda j: (d[j], j))[:4]
    plan = ret.vector_topk(q, idx, 4)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    none = ret.vector_topk(q.filter("qid < 0"), idx, 4)
    assert none.count() == 0


def _all_scores(docs, queries):
    """Plain TF-IDF cosine and keyword share of every pair that shares a term."""
    import math
    import re
    from collections import Counter
    tok = lambda t: re.findall(r"\w+", (t or "").lower())
    tfs = {d: Counter(tok(t)) for d, t in docs}
    df = Counter(w for c in tfs.values() for w in c)
    idf = lambda w: math.log((1 + len(docs)) / (1 + df[w])) + 1
    out = []
    for q, t in queries:
        qtf = Counter(tok(t))
        qn = math.sqrt(sum((c * idf(w)) ** 2 for w, c in qtf.items()))
        for d, tf in tfs.items():
            both = set(tf) & set(qtf)
            if both:
                dn = math.sqrt(sum((c * idf(w)) ** 2 for w, c in tf.items()))
                sim = sum(tf[w] * qtf[w] * idf(w) ** 2 for w in both) / dn / qn
                kw = len(both) / len(qtf)
                out.append((q, d, sim, kw, 0.7 * sim + 0.3 * kw))
    return out


@pytest.mark.parametrize("block,together", [(2048, 1 << 21), (4, 20)])
def test_text_topk_equals_all_pairs_with_hot_terms(spark, monkeypatch, block, together):
    import random
    monkeypatch.setattr(ret, "QUERY_BLOCK", block)
    monkeypatch.setattr(ret, "SCORES_TOGETHER", together)
    rnd = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"] + [f"rare{i}" for i in range(200)]
    docs = [(i, "the of " + " ".join(rnd.choice(words[:8] if rnd.random() < .7 else words) for _ in range(rnd.randint(1, 30)))) for i in range(150)]
    docs += [(900, None), (901, ""), (902, "the"), (903, docs[3][1])]
    queries = [(j, "the of " + " ".join(rnd.sample(words, 4))) for j in range(12)] + [(50, "the"), (51, "unknown"), (52, None), (53, "unknown the")]
    ddf = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    qdf = spark.createDataFrame(queries, "qid long, text string")
    index = ret.build_text_index(ddf)
    plain = _all_scores(docs, queries)
    for at, rank_by in ((2, "similarity"), (3, "keyword_score"), (4, "score")):
        want = set()
        for q, _ in queries:
            best = sorted((r for r in plain if r[0] == q), key=lambda r: (-round(r[at], 6), r[1]))[:5]
            want |= {(q, r[1], n + 1, round(r[at], 5)) for n, r in enumerate(best)}
        got = {(r.qid, r.doc_id, r["rank"], round(r[rank_by], 5)) for r in ret.text_topk(qdf, index, 5, rank_by).collect()}
        assert {x[:3] for x in got} == {x[:3] for x in want}, rank_by
    assert ret.text_topk(qdf, ret.build_text_index(ddf.filter("doc_id < 0")), 5).count() == 0


def test_string_ids_rank_like_whole_numbers(spark):
    import random
    rng = random.Random(4)
    vecs = [[float(rng.randrange(5)) for _ in range(3)] for _ in range(60)]
    texts = [" ".join(rng.choice(["red", "blue", "green", "tea", "cup"]) for _ in range(6)) for _ in range(60)]
    rows = [(100 + i, f"r{100 + i}", v, t) for i, (v, t) in enumerate(zip(vecs, texts))]
    df = spark.createDataFrame(rows, "n long, s string, embedding array<float>, text string").repartition(3)
    q = df.filter("n % 10 = 0")
    whole = ret.vector_topk(q.withColumnRenamed("n", "q"), df, 4, qid="q", id_col="n").collect()
    text = ret.vector_topk(q.withColumnRenamed("s", "q"), df, 4, qid="q", id_col="s").collect()
    assert {(f"r{r.q}", f"r{r.n}", r.distance, r["rank"]) for r in whole} == {(r.q, r.s, r.distance, r["rank"]) for r in text}
    whole = ret.text_topk(q.withColumnRenamed("n", "q"), ret.build_text_index(df, "n"), 4, qid="q", did="n").collect()
    text = ret.text_topk(q.withColumnRenamed("s", "q"), ret.build_text_index(df, "s"), 4, qid="q", did="s").collect()
    assert {(f"r{r.q}", f"r{r.n}", r.score, r["rank"]) for r in whole} == {(r.q, r.s, r.score, r["rank"]) for r in text}


def test_stream_and_batch_give_the_same_ids(spark, tmpdir_path):
    from quarry.operators.entities import entity_id
    from quarry.operators.extract import extract_entities
    from quarry.sources.files import keep_utf8, scan_files
    src = os.path.join(tmpdir_path, "src dir")
    os.makedirs(os.path.join(src, "sub"))
    with open(os.path.join(src, "sub", "a b.py"), "wb") as fh:
        fh.write(b"def f():\r\n    pass\r\n")
    with open(os.path.join(src, "bad.py"), "wb") as fh:
        fh.write(b"\xff\xfe")
    idx = os.path.join(tmpdir_path, "idx3")
    stream_ingest(spark, src, idx, os.path.join(tmpdir_path, "ck3"))
    batch = extract_entities(keep_utf8(scan_files(spark, src))[0]).withColumn("id", entity_id())
    assert {(r.id, r.content) for r in spark.read.parquet(idx).collect()} == {(r.id, r.content) for r in batch.collect()} != set()


def test_text_index_moves_hashes_not_words(spark):
    """Rows of one id (null too) are one document; no term is stored or moved as text."""
    docs = spark.createDataFrame([(1, "red blue"), (1, "blue tea"), (None, "red"), (2, None)], "doc_id long, text string").repartition(3)
    index = ret.build_text_index(docs)
    assert index.docs.dtypes == [("doc", "bigint"), ("norm", "double"), ("t", "array<bigint>"), ("tf", "array<int>")]
    assert index.terms.dtypes == [("t", "bigint"), ("idf", "double")]
    assert {r.doc: sorted(r.tf) for r in index.docs.collect()} == {1: [1, 1, 2], None: [1]}
