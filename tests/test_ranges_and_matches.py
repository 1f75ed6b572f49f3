"""Islands, innermost entities, description matches and call metrics against plain versions."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import entities as ent
from quarry.operators import findings as fnd
from quarry.operators import traces as trc
from quarry.operators import workflow as wf


def islands(ranges, gap):
    out = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1] + gap:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


@pytest.mark.parametrize("gap", [0, 1, 3])
def test_islands_inside_a_row_and_over_rows(spark, gap):
    rng = random.Random(gap)
    files = {f"f{k}": [(s, s + rng.randrange(0, 6)) for s in (rng.randrange(1, 80) for _ in range(rng.randrange(0, 25)))] for k in range(40)}
    rows = [(k, [s for s, _ in v], [e for _, e in v]) for k, v in files.items()]
    df = spark.createDataFrame(rows, "k string, s array<int>, e array<int>")
    got = {r.k: [(b.start_line, b.end_line) for b in r.b] for r in df.select("k", ent.merge_ranges(F.col("s"), F.col("e"), gap).alias("b")).collect()}
    assert got == {k: islands(v, gap) for k, v in files.items()}
    flat = spark.createDataFrame([(k, s, e) for k, v in files.items() for s, e in v], "k string, start_line int, end_line int")
    over = sorted((r.k, r.block, r.start_line, r.end_line) for r in ent.merge_intervals(flat, "k", gap=gap).collect())
    assert over == sorted((k, n + 1, s, e) for k, v in files.items() for n, (s, e) in enumerate(islands(v, gap)))


def test_paragraphs(spark):
    df = spark.createDataFrame([("a", "x\ny\n\n\t \nz"), ("b", ""), ("c", "\n\n"), ("d", None), ("e", "one")], "path string, content string")
    got = sorted(map(tuple, ent.paragraph_blocks(df).collect()))
    assert got == [("a", 1, 1, 2), ("a", 2, 5, 5), ("e", 1, 1, 1)]


@pytest.mark.parametrize("lines", [1 << 16, 7])
def test_innermost_entity_by_one_sweep(spark, lines):
    rng = random.Random(lines)
    ents = []
    for k in range(150):
        s = rng.randrange(1, 200)
        ents.append((f"p{k % 3}", f"id{k:03}", f"n{k}", s, s + rng.choice([0, 1, 5, 40, 150])))
    ents += [(None, "x", "x", 1, 500), ("p0", "y", "y", 9, 3), ("p0", None, "z", 250, 251)]
    found = [(f"p{rng.randrange(4)}", rng.randrange(1, 360), f"m{k}", k) for k in range(400)]
    found += [("p0", None, "no line", 900), (None, 5, "no path", 901), ("p0", 250, "null id", 902)] + found[:3]
    edf = spark.createDataFrame(ents, "file_path string, id string, name string, start_line int, end_line int").repartition(3)
    fdf = fnd.to_findings(spark.createDataFrame(found, "file_path string, line_number int, message string, emit_ord long")).repartition(4)
    got = fnd.attach_entity(fdf, edf, lines)
    assert got.columns == [*fdf.columns, "entity_id", "entity_name", "e_start", "e_end"]

    def best(path, line):
        inside = [e for e in ents if e[0] == path and path is not None and line is not None and e[3] <= line <= e[4]]
        e = min(inside, key=lambda e: (e[4] - e[3], -e[3], e[1] or ""), default=None)
        return (None,) * 4 if e is None else (e[1], e[2], e[3], e[4])

    want = sorted(((p, n, m, o, *best(p, n)) for p, n, m, o in found), key=str)
    rows = got.select("file_path", "line_number", "message", "emit_ord", "entity_id", "entity_name", "e_start", "e_end").collect()
    assert sorted(map(tuple, rows), key=str) == want


@pytest.mark.parametrize("together", [5000, 3])
def test_match_finding_equals_a_search_of_all_pairs(spark, monkeypatch, together):
    monkeypatch.setattr(fnd, "TOGETHER", together)
    rng = random.Random(together)
    words = ["Null", "bound", "zero", "File", "ÄRGER", "x"]
    found = [("hot" if rng.random() < 0.8 else f"p{rng.randrange(3)}", " ".join(rng.choice(words) for _ in range(4)), rng.randrange(3), k) for k in range(500)]
    found += [("hot", None, 0, 900), ("hot", "", None, None)]
    asked = [(k, rng.choice(["hot", "p0", "p1", "none"]), " ".join(rng.choice(words) for _ in range(rng.randrange(1, 4))).upper()) for k in range(60)]
    asked += [(100, "hot", ""), (101, "hot", None), (102, None, "x"), (103, "p0", "nowhere")]
    fdf = fnd.to_findings(spark.createDataFrame(found, "file_path string, message string, detector_ord int, emit_ord long").withColumn("line_number", F.lit(1)))
    rdf = spark.createDataFrame(asked, "req_id long, file_path string, description string")
    got = {r.req_id: (r.message, r.detector_ord, r.emit_ord) for r in fnd.match_finding(fdf.repartition(5), rdf).collect()}
    order = lambda f: (-1 if f[2] is None else f[2], -1 if f[3] is None else f[3])
    want = {}
    for req, path, text in asked:
        hits = [f for f in found if f[0] == path and path and f[1] is not None and text is not None and text.lower() in f[1].lower()]
        if hits:
            want[req] = min(hits, key=order)[1:]
    assert got == want


def test_call_metrics_exact_and_from_the_sketch(spark):
    rng = np.random.default_rng(3)
    rows = [(a, int(rng.integers(1, 9)) if rng.random() < 0.9 else None, float(np.round(x, 2)) if rng.random() < 0.95 else None)
            for a, n in (("hot", 20000), ("cold", 37), ("one", 1)) for x in rng.exponential(50, n)]
    rows += [("none", None, None)]
    df = spark.createDataFrame(rows, "agent string, tokens int, latency_ms double").repartition(4)
    exact = {r.agent: r for r in trc.call_metrics(df, ["agent"]).collect()}
    near = {r.agent: r for r in trc.call_metrics(df, ["agent"], exact=False).collect()}
    for a in ("hot", "cold", "one"):
        mine = np.array([x for g, _, x in rows if g == a and x is not None])
        tokens = [t for g, t, _ in rows if g == a and t is not None]
        assert exact[a].calls == near[a].calls == sum(g == a for g, _, _ in rows)
        assert exact[a].tokens == near[a].tokens == (sum(tokens) if tokens else None)
        if len(mine):
            assert abs(exact[a].p95_latency_ms - np.percentile(mine, 95)) < 1e-6
            assert abs(exact[a].mean_latency_ms - mine.mean()) < 1e-5
            assert abs((mine <= near[a].p95_latency_ms).mean() - 0.95) <= 0.005 + 1 / len(mine)
    assert (exact["none"].calls, exact["none"].p95_latency_ms, exact["none"].mean_latency_ms) == (1, None, None)


def test_outcomes_from_a_log_with_ties_and_a_hot_goal(spark):
    rng = random.Random(6)
    goals = [(g, g % 4) for g in range(50)] + [(77, 3)]
    log = [(g, rng.randrange(8), rng.random() < 0.2) for g in range(50) for _ in range(rng.randrange(12))] + [(0, 3, False)] * 3000
    got = {r.goal_id: tuple(r)[1:] for r in wf.outcomes_from_log(
        spark.createDataFrame(log, "goal_id long, ts long, approved boolean").repartition(4),
        spark.createDataFrame(goals, "goal_id long, max_retries int")).collect()}
    want = {}
    for g, retries in goals:
        mine = [x for x in log if x[0] == g]
        ok = min((t for _, t, a in mine if a), default=None)
        before = sum(t < ok for _, t, _ in mine) if ok is not None else None
        used = min(len(mine), retries + 1)
        want[g] = ("approved", before, used) if ok is not None and before <= retries else ("rejected", retries, used) if len(mine) > retries else \
            ("open", max(len(mine) - 1, 0), used)
    assert got == want
