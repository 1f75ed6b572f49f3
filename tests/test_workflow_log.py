"""Logged runs against a plain state machine; the stream over several batches and restarts."""
import json
import os
import random

from quarry.operators import workflow as wf
from quarry.streaming.jobs import run_transitions_to_table

LOG = "goal_id long, seq long, stage string, content string"


def run(rng, goal, max_retries):
    """A log in the order of the protocol, and the moves and the end that it means."""
    log, moves, seq = [], [], 0

    def say(stage, content):
        nonlocal seq
        seq += 1
        log.append((goal, seq, stage, content))

    goal_text = f"goal number {goal}"
    broken = rng.random() < 0.3
    say("plan", "no json" if broken else json.dumps({"search_query": "find it", "keywords": []}))
    moves.append((goal, seq, "planning", "retrieving", "Query: " + (goal_text if broken else "find it"), 0))
    say("retrieve", str(n := rng.randrange(6)))
    moves.append((goal, seq, "retrieving", "coding", f"Retrieved {n} entities", 0))
    status, retry, fix, said = "coding", 0, None, (None, [])
    while status == "coding":
        if rng.random() < 0.1:
            return log, moves, (status, retry, fix, *said)
        kind = rng.choice(["json", "json", "raw", "none"] if retry else ["json", "raw"])
        fix = {"json": f"fix {retry}", "raw": "raw text", "none": ""}[kind]
        say("code", fix if kind == "raw" else json.dumps({"proposed_fix": fix, "confidence_score": 0.75}))
        moves.append((goal, seq, "coding", "reviewing", f"Fix generated, confidence: {'0.50' if kind == 'raw' else '0.75'}", retry))
        if kind == "none":
            moves.append((goal, seq, "reviewing", "rejected", "No fix was generated", retry))
            return log, moves, ("rejected", retry, fix, *said)
        if rng.random() < 0.1:
            return log, moves, ("reviewing", retry, fix, *said)
        ok = rng.choice([True, False, False, False, None])
        said = ("Auto-approved (parse error)", []) if ok is None else (f"said {retry}", ["a"])
        say("review", "looks fine" if ok is None else f"Well: {json.dumps({'is_approved': ok, 'feedback': said[0], 'issues': said[1]})}.")
        status = "approved" if ok in (True, None) else "coding" if retry < max_retries else "rejected"
        note = {"approved": "Fix passed review", "coding": f"Rejected, preparing retry #{retry + 1}",
                "rejected": f"Max retries ({max_retries}) exceeded"}[status]
        moves.append((goal, seq, "reviewing", status, note, retry))
        retry += status == "coding"
    say("code", "too late")
    say("review", "too late")
    return log, moves, (status, retry, fix, *said)


def corpus():
    rng = random.Random(12)
    goals = [(g, f"goal number {g}", g % 4) for g in range(60)]
    runs = [run(rng, g, r) for g, _, r in goals]
    return goals + [(99, "goal without a log", 2)], [x for log, _, _ in runs for x in log], [m for _, ms, _ in runs for m in ms], {g: runs[g][2] for g in range(60)}


def test_transitions_and_results_from_a_log(spark):
    goals, log, moves, ends = corpus()
    gdf = spark.createDataFrame(goals, "goal_id long, user_goal string, max_retries int")
    odd = [(5, 0, "other", "x"), (1234, 1, "plan", "of no goal")]
    steps = wf.steps_from_log(spark.createDataFrame(log + odd, LOG).repartition(4), gdf)
    assert sorted(map(tuple, wf.transitions_from_log(steps).collect())) == sorted(moves)
    steps = wf.steps_from_log(spark.createDataFrame(log, LOG).repartition(4), gdf)
    assert sorted(map(tuple, wf.transitions_from_log(steps).collect())) == sorted(moves)
    got = {r.goal_id: (r.status, r.retry_count, r.proposed_fix, r.feedback, r.issues) for r in wf.run_from_log(steps, gdf).collect()}
    assert got.pop(99) == ("planning", 0, None, None, []) and got == ends


def test_hot_goal_and_empty_log(spark):
    gdf = spark.createDataFrame([(1, "goal number one", 10), (2, "goal number two", 0)], "goal_id long, user_goal string, max_retries int")
    hot = [(1, 2 * k + d, s, c) for k in range(2000) for d, s, c in ((0, "code", "x"), (1, "review", '{"is_approved": false}'))]
    moves = wf.transitions_from_log(wf.steps_from_log(spark.createDataFrame(hot, LOG), gdf)).collect()
    assert len(moves) == 22 and max(moves, key=lambda r: r.seq).to_status == "rejected"
    none = wf.steps_from_log(spark.createDataFrame([], LOG), gdf)
    assert wf.transitions_from_log(none).count() == 0
    assert sorted((r.goal_id, r.status) for r in wf.run_from_log(none, gdf).collect()) == [(1, "planning"), (2, "planning")]


def test_stream_gives_the_same_moves_over_batches_and_restarts(spark, tmpdir_path):
    goals, log, moves, _ = corpus()
    gdf = spark.createDataFrame(goals, "goal_id long, user_goal string, max_retries int")
    src, out, ck = (os.path.join(tmpdir_path, x) for x in ("log", "moves", "ck"))
    cut = {g: random.Random(g).randrange(1, 6) for g, _, _ in goals}
    parts = ([x for x in log if x[1] <= cut[x[0]]], [x for x in log if x[1] > cut[x[0]]])
    schema = spark.createDataFrame([], LOG).schema
    for part in parts:  # the second run goes on from the first one's state
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(src)
        run_transitions_to_table(spark, src, schema, gdf, out, ck)
    run_transitions_to_table(spark, src, schema, gdf, out, ck)  # nothing new
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(moves)


def test_ingest_goes_on_after_a_restart_without_reading_the_index(spark, tmpdir_path):
    from quarry.streaming.jobs import stream_ingest
    src, idx, ck = (os.path.join(tmpdir_path, x) for x in ("src", "idx", "ck"))
    os.makedirs(src)

    def add(name, text):
        with open(os.path.join(src, name), "w") as f:
            f.write(text)

    add("a.py", "def f():\n    return 1\n")
    stream_ingest(spark, src, idx, ck)
    add("b.py", "def g():\n    return 2\n")
    stream_ingest(spark, src, idx, ck)
    stream_ingest(spark, src, idx, ck)
    assert sorted(r.name for r in spark.read.parquet(idx).collect()) == ["f", "g"]
    os.utime(os.path.join(src, "a.py"))  # the same file under the same name: its ids are known
    stream_ingest(spark, src, idx, ck)
    assert sorted(r.name for r in spark.read.parquet(idx).collect()) == ["f", "g"]
    again = os.path.join(tmpdir_path, "again")
    stream_ingest(spark, src, again, os.path.join(tmpdir_path, "ck2"))  # a replay from the beginning
    assert sorted(r.id for r in spark.read.parquet(again).collect()) == sorted(r.id for r in spark.read.parquet(idx).collect())


def test_processor_travels_without_the_package(tmp_path):
    """Spark's worker on the driver reads the processor, and has no path to the package."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    from quarry.streaming.jobs import _goal_processor
    (tmp_path / "p").write_bytes(cloudpickle.dumps(_goal_processor()))
    code = "import pickle, sys; print(type(pickle.load(open('p', 'rb'))).__name__)"
    seen = subprocess.run([sys.executable, "-I", "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert seen.stdout.strip() == "Goal", seen.stderr


def test_stream_reads_a_table_of_one_or_many_files(spark, tmp_path):
    from quarry.plans import workflow_queries as wq
    c = spark.createDataFrame([(i, t, "user", f"text {i} {t}") for i in range(4) for t in range(3)], "conv_id long, turn long, role string, text string")
    many, one = tmp_path / "many", tmp_path / "one"
    c.repartition(3).write.parquet(f"{many}/conversations.parquet")
    one.mkdir()
    c.toPandas().to_parquet(one / "conversations.parquet")
    want = sorted(map(tuple, wq.workflow_transitions(spark, str(one)).collect()))
    assert want and all(sorted(map(tuple, wq.workflow_transitions_stream(spark, str(d)).collect())) == want for d in (one, many))
