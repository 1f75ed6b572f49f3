from pyspark.sql import functions as F

from quarry.operators import detect as det
from quarry.operators import findings as fnd
from quarry.operators import retrieval as ret
from quarry.operators import workflow as wf
from quarry.operators.rules import DEFAULT_RULES, rule_findings


def test_detector_registry_order_and_failures(spark):
    files = spark.createDataFrame([("a.py", "print(1)\n")], "path string, content string")
    reg = fnd.DetectorRegistry()
    reg.register("rules", lambda f: rule_findings(f, [r for r in DEFAULT_RULES if r.rule == "debug_print"]))
    reg.register("broken", lambda f: (_ for _ in ()).throw(RuntimeError("tool missing")))
    reg.register("same", lambda f: rule_findings(f, [r for r in DEFAULT_RULES if r.rule == "debug_print"]))
    out, errors = reg.run(files)
    assert reg.names == ["rules", "broken", "same"]
    assert len(errors) == 1 and "tool missing" in errors[0]
    kept = fnd.dedup_findings(out).collect()
    assert len(kept) == 1 and kept[0].detector_ord == 0


def test_add_chunks_and_rehydrate_defaults(spark):
    index = spark.createDataFrame([], "id string, entity_type string, name string, content string, file_path string, "
                                      "start_line int, end_line int, parent string, docstring string, signature string, "
                                      "imports array<string>")
    chunks = spark.createDataFrame([("x = 1\ny = 2", "a.py", 1, "a.py", ".py", 2, True)],
                                   "content string, file_path string, start_line int, filename string, extension string, "
                                   "end_line int, is_file_level boolean")
    once = ret.add_chunks(index, chunks)
    twice = ret.add_chunks(once, chunks)
    assert twice.count() == 1 and twice.first().id == "a.py:1:2:a.py"
    rec = spark.createDataFrame([("r1", "# h\n\n```python\n  code()  \n```", '{"name": "f", "custom": "v"}', 0.25),
                                 ("r2", "plain text", "{}", 2.0)], "id string, document string, metadata string, distance double")
    rows = {r.id: r for r in ret.rehydrate(rec).collect()}
    assert rows["r1"].name == "f" and rows["r1"].content == "code()" and rows["r1"].extra == {"custom": "v"}
    assert rows["r1"].similarity_score == 0.75 and rows["r2"].similarity_score == -1.0
    r2 = rows["r2"]
    assert (r2.entity_type, r2.name, r2.file_path, r2.start_line, r2.end_line, r2.imports) == \
        ("STANDALONE", "unknown", "unknown.py", 1, 1, [])


def test_render_prompt_values_not_rescanned(spark):
    df = spark.createDataFrame([("planner", "fix {max_retries} now", 3), ("ghost", "x", 1)],
                               "role string, user_goal string, max_retries int")
    out = {r.role: r for r in wf.render_prompt(df, [("planner", "Goal: {user_goal} / {max_retries}")], "role",
                                               ("user_goal", "max_retries")).collect()}
    assert out["planner"].prompt == "Goal: fix {max_retries} now / 3" and out["planner"].prompt_error is None
    assert out["ghost"].prompt is None and out["ghost"].prompt_error == "unknown role: ghost"


def test_parse_reviews_defaults(spark):
    ents = spark.createDataFrame([("e1", "f", "a.py", 10, 20, None, "def f():\n    pass")],
                                 "id string, name string, file_path string, start_line int, end_line int, parent string, content string")
    replies = spark.createDataFrame([
        ("e1", 'ok {"issues": [{"line": 12, "severity": "error", "message": "m1", "suggestion": "s"},'
               ' {"severity": "weird"}, {"message": "m3", "severity": "info"}]} end'),
        ("e1", "no json here"), ("e1", '["list"]')], "entity_id string, reply string")
    rows = sorted(det.parse_reviews(replies, ents).collect(), key=lambda r: r.emit_ord)
    assert [(r.line_number, r.severity, r.message, r.suggested_fix) for r in rows] == [
        (12, "ERROR", "m1", "s"), (10, "WARNING", "Issue found", None), (10, "INFO", "m3", None)]
    assert rows[0].metadata == {"function": "f", "analyzed_by": "LLM"} and rows[0].error_code == "llm-discovery"


def test_a_users_events_are_one_reply(spark, tmp_path):
    from quarry.plans import catalog
    spark.createDataFrame([(i * 7, 1, "view", '{"k": 1}') for i in range(700)],
                          "event_id long, user_id long, event_type string, props string").write.parquet(f"{tmp_path}/events.parquet")
    reply, = catalog._review_replies(spark, str(tmp_path)).collect()
    assert reply.doc_id == 1 and reply.reply.count('"severity"') == 700
