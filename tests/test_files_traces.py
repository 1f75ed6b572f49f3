import os

from pyspark.sql import functions as F

from quarry.operators import findings as fnd
from quarry.operators import traces as trc
from quarry.sources import files as fs
from quarry.sources import reports as rp


def _mk(d, rel, data: bytes):
    p = os.path.join(d, rel)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "wb") as fh:
        fh.write(data)


def test_scan_utf8_and_test_names(spark, tmpdir_path):
    _mk(tmpdir_path, "a/x.py", b"print(1)\r\nprint(2)\r\n")
    _mk(tmpdir_path, "a/Test_x.py", b"x = 1\n")
    _mk(tmpdir_path, "test/y.py", b"y = 2\n")
    _mk(tmpdir_path, "a/bin.py", b"\xff\xfe\x00")
    _mk(tmpdir_path, "a/notes.txt", b"text\n")
    _mk(tmpdir_path, "a/tool.pyw", b"z = 3\n")
    raw = fs.scan_files(spark, tmpdir_path)
    good, bad = fs.keep_utf8(raw)
    names = sorted(r.file_name for r in good.collect())
    assert names == ["Test_x.py", "tool.pyw", "x.py", "y.py"]
    assert [r.key.endswith("bin.py") for r in bad.collect()] == [True]
    x = good.filter(F.col("file_name") == "x.py").first()
    assert x.content == "print(1)\nprint(2)\n"
    kept = sorted(r.file_name for r in fs.drop_tests(good).collect())
    assert kept == ["tool.pyw", "x.py", "y.py"]          # directory named test is kept
    assert fs.count_files(good, include_tests=False).first().files == 3
    assert fs.count_files(good).first().files == 4


def test_route_reports_and_sinks(spark, tmpdir_path):
    rep = os.path.join(tmpdir_path, "reports")
    _mk(rep, "junit.xml", b'<testsuite><testcase name="t" file="a.py" line="3"><failure message="m">x</failure>'
                          b'</testcase></testsuite>')
    _mk(rep, "r.json", b'{"tests": [{"nodeid": "b::c", "outcome": "failed", "call": {"crash": {"path": "b.py", "lineno": 4}}}]}')
    _mk(rep, "out.txt", b"ERROR c.py::t - broke\n")
    f = rp.read_test_reports(spark, rep).rows
    assert sorted(r.file_path for r in f.collect()) == ["a.py", "b.py", "c.py"]
    idx = os.path.join(tmpdir_path, "index")
    ents = spark.createDataFrame([("FUNCTION", "f", "a.py"), ("CLASS", "C", "a.py")], "entity_type string, name string, file_path string")
    fs.write_index(ents, idx)
    assert sorted(d for d in os.listdir(idx) if d.startswith("entity_type=")) == ["entity_type=CLASS", "entity_type=FUNCTION"]
    assert spark.read.parquet(idx).filter("entity_type = 'CLASS'").count() == 1


def test_attach_innermost_entity(spark):
    ents = spark.createDataFrame([("a.py:1:400:C", "C", "a.py", 1, 400), ("a.py:200:260:m", "m", "a.py", 200, 260),
                                  ("b.py:1:5:g", "g", "b.py", 1, 5)],
                                 "id string, name string, file_path string, start_line int, end_line int")
    f = fnd.to_findings(spark.createDataFrame([("a.py", 250, "x"), ("a.py", 10, "y"), ("a.py", 500, "z"), ("b.py", 3, "w")],
                                              "file_path string, line_number int, message string"))
    got = {r.message: r.entity_id for r in fnd.attach_entity(f, ents, lines=16).collect()}
    assert got == {"x": "a.py:200:260:m", "y": "a.py:1:400:C", "z": None, "w": "b.py:1:5:g"}


def test_transitions_and_messages(spark):
    log = spark.createDataFrame([(1, i, s) for i, s in enumerate(
        ["planning", "retrieving", "coding", "reviewing", "coding", "reviewing", "approved"])],
        "run long, seq long, status string")
    dense = {(r.from_status, r.to_status): r.n for r in trc.transition_matrix(log, "run", "seq", "status").collect()}
    gaps = log.withColumn("seq", log["seq"] * 10)
    win = {(r.from_status, r.to_status): r.n for r in trc.transition_matrix(gaps, "run", "seq", "status").collect()}
    assert dense == win and sum(dense.values()) == 6 and dense[("reviewing", "coding")] == 1
    chunks = spark.createDataFrame([(1, 2, "c"), (1, 0, "a"), (1, 1, "b"), (2, 0, "z")], "m long, s long, t string")
    msgs = {r.m: r.message for r in trc.assemble_messages(chunks, "m", "s", "t", block=2).collect()}
    assert msgs == {1: "abc", 2: "z"}


def test_order_entities_and_result_sinks(spark, tmpdir_path):
    from quarry.operators.entities import order_entities
    ents = spark.createDataFrame([("b.py", 5, 9), ("a.py", 3, 4), ("a.py", 1, 10), ("a.py", 1, 2), ("b.py", 1, 1)],
                                 "file_path string, start_line int, end_line int")
    parts = order_entities(ents, 2).rdd.glom().collect()
    for part in parts:
        for path in {r.file_path for r in part}:
            seq = [(r.start_line, r.end_line) for r in part if r.file_path == path]
            assert seq == sorted(seq)
    assert sum(len({r.file_path for r in p}) for p in parts) == 2     # each file in one partition
    res = spark.createDataFrame([(1, True, "fix", None, ["i"], 0)],
                                "goal_id long, success boolean, fix string, feedback string, issues array<string>, retry_count int")
    out_json = os.path.join(tmpdir_path, "results_json")
    fs.write_results_json(res, out_json, "20240101_000000")
    back = spark.read.json(out_json).first()
    assert back.timestamp == "20240101_000000" and back.fix == "fix"
    out_md = os.path.join(tmpdir_path, "results_md")
    fs.write_results_md(res.select(F.lit("# Report").alias("report")), out_md)
    assert spark.read.text(out_md).first().value == "# Report"
