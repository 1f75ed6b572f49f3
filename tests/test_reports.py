import json
import os

from quarry.sources import reports as rp


def _write(d, name, text):
    p = os.path.join(d, name)
    with open(p, "w") as fh:
        fh.write(text)
    return p


def test_typecheck_text(spark):
    lines = spark.createDataFrame([
        ("a.py:3:5: error: Bad thing [attr_defined]",), ("a.py:4:1: note: See here",),
        ("a.py:5:2: warning: Hm [x]",), ("a.py:6:2: weird: Odd [y]",), ("a.py:7:1: error: Dash [has-hyphen]",),
        ("Success: no issues",), ("",), ("garbage",)], "value string")
    rows = {r.line_number: r for r in rp.parse_typecheck(lines).rows.collect()}
    assert set(rows) == {3, 4, 5, 6, 7}
    assert rows[3].severity == "ERROR" and rows[3].error_code == "attr_defined" and rows[3].col == 5
    assert rows[4].severity == "INFO" and rows[5].severity == "WARNING" and rows[6].severity == "WARNING"
    assert rows[7].error_code == "mypy-error" and rows[7].message.endswith("[has-hyphen]")


def test_lint_reports(spark):
    flat = json.dumps([{"type": "error", "obj": "", "line": 2, "column": 0, "path": "a.py", "symbol": "e1", "message": "E"},
                       {"type": "warning", "obj": "os", "line": 1, "column": 0, "path": "a.py", "symbol": "unused-import",
                        "message": "unused"}])
    df = spark.createDataFrame([(flat,), ("not json",), ('{"path": "a.py"}',)], "value string")
    rows = {r.line_number: r for r in rp.parse_lint_flat(df).rows.collect()}
    assert rows[2].severity == "ERROR" and rows[1].suggested_fix == "Remove unused import: os"
    assert len(rows) == 2
    nested = json.dumps([
        {"code": "F401", "message": "m", "filename": "b.py", "fix": None, "location": {"row": 3, "column": 1},
         "end_location": {"row": 3, "column": 9}},
        {"code": "E1", "message": "n", "filename": "b.py", "fix": {"content": "x = 1"},
         "location": {"row": 4, "column": 1}, "end_location": {"row": 5, "column": 2}}])
    df2 = spark.createDataFrame([(nested,), ("[]",), ("nope",)], "value string")
    r2 = {r.line_number: r for r in rp.parse_lint_nested(df2).rows.collect()}
    assert r2[3].severity == "WARNING" and r2[3].suggested_fix is None
    assert r2[4].severity == "INFO" and r2[4].suggested_fix == "Replace with: x = 1" and r2[4].end_line == 5


def test_junit_xml(spark, tmpdir_path):
    xml = """<testsuite>
<testcase name="t_ok" file="t.py" line="1"/>
<testcase name="t_fail" file="t.py" line="10"><failure message="boom">trace</failure></testcase>
<testcase name="t_err" file="t.py" line="20"><error message="bad">err text</error></testcase>
<testcase name="t_back"><failure message="x">File "src/m.py", line 42, in f</failure></testcase>
<testcase name="t_nofile"><error message="e"/></testcase>
</testsuite>"""
    p = _write(tmpdir_path, "junit.xml", xml)
    rows = {r.message: r for r in rp.read_junit(spark, p).rows.collect()}
    assert rows["Test failure: t_fail - boom"].line_number == 10
    assert rows["Test error: t_err - bad"].error_code == "test-error"
    back = rows["Test failure: t_back - x"]
    assert (back.file_path, back.line_number) == ("src/m.py", 42)
    nf = rows["Test error: t_nofile - e"]
    assert (nf.file_path, nf.line_number) == ("unknown", 1)
    assert len(rows) == 4


def test_test_json_and_text(spark, tmpdir_path):
    rep = {"tests": [{"nodeid": "t.py::a", "outcome": "failed", "call": {"crash": {"path": "t.py", "lineno": 7}}},
                     {"nodeid": "t.py::b", "outcome": "passed"}]}
    p = _write(tmpdir_path, "r.json", json.dumps(rep))
    rows = rp.read_test_json(spark, p).rows.collect()
    assert len(rows) == 1 and rows[0].line_number == 7 and rows[0].message == "Test failure: t.py::a - Test failed"
    text = ("FAILED t.py::test_a - AssertionError: x\nmore detail\nPASSED t.py::b\n"
            "ERROR t.py::test_c - setup broke\n")
    p2 = _write(tmpdir_path, "out.txt", text)
    r2 = sorted(rp.read_test_text(spark, p2).rows.collect(), key=lambda r: r.message)
    assert [r.error_code for r in r2] == ["test-error", "test-failure"]
    assert r2[1].message == "Test failure: test_a - AssertionError: x\nmore detail"


def test_stack_frames(spark):
    t = 'File "a.py", line 3, in f\nFile "b.py", line 9, in g'
    df = spark.createDataFrame([(1, t), (2, "")], "id int, text string")
    rows = rp.stack_frames(df).collect()
    assert [(r.frame, r.file, r.line, r.function) for r in rows] == [(0, "a.py", 3, "f"), (1, "b.py", 9, "g")]


def test_text_report_ends_with_white_space(spark):
    text = "FAILED t.py::test_a - boom\t\n"
    df = spark.createDataFrame([(text,)], "value string")
    [r] = rp.parse_test_text(df).rows.collect()
    assert r.message == "Test failure: test_a - boom" and r.tool_output == text
    lines = spark.createDataFrame([("a.py:3:5: error: Bad\u00a0",)], "value string")
    assert [x.message for x in rp.parse_typecheck(lines).rows.collect()] == ["Bad"]


def bad(report):
    return sorted(tuple(r) for r in report.bad_rows.collect())


def test_bad_rows_of_json_reports_and_whole_elements(spark):
    good = '{"path":"a.py","line":3,"message":"m","symbol":"s","endLine":null,"extra":{"z":1,"a":[true]}}'
    texts = [("r1", f"[{good}, {{\"path\":\"b.py\"}}, 7]"), ("r2", '{"path": "a.py"}'), ("r3", "[" + good), ("r4", None), ("r5", " [ ] ")]
    got = rp.parse_lint_flat(spark.createDataFrame(texts, "k string, value string"), key="k")
    [r] = got.rows.collect()
    assert r.tool_output == '{"endLine":null,"extra":{"a":[true],"z":1},"line":3,"message":"m","path":"a.py","symbol":"s"}'
    assert r.metadata == {"report": "r1"}
    assert bad(got) == [("lint_flat", "r1", "no line", '{"path":"b.py"}'), ("lint_flat", "r1", "not a JSON object", "7"),
                        ("lint_flat", "r2", "not a JSON array", '{"path": "a.py"}'), ("lint_flat", "r3", "not JSON", "[" + good),
                        ("lint_flat", "r4", "not JSON", None)]
    tests = [("t1", '{"tests":[{"outcome":"failed","call":{"longrepr":{"a":1}}}, null]}'), ("t2", '{"tests":"x"}'), ("t3", "{}")]
    got = rp.parse_test_json(spark.createDataFrame(tests, "k string, value string"), key="k")
    [r] = got.rows.collect()
    assert (r.file_path, r.line_number, r.message) == ("unknown", 1, 'Test failure: unknown - {"a":1}')
    assert [x[1:3] for x in bad(got)] == [("t1", "not a JSON object"), ("t2", "$.tests is not a JSON array")]


def test_bad_rows_of_xml_lines_and_bytes(spark, tmpdir_path):
    xml = [("x1", "<testsuites><testsuite><testsuite><testcase><failure/></testcase></testsuite></testsuite></testsuites>"),
           ("x2", "<testsuite><testcase>"), ("x3", "plain"), ("x4", None), ("x5", "<a/>")]
    got = rp.parse_junit(spark.createDataFrame(xml, "k string, value string"), key="k")
    assert [(r.metadata["report"], r.message) for r in got.rows.collect()] == [("x1", "Test failure: unknown - Test failed")]
    assert [x[1:3] for x in bad(got)] == [("x2", "not XML"), ("x3", "not XML"), ("x4", "not XML")]
    lines = spark.createDataFrame([("a.py:99999999999:5: error: far",), ("what",), (" ",), ("Success: x",)], "value string")
    got = rp.parse_typecheck(lines)
    assert [r.line_number for r in got.rows.collect()] == [None] and [x[2:] for x in bad(got)] == [("not a report line", "what")]
    with open(os.path.join(tmpdir_path, "r.json"), "wb") as f:
        f.write(b"\xff\xfe[]")
    got = rp.read_lint_flat(spark, tmpdir_path)
    assert got.rows.count() == 0 and [(x[0], x[1].rsplit("/")[-1], x[2]) for x in bad(got)] == [("reports", "r.json", "not valid UTF-8")]


def test_routing_by_suffix_and_by_default_names(spark, tmpdir_path):
    xml = '<testsuite><testcase name="%s" file="t.py" line="2"><failure message="m">x</failure></testcase></testsuite>'
    for name, text in (("junit.xml", xml % "a"), ("test-results.xml", xml % "b"), ("other.xml", xml % "c"),
                       ("r.json", '{"tests":[{"nodeid":"d","outcome":"failed"}]}'), ("run.out", "FAILED t.py::e - boom"),
                       ("noending", "ERROR t.py::f - boom")):
        _write(tmpdir_path, name, text)
    names = lambda got: sorted(r.message.split(" - ")[0].split(": ")[1] for r in got.rows.collect())
    assert names(rp.read_test_reports(spark, tmpdir_path)) == ["a", "b", "c", "d", "e", "f"]
    assert names(rp.read_test_reports(spark, tmpdir_path, default_names=True)) == ["a", "b"]
    assert names(rp.read_test_reports(spark, os.path.join(tmpdir_path, "run.out"))) == ["e"]


def test_many_entries_in_one_text(spark):
    """Time grows with the text, and each entry finds the frame behind it, not further than 2000 characters."""
    import time
    entry = 'FAILED t{0}.py::test - boom\nERROR x::y - z\nPASSED q\nFile "t{0}.py", line {0}, in f\n'
    text = "".join(entry.format(k) for k in range(1, 20001))
    start = time.time()
    rows = rp.parse_test_text(spark.createDataFrame([(text,)], "value string")).rows.filter("error_code = 'test-failure'").select(
        "file_path", "line_number").collect()
    assert len(rows) == 20000 and all(r.file_path == f"t{r.line_number}.py" for r in rows)
    assert time.time() - start < 60
    far = "FAILED a.py::t - m\nPASSED x\n" + "-" * 2000 + 'File "a.py", line 9'
    near = "FAILED a.py::t - m\nPASSED x\n" + "-" * 1970 + 'File "a.py", line 9'
    got = [r.line_number for t in (far, near) for r in rp.parse_test_text(spark.createDataFrame([(t,)], "value string")).rows.collect()]
    assert got == [1, 9]


def test_reports_are_parsed_once_and_behind_the_shuffle(spark):
    """``both`` parses a report once, and no parsing moves into the few tasks before the shuffle."""
    texts = [("1.xml", '<testsuite><testcase name="a" file="t.py" line="2"><failure message="m">x</failure></testcase></testsuite>'),
             ("2.xml", "no"), ("3.json", '{"tests":[{"nodeid":"d","outcome":"failed"}, 7]}'), ("4.json", "["), ("5.log", "FAILED t.py::e - boom"),
             ("6.log", None)]
    got = rp.parse_test_reports(spark.createDataFrame(texts, "path string, value string").repartition(4, "path", "value"))
    rows = [(r.metadata["report"], r.message, None, None) for r in got.rows.collect()]
    found = [(r.key, None, r.reason, r.payload) for r in got.bad_rows.collect()]
    both = [(r.metadata and r.metadata["report"], r.message, r.reason, r.payload) for r in got.both.collect()]
    assert len(rows) == 3 and len(found) == 4 and sorted(both, key=str) == sorted(rows + found, key=str)
    assert all(r.severity is r.tool_output is r.file_path is None for r in got.both.filter("reason IS NOT NULL").collect())
    plan = got.both._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert sum("from_xml(" in x for x in plan) == 1 and sum(x.count("parseJson") + x.count("parse_json") for x in plan) == 1
    for frame in (got.rows, got.bad_rows, got.both):
        plan = frame._jdf.queryExecution().optimizedPlan().toString().splitlines()
        depth = [len(x) - len(x.lstrip(" :+-")) for x in plan]
        for i, x in enumerate(plan):
            if "RepartitionByExpression" in x:
                below = [y for y, n in zip(plan[i + 1:], depth[i + 1:]) if n > depth[i]]
                assert not any(w in y for y in below for w in ("from_xml", "arseJson", "parse_json", "regexp_extract_all"))
