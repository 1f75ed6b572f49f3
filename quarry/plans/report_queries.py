"""Report readers (SRC-05…11, DET-06…09, 15) over report texts made from ``events``.

Each event becomes one report; about a tenth are broken in one way or another.
A query returns findings (``reason`` null) and bad rows (``reason`` set, the
payload as ``tool_output``) of all reports; its SQL twin derives both from the
columns of ``events`` without parsing anything.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import reports as rp
from ..sources.tables import load, spread
from .registry import register

_OUT = ("severity", "file_path", "line_number", "col", "end_line", "message", "error_code", "suggested_fix", "code_snippet", "tool_output")


def _events(spark, sf_dir) -> DataFrame:
    ev = spread(load(spark, sf_dir, "events"))
    return ev.select(F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("kind"),
                     F.get_json_object("props", "$.k").cast("int").alias("k"))


_EV = """ev AS (SELECT event_id AS id, user_id, event_type AS kind, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
  CAST(event_id AS VARCHAR) AS report, CAST(event_id % 10 AS INTEGER) AS how, 'user_' || CAST(user_id AS VARCHAR) || '/a.py' AS path FROM events)"""


def _text(template: str):
    """``template`` with ``<column>`` filled in, for the columns of the events."""
    parts = re.split(r"<(id|user_id|kind|k|c|end|symbol)>", template)
    return F.concat(*[F.col(x).cast("string") if n % 2 else F.lit(x) for n, x in enumerate(parts) if x])


def _both(report: rp.Report) -> DataFrame:
    output = F.when(F.col("reason").isNull(), F.col("tool_output")).otherwise(F.col("payload"))
    return report.both.select(F.col("metadata")["report"].alias("report"), *_OUT[:-1], output.alias("tool_output"), "reason")


def _sql(rows: str, bad: str) -> str:
    """Rows (all of ``_OUT``) and bad rows (``report, tool_output, reason``) of SQL text."""
    return f"""WITH {_EV}, good AS ({rows}), bad AS ({bad})
SELECT report, severity, file_path, line_number, col, end_line, message, error_code, suggested_fix, code_snippet, tool_output,
  CAST(NULL AS VARCHAR) AS reason FROM good
UNION ALL SELECT report, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, tool_output, reason FROM bad"""


_INT_NULL, _TEXT_NULL = "CAST(NULL AS INTEGER)", "CAST(NULL AS VARCHAR)"


# ---- type checker (SRC-05)

@register("report_typecheck", _sql(
    f"""SELECT report, CASE kind WHEN 'error' THEN 'ERROR' ELSE 'WARNING' END AS severity, path AS file_path, k AS line_number,
  k % 7 AS col, {_INT_NULL} AS end_line,
  'Bad ' || kind || CASE WHEN id % 4 = 2 THEN ' [has-hyphen]' ELSE '' END AS message,
  CASE WHEN id % 4 = 1 THEN 'code_' || kind ELSE 'mypy-error' END AS error_code, {_TEXT_NULL} AS suggested_fix, {_TEXT_NULL} AS code_snippet,
  path || ':' || k || ':' || k % 7 || ': ' || kind || ': Bad ' || kind
  || CASE WHEN id % 4 = 1 THEN ' [code_' || kind || ']' WHEN id % 4 = 2 THEN ' [has-hyphen]' ELSE ' ' END AS tool_output FROM ev WHERE how NOT IN (3, 7)""",
    "SELECT report, path || ': cannot read ' || k AS tool_output, 'not a report line' AS reason FROM ev WHERE how = 3"))
def report_typecheck(spark, sf_dir):
    e = _events(spark, sf_dir)
    tail = F.when(F.col("id") % 4 == 1, _text(" [code_<kind>]")).when(F.col("id") % 4 == 2, F.lit(" [has-hyphen]")).otherwise(F.lit(" "))
    line = (F.when(F.col("id") % 10 == 3, _text("user_<user_id>/a.py: cannot read <k>"))
            .when(F.col("id") % 10 == 7, F.when(F.col("id") % 4 == 1, _text("Success: no issues in <k> files")).otherwise(F.lit(" ")))
            .otherwise(F.concat(_text("user_<user_id>/a.py:<k>:"), (F.col("k") % 7).cast("string"), _text(": <kind>: Bad <kind>"), tail)))
    return _both(rp.parse_typecheck(e.select(F.col("id").alias("key"), line.alias("value")), key="key"))


# ---- linters (SRC-06, 07)

def _listed(first, second, has_second):
    """A JSON array of one or two elements; every tenth report is cut, every tenth
    is a lone object."""
    text = F.concat(F.lit("["), first, F.when(has_second, F.concat(F.lit(","), second)).otherwise(F.lit("")), F.lit("]"))
    return F.when(F.col("id") % 10 == 3, F.substring(text, F.lit(1), F.length(text) - 1)).when(F.col("id") % 10 == 7, first).otherwise(text)


_FLAT = ('{"type":"<kind>","module":"m<user_id>","obj":"o<k>",%s"column":<c>,"path":"user_<user_id>/a.py","symbol":"<symbol>",'
         '"message":"event \\"<id>\\" é","message-id":"W<k>","endLine":null,"extra":{"b":[1,2.5,true],"a":"<kind>"}}')
_FLAT_OUT = """'{"column":' || k % 7 || ',"endLine":null,"extra":{"a":"' || kind || '","b":[1,2.5,true]},' @LINE
  || '"message":"event \\"' || id || '\\" é","message-id":"W' || k || '","module":"m' || user_id || '","obj":"o' || k || '","path":"' || path
  || '","symbol":"' || symbol || '","type":"' || kind || '"}'"""
_FLAT_RAW = """'{"type":"' || kind || '","module":"m' || user_id || '","obj":"o' || k || '",' @LINE || '"column":' || k % 7 || ',"path":"' || path
  || '","symbol":"' || symbol || '","message":"event \\"' || id || '\\" é","message-id":"W' || k || '","endLine":null,"extra":{"b":[1,2.5,true],"a":"' || kind || '"}}'"""
_LINE = """|| '"line":' || k || ','"""
_SYM = "(SELECT *, CASE WHEN kind = 'click' THEN 'unused-import' ELSE 'sym-' || kind END AS symbol FROM ev)"


@register("report_lint_flat", _sql(
    f"""SELECT report, CASE kind WHEN 'error' THEN 'ERROR' ELSE 'WARNING' END AS severity, path AS file_path, k AS line_number, k % 7 AS col,
  {_INT_NULL} AS end_line, 'event "' || id || '" é' AS message, symbol AS error_code,
  CASE WHEN kind = 'click' THEN 'Remove unused import: o' || k END AS suggested_fix, {_TEXT_NULL} AS code_snippet,
  {_FLAT_OUT.replace('@LINE', _LINE)} AS tool_output FROM {_SYM} WHERE how NOT IN (3, 7)""",
    f"""SELECT report, '[' || {_FLAT_RAW.replace('@LINE', _LINE)} || CASE WHEN id % 4 = 1 THEN ',' || {_FLAT_RAW.replace('@LINE', '')} ELSE '' END AS tool_output,
  'not JSON' AS reason FROM {_SYM} WHERE how = 3
UNION ALL SELECT report, {_FLAT_RAW.replace('@LINE', _LINE)}, 'not a JSON array' FROM {_SYM} WHERE how = 7
UNION ALL SELECT report, {_FLAT_OUT.replace('@LINE', '')}, 'no line' FROM {_SYM} WHERE how NOT IN (3, 7) AND id % 4 = 1"""))
def report_lint_flat(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("c", F.col("k") % 7).withColumn(
        "symbol", F.when(F.col("kind") == "click", "unused-import").otherwise(F.concat(F.lit("sym-"), "kind")))
    text = _listed(_text(_FLAT % '"line":<k>,'), _text(_FLAT % ""), F.col("id") % 4 == 1)
    return _both(rp.parse_lint_flat(e.select("id", text.alias("value")), key="id"))


_NESTED = ('{"code":"R<k>","message":"m <id>","filename":"user_<user_id>/a.py","fix":%s,"location":{"row":<k>,"column":<c>},'
           '"end_location":{"row":<end>,"column":1},"url":null}')
_NESTED_OUT = """'{"code":"R' || k || '","end_location":{"column":1,"row":' || k + 2 || '},"filename":"' || path || '","fix":'
  || CASE id % 3 WHEN 0 THEN 'null' WHEN 1 THEN '{"applicability":"safe","content":"x = ' || k || '"}' ELSE '{"edits":[]}' END
  || ',"location":{"column":' || k % 7 || ',"row":' || k || '},"message":"m ' || id || '","url":null}'"""
_NESTED_RAW = """'{"code":"R' || k || '","message":"m ' || id || '","filename":"' || path || '","fix":'
  || CASE id % 3 WHEN 0 THEN 'null' WHEN 1 THEN '{"content":"x = ' || k || '","applicability":"safe"}' ELSE '{"edits":[]}' END
  || ',"location":{"row":' || k || ',"column":' || k % 7 || '},"end_location":{"row":' || k + 2 || ',"column":1},"url":null}'"""


@register("report_lint_nested", _sql(
    f"""SELECT report, CASE WHEN id % 3 = 0 THEN 'WARNING' ELSE 'INFO' END AS severity, path AS file_path, k AS line_number, k % 7 AS col,
  k + 2 AS end_line, 'm ' || id AS message, 'R' || k AS error_code,
  CASE id % 3 WHEN 1 THEN 'Replace with: x = ' || k WHEN 2 THEN 'Replace with: ' END AS suggested_fix, {_TEXT_NULL} AS code_snippet,
  {_NESTED_OUT} AS tool_output FROM ev WHERE how NOT IN (3, 7)""",
    f"""SELECT report, '[' || {_NESTED_RAW} || CASE WHEN id % 4 = 1 THEN ',"text"' ELSE '' END AS tool_output, 'not JSON' AS reason FROM ev WHERE how = 3
UNION ALL SELECT report, {_NESTED_RAW}, 'not a JSON array' FROM ev WHERE how = 7
UNION ALL SELECT report, '"text"', 'not a JSON object' FROM ev WHERE how NOT IN (3, 7) AND id % 4 = 1"""))
def report_lint_nested(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("c", F.col("k") % 7).withColumn("end", F.col("k") + 2)
    fix = F.col("id") % 3
    one = (F.when(fix == 0, _text(_NESTED % "null")).when(fix == 1, _text(_NESTED % '{"content":"x = <k>","applicability":"safe"}'))
           .otherwise(_text(_NESTED % '{"edits":[]}')))
    return _both(rp.parse_lint_nested(e.select("id", _listed(one, F.lit('"text"'), F.col("id") % 4 == 1).alias("value")), key="id"))


# ---- test reports (SRC-08 to 11)

_PASSED = '<testcase name="ok_<id>" file="user_<user_id>/a.py" line="1"/>'
_XML = ('<testsuites><testsuite name="s"><properties/>' + _PASSED + '<testsuite>'
        '<testcase name="t_<id>"%s><failure message="boom &lt;<k>&gt;">%s</failure></testcase></testsuite></testsuite>%s')
_XML_END = '<testcase file="x.py" line="<k>"><error message="setup"/><error message="second"/></testcase></testsuites>'


def _junit_text():
    traced = F.col("id") % 4 == 1
    body = F.when(traced, _text(_XML % ("", 'File "src/b.py", line <k>, in f', ""))).otherwise(
        _text(_XML % (' file="user_<user_id>/a.py" line="<k>"', "trace <k>", "")))
    whole = F.concat(body, _text(_XML_END))
    return F.when(F.col("id") % 10 == 3, body).when(F.col("id") % 10 == 7, _text("<testsuite>" + _PASSED + "</testsuite>")).otherwise(whole)


_JUNIT_ROWS = f"""SELECT report, 'ERROR' AS severity, CASE WHEN id % 4 = 1 THEN 'src/b.py' ELSE path END AS file_path,
  CASE WHEN k = 0 THEN 1 ELSE k END AS line_number, {_INT_NULL} AS col, {_INT_NULL} AS end_line,
  'Test failure: t_' || id || ' - boom <' || k || '>' AS message, 'test-failure' AS error_code, {_TEXT_NULL} AS suggested_fix,
  CASE WHEN id % 4 = 1 THEN 'File "src/b.py", line ' || k || ', in f' ELSE 'trace ' || k END AS code_snippet,
  CASE WHEN id % 4 = 1 THEN 'File "src/b.py", line ' || k || ', in f' ELSE 'trace ' || k END AS tool_output FROM ev WHERE how NOT IN (3, 7) AND %s
UNION ALL SELECT report, 'ERROR', 'x.py', CASE WHEN k = 0 THEN 1 ELSE k END, NULL, NULL, 'Test error: unknown - setup', 'test-error', NULL, NULL, NULL
  FROM ev WHERE how NOT IN (3, 7) AND %s"""
_JUNIT_BAD = """SELECT report, '<testsuites><testsuite name="s"><properties/><testcase name="ok_' || id || '" file="' || path || '" line="1"/><testsuite>'
  || '<testcase name="t_' || id || '"' || CASE WHEN id %% 4 = 1 THEN '' ELSE ' file="' || path || '" line="' || k || '"' END
  || '><failure message="boom &lt;' || k || '&gt;">' || CASE WHEN id %% 4 = 1 THEN 'File "src/b.py", line ' || k || ', in f' ELSE 'trace ' || k END
  || '</failure></testcase></testsuite></testsuite>' AS tool_output, 'not XML' AS reason FROM ev WHERE how = 3 AND %s"""


@register("report_junit", _sql(_JUNIT_ROWS.replace("%s", "TRUE"), _JUNIT_BAD.replace("%%", "%").replace("%s", "TRUE")))
def report_junit(spark, sf_dir):
    return _both(rp.parse_junit(_events(spark, sf_dir).select("id", _junit_text().alias("value")), key="id"))


_TEST = ('{"nodeid":"a.py::t_<id>","outcome":"%s","call":{"longrepr":"%s","crash":{"path":"%s","lineno":<k>}},"keywords":["x",null]}')


def _json_text():
    failed = _text(_TEST % ("failed", "assert <k>", "user_<user_id>/a.py"))
    bare = _text('{"outcome":"failed","nodeid":"a.py::b_<id>"}')
    tests = F.concat(F.lit('{"created":1.5,"tests":['), failed, F.lit(","), _text(_TEST % ("passed", "", "")),
                     F.when(F.col("id") % 4 == 1, F.concat(F.lit(","), bare)).otherwise(F.lit("")), F.lit("]}"))
    return (F.when(F.col("id") % 10 == 3, F.substring(tests, F.lit(1), F.length(tests) - 2)).when(F.col("id") % 10 == 7, F.lit("[]"))
            .when(F.col("id") % 10 == 9, F.lit('{"tests":3}')).otherwise(tests))


_JSON_ROWS = f"""SELECT report, 'ERROR' AS severity, path AS file_path, k AS line_number, {_INT_NULL} AS col, {_INT_NULL} AS end_line,
  'Test failure: a.py::t_' || id || ' - assert ' || k AS message, 'test-failure' AS error_code, {_TEXT_NULL} AS suggested_fix,
  'assert ' || k AS code_snippet, '{{"call":{{"crash":{{"lineno":' || k || ',"path":"' || path || '"}},"longrepr":"assert ' || k
  || '"}},"keywords":["x",null],"nodeid":"a.py::t_' || id || '","outcome":"failed"}}' AS tool_output FROM ev WHERE how NOT IN (3, 7, 9) AND %s
UNION ALL SELECT report, 'ERROR', 'unknown', 1, NULL, NULL, 'Test failure: a.py::b_' || id || ' - Test failed', 'test-failure', NULL, 'Test failed',
  '{{"nodeid":"a.py::b_' || id || '","outcome":"failed"}}' FROM ev WHERE how NOT IN (3, 7, 9) AND id % 4 = 1 AND %s"""
_JSON_BAD = """SELECT report, '{"created":1.5,"tests":[{"nodeid":"a.py::t_' || id || '","outcome":"failed","call":{"longrepr":"assert ' || k
  || '","crash":{"path":"' || path || '","lineno":' || k || '}},"keywords":["x",null]},{"nodeid":"a.py::t_' || id
  || '","outcome":"passed","call":{"longrepr":"","crash":{"path":"","lineno":' || k || '}},"keywords":["x",null]}'
  || CASE WHEN id % 4 = 1 THEN ',{"outcome":"failed","nodeid":"a.py::b_' || id || '"}' ELSE '' END AS tool_output, 'not JSON' AS reason FROM ev WHERE how = 3 AND %s
UNION ALL SELECT report, CASE how WHEN 7 THEN '[]' ELSE '{"tests":3}' END,
  CASE how WHEN 7 THEN 'not a JSON object' ELSE '$.tests is not a JSON array' END FROM ev WHERE how IN (7, 9) AND %s"""


@register("report_test_json", _sql(_JSON_ROWS.replace("%s", "TRUE"), _JSON_BAD.replace("%s", "TRUE")))
def report_test_json(spark, sf_dir):
    return _both(rp.parse_test_json(_events(spark, sf_dir).select("id", _json_text().alias("value")), key="id"))


def _terminal_text():
    text = _text('run <kind>\nFAILED user_<user_id>/a.py::t_<id> - boom <k>\nmore\t\nERROR x.py::s_<id> - setup\nPASSED y\n'
                 '  File "/r/user_<user_id>/a.py", line <k>, in f\nFAILED no.py::z - last\n')
    return F.when(F.col("id") % 10 != 3, F.when(F.col("id") % 10 == 7, F.lit("")).otherwise(text))


_TERMINAL_ROWS = f"""SELECT report, 'ERROR' AS severity, path AS file_path, k AS line_number, {_INT_NULL} AS col, {_INT_NULL} AS end_line,
  'Test failure: t_' || id || ' - boom ' || k || chr(10) || 'more' AS message, 'test-failure' AS error_code, {_TEXT_NULL} AS suggested_fix,
  {_TEXT_NULL} AS code_snippet, 'FAILED ' || path || '::t_' || id || ' - boom ' || k || chr(10) || 'more' || chr(9) AS tool_output FROM ev WHERE how NOT IN (3, 7) AND %s
UNION ALL SELECT report, 'ERROR', 'no.py', 1, NULL, NULL, 'Test failure: z - last', 'test-failure', NULL, NULL, 'FAILED no.py::z - last' || chr(10)
  FROM ev WHERE how NOT IN (3, 7) AND %s
UNION ALL SELECT report, 'ERROR', 'x.py', 1, NULL, NULL, 'Test error: s_' || id || ' - setup', 'test-error', NULL, NULL, 'ERROR x.py::s_' || id || ' - setup'
  FROM ev WHERE how NOT IN (3, 7) AND %s"""
_TERMINAL_BAD = f"SELECT report, {_TEXT_NULL} AS tool_output, 'no text' AS reason FROM ev WHERE how = 3 AND %s"


@register("report_test_text", _sql(_TERMINAL_ROWS.replace("%s", "TRUE"), _TERMINAL_BAD.replace("%s", "TRUE")))
def report_test_text(spark, sf_dir):
    return _both(rp.parse_test_text(_events(spark, sf_dir).select("id", _terminal_text().alias("value")), key="id"))


def _routed_sql(rows: str, bad: str, part: int) -> tuple[str, str]:
    """The twins of one kind of report, for the events that are of this kind; the
    report's name is its path."""
    end = (".xml", ".json", ".log")[part]
    return tuple(f"SELECT report || '{end}' AS report, * EXCLUDE (report) FROM ({x.replace('%%', '%').replace('%s', f'user_id % 3 = {part}')})"
                 for x in (rows, bad))


_ROUTED = [_routed_sql(r, b, n) for n, (r, b) in enumerate(((_JUNIT_ROWS, _JUNIT_BAD), (_JSON_ROWS, _JSON_BAD), (_TERMINAL_ROWS, _TERMINAL_BAD)))]


@register("report_routing", _sql(*(" UNION ALL ".join(x) for x in zip(*_ROUTED))))
def report_routing(spark, sf_dir):
    """SRC-11: XML, JSON and terminal reports in one table, told apart by suffix."""
    part = F.col("user_id") % 3
    e = _events(spark, sf_dir).select(
        F.concat(F.col("id").cast("string"), F.when(part == 0, ".xml").when(part == 1, ".json").otherwise(".log")).alias("path"),
        F.when(part == 0, _junit_text()).when(part == 1, _json_text()).otherwise(_terminal_text()).alias("value"))
    return _both(rp.parse_test_reports(e))
