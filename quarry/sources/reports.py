"""Tool reports as tables (SRC-05…11, DET-06…09, DET-15).

Every reader takes a table of whole report texts and returns ``(rows, bad_rows, both)``:
*findings*, and what could not be read (``stage, key, reason, payload``): a text
that isn't UTF-8, a report that isn't of its format, an element without the
fields that a finding needs. No report fails a job: parsing gives null, never an
exception. ``key`` names the report; findings carry it as ``metadata['report']``.
JSON reports are read as VARIANT and taken apart element by element, so
``tool_output`` holds the whole element with all its keys (nulls too; keys
sorted). Paths are kept as written in the report (the reference makes them
absolute on the machine that ran the tool).
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.regex import unicode_classes
from ..functions.text import path_name, path_suffix
from ..operators.detect import FRAME_PATTERN, fixable_severity, map_severity
from ..operators.entities import py_strip
from ..operators.findings import to_findings

# --- fixed values: report line formats, default report names and default texts
TYPECHECK_LINE = r"^(.*?):(\d+):(\d+):\s*(\w+):\s*(.*?)(?:\s*\[(\w+)\])?$"
TEST_FAILED = r"FAILED\s+(\S+)::(\S+)\s+-\s+(.+?)(?=\n(?:FAILED|PASSED|ERROR)|\Z)"
TEST_ERROR = r"ERROR\s+(\S+)::(\S+)\s+-\s+(.+?)(?=\n(?:FAILED|PASSED|ERROR)|\Z)"
FAILURE_LOCATION = r'File "([^"]+)", line (\d+)'
DEFAULT_REPORTS = ("junit.xml", "test-results.xml")

# detector order of the sources (first wins in dedup)
DETECTOR_ORD = {"MYPY": 0, "PYLINT": 1, "RUFF": 2, "PATTERN_MATCH": 3, "PYTEST": 4, "LLM_DISCOVERY": 5}

#: Levels of nested suites in an XML report.
SUITE_LEVELS = 4
#: A FAILED entry looks for its line in so many characters behind it; an entry has
#: at least ``LEAST_ENTRY`` characters, which bounds the entries in that stretch.
AFTER, LEAST_ENTRY = 2000, 14

BAD_ROW = "stage string, key string, reason string, payload string"


class Report(NamedTuple):
    rows: DataFrame
    bad_rows: DataFrame
    #: Both in one table, for those who want both: findings with a null ``reason`` and
    #: ``payload``, bad rows with nothing but ``metadata``, ``reason`` and ``payload``. Each
    #: report is parsed once for it; ``rows`` and ``bad_rows`` side by side parse it twice.
    both: DataFrame


def _union(parts: list[Report]) -> Report:
    return Report(*(reduce(DataFrame.unionByName, frames) for frames in zip(*parts)))


def _texts(reports: DataFrame, col: str, key: str | None) -> DataFrame:
    """``key, text`` of the reports."""
    return reports.select((F.col(key).cast("string") if key else F.lit(None).cast("string")).alias("key"), F.col(col).alias("text"))


def _marked(items: Column, item: str, reason: Column, payload: str) -> Column:
    """``item, reason, payload`` per element of ``items`` and, with a ``reason``, one more.

    To be exploded as it stands: what Spark filters on afterwards (a column made by
    ``explode``) can't move below the shuffle that deals out the reports, where few tasks
    would parse all of them once more."""
    none = F.lit(None).cast("string")
    good = F.transform(items, lambda x: F.struct(x.alias(item), none.alias("reason"), none.alias("payload")))
    bad = F.struct(F.get(F.slice(items, 1, 0), F.lit(0)).alias(item), reason.alias("reason"), F.col(payload).alias("payload"))
    return F.concat(F.coalesce(good, F.array()), F.when(reason.isNotNull(), F.array(bad)).otherwise(F.array()))


def _report(marked: DataFrame, stage: str, source: str, **columns: Column) -> Report:
    """Findings from the ``columns`` of the rows without a ``reason``; the others are bad rows."""
    report = F.when(F.col("key").isNotNull(), F.create_map(F.lit("report"), F.col("key")))
    found = [c.alias(name) for name, c in columns.items()]
    origin = [F.lit(source).alias("source"), report.alias("metadata"), F.lit(DETECTOR_ORD[source]).alias("detector_ord")]
    good = F.col("reason").isNull()
    rows = to_findings(marked.filter(good).select(*origin, F.monotonically_increasing_id().alias("emit_ord"), *found))
    bad = marked.filter(~good).select(F.lit(stage).alias("stage"), "key", "reason", "payload")
    both = to_findings(marked.select(
        *origin, F.monotonically_increasing_id().alias("emit_ord"), *(F.when(good, c).alias(n) for n, c in columns.items()), "reason",
        F.when(~good, F.col("payload")).alias("payload")))
    return Report(rows, bad, both)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# ---- type checker lines (SRC-05)

def parse_typecheck(lines: DataFrame, col: str = "value", key: str | None = None) -> Report:
    """SRC-05 over a column of report lines. Blank and ``Success…`` lines say
    nothing; a line of no known format is a bad row."""
    pat = unicode_classes(TYPECHECK_LINE)
    v = F.col("text")
    g = lambda i: F.regexp_extract(v, pat, i)
    said = _texts(lines, col, key).filter((py_strip(v) != "") & ~F.startswith(v, F.lit("Success")))
    marked = said.select("key", "text", F.when(~v.rlike(pat), F.lit("not a report line")).alias("reason"), v.alias("payload"))
    return _report(
        marked, "typecheck", "MYPY", severity=map_severity(F.lower(g(4))),
        file_path=g(1), line_number=g(2).try_cast("int"), col=g(3).try_cast("int"),
        message=py_strip(g(5)), error_code=F.coalesce(F.nullif(g(6), F.lit("")), F.lit("mypy-error")), tool_output=v)


# ---- JSON reports (SRC-06, 07, 09)

def _elements(reports: DataFrame, path: str, kind: str, needed: dict[str, str]) -> DataFrame:
    """``key, e`` (VARIANT), ``raw`` per element of the array at ``path`` in each report
    (missing: none), with a ``reason`` and ``payload`` where a report has no such shape or
    an element lacks one of the ``needed`` fields (path -> type)."""
    v = F.col("v")
    outer = F.startswith(F.schema_of_variant(v), F.lit(kind))
    here = F.try_variant_get(v, path, "variant")
    listed = F.try_variant_get(v, path, "array<variant>")
    shape = (F.when(v.isNull(), F.lit("not JSON")).when(~outer, F.lit(f"not a JSON {kind.lower()}"))
             .when(here.isNotNull() & listed.isNull(), F.lit(f"{path} is not a JSON array")))
    parsed = reports.select("key", "text", F.try_parse_json("text").alias("v"))
    elements = parsed.select("key", F.explode(_marked(F.when(outer, listed), "e", shape, "text")).alias("x")).select("key", "x.*")
    lacks = F.lit(None).cast("string")
    for field, of in reversed(needed.items()):
        lacks = F.when(_field(field, of).isNull(), F.lit(f"no {field[2:]}")).otherwise(lacks)
    lacks = F.when(~F.startswith(F.schema_of_variant("e"), F.lit("OBJECT")), F.lit("not a JSON object")).otherwise(lacks)
    whole, raw = F.col("reason").isNotNull(), F.to_json("e")
    return elements.select("key", "e", raw.alias("raw"), F.when(whole, F.col("reason")).otherwise(lacks).alias("reason"),
                           F.when(whole, F.col("payload")).otherwise(raw).alias("payload"))


def _field(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("e", path, kind)


def parse_lint_flat(reports: DataFrame, col: str = "value", key: str | None = None) -> Report:
    """SRC-06: flat JSON array report; ``unused-import`` gets a suggestion."""
    m = _elements(_texts(reports, col, key), "$", "ARRAY", {"$.path": "string", "$.line": "int", "$.message": "string", "$.symbol": "string"})
    return _report(
        m, "lint_flat", "PYLINT", severity=map_severity(F.lower(F.coalesce(_field("$.type"), F.lit("warning")))),
        file_path=_field("$.path"), line_number=_field("$.line", "int"), col=_field("$.column", "int"),
        message=_field("$.message"), error_code=_field("$.symbol"),
        suggested_fix=F.when(_field("$.symbol") == "unused-import",
                             F.concat(F.lit("Remove unused import: "), F.coalesce(_field("$.obj"), F.lit("")))),
        tool_output=F.col("raw"))


def parse_lint_nested(reports: DataFrame, col: str = "value", key: str | None = None) -> Report:
    """SRC-07: nested JSON array report; a fix makes the finding INFO with a suggestion."""
    m = _elements(_texts(reports, col, key), "$", "ARRAY",
                  {"$.filename": "string", "$.location.row": "int", "$.message": "string", "$.code": "string"})
    fix = _field("$.fix", "map<string,variant>")
    has_fix = F.coalesce(F.size(fix) > 0, F.lit(False))
    return _report(
        m, "lint_nested", "RUFF", severity=fixable_severity(has_fix), file_path=_field("$.filename"),
        line_number=_field("$.location.row", "int"), col=_field("$.location.column", "int"),
        end_line=_field("$.end_location.row", "int"), message=_field("$.message"), error_code=_field("$.code"),
        suggested_fix=F.when(has_fix, F.concat(F.lit("Replace with: "), F.coalesce(_field("$.fix.content"), F.lit("")))),
        tool_output=F.col("raw"))


def parse_test_json(reports: DataFrame, col: str = "value", key: str | None = None) -> Report:
    """SRC-09: failed tests of a JSON test report (crash path/line, long text)."""
    t = _elements(_texts(reports, col, key), "$.tests", "OBJECT", {})
    long = _field("$.call.longrepr", "variant")
    msg = F.coalesce(_field("$.call.longrepr"), F.when(F.schema_of_variant(long) != "VOID", F.to_json(long)), F.lit("Test failed"))
    return _report(
        t.filter(F.col("reason").isNotNull() | (_field("$.outcome") == "failed")), "test_json", "PYTEST", severity=F.lit("ERROR"),
        file_path=F.coalesce(F.nullif(_field("$.call.crash.path"), F.lit("")), F.lit("unknown")),
        line_number=F.coalesce(_field("$.call.crash.lineno", "int"), F.lit(1)),
        message=F.concat(F.lit("Test failure: "), F.coalesce(_field("$.nodeid"), F.lit("unknown")), F.lit(" - "), F.substring(msg, 1, 200)),
        error_code=F.lit("test-failure"), code_snippet=F.substring(msg, 1, 500), tool_output=F.col("raw"))


# ---- JUnit XML (SRC-08, DET-09)

_MARK = "array<struct<_message:string,_VALUE:string>>"
_CASE = f"array<struct<_name:string,_file:string,_line:string,failure:{_MARK},error:{_MARK}>>"


def _suite(levels: int) -> str:
    inner = f",testsuite:array<struct<{_suite(levels - 1)}>>" if levels else ""
    return f"testcase:{_CASE}{inner}"


def _cases(root: str, levels: int) -> Column:
    """All test cases below ``root`` (SQL), in document order of their levels."""
    none = f"cast(array() as {_CASE})"
    parts, suites = [f"coalesce({root}.testcase, {none})"], f"{root}.testsuite"
    for _ in range(levels):
        parts.append(f"coalesce(flatten(transform({suites}, s -> coalesce(s.testcase, {none}))), {none})")
        suites = f"flatten(transform({suites}, s -> s.testsuite))"
        suites = f"filter({suites}, s -> s is not null)"
    return F.expr(f"concat({', '.join(parts)})")


def parse_junit(reports: DataFrame, col: str = "value", key: str | None = None) -> Report:
    """SRC-08: one finding per test case with a ``failure`` and one per test case with
    an ``error`` (the first of each); a failure without a line takes file and line
    from its traceback (DET-09). Suites may be nested ``SUITE_LEVELS`` deep."""
    schema = f"struct<{_suite(SUITE_LEVELS)},_corrupt_record:string>"
    texts = _texts(reports, col, key)
    parsed = texts.select("key", "text", F.from_xml("text", schema, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("x"))
    reason = F.when(F.col("x").isNull() | F.col("x._corrupt_record").isNotNull(), F.lit("not XML"))
    cases = parsed.select("key", F.explode(_marked(_cases("x", SUITE_LEVELS), "c", reason, "text")).alias("m")).select(
        "key", "m.reason", "m.payload", "m.c.*")
    name = F.coalesce(F.col("_name"), F.lit("unknown"))
    line0 = F.coalesce(F.col("_line").try_cast("int"), F.lit(0))
    file0 = F.coalesce(F.col("_file"), F.lit(""))

    def first(kind: str) -> Column:
        return F.get(F.col(kind), 0)

    details = F.coalesce(first("failure")["_VALUE"], F.lit(""))
    back = (line0 == 0) & details.rlike(FAILURE_LOCATION)
    f_file = F.when(back, F.regexp_extract(details, FAILURE_LOCATION, 1)).otherwise(file0)
    f_line = F.when(back, F.regexp_extract(details, FAILURE_LOCATION, 2).try_cast("int")).otherwise(line0)

    def entry(kind: str, said: str, file: Column, line: Column, snippet: Column, output: Column) -> Column:
        return F.when(F.size(kind) > 0, F.struct(
            F.coalesce(F.nullif(file, F.lit("")), F.lit("unknown")).alias("file_path"),
            F.coalesce(F.nullif(line, F.lit(0)), F.lit(1)).alias("line_number"),
            F.concat(F.lit(f"Test {said}: "), name, F.lit(" - "),
                     F.coalesce(first(kind)["_message"], F.lit("Test failed" if kind == "failure" else "Test error"))).alias("message"),
            F.lit(f"test-{said}").alias("error_code"), snippet.alias("code_snippet"), output.alias("tool_output")))

    fail = entry("failure", "failure", f_file, f_line, F.nullif(F.substring(details, 1, 500), F.lit("")), F.substring(details, 1, 1000))
    err = entry("error", "error", file0, line0, F.lit(None).cast("string"),
                F.nullif(F.substring(first("error")["_VALUE"], 1, 1000), F.lit("")))
    found = F.transform(F.array_compact(F.array(fail, err)), lambda f: F.struct(f.alias("f"), F.lit(None).cast("string").alias("reason")))
    unread = F.when(F.col("reason").isNotNull(), F.array(F.struct(F.get(F.array(fail), F.lit(1)).alias("f"), F.col("reason").alias("reason"))))
    marked = cases.select("key", "payload", F.explode(F.coalesce(unread, found)).alias("m")).select("key", "payload", "m.reason", "m.f.*")
    return _report(marked, "junit", "PYTEST", severity=F.lit("ERROR"), **{
        c: F.col(c) for c in ("file_path", "line_number", "message", "error_code", "code_snippet", "tool_output")})


# ---- terminal text (SRC-10)

def _entries(text: Column, pattern: str, kind: str) -> Column:
    """All entries of one kind with the ``AFTER`` characters behind each. Linear: what
    stands behind an entry is joined from a bounded number of pieces."""
    # only Java's ``\z`` is the very end; its ``\Z`` stops before a final line end
    p = "(?s)" + pattern.replace(r"\Z", r"\z")
    files_, names, msgs, whole = (F.regexp_extract_all(text, F.lit(p), g) for g in (1, 2, 3, 0))
    # of the text from the end of one entry to the end of the next, what can matter
    pieces = F.zip_with(F.split(text, p, -1), whole, lambda a, b: F.substring(F.concat(a, F.coalesce(b, F.lit(""))), 1, AFTER))
    found = F.struct(files_.alias("files"), names.alias("names"), msgs.alias("msgs"), whole.alias("whole"), pieces.alias("pieces"))
    behind = AFTER // LEAST_ENTRY + 1
    return _let(found, lambda f: F.transform(f["whole"], lambda w, i: F.struct(
        F.lit(kind).alias("kind"), F.get(f["files"], i).alias("file"), F.get(f["names"], i).alias("test"),
        py_strip(F.get(f["msgs"], i)).alias("msg"), w.alias("raw"),
        F.substring(F.array_join(F.slice(f["pieces"], i + 2, F.lit(behind)), ""), 1, AFTER).alias("after"))))


def parse_test_text(reports: DataFrame, col: str = "value", key: str | None = None) -> Report:
    """SRC-10: FAILED and ERROR summary entries of test-runner terminal text;
    a FAILED entry takes its line from the next traceback frame of that file. Any
    text is a report; a null one is a bad row."""
    t = F.col("text")
    texts = _texts(reports, col, key)
    entries = F.concat(_entries(t, TEST_FAILED, "failure"), _entries(t, TEST_ERROR, "error"))
    e = texts.select("key", F.explode(_marked(entries, "x", F.when(t.isNull(), F.lit("no text")), "text")).alias("m")).select(
        "key", "m.reason", "m.payload", "m.x.*")
    loc = F.concat(F.lit('File "[^"]*'), F.regexp_replace(F.col("file"), r"([\\^$.|?*+()\[\]{}])", r"\\$1"),
                   F.lit(r'", line (\d+)'))
    at = F.call_function("regexp_extract", F.col("after"), loc, F.lit(1)).try_cast("int")
    line = F.when(F.col("kind") == "failure", F.coalesce(at, F.lit(1))).otherwise(F.lit(1))
    return _report(
        e, "test_text", "PYTEST", severity=F.lit("ERROR"), file_path=F.col("file"), line_number=line,
        message=F.concat(F.lit("Test "), F.col("kind"), F.lit(": "), F.col("test"), F.lit(" - "), F.substring("msg", 1, 200)),
        error_code=F.concat(F.lit("test-"), F.col("kind")), tool_output=F.col("raw"))


# ---- files

def report_texts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``path, value`` of the report files under ``path`` (a file or a folder), and
    those that aren't UTF-8 as bad rows."""
    raw = spark.read.format("binaryFile").load(path).select(F.regexp_replace("path", "^file:", "").alias("path"), "content")
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    t = raw.select("path", F.regexp_replace(text, "\r\n?", "\n").alias("value"))
    bad = t.filter("value IS NULL").select(
        F.lit("reports").alias("stage"), F.col("path").alias("key"), F.lit("not valid UTF-8").alias("reason"),
        F.lit(None).cast("string").alias("payload"))
    return t.filter("value IS NOT NULL"), bad


def _with_unreadable(report: Report, unreadable: DataFrame) -> Report:
    marked = unreadable.select(F.create_map(F.lit("report"), F.col("key")).alias("metadata"), "reason", "payload")
    return Report(report.rows, unreadable.unionByName(report.bad_rows), report.both.unionByName(marked, allowMissingColumns=True))


def _read(spark: SparkSession, path: str, parse) -> Report:
    texts, unreadable = report_texts(spark, path)
    return _with_unreadable(parse(texts, "value", "path"), unreadable)


def read_typecheck(spark: SparkSession, path: str) -> Report:
    """Line by line: a long log is split over tasks."""
    lines = spark.read.text(path).select("value", F.regexp_replace("_metadata.file_path", "^file:(//)?", "").alias("path"))
    return parse_typecheck(lines, "value", "path")


def read_lint_flat(spark: SparkSession, path: str) -> Report:
    return _read(spark, path, parse_lint_flat)


def read_lint_nested(spark: SparkSession, path: str) -> Report:
    return _read(spark, path, parse_lint_nested)


def read_junit(spark: SparkSession, path: str) -> Report:
    return _read(spark, path, parse_junit)


def read_test_json(spark: SparkSession, path: str) -> Report:
    return _read(spark, path, parse_test_json)


def read_test_text(spark: SparkSession, path: str) -> Report:
    return _read(spark, path, parse_test_text)


def parse_test_reports(reports: DataFrame, col: str = "value", path: str = "path") -> Report:
    """SRC-11: each report by the suffix of its path: ``.xml``, ``.json``, anything
    else is terminal text."""
    suffix = path_suffix(path)
    return _union([parse_junit(reports.filter(suffix == ".xml"), col, path),
                   parse_test_json(reports.filter(suffix == ".json"), col, path),
                   parse_test_text(reports.filter(~suffix.isin(".xml", ".json")), col, path)])


def read_test_reports(spark: SparkSession, path: str, default_names: bool = False) -> Report:
    """SRC-11 over a file or a folder. ``default_names``: of a folder, only the two
    default report names are read."""
    texts, unreadable = report_texts(spark, path)
    if default_names:
        wanted = lambda c: path_name(c).isin(*DEFAULT_REPORTS)
        texts, unreadable = texts.filter(wanted("path")), unreadable.filter(wanted("key"))
    return _with_unreadable(parse_test_reports(texts), unreadable)


def stack_frames(df: DataFrame, text: str = "text", pattern: str = FRAME_PATTERN) -> DataFrame:
    """DET-08, all frames: one row per traceback frame with its index (0 = first in text)."""
    p = F.lit(unicode_classes(pattern))
    t = F.col(text)
    fs = F.arrays_zip(F.regexp_extract_all(t, p, 1).alias("file"), F.regexp_extract_all(t, p, 2).alias("line"),
                      F.regexp_extract_all(t, p, 3).alias("function"))
    return df.select("*", F.posexplode(fs).alias("frame", "f")).select(
        *df.columns, "frame", F.col("f.file").alias("file"), F.col("f.line").cast("int").alias("line"),
        F.col("f.function").alias("function"))
