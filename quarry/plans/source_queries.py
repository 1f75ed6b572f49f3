"""The parse job (ENT-01 to 07, 11, DET-04, 05, 16) and sources and sinks (SRC-01, 02,
12 to 14) over Python files made from ``events``: one file an event, every tenth does
not parse. The SQL twins know where the template puts what and parse nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import extract as ex
from ..operators import rules as ru
from ..operators import workflow as wf
from ..session import checkpoint_dir
from ..sources import files as fs
from ..sources.tables import load, spread
from .registry import register
from .report_queries import _text

_GOOD = '''import os
from sys import path as p


def f_<id>(a, b=<k>, *args):
    """Doc <kind>."""
    return a


class C_<id>(Base, m.Other):
    """Class <kind>."""

    x = <k>

    def __init__(self, v):
        self.v = v

    @staticmethod
    def s(q, unused):
        try:
            return q
        except ValueError:
            pass

    async def m(self, zz):
        def inner():
            return 1
        return inner()


total = <k>
other = total
print(other)
'''
_BROKEN = "def broken(:\n    <kind>\n"


def _files(spark, sf_dir) -> DataFrame:
    e = load(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    return spread(e).select(_text("src/m_<id>.py").alias("path"),
                            F.when(F.col("id") % 10 == 3, _text(_BROKEN)).otherwise(_text(_GOOD)).alias("content"))


_EV = """ev AS (SELECT event_id AS id, event_type AS kind, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
  'src/m_' || event_id || '.py' AS file_path, event_id % 10 = 3 AS broken FROM events)"""
_IMPORTS = "'import os;from sys import path'"
_NO = "CAST(NULL AS VARCHAR)"


def _rows(*rows: tuple) -> str:
    """One SELECT per template row: type, name, start, end, parent, docstring, signature,
    flags (async/nested/decorators/methods/bases/kind, ``-`` for null)."""
    return " UNION ALL ".join(
        f"SELECT '{t}' AS entity_type, {n} AS name, file_path, {s} AS start_line, {e} AS end_line, {p} AS parent, {d} AS docstring, "
        f"{g} AS signature, {_IMPORTS} AS imports, {f} AS flags FROM ev WHERE NOT broken" for t, n, s, e, p, d, g, f in rows)


_ENTITIES = _rows(
    ("FUNCTION", "'f_' || id", 5, 7, _NO, "'Doc ' || kind || '.'", "'def f_' || id || ' (a, b, *args)'", "'false/false/0/-/-/-'"),
    ("CLASS", "'C_' || id", 10, 28, _NO, "'Class ' || kind || '.'", "'class C_' || id || '(Base, m.Other)'", "'-/-/0/3/Base,m.Other/-'"),
    ("METHOD", "'__init__'", 15, 16, "'C_' || id", _NO, "'def __init__ (self, v)'", "'false/false/0/-/-/constructor'"),
    ("METHOD", "'s'", 19, 23, "'C_' || id", _NO, "'def s (q, unused)'", "'false/false/1/-/-/static_method'"),
    ("METHOD", "'m'", 25, 28, "'C_' || id", _NO, "'async def m (self, zz)'", "'true/true/0/-/-/instance'"),
    ("STANDALONE", "'assignments_total_other'", 31, 33, _NO, _NO, _NO, "'-/-/-/-/-/-'"),
) + f""" UNION ALL SELECT 'STANDALONE', 'm_' || id || '.py', file_path, 1, 3, NULL, NULL, NULL, '', '-/-/-/-/-/-' FROM ev WHERE broken"""


def _flags():
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    return F.concat_ws("/", text("is_async"), text("has_nested"), text("decorator_count"), text("method_count"),
                       F.coalesce(F.array_join("base_classes", ","), F.lit("-")), text("method_kind"))


def _shown(entities: DataFrame) -> DataFrame:
    return entities.select("entity_type", "name", "file_path", "start_line", "end_line", "parent", "docstring", "signature",
                           F.array_join("imports", ";").alias("imports"), _flags().alias("flags"))


@register("python_entities", f"WITH {_EV} {_ENTITIES}")
def python_entities(spark, sf_dir):
    """ENT-01 to 07, 11: all entities of all files."""
    return _shown(ex.extract_entities(_files(spark, sf_dir)))


@register("unused_args", f"""WITH {_EV} SELECT file_path, 5 AS line_number, 'Potentially unused argument: b' AS message, 'def f_' || id || '(...)' AS code_snippet,
  'INFO' AS severity FROM ev WHERE NOT broken
UNION ALL SELECT file_path, 19, 'Potentially unused argument: unused', 'def s(...)', 'INFO' FROM ev WHERE NOT broken""")
def unused_args(spark, sf_dir):
    """DET-04/16: nothing from files that don't parse, nor from async functions."""
    f = ex.unused_args(ex.parse_files(_files(spark, sf_dir), ("function_args",)))
    return f.select("file_path", "line_number", "message", "code_snippet", "severity")


@register("silent_handlers", f"WITH {_EV} SELECT file_path, 22 AS line_number, 'pattern-except-pass' AS error_code, 'WARNING' AS severity FROM ev WHERE NOT broken")
def silent_handlers(spark, sf_dir):
    """DET-05/16."""
    return ex.silent_handlers(ex.parse_files(_files(spark, sf_dir), ("silent_handler",))).select("file_path", "line_number", "error_code", "severity")


def _folder(spark) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/queries/{uuid.uuid4().hex}"


@register("index_round_trip", f"WITH {_EV}, e AS ({_ENTITIES}) SELECT entity_type, count(*) AS n, count(DISTINCT file_path) AS files, CAST(sum(end_line) AS BIGINT) AS lines FROM e GROUP BY entity_type")
def index_round_trip(spark, sf_dir):
    """SRC-12: the index written by type and read back."""
    path = _folder(spark)
    fs.write_index(_shown(ex.extract_entities(_files(spark, sf_dir))), path)
    return spark.read.parquet(path).groupBy("entity_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("file_path").alias("files"), F.sum("end_line").alias("lines"))


_RESULT = """r AS (SELECT event_id AS goal_id, event_type = 'purchase' AS ok, event_type || chr(10) || 'fix' AS fix FROM events)"""


def _results(spark, sf_dir) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return wf.result_rows(e.select(
        F.col("event_id").alias("goal_id"), F.when(F.col("event_type") == "purchase", "approved").otherwise("rejected").alias("status"),
        F.concat("event_type", F.lit("\nfix")).alias("proposed_fix"), F.lit(None).cast("string").alias("feedback"),
        F.array(F.lit("one")).alias("issues"), F.lit(1).alias("retry_count")))


@register("results_json_sink", f"""WITH {_RESULT} SELECT goal_id, ok AS success, fix, 'one' AS issues, CAST(1 AS BIGINT) AS retry_count, 'now' AS timestamp FROM r""")
def results_json_sink(spark, sf_dir):
    """SRC-13: results written as JSON lines with the run's stamp and read back."""
    path = _folder(spark)
    fs.write_results_json(_results(spark, sf_dir), path, "now")
    back = spark.read.json(path)
    return back.select("goal_id", "success", "fix", F.array_join("issues", ",").alias("issues"), "retry_count", "timestamp")


@register("results_md_sink", f"""WITH {_RESULT}, t AS (SELECT chr(10) || '# Fix Result Report' || chr(10) || '## Summary' || chr(10)
  || '- **Success**: ' || CASE WHEN ok THEN 'True' ELSE 'False' END || chr(10) || '- **Approved**: ' || CASE WHEN ok THEN 'True' ELSE 'False' END || chr(10)
  || '- **Retries**: 1' || chr(10) || '- **Timestamp**: now' || chr(10) || '## Proposed Fix' || chr(10) || '```python' || chr(10) || fix || chr(10) || '```'
  || chr(10) || '## Feedback' || chr(10) || 'None' || chr(10) || '## Issues Found' || chr(10) || '0. one' || chr(10) AS report FROM r)
SELECT line, count(*) AS n FROM (SELECT unnest(string_split(report, chr(10))) AS line FROM t) GROUP BY line""")
def results_md_sink(spark, sf_dir):
    """SRC-14: Markdown reports written as text and read back line by line."""
    path = _folder(spark)
    r = _results(spark, sf_dir)
    fs.write_results_md(r.select(wf.report_md(r, "now").alias("report")), path)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@register("keep_utf8", """SELECT doc_id, CASE WHEN doc_id % 7 <> 2 THEN md5(replace(text, chr(13), chr(10))) END AS content_md5,
  CASE WHEN doc_id % 7 = 2 THEN 'not valid UTF-8' END AS reason FROM (SELECT doc_id, replace(text, chr(13) || chr(10), chr(10)) AS text FROM documents)""")
def keep_utf8(spark, sf_dir):
    """SRC-02: the documents as bytes, some of them broken."""
    n, b = F.col("doc_id"), F.col("text").cast("binary")
    d = load(spark, sf_dir, "documents").select(n.cast("string").alias("path"), F.when(n % 7 == 2, F.concat(F.lit(bytearray(b"\xff\xfe")), b)).otherwise(b).alias("bytes"))
    good, bad = fs.keep_utf8(d)
    return good.select(F.col("path").cast("long").alias("doc_id"), F.md5("content").alias("content_md5"), F.lit(None).cast("string").alias("reason")).unionByName(
        bad.select(F.col("key").cast("long").alias("doc_id"), F.lit(None).cast("string").alias("content_md5"), "reason"))


@register("scan_tree", """SELECT lang, CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS lines, CAST(sum(length(text) + 1) AS BIGINT) AS chars
FROM (SELECT lang, replace(text, chr(13), '') AS text FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL) GROUP BY lang""")
def scan_tree(spark, sf_dir):
    """SRC-01: the documents written as a tree of text files, a folder a language, and
    the tree scanned (whatever the number of files)."""
    path = _folder(spark)
    d = load(spark, sf_dir, "documents").filter("lang IS NOT NULL AND text IS NOT NULL")
    d.select("lang", F.replace("text", F.lit("\r"), F.lit("")).alias("value")).write.partitionBy("lang").text(path)
    good, _ = fs.keep_utf8(fs.scan_files(spark, path, (".txt",)))
    size = F.length("content")
    return good.groupBy(F.regexp_extract("path", "lang=([^/]*)/", 1).alias("lang")).agg(
        F.sum(size - F.length(F.replace("content", F.lit("\n"), F.lit("")))).alias("lines"), F.sum(size).cast("long").alias("chars"))


@register("rule_scan_many", """WITH r AS (SELECT item_id, lower(array_to_string(string_split(replace(text, chr(10), ' '), ' ')[1:2], ' ')) AS lit FROM benchmark),
f AS (SELECT source || '/doc_' || CAST(doc_id AS VARCHAR) || '.' || lang AS path, lower(text) AS low FROM documents),
h AS (SELECT path, item_id, lit, string_split(low, lit) AS p FROM f JOIN r ON lit <> '' AND contains(low, lit)),
m AS (SELECT path, item_id, p, lit, unnest(range(1, len(p))) AS i FROM h)
SELECT path, 'item_' || item_id AS rule, CAST(1 + list_sum(list_transform(p[1:i], lambda x: length(x) - length(replace(x, chr(10), '')))) AS INTEGER) AS line_number,
  CAST(i - 1 AS INTEGER) AS match_idx FROM m""")
def rule_scan_many(spark, sf_dir):
    """DET-02/03 with a rule for each benchmark item: its first two words, literally."""
    from ..sources.tables import files
    b = load(spark, sf_dir, "benchmark")
    words = F.array_join(F.slice(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " "), 1, 2), " ")
    rules = b.filter(words != "").select(
        F.concat(F.lit("item_"), F.col("item_id").cast("string")).alias("rule"), F.regexp_replace(words, r"([^\p{L}\p{N} ])", r"\\$1").alias("pattern"),
        F.lit("first words").alias("message"), F.lit(None).cast("string").alias("suggestion"), F.lit("INFO").alias("severity"),
        F.col("item_id").cast("int").alias("ord"), F.array(F.lower(words)).alias("must_contain"))
    return ru.rule_scan_many(files(spark, sf_dir), rules).select("path", "rule", "line_number", "match_idx")
