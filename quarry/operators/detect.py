"""Detector-side column logic shared by report readers (DET-06…12)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: type-checker level -> severity (anything else is WARNING)
LEVEL_SEVERITY = {"error": "ERROR", "warning": "WARNING", "note": "INFO"}


def map_severity(level) -> Column:
    """DET-06: error / warning / note -> ERROR / WARNING / INFO; else WARNING."""
    c = F.col(level) if isinstance(level, str) else level
    m = F.create_map(*[x for k, v in LEVEL_SEVERITY.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[c], F.lit("WARNING"))


def fixable_severity(has_fix) -> Column:
    """DET-06, nested linter: a finding with a fix is INFO, otherwise WARNING."""
    c = F.col(has_fix) if isinstance(has_fix, str) else has_fix
    return F.when(c, F.lit("INFO")).otherwise(F.lit("WARNING"))


# --- fixed values: traceback frame pattern (file, line, function)
FRAME_PATTERN = r'File "([^"]+)", line (\d+), in (\w+)'


def stack_frame(text, n: int = 0, pattern: str = FRAME_PATTERN) -> Column:
    """DET-08: the ``n``-th frame (0 = first in the text) as
    ``STRUCT<file, line, function>``; null when there are fewer frames."""
    from ..functions.regex import unicode_classes
    t = F.col(text) if isinstance(text, str) else text
    p = F.lit(unicode_classes(pattern))
    files_, lines_, funcs = (F.regexp_extract_all(t, p, g) for g in (1, 2, 3))
    return F.when(F.size(files_) > n, F.struct(
        F.get(files_, n).alias("file"), F.get(lines_, n).cast("int").alias("line"),
        F.get(funcs, n).alias("function")))


def import_lines(text, limit: int = 10) -> Column:
    """DET-12: first ``limit`` stripped lines that start with ``import `` or ``from ``."""
    from .entities import py_strip
    t = F.col(text) if isinstance(text, str) else text
    stripped = F.transform(F.split(t, "\n", -1), py_strip)
    hits = F.filter(stripped, lambda x: F.startswith(x, F.lit("import ")) | F.startswith(x, F.lit("from ")))
    return F.array_join(F.slice(hits, 1, limit), "\n")


# --- fixed values: review size window and accessor markers
MIN_REVIEW_LINES, MAX_REVIEW_LINES = 3, 100
GETTER_MARKERS = ("return self.", "return self._")
ACCESSOR_PREFIXES = ("get_", "set_")


def is_trivial(content="content", name="name") -> Column:
    """DET-11: at most 3 non-blank lines and (returns a self attribute, or the
    name starts with get_/set_)."""
    from .entities import py_strip
    low = F.lower(F.col(content))
    non_blank = F.size(F.filter(F.split(low, "\n", -1), lambda x: py_strip(x) != ""))
    getter = F.lit(False)
    for p in GETTER_MARKERS:
        getter = getter | F.contains(low, F.lit(p))
    prefix = F.lit(False)
    for p in ACCESSOR_PREFIXES:
        prefix = prefix | F.startswith(F.col(name), F.lit(p))
    return (non_blank <= 3) & (getter | prefix)


def review_candidates(entities):
    """DET-10: functions and methods of 3..100 lines that are not trivial accessors."""
    n = F.col("end_line") - F.col("start_line") + 1
    return entities.filter(F.col("entity_type").isin("FUNCTION", "METHOD") &
                           n.between(MIN_REVIEW_LINES, MAX_REVIEW_LINES) & ~is_trivial())


# Review prompt (our wording; the reference's prompt texts are user data).
REVIEW_TEMPLATE = ("Review this function for bugs.\n\nFunction: {qualified_name}\nLocation: {location}\n\n"
                   "```python\n{content}\n```\n\nImports of the file:\n{imports}\n")


def review_prompts(candidates, files=None, template: str = REVIEW_TEMPLATE):
    """DET-13: one prompt per review candidate, with the first import lines of its file
    (DET-12): those that the row itself carries as ``import_lines``, taken where the
    file's text was at hand; only candidates without that column are joined to ``files``."""
    from ..functions.text import fill_template
    from .entities import add_derived
    e = add_derived(candidates)
    if "import_lines" not in e.columns:
        e = e.join(files.select(F.col("path").alias("file_path"), import_lines("content").alias("import_lines")), "file_path", "left")
    return e.withColumn("prompt", fill_template(template, {
        "qualified_name": "qualified_name", "location": "location", "content": "content", "imports": "import_lines"}))


# --- fixed values: review reply defaults
REVIEW_DEFAULT_MESSAGE = "Issue found"
REVIEW_CODE = "llm-discovery"


def parse_reviews(replies, entities, reply: str = "reply"):
    """DET-14: model replies -> findings. The JSON is the span from the first
    ``{`` to the last ``}`` (the whole reply when either is missing); each item
    of ``issues`` is one finding: line (default: entity start), severity
    (ERROR / INFO, anything else WARNING), message (default text), suggestion;
    snippet = first 200 characters of the entity; the entity in metadata.
    ``replies(entity_id, reply)``; ``entities(id, ...)``."""
    from ..functions.jsonx import json_field
    from .entities import qualified_name
    from .findings import to_findings
    t = F.col(reply)
    start, end = F.instr(t, "{"), F.length(t) - F.instr(F.reverse(t), "}") + 1
    has_both = (start > 0) & (F.instr(t, "}") > 0)
    body = F.when(has_both, F.when(end >= start, F.substr(t, start, end - start + 1)).otherwise(F.lit(""))).otherwise(t)
    obj = F.when(F.startswith(F.trim(body), F.lit("{")), F.try_parse_json(body))
    e = entities.select(F.col("id").alias("entity_id"), "file_path", "start_line", "content",
                        qualified_name().alias("qualified_name"))
    r = replies.join(e, "entity_id").withColumn("_issues", F.try_variant_get(obj, "$.issues", "array<variant>"))
    x = r.select("*", F.posexplode("_issues").alias("_i", "_issue"))
    sev = F.upper(json_field("_issue", "severity", "string", "WARNING"))
    return to_findings(x.select(
        F.lit("LLM_DISCOVERY").alias("source"),
        F.when(sev == "ERROR", "ERROR").when(sev == "INFO", "INFO").otherwise("WARNING").alias("severity"),
        "file_path",
        json_field("_issue", "line", "int", F.col("start_line")).alias("line_number"),
        json_field("_issue", "message", "string", REVIEW_DEFAULT_MESSAGE).alias("message"),
        F.lit(REVIEW_CODE).alias("error_code"),
        json_field("_issue", "suggestion", "string").alias("suggested_fix"),
        F.substring("content", 1, 200).alias("code_snippet"),
        F.create_map(F.lit("function"), F.col("qualified_name"), F.lit("analyzed_by"), F.lit("LLM")).alias("metadata"),
        F.lit(5).alias("detector_ord"),
        F.col("_i").cast("long").alias("emit_ord"),
        "entity_id"))
