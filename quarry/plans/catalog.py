"""Query catalogue: each operator run on the driver's tables.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and, where the operator is
expressible in SQL, ``ORACLE[name]`` with the same result in DuckDB SQL over
the pre-registered views. Every query reads whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import path_parent
from ..operators import findings as fnd
from ..operators.rules import DEFAULT_RULES, Rule, rule_findings
from ..sources.tables import files, load
from . import oracle as O
from .registry import ORACLE, QUERIES, register

# User rules for prose texts (our wording), registered next to the defaults.
PROSE_RULES: tuple[Rule, ...] = (
    Rule("license_line", r"(licensed|released) under [^\n.]+",
         "License statement in text", None, "INFO", ("licensed under", "released under")),
    Rule("email_address", r"[\w.+-]+@[\w-]+(\.[\w-]+)+",
         "Personal data: e-mail address", "Mask or remove the address", "WARNING", ("@",)),
    Rule("ipv4_address", r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}",
         "Personal data: IP address", "Mask or remove the address", "WARNING"),
)

# All default rules, plus prose rules.
SCAN_RULES: tuple[Rule, ...] = DEFAULT_RULES + PROSE_RULES


def _findings(spark, sf_dir):
    return rule_findings(files(spark, sf_dir), SCAN_RULES)


# ---------------------------------------------------------------- flagship

def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> rule scan -> ids -> dedup -> at least WARNING -> counts per directory."""
    f = fnd.at_least(fnd.dedup_findings(_findings(spark, sf_dir)), "WARNING")
    return fnd.severity_counts(f.withColumn("directory", path_parent("file_path")), by=["directory"])


_FINDINGS_SQL = O.rule_findings_sql(SCAN_RULES)
_WITH_FILES = f"WITH {O.FILES_CTE}\n"

register("severity_counts_by_dir", _WITH_FILES + f"""
SELECT regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS directory,
       count_if(severity = 'ERROR') AS errors, count_if(severity = 'WARNING') AS warnings,
       count_if(severity = 'INFO') AS infos, count_if(suggested_fix IS NOT NULL) AS auto_fixable,
       count(*) AS total
FROM {O.dedup_sql(_FINDINGS_SQL)} WHERE sev_rank <= 1
GROUP BY 1""")(flagship)


@register("rule_scan_lines", _WITH_FILES + f"""
SELECT path, rule, line_number, match_idx, hit FROM {O.rule_hits_sql(SCAN_RULES)}""")
def rule_scan_lines(spark, sf_dir):
    from ..operators.rules import rule_scan
    return rule_scan(files(spark, sf_dir), SCAN_RULES).select("path", "rule", "line_number", "match_idx", "hit")


# ---------------------------------------------------------------- entities (ENT-*)

from ..functions.text import line_count as _line_count, slice_lines as _slice_lines  # noqa: E402
from ..operators import entities as ent  # noqa: E402


def doc_entities(spark, sf_dir):
    """Stand-in entity table: one whole-file chunk entity per document
    (ENT-12 -> ENT-13), its first line standing in for the docstring."""
    e = ent.chunks_to_entities(ent.file_chunks(files(spark, sf_dir)))
    return e.withColumn("docstring", F.split_part(F.col("content"), F.lit("\n"), F.lit(1)))


def doc_blocks(spark, sf_dir):
    """Paragraph blocks: non-blank lines merged into islands, in each file's row (ENT-08)."""
    return ent.paragraph_blocks(files(spark, sf_dir))


_WF = f"WITH {O.FILES_CTE}"


@register("line_table", f"{_WF}, {O.LINES_CTE} SELECT path, line_no, line FROM lines")
def line_table(spark, sf_dir):
    return ent.explode_lines(files(spark, sf_dir))


@register("line_counts", f"""{_WF} SELECT path, CAST({O.nl('content')} + 1 AS INTEGER) AS line_count,
  CAST(length(content) AS INTEGER) AS n_chars FROM files""")
def line_counts(spark, sf_dir):
    return files(spark, sf_dir).select("path", _line_count("content").alias("line_count"),
                                       F.length("content").alias("n_chars"))


@register("slice_lines", f"""{_WF} SELECT path,
  {O.slice_lines('content', '2', f"greatest(2, {O.nl('content')})")} AS middle FROM files""")
def slice_lines_q(spark, sf_dir):
    f = files(spark, sf_dir)
    return f.select("path", _slice_lines("content", F.lit(2), F.greatest(F.lit(2), _line_count("content") - 1)).alias("middle"))


@register("text_blocks", f"{_WF}, {O.LINES_CTE}, {O.BLOCKS_CTE} SELECT path, block, start_line, end_line FROM blocks")
def text_blocks(spark, sf_dir):
    return doc_blocks(spark, sf_dir)


@register("name_blocks", f"""{_WF}, {O.LINES_CTE}, {O.BLOCKS_CTE}
SELECT b.path, b.block, {O.name_block(O.slice_lines('f.content', 'b.start_line', 'b.end_line'))} AS name
FROM blocks b JOIN files f ON f.path = b.path""")
def name_blocks(spark, sf_dir):
    b = doc_blocks(spark, sf_dir)
    f = files(spark, sf_dir).select("path", "content")
    return b.join(f, "path").select("path", "block", ent.name_block(
        _slice_lines("content", F.col("start_line"), F.col("end_line"))).alias("name"))


@register("chunk_entities", f"""{_WF} SELECT 'STANDALONE' AS entity_type, file_name AS name, path AS file_path,
  1 AS start_line, CAST({O.nl('content')} + 1 AS INTEGER) AS end_line FROM files""")
def chunk_entities(spark, sf_dir):
    return ent.chunks_to_entities(ent.file_chunks(files(spark, sf_dir))).select(
        "entity_type", "name", "file_path", "start_line", "end_line")


@register("derived_columns", f"""{_WF}, {O.DOC_ENTITIES_CTE}
SELECT file_path, CASE WHEN coalesce(parent, '') <> '' THEN parent || '.' || name ELSE name END AS qualified_name,
  file_path || ':' || CAST(start_line AS VARCHAR) || '-' || CAST(end_line AS VARCHAR) AS location,
  CAST(end_line - start_line + 1 AS INTEGER) AS line_count,
  entity_type IN ('FUNCTION', 'METHOD', 'NESTED_FUNCTION', 'CLASS') AS is_callable FROM ents""")
def derived_columns(spark, sf_dir):
    return ent.add_derived(doc_entities(spark, sf_dir)).select(
        "file_path", "qualified_name", "location", "line_count", "is_callable")


@register("validate_ranges", f"""{_WF}, {O.LINES_CTE}, {O.BLOCKS_CTE}
SELECT path AS file_path, start_line, CAST(end_line - 2 AS INTEGER) AS end_line,
  CASE WHEN start_line < 1 THEN 'start_line must be >= 1, got ' || CAST(start_line AS VARCHAR)
       WHEN end_line - 2 < start_line THEN 'end_line (' || CAST(end_line - 2 AS VARCHAR) || ') must be >= start_line ('
            || CAST(start_line AS VARCHAR) || ')' END AS reason
FROM blocks""")
def validate_ranges_q(spark, sf_dir):
    """Block ranges trimmed by two lines: one-line blocks become invalid;
    valid and quarantined rows are both returned, tagged by ``reason``."""
    b = doc_blocks(spark, sf_dir).select(F.col("path").alias("file_path"), "start_line",
                                         (F.col("end_line") - 2).cast("int").alias("end_line"),
                                         F.lit("x").alias("name"))
    good, bad = ent.validate_ranges(b)
    bad_rows = bad.select(F.get_json_object("payload", "$.file_path").alias("file_path"),
                          F.get_json_object("payload", "$.start_line").cast("int").alias("start_line"),
                          F.get_json_object("payload", "$.end_line").cast("int").alias("end_line"), "reason")
    return good.select("file_path", "start_line", "end_line", F.lit(None).cast("string").alias("reason")) \
        .unionByName(bad_rows)


_HEADER_SQL = """concat_ws(chr(10), '# ' || entity_type || ': ' || CASE WHEN coalesce(parent, '') <> '' THEN parent || '.' || name ELSE name END,
  CASE WHEN coalesce(signature, '') <> '' THEN '# Signature: ' || signature END,
  '# Location: ' || file_path || ':' || CAST(start_line AS VARCHAR) || '-' || CAST(end_line AS VARCHAR),
  CASE WHEN coalesce(docstring, '') <> '' THEN '# Docstring: ' || """ + O.preview("docstring", 100) + """ END)"""


@register("context_headers", f"{_WF}, {O.DOC_ENTITIES_CTE} SELECT file_path, {_HEADER_SQL} AS header FROM ents")
def context_headers(spark, sf_dir):
    return doc_entities(spark, sf_dir).select("file_path", ent.context_header().alias("header"))


@register("render_documents", f"""{_WF}, {O.DOC_ENTITIES_CTE}
SELECT file_path, {_HEADER_SQL} || chr(10) || chr(10) || '```python' || chr(10) || content || chr(10) || '```' AS document FROM ents""")
def render_documents(spark, sf_dir):
    return doc_entities(spark, sf_dir).select("file_path", ent.render_document().alias("document"))


@register("document_code", f"""{_WF}, {O.DOC_ENTITIES_CTE},
docs AS (SELECT file_path, {_HEADER_SQL} || chr(10) || chr(10) || '```python' || chr(10) || content || chr(10) || '```' AS document FROM ents)
SELECT file_path, CASE WHEN contains(document, '```python')
  THEN {O.py_strip("split_part(split_part(document, '```python', 2), '```', 1)")} ELSE document END AS code FROM docs""")
def document_code(spark, sf_dir):
    d = doc_entities(spark, sf_dir).select("file_path", ent.render_document().alias("document"))
    return d.select("file_path", ent.document_code("document").alias("code"))


@register("entity_ids", f"""{_WF}, {O.LINES_CTE}, {O.BLOCKS_CTE}
SELECT path || ':' || CAST(start_line AS VARCHAR) || ':' || CAST(end_line AS VARCHAR) || ':' || 'block_' || CAST(block AS VARCHAR) AS id
FROM blocks""")
def entity_ids(spark, sf_dir):
    b = doc_blocks(spark, sf_dir).select(F.col("path").alias("file_path"), "start_line", "end_line",
                                         F.concat(F.lit("block_"), F.col("block").cast("string")).alias("name"))
    return b.select(ent.entity_id().alias("id"))


@register("dedup_entities", f"""{_WF}, {O.DOC_ENTITIES_CTE},
k AS (SELECT *, row_number() OVER (PARTITION BY CAST(NULL AS VARCHAR), start_line, end_line, name ORDER BY entity_type, content) AS rn
      FROM (SELECT entity_type, md5(content) AS name, content, file_path, start_line, end_line FROM ents))
SELECT name AS text_md5, start_line, end_line FROM k WHERE rn = 1""")
def dedup_entities_q(spark, sf_dir):
    """Exact-copy documents collapse: key (path, start, end, name) with the path
    blanked and the content hash as the name."""
    e = doc_entities(spark, sf_dir).select(
        "entity_type", F.md5("content").alias("name"), "content",
        F.lit(None).cast("string").alias("file_path"), "start_line", "end_line")
    return ent.dedup_entities(e).select(F.col("name").alias("text_md5"), "start_line", "end_line")


@register("type_breakdown", f"""{_WF}, {O.LINES_CTE}, {O.BLOCKS_CTE},
e AS (SELECT 'STANDALONE' AS entity_type FROM files UNION ALL SELECT 'BLOCK' FROM blocks)
SELECT entity_type, count(*) AS n FROM e GROUP BY entity_type""")
def type_breakdown_q(spark, sf_dir):
    e = doc_entities(spark, sf_dir).select("entity_type").unionByName(
        doc_blocks(spark, sf_dir).select(F.lit("BLOCK").alias("entity_type")))
    return ent.type_breakdown(e)


@register("ingest_summary", f"""{_WF}, {O.DOC_ENTITIES_CTE}
SELECT count(DISTINCT file_path) AS files_processed, count(*) AS entities_extracted,
  count_if(entity_type = 'FUNCTION') AS function, count_if(entity_type = 'CLASS') AS class,
  count_if(entity_type = 'METHOD') AS method, count_if(entity_type = 'NESTED_FUNCTION') AS nested_function,
  count_if(entity_type = 'MODULE') AS module, count_if(entity_type = 'STANDALONE') AS standalone FROM ents""")
def ingest_summary_q(spark, sf_dir):
    return ent.ingest_summary(doc_entities(spark, sf_dir))


@register("metadata_projection", f"""{_WF}, {O.DOC_ENTITIES_CTE}
SELECT file_path, '{{"entity_type":' || to_json(entity_type) || ',"name":' || to_json(name)
  || ',"qualified_name":' || to_json(name) || ',"file_path":' || to_json(file_path)
  || ',"start_line":' || CAST(start_line AS VARCHAR) || ',"end_line":' || CAST(end_line AS VARCHAR)
  || ',"line_count":' || CAST(end_line - start_line + 1 AS VARCHAR) || ',"parent":"","is_callable":false'
  || CASE WHEN coalesce(docstring, '') <> '' THEN ',"docstring":' || to_json(substr(docstring, 1, 1000)) ELSE '' END
  || '}}' AS metadata FROM ents""")
def metadata_projection(spark, sf_dir):
    e = doc_entities(spark, sf_dir)
    return e.select("file_path", ent.to_metadata().alias("metadata"))


# ---------------------------------------------------------------- findings over events (DET-06, FND-*)

from ..operators.detect import map_severity  # noqa: E402


def event_findings(spark, sf_dir):
    """Stand-in findings: one per event. The event type is the tool's level text
    (DET-06 maps it to a severity), ``user_id`` the file, ``props.k`` the line,
    ``value`` the tool (MYPY/PYLINT/RUFF = detector order), ``event_id`` the emit order."""
    from ..sources.tables import spread
    ev = spread(load(spark, sf_dir, "events"))
    level = (F.when(F.col("event_type") == "view", "note").when(F.col("event_type") == "click", "warning")
             .otherwise(F.col("event_type")))
    source = F.when(F.col("value") >= 30, "MYPY").when(F.col("value") >= 10, "PYLINT").otherwise("RUFF")
    msg_type = F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type"))
    return fnd.to_findings(ev.select(
        source.alias("source"),
        map_severity(level).alias("severity"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string"), F.lit("/events.log")).alias("file_path"),
        F.get_json_object("props", "$.k").cast("int").alias("line_number"),
        (F.floor(F.col("value")).cast("int") % 3).alias("col"),
        F.concat(msg_type, F.lit(" event observed")).alias("message"),
        F.when(F.col("event_type") != "purchase", F.concat(F.lit("E-"), F.col("event_type"))).alias("error_code"),
        F.when(F.col("event_type") == "signup", F.lit("")).when(F.col("event_type") == "click", F.lit("retry")).alias("suggested_fix"),
        F.col("props").alias("code_snippet"),
        F.when(F.col("value") >= 30, 0).when(F.col("value") >= 10, 1).otherwise(2).alias("detector_ord"),
        F.col("event_id").alias("emit_ord"),
        "user_id", "ts", "event_id", "value", "event_type"))


EV_FINDINGS_CTE = """evf0 AS (SELECT
  CASE WHEN value >= 30 THEN 'MYPY' WHEN value >= 10 THEN 'PYLINT' ELSE 'RUFF' END AS source,
  CASE (CASE event_type WHEN 'view' THEN 'note' WHEN 'click' THEN 'warning' ELSE event_type END)
       WHEN 'error' THEN 'ERROR' WHEN 'warning' THEN 'WARNING' WHEN 'note' THEN 'INFO' ELSE 'WARNING' END AS severity,
  'user_' || CAST(user_id AS VARCHAR) || '/events.log' AS file_path,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS line_number,
  CAST(floor(value) AS INTEGER) % 3 AS col,
  (CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END) || ' event observed' AS message,
  CASE WHEN event_type <> 'purchase' THEN 'E-' || event_type END AS error_code,
  CASE WHEN event_type = 'signup' THEN '' WHEN event_type = 'click' THEN 'retry' END AS suggested_fix,
  props AS code_snippet,
  CASE WHEN value >= 30 THEN 0 WHEN value >= 10 THEN 1 ELSE 2 END AS detector_ord,
  event_id AS emit_ord, user_id, ts, event_id, value, event_type FROM events),
evf AS (SELECT substr(md5(file_path || ':' || CAST(line_number AS VARCHAR) || CASE WHEN col IS NOT NULL AND col <> 0 THEN ':' || CAST(col AS VARCHAR) ELSE '' END || ':' || message), 1, 12) AS id,
  CASE severity WHEN 'ERROR' THEN 0 WHEN 'WARNING' THEN 1 WHEN 'INFO' THEN 2 ELSE 3 END AS sev_rank, * FROM evf0)"""
_WE = f"WITH {EV_FINDINGS_CTE}"
_LOC_SQL = "file_path || ':' || CAST(line_number AS VARCHAR) || CASE WHEN col IS NOT NULL AND col <> 0 THEN ':' || CAST(col AS VARCHAR) ELSE '' END"


@register("severity_map", f"{_WE} SELECT event_id, severity, sev_rank FROM evf")
def severity_map(spark, sf_dir):
    return event_findings(spark, sf_dir).select("event_id", "severity", "sev_rank")


@register("event_severity_counts", f"""{_WE} SELECT source, count_if(severity = 'ERROR') AS errors,
  count_if(severity = 'WARNING') AS warnings, count_if(severity = 'INFO') AS infos,
  count_if(suggested_fix IS NOT NULL) AS auto_fixable, count(*) AS total FROM evf GROUP BY source""")
def event_severity_counts(spark, sf_dir):
    return fnd.severity_counts(event_findings(spark, sf_dir), by=["source"])


@register("severity_rollup", f"""{_WE} SELECT source, severity, count(*) AS n FROM evf GROUP BY ROLLUP (source, severity)""")
def severity_rollup(spark, sf_dir):
    """FND-14 per source with subtotals (rollup)."""
    return event_findings(spark, sf_dir).rollup("source", "severity").agg(F.count(F.lit(1)).alias("n"))


@register("finding_ids", f"{_WE} SELECT event_id, id FROM evf")
def finding_ids(spark, sf_dir):
    return event_findings(spark, sf_dir).select("event_id", "id")


@register("location_text", f"{_WE} SELECT event_id, {_LOC_SQL} AS location FROM evf")
def location_text_q(spark, sf_dir):
    return event_findings(spark, sf_dir).select("event_id", fnd.location_text().alias("location"))


@register("short_names", f"""{_WE} SELECT event_id, regexp_extract(file_path, '([^/]*)$', 1) AS name,
  split_part(regexp_extract(file_path, '([^/]*)$', 1), '.', 1) || ':' || CAST(line_number AS VARCHAR) || ':'
  || coalesce(nullif(error_code, ''), 'BUG') AS short_name, suggested_fix IS NOT NULL AS is_auto_fixable FROM evf""")
def short_names(spark, sf_dir):
    from ..functions.text import path_name
    f = event_findings(spark, sf_dir)
    return f.select("event_id", path_name("file_path").alias("name"), fnd.short_name(f).alias("short_name"),
                    fnd.is_fixable().alias("is_auto_fixable"))


@register("goal_text", f"""{_WE} SELECT event_id, concat_ws(' ', 'Fix ' || lower(severity),
  'in ' || regexp_extract(file_path, '([^/]*)$', 1), 'at line ' || CAST(line_number AS VARCHAR),
  CASE WHEN coalesce(error_code, '') <> '' THEN '(' || error_code || ')' END, ': ' || message) AS goal FROM evf""")
def goal_text_q(spark, sf_dir):
    return event_findings(spark, sf_dir).select("event_id", fnd.goal_text().alias("goal"))


@register("findings_json", f"""{_WE} SELECT event_id, '{{"id":' || to_json(id) || ',"source":' || to_json(source)
  || ',"severity":' || to_json(severity) || ',"location":{{"file_path":' || to_json(file_path)
  || ',"line_number":' || CAST(line_number AS VARCHAR) || ',"column":' || CAST(col AS VARCHAR) || ',"end_line":null}}'
  || ',"message":' || to_json(message) || ',"error_code":' || coalesce(to_json(error_code), 'null')
  || ',"suggested_fix":' || coalesce(to_json(suggested_fix), 'null') || ',"code_snippet":' || coalesce(to_json(code_snippet), 'null')
  || ',"is_auto_fixable":' || CASE WHEN suggested_fix IS NOT NULL THEN 'true' ELSE 'false' END || '}}' AS json FROM evf""")
def findings_json_q(spark, sf_dir):
    return event_findings(spark, sf_dir).select("event_id", fnd.findings_json().alias("json"))


@register("display_lines", f"""{_WE} SELECT event_id, CASE severity WHEN 'ERROR' THEN '❌' WHEN 'WARNING' THEN '⚠️'
  WHEN 'INFO' THEN 'ℹ️' ELSE '❓' END || ' [' || source || '] ' || {_LOC_SQL} || ' - ' || message AS display FROM evf""")
def display_lines(spark, sf_dir):
    return event_findings(spark, sf_dir).select("event_id", fnd.display_line().alias("display"))


@register("threshold", f"{_WE} SELECT event_id, severity FROM evf WHERE sev_rank <= 1")
def threshold(spark, sf_dir):
    return fnd.at_least(event_findings(spark, sf_dir), "warning").select("event_id", "severity")


@register("severity_sort", f"{_WE} SELECT event_id, sev_rank, detector_ord FROM evf ORDER BY sev_rank, detector_ord, emit_ord")
def severity_sort(spark, sf_dir):
    return fnd.sort_findings(event_findings(spark, sf_dir)).select("event_id", "sev_rank", "detector_ord")


@register("by_source", f"{_WE} SELECT event_id, source, severity FROM evf WHERE source = 'MYPY' AND severity = 'ERROR'")
def by_source_q(spark, sf_dir):
    return fnd.by_severity(fnd.by_source(event_findings(spark, sf_dir), "MYPY"), "error").select(
        "event_id", "source", "severity")


@register("run_summary", f"""{_WE} SELECT (SELECT count(*) FROM documents) AS files_analyzed,
  (SELECT string_agg(source, ', ' ORDER BY source) FROM (SELECT DISTINCT source FROM evf)) AS tools,
  count(*) AS total, count_if(severity = 'ERROR') AS errors, count_if(severity = 'WARNING') AS warnings,
  count_if(severity = 'INFO') AS infos, count_if(suggested_fix IS NOT NULL) AS auto_fixable FROM evf""")
def run_summary_q(spark, sf_dir):
    return fnd.run_summary(event_findings(spark, sf_dir), load(spark, sf_dir, "documents"))


@register("tools_used", f"""{_WE} SELECT user_id, string_agg(DISTINCT source, ', ' ORDER BY source) AS tools FROM evf GROUP BY user_id""")
def tools_used_q(spark, sf_dir):
    return fnd.tools_used(event_findings(spark, sf_dir), by=["user_id"])


@register("cap_findings", f"""{_WE} SELECT event_id, severity FROM evf
  ORDER BY sev_rank, detector_ord, emit_ord, file_path, id LIMIT 100""")
def cap_findings_q(spark, sf_dir):
    return fnd.cap_findings(event_findings(spark, sf_dir), 100).select("event_id", "severity")


@register("top_listing", f"""{_WE}, t AS (SELECT * FROM evf ORDER BY sev_rank, detector_ord, emit_ord, file_path, id LIMIT 20)
SELECT CAST(row_number() OVER (ORDER BY sev_rank, detector_ord, emit_ord, file_path, id) AS INTEGER) AS pos,
  CAST(row_number() OVER (ORDER BY sev_rank, detector_ord, emit_ord, file_path, id) AS VARCHAR) || '. ' ||
  CASE severity WHEN 'ERROR' THEN '❌' WHEN 'WARNING' THEN '⚠️' WHEN 'INFO' THEN 'ℹ️' ELSE '❓' END || ' [' || source || '] '
  || {_LOC_SQL} || ' - ' || message || CASE WHEN suggested_fix IS NOT NULL THEN ' [AUTO-FIXABLE]' ELSE '' END AS listing FROM t""")
def top_listing_q(spark, sf_dir):
    return fnd.top_listing(event_findings(spark, sf_dir), 20)


@register("match_finding", f"""{_WE}, req AS (SELECT DISTINCT user_id AS req_id, file_path, 'Error' AS description FROM evf),
j AS (SELECT r.req_id, f.id, f.message, row_number() OVER (PARTITION BY r.req_id ORDER BY f.detector_ord, f.emit_ord, f.id) AS rn
      FROM req r JOIN evf f ON f.file_path = r.file_path AND contains(lower(f.message), lower(r.description)))
SELECT req_id, id, message FROM j WHERE rn = 1""")
def match_finding_q(spark, sf_dir):
    f = event_findings(spark, sf_dir)
    req = f.select(F.col("user_id").alias("req_id"), "file_path").distinct().withColumn("description", F.lit("Error"))
    return fnd.match_finding(f, req).select("req_id", "id", "message")


@register("snippet_preview", f"""WITH d AS (SELECT doc_id, text AS code_snippet FROM documents)
SELECT doc_id, {O.preview('code_snippet', 100)} AS preview FROM d""")
def snippet_preview_q(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("code_snippet"))
    return d.select("doc_id", fnd.snippet_preview().alias("preview"))


# ---------------------------------------------------------------- detection helpers (DET-08, 10-12)

from ..operators import detect as det  # noqa: E402

# Frame pattern for prose: "<name>.<number>@<host>" stands for file, line, function.
PROSE_FRAME = r"(\w+)\.(\d+)@(\w+)"


@register("frame_nth", f"""WITH d AS (SELECT doc_id,
  regexp_extract_all(text, '({O.WORD}+)\\.(\\p{{Nd}}+)@({O.WORD}+)', 1) AS f,
  regexp_extract_all(text, '({O.WORD}+)\\.(\\p{{Nd}}+)@({O.WORD}+)', 2) AS l,
  regexp_extract_all(text, '({O.WORD}+)\\.(\\p{{Nd}}+)@({O.WORD}+)', 3) AS fn FROM documents)
SELECT doc_id, CASE WHEN len(f) > 0 THEN f[1] END AS file0, CASE WHEN len(f) > 0 THEN CAST(l[1] AS INTEGER) END AS line0,
  CASE WHEN len(f) > 0 THEN fn[1] END AS function0, CASE WHEN len(f) > 1 THEN f[2] END AS file1 FROM d""")
def frame_nth(spark, sf_dir):
    d = _docs(spark, sf_dir)
    f0 = det.stack_frame("text", 0, PROSE_FRAME)
    f1 = det.stack_frame("text", 1, PROSE_FRAME)
    return d.select("doc_id", f0["file"].alias("file0"), f0["line"].alias("line0"),
                    f0["function"].alias("function0"), f1["file"].alias("file1"))


@register("import_lines", f"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)),
  lambda x: {O.py_strip('x')}), lambda x: starts_with(x, 'import ') OR starts_with(x, 'from '))[1:10], chr(10)) AS imports FROM documents""")
def import_lines_q(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", det.import_lines("text").alias("imports"))


_TRIVIAL_SQL = ("(len(list_filter(string_split(lower(content), chr(10)), lambda x: " + O.py_strip("x") + " <> '')) <= 3 "
                "AND (contains(lower(content), 'return self.') OR contains(lower(content), 'return self._') "
                "OR starts_with(name, 'get_') OR starts_with(name, 'set_')))")
_DOC_FUNCS_CTE = ("fe AS (SELECT 'FUNCTION' AS entity_type, lower(split_part(text, ' ', 1)) || '_' || CAST(doc_id AS VARCHAR) AS name, "
                  "text AS content, doc_id, 1 AS start_line, CAST(" + O.nl("text") + " + 1 AS INTEGER) AS end_line FROM documents)")


def _doc_functions(spark, sf_dir):
    """Each document as a FUNCTION stand-in named after its first word."""
    d = _docs(spark, sf_dir)
    from ..functions.text import line_count
    return d.select(F.lit("FUNCTION").alias("entity_type"),
                    F.concat(F.lower(F.split_part("text", F.lit(" "), F.lit(1))), F.lit("_"), F.col("doc_id").cast("string")).alias("name"),
                    F.col("text").alias("content"), "doc_id", F.lit(1).alias("start_line"), line_count("text").alias("end_line"),
                    _doc_path_col().alias("file_path"), F.lit(None).cast("string").alias("parent"))


@register("trivial_filter", f"WITH {_DOC_FUNCS_CTE} SELECT doc_id, {_TRIVIAL_SQL} AS trivial FROM fe")
def trivial_filter(spark, sf_dir):
    return _doc_functions(spark, sf_dir).select("doc_id", det.is_trivial().alias("trivial"))


@register("review_candidates", f"""WITH {_DOC_FUNCS_CTE} SELECT doc_id, name FROM fe
WHERE entity_type IN ('FUNCTION', 'METHOD') AND end_line - start_line + 1 BETWEEN 3 AND 100 AND NOT {_TRIVIAL_SQL}""")
def review_candidates_q(spark, sf_dir):
    return det.review_candidates(_doc_functions(spark, sf_dir)).select("doc_id", "name")


# ---------------------------------------------------------------- union / dedup over documents (FND-08..11, 22)

def doc_findings(spark, sf_dir):
    """Each document as one finding of a review detector: all in one file, line 1,
    message = the text, emitted in doc_id order (copies collapse under dedup)."""
    d = load(spark, sf_dir, "documents")
    return fnd.to_findings(d.select(
        F.lit("LLM_DISCOVERY").alias("source"), F.lit("INFO").alias("severity"),
        F.lit("corpus").alias("file_path"), F.lit(1).alias("line_number"), F.col("text").alias("message"),
        F.lit(1).alias("detector_ord"), F.col("doc_id").alias("emit_ord")))


_DOC_FINDINGS_SQL = """(SELECT substr(md5('corpus:1:' || text), 1, 12) AS id, 'LLM_DISCOVERY' AS source, 'INFO' AS severity,
  'corpus' AS file_path, 1 AS line_number, text AS message, 1 AS detector_ord, doc_id AS emit_ord FROM documents)"""


@register("union_findings", f"""{_WF}, {EV_FINDINGS_CTE},
u AS (SELECT 0 AS detector_ord, source FROM {O.rule_findings_sql(SCAN_RULES)}
      UNION ALL SELECT 1, source FROM {_DOC_FINDINGS_SQL} UNION ALL SELECT 2, source FROM evf)
SELECT detector_ord, source, count(*) AS n FROM u GROUP BY ALL""")
def union_findings_q(spark, sf_dir):
    u = fnd.union_findings(_findings(spark, sf_dir), doc_findings(spark, sf_dir), event_findings(spark, sf_dir))
    return u.groupBy("detector_ord", "source").agg(F.count(F.lit(1)).alias("n"))


@register("dedup_ci", f"SELECT emit_ord AS doc_id FROM {O.dedup_sql(_DOC_FINDINGS_SQL)}")
def dedup_ci(spark, sf_dir):
    return fnd.dedup_findings(doc_findings(spark, sf_dir)).select(F.col("emit_ord").alias("doc_id"))


@register("dedup_cs", f"SELECT emit_ord AS doc_id FROM {O.dedup_sql(_DOC_FINDINGS_SQL, lower=False)}")
def dedup_cs(spark, sf_dir):
    return fnd.dedup_findings(doc_findings(spark, sf_dir), lower=False).select(F.col("emit_ord").alias("doc_id"))


@register("distinct_ids", f"""SELECT id, emit_ord AS doc_id FROM (SELECT *, row_number() OVER (PARTITION BY id
  ORDER BY detector_ord, emit_ord, id) AS rn FROM {_DOC_FINDINGS_SQL}) WHERE rn = 1""")
def distinct_ids(spark, sf_dir):
    return fnd.distinct_findings(doc_findings(spark, sf_dir)).select("id", F.col("emit_ord").alias("doc_id"))


@register("attach_block", f"""{_WF}, {O.LINES_CTE}, {O.BLOCKS_CTE},
ents AS (SELECT path AS e_path, path || ':' || CAST(start_line AS VARCHAR) || ':' || CAST(end_line AS VARCHAR) || ':block_'
         || CAST(block AS VARCHAR) AS entity_id, start_line AS e_start, end_line AS e_end FROM blocks),
f AS {O.rule_findings_sql(SCAN_RULES)},
j AS (SELECT f.id, f.emit_ord, f.line_number, e.entity_id, row_number() OVER (PARTITION BY f.id, f.detector_ord, f.emit_ord
      ORDER BY e.e_end - e.e_start ASC NULLS LAST, e.e_start DESC, e.entity_id) AS rn
      FROM f LEFT JOIN ents e ON f.file_path = e.e_path AND f.line_number BETWEEN e.e_start AND e.e_end)
SELECT id, emit_ord, line_number, entity_id FROM j WHERE rn = 1""")
def attach_block(spark, sf_dir):
    b = doc_blocks(spark, sf_dir)
    ents = b.select(F.col("path").alias("file_path"), "start_line", "end_line",
                    F.concat(F.lit("block_"), F.col("block").cast("string")).alias("name"))
    ents = ents.withColumn("id", ent.entity_id())
    return fnd.attach_entity(_findings(spark, sf_dir), ents).select("id", "emit_ord", "line_number", "entity_id")


# ---------------------------------------------------------------- work-list gate and counters (FIX-22, FND-23)

from ..operators import workflow as wf  # noqa: E402


def _decisions(spark, sf_dir):
    """Decisions table: label rows keyed by event id; quality 1 = process."""
    lab = load(spark, sf_dir, "labels")
    return lab.select(F.col("doc_id").alias("event_id"), (F.col("quality") == 1).alias("approve"),
                      (F.col("toxic") == 1).alias("fails"))


@register("gate", f"""{_WE}, w AS (SELECT * FROM evf WHERE sev_rank <= 1)
SELECT event_id, CASE WHEN event_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 'process' ELSE 'skip' END AS decision FROM w""")
def gate_q(spark, sf_dir):
    work = fnd.at_least(event_findings(spark, sf_dir), "WARNING")
    dec = _decisions(spark, sf_dir)
    go, skip = wf.gate(work, dec.filter("approve").select("event_id"), "event_id")
    return go.select("event_id", F.lit("process").alias("decision")).unionByName(
        skip.select("event_id", F.lit("skip").alias("decision")))


@register("fix_counters", f"""{_WE}, w AS (SELECT e.event_id, l.quality, l.toxic FROM evf e LEFT JOIN labels l ON l.doc_id = e.event_id WHERE e.sev_rank <= 1),
o AS (SELECT CASE WHEN quality = 1 AND toxic = 0 THEN 'fixed' WHEN quality = 1 THEN 'failed' ELSE 'skipped' END AS outcome FROM w)
SELECT count(*) AS total, count_if(outcome = 'fixed') AS fixed, count_if(outcome = 'failed') AS failed,
  count_if(outcome = 'skipped') AS skipped FROM o""")
def fix_counters_q(spark, sf_dir):
    work = fnd.at_least(event_findings(spark, sf_dir), "WARNING").select("event_id")
    o = work.join(_decisions(spark, sf_dir), "event_id", "left").select(
        F.when(F.col("approve") & ~F.col("fails"), "fixed").when(F.col("approve"), "failed")
        .otherwise("skipped").alias("outcome"))
    return fnd.fix_counters(o)


# ---------------------------------------------------------------- workflow (FIX-*)

from ..functions.text import preview as _preview  # noqa: E402


@register("validate_goals", """SELECT item_id AS goal_id,
  CASE WHEN length(trim(text)) < 10 THEN 'User goal must be at least 10 characters'
       WHEN CAST(length(text) % 13 AS INTEGER) - 1 NOT BETWEEN 0 AND 10 THEN 'max_retries must be between 0 and 10' END AS reason
FROM benchmark""")
def validate_goals_q(spark, sf_dir):
    b = load(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("goal_id"), F.col("text").alias("user_goal"),
        ((F.length("text") % 13) - 1).cast("int").alias("max_retries"))
    good, bad = wf.validate_goals(b)
    return good.select("goal_id", F.lit(None).cast("string").alias("reason")).unionByName(
        bad.select(F.col("key").cast("long").alias("goal_id"), "reason"))


@register("goals_from_findings", f"""{_WE} SELECT id AS goal_id, concat_ws(' ', 'Fix ' || lower(severity),
  'in ' || regexp_extract(file_path, '([^/]*)$', 1), 'at line ' || CAST(line_number AS VARCHAR),
  CASE WHEN coalesce(error_code, '') <> '' THEN '(' || error_code || ')' END, ': ' || message) AS user_goal,
  3 AS max_retries FROM evf WHERE sev_rank <= 1""")
def goals_from_findings_q(spark, sf_dir):
    return wf.goals_from_findings(event_findings(spark, sf_dir))


def _review_log(spark, sf_dir):
    """Review log stand-in: every event is a review, a purchase an approving one; one
    goal per user, reviews in time order."""
    ev = load(spark, sf_dir, "events")
    return ev.select(F.col("user_id").alias("goal_id"), "ts", (F.col("event_type") == "purchase").alias("approved"),
                     "event_id", "event_type", "value", "props")


_REVIEWS_CTE = """rv AS (SELECT user_id AS goal_id, ts, event_type = 'purchase' AS approved, event_id, event_type, value, props
  FROM events)"""


@register("outcomes_from_log", f"""WITH {_REVIEWS_CTE},
f AS (SELECT goal_id, min(CASE WHEN approved THEN ts END) AS first_ok, count(*) AS n FROM rv GROUP BY goal_id),
b AS (SELECT rv.goal_id, count_if(f.first_ok IS NOT NULL AND rv.ts < f.first_ok) AS n_before FROM rv JOIN f USING (goal_id) GROUP BY rv.goal_id),
g AS (SELECT DISTINCT user_id AS goal_id, 3 AS max_retries FROM events),
j AS (SELECT g.goal_id, g.max_retries, f.first_ok, coalesce(f.n, 0) AS n, b.n_before FROM g LEFT JOIN f USING (goal_id) LEFT JOIN b USING (goal_id)),
s AS (SELECT *, CASE WHEN first_ok IS NOT NULL AND n_before + 1 <= max_retries + 1 THEN 'approved'
                     WHEN n >= max_retries + 1 THEN 'rejected' ELSE 'open' END AS final_status FROM j)
SELECT goal_id, final_status, CAST(CASE final_status WHEN 'approved' THEN n_before WHEN 'rejected' THEN max_retries
  ELSE greatest(n - 1, 0) END AS INTEGER) AS retry_count, CAST(least(n, max_retries + 1) AS INTEGER) AS reviews_used FROM s""")
def outcomes_from_log_q(spark, sf_dir):
    goals = load(spark, sf_dir, "events").select(F.col("user_id").alias("goal_id")).distinct() \
        .withColumn("max_retries", F.lit(3))
    return wf.outcomes_from_log(_review_log(spark, sf_dir), goals)


def _attempts(spark, sf_dir):
    """Attempt rows: reviews numbered per goal by time (retry_count = number - 1)."""
    from pyspark.sql.window import Window
    r = _review_log(spark, sf_dir).withColumn("_attempt", F.row_number().over(Window.partitionBy("goal_id").orderBy("ts", "event_id")))
    return r.withColumns({
        "retry_count": (F.col("_attempt") - 1).cast("int"),
        "max_retries": F.lit(3),
        "proposed_fix": F.when(F.col("value") >= 5, F.col("props")),
        "is_approved": F.col("approved"),
        "feedback": F.when(~F.col("approved"), F.concat(F.lit("Rejected at value "), F.floor("value").cast("string"))),
        "issues": F.when(~F.col("approved"), F.array(F.col("props"), F.lit("check the bounds"))).otherwise(F.array().cast("array<string>")),
        "failed": F.col("value") >= 49,
    }).drop("_attempt")


_ATTEMPTS_CTE = _REVIEWS_CTE + """, att AS (SELECT *, CAST(row_number() OVER (PARTITION BY goal_id ORDER BY ts, event_id) - 1 AS INTEGER) AS retry_count,
  3 AS max_retries, CASE WHEN value >= 5 THEN props END AS proposed_fix, approved AS is_approved,
  CASE WHEN NOT approved THEN 'Rejected at value ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS feedback,
  CASE WHEN NOT approved THEN [props, 'check the bounds'] ELSE [] END AS issues, value >= 49 AS failed FROM rv)"""
_NEXT_SQL = """CASE WHEN failed THEN 'failed' WHEN coalesce(proposed_fix, '') = '' THEN 'rejected' WHEN is_approved THEN 'approved'
  WHEN retry_count < max_retries THEN 'coding' ELSE 'rejected' END"""


@register("next_status", f"WITH {_ATTEMPTS_CTE} SELECT event_id, retry_count, {_NEXT_SQL} AS next_status FROM att")
def next_status_q(spark, sf_dir):
    a = _attempts(spark, sf_dir)
    return a.select("event_id", "retry_count", wf.next_status().alias("next_status"))


@register("retry_rows", f"""WITH {_ATTEMPTS_CTE} SELECT event_id, retry_count + 1 AS retry_count, 'coding' AS status,
  CAST(NULL AS VARCHAR) AS proposed_fix, feedback FROM att WHERE ({_NEXT_SQL}) = 'coding'""")
def retry_rows_q(spark, sf_dir):
    a = _attempts(spark, sf_dir)
    r = wf.retry_rows(a.filter(wf.next_status() == "coding"))
    return r.select("event_id", "retry_count", "status", "proposed_fix", "feedback")


def _results(spark, sf_dir):
    a = _attempts(spark, sf_dir).withColumn("status", wf.next_status())
    return wf.result_rows(a.withColumn("goal_id", F.col("event_id")))


_RESULTS_CTE = _ATTEMPTS_CTE + f""", res AS (SELECT event_id AS goal_id, ({_NEXT_SQL}) = 'approved' AS success,
  ({_NEXT_SQL}) = 'approved' AS is_approved, proposed_fix AS fix, feedback, issues, retry_count, ({_NEXT_SQL}) AS final_status,
  0 AS retrieved_context_count FROM att)"""


@register("result_rows", f"""WITH {_RESULTS_CTE} SELECT goal_id, success, fix, feedback, CAST(len(issues) AS INTEGER) AS n_issues,
  retry_count, final_status, retrieved_context_count FROM res""")
def result_rows_q(spark, sf_dir):
    return _results(spark, sf_dir).select("goal_id", "success", "fix", "feedback", F.size("issues").alias("n_issues"),
                                          "retry_count", "final_status", "retrieved_context_count")


@register("result_preview", f"""WITH {_RESULTS_CTE} SELECT goal_id,
  CASE WHEN success THEN '✅ APPROVED' ELSE '❌ REJECTED' END || ' (retries: ' || CAST(retry_count AS VARCHAR) || ')' || chr(10)
  || CASE WHEN coalesce(fix, '') <> '' THEN chr(10) || 'Proposed Fix (' || CAST(length(fix) AS VARCHAR) || ' chars):' || chr(10)
     || '```python' || chr(10) || substr(fix, 1, 500) || CASE WHEN length(fix) > 500 THEN chr(10) || '... (truncated)' ELSE '' END
     || chr(10) || '```' || chr(10) ELSE '' END
  || CASE WHEN coalesce(feedback, '') <> '' THEN chr(10) || 'Feedback: ' || substr(feedback, 1, 200)
     || CASE WHEN length(feedback) > 200 THEN '...' ELSE '' END || chr(10) ELSE '' END
  || CASE WHEN len(issues) > 0 THEN chr(10) || 'Issues (' || CAST(len(issues) AS VARCHAR) || '):' || chr(10)
     || array_to_string(list_transform(issues[1:3], lambda x: '  - ' || substr(x, 1, 80) || chr(10)), '') ELSE '' END AS preview
FROM res""")
def result_preview_q(spark, sf_dir):
    r = _results(spark, sf_dir)
    return r.select("goal_id", wf.result_preview(r).alias("preview"))


@register("report_md", f"""WITH {_RESULTS_CTE} SELECT goal_id, chr(10) || '# Fix Result Report' || chr(10) || '## Summary' || chr(10)
  || '- **Success**: ' || CASE WHEN success THEN 'True' ELSE 'False' END || chr(10)
  || '- **Approved**: ' || CASE WHEN is_approved THEN 'True' ELSE 'False' END || chr(10)
  || '- **Retries**: ' || CAST(retry_count AS VARCHAR) || chr(10) || '- **Timestamp**: 2024-01-01 00:00:00' || chr(10)
  || '## Proposed Fix' || chr(10) || CASE WHEN coalesce(fix, '') <> '' THEN '```python' || chr(10) || fix || chr(10) || '```' ELSE 'No fix generated' END
  || chr(10) || '## Feedback' || chr(10) || coalesce(feedback, 'None') || chr(10) || '## Issues Found' || chr(10)
  || CASE WHEN len(issues) > 0 THEN array_to_string(list_transform(issues, lambda x, i: CAST(i - 1 AS VARCHAR) || '. ' || x || chr(10)), '')
     ELSE 'No issues reported' END AS report FROM res""")
def report_md_q(spark, sf_dir):
    r = _results(spark, sf_dir)
    return r.select("goal_id", wf.report_md(r, "2024-01-01 00:00:00").alias("report"))


@register("retry_context", f"""WITH {_ATTEMPTS_CTE} SELECT event_id, CASE WHEN retry_count = 0 THEN ''
  WHEN coalesce(feedback, '') = '' AND len(issues) = 0 THEN ''
  ELSE concat_ws(chr(10), chr(10) || '## Previous Attempt Feedback' || chr(10),
    'The previous fix was rejected with this feedback:' || chr(10) || coalesce(feedback, 'None'),
    CASE WHEN len(issues) > 0 THEN chr(10) || 'Specific issues to address:' || chr(10)
      || array_to_string(list_transform(issues, lambda x: '  - ' || x), chr(10)) END) END AS retry_context FROM att""")
def retry_context_q(spark, sf_dir):
    return _attempts(spark, sf_dir).select("event_id", wf.retry_context().alias("retry_context"))


# ---------------------------------------------------------------- retrieval (RET-*)

from ..operators import retrieval as ret  # noqa: E402
from ..functions.regex import sql_literal as _sql_lit  # noqa: E402

_DIST_SQL = ("round(list_sum(list_transform(range(1, len(q.qv) + 1), lambda i: "
             "(CAST(q.qv[i] AS DOUBLE) - CAST(e.embedding[i] AS DOUBLE)) * (CAST(q.qv[i] AS DOUBLE) - CAST(e.embedding[i] AS DOUBLE)))), 6)")


def _vec_sql(where: str = "TRUE", k: int = 5) -> str:
    return f"""WITH q AS (SELECT vec_id AS qid, embedding AS qv FROM embeddings),
d AS (SELECT q.qid, e.vec_id AS id, {_DIST_SQL} AS distance FROM q, embeddings e WHERE {where}),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS INTEGER) AS rank FROM d)
SELECT qid, id, distance, 1.0 - distance AS score, rank FROM r WHERE rank <= {k}"""


def _embeddings(spark, sf_dir):
    return load(spark, sf_dir, "embeddings")


@register("vector_topk", _vec_sql())
def vector_topk_q(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    return ret.vector_topk(e.select(F.col("vec_id").alias("qid"), "embedding"), e, 5, id_col="vec_id") \
        .withColumnRenamed("vec_id", "id")


@register("vector_topk_filtered", _vec_sql("e.label = 3"))
def vector_topk_filtered(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    return ret.vector_topk(e.select(F.col("vec_id").alias("qid"), "embedding"), e, 5, id_col="vec_id",
                           where=F.col("label") == 3).withColumnRenamed("vec_id", "id")


@register("index_stats", "SELECT CAST(label AS VARCHAR) AS entity_type, count(*) AS n FROM embeddings GROUP BY 1")
def index_stats_q(spark, sf_dir):
    return ret.index_stats(_embeddings(spark, sf_dir), "label")


@register("upsert_index", """WITH old AS (SELECT vec_id, label FROM embeddings WHERE label < 5),
u AS (SELECT * FROM old UNION ALL SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM old))
SELECT label, count(*) AS n, count(DISTINCT vec_id) AS ids FROM u GROUP BY label""")
def upsert_index_q(spark, sf_dir):
    e = _embeddings(spark, sf_dir).select("vec_id", "label")
    u = ret.upsert_index(e.filter(F.col("label") < 5), e.unionByName(e), id_col="vec_id")
    return u.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("vec_id").alias("ids"))


@register("index_add", """SELECT label, count(*) AS n, count(DISTINCT vec_id) AS ids, CAST(sum(CASE WHEN label < 5 THEN 1 ELSE 2 END) AS BIGINT) AS batches
FROM embeddings GROUP BY label""")
def index_add_q(spark, sf_dir):
    """RET-06 over a bucketed index: two adds, the second with every stored id again."""
    import uuid
    from ..session import checkpoint_dir
    e = _embeddings(spark, sf_dir).select("vec_id", "label")
    name, path = f"index_{uuid.uuid4().hex}", f"{checkpoint_dir(spark).rstrip('/')}/index_add/{uuid.uuid4().hex}"
    first = e.filter("label < 5").withColumn("batch", F.lit(1))
    ret.create_index(spark, name, first.schema, path, "vec_id", 8)
    ret.add_to_index(spark, name, first, "vec_id")
    again = e.withColumn("batch", F.lit(2))
    ret.add_to_index(spark, name, again.unionByName(again), "vec_id")
    spark.sql(f"DROP TABLE {name}")  # the files stay
    return spark.read.parquet(path).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("vec_id").alias("ids"), F.sum("batch").alias("batches"))


_TOK = r"[^\p{L}\p{N}_]+"
_KW_CTE = f"""qt AS (SELECT DISTINCT item_id AS qid, unnest(list_filter(regexp_split_to_array(lower(text), '{_TOK}'), lambda x: x <> '')) AS term FROM benchmark),
qn AS (SELECT qid, count(*) AS nq FROM qt GROUP BY qid),
dt AS (SELECT DISTINCT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '{_TOK}'), lambda x: x <> '')) AS term FROM documents),
kw AS (SELECT qt.qid, dt.doc_id, count(*) / max(qn.nq) AS keyword_score FROM qt JOIN dt USING (term) JOIN qn USING (qid) GROUP BY qt.qid, dt.doc_id)"""


@register("keyword_score", f"WITH {_KW_CTE} SELECT qid, doc_id, round(keyword_score, 6) AS keyword_score FROM kw")
def keyword_score_q(spark, sf_dir):
    q = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    kw = ret.keyword_score(q, _docs(spark, sf_dir))
    return kw.withColumn("keyword_score", F.round("keyword_score", 6))


_TFIDF_CTE = f"""dtf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '{_TOK}'), lambda x: x <> '')) AS term FROM documents) GROUP BY ALL),
nd AS (SELECT count(*) AS n FROM documents),
idf AS (SELECT term, ln((1 + (SELECT n FROM nd)) / (1 + count(*))) + 1 AS idf FROM dtf GROUP BY term),
dw0 AS (SELECT doc_id, term, tf * idf AS w FROM dtf JOIN idf USING (term)),
dw AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM dw0),
qtf AS (SELECT qid, term, count(*) AS tf FROM (SELECT item_id AS qid, unnest(list_filter(regexp_split_to_array(lower(text), '{_TOK}'), lambda x: x <> '')) AS term FROM benchmark) GROUP BY ALL),
qw0 AS (SELECT qid, term, tf * coalesce(idf, ln(1 + (SELECT n FROM nd)) + 1) AS qw FROM qtf LEFT JOIN idf USING (term)),
qw AS (SELECT qid, term, qw / sqrt(sum(qw * qw) OVER (PARTITION BY qid)) AS qw FROM qw0),
sim AS (SELECT qid, doc_id, sum(w * qw) AS similarity FROM dw JOIN qw USING (term) GROUP BY qid, doc_id)"""


def _docs(spark, sf_dir):
    from ..sources.tables import spread
    return spread(load(spark, sf_dir, "documents"))


def _text_topk(spark, sf_dir, rank_by):
    q = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return ret.text_topk(q, ret.build_text_index(load(spark, sf_dir, "documents")), 5, rank_by)


@register("tfidf_topk", f"""WITH {_TFIDF_CTE}, r AS (SELECT qid, doc_id, round(similarity, 6) AS similarity FROM sim),
t AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, doc_id) AS INTEGER) AS rank FROM r)
SELECT qid, doc_id, similarity, rank FROM t WHERE rank <= 5""")
def tfidf_topk(spark, sf_dir):
    return _text_topk(spark, sf_dir, "similarity").select("qid", "doc_id", "similarity", "rank")


@register("hybrid_topk", f"""WITH {_TFIDF_CTE}, {_KW_CTE},
j AS (SELECT coalesce(sim.qid, kw.qid) AS qid, coalesce(sim.doc_id, kw.doc_id) AS doc_id,
  coalesce(similarity, 0.0) AS similarity, coalesce(keyword_score, 0.0) AS keyword_score
  FROM sim FULL OUTER JOIN kw ON sim.qid = kw.qid AND sim.doc_id = kw.doc_id),
s AS (SELECT qid, doc_id, round(0.7 * similarity + 0.3 * keyword_score, 6) AS score FROM j),
t AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s)
SELECT qid, doc_id, score, rank FROM t WHERE rank <= 5""")
def hybrid_topk_q(spark, sf_dir):
    return _text_topk(spark, sf_dir, "score").select("qid", "doc_id", "score", "rank")


@register("keyword_topk", f"""WITH {_KW_CTE},
t AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(keyword_score, 6) DESC, doc_id) AS INTEGER) AS rank FROM kw)
SELECT qid, doc_id, round(keyword_score, 6) AS keyword_score, rank FROM t WHERE rank <= 5""")
def keyword_topk_q(spark, sf_dir):
    """RET-08 as a top-k: no table of all pairs."""
    return _text_topk(spark, sf_dir, "keyword_score").select("qid", "doc_id", "keyword_score", "rank")


# ---------------------------------------------------------------- prompt context (FIX-06 to 08), from a retrieval

def _goal_contexts(spark, sf_dir):
    """Per benchmark item (goal): its five best documents by the hybrid score as the
    retrieved context, in rank order; goals that find nothing keep an empty one."""
    hits = _text_topk(spark, sf_dir, "score").select("qid", "doc_id", "rank")
    e = ent.add_derived(doc_entities(spark, sf_dir))
    e = e.select(F.regexp_extract("name", r"doc_(\d+)", 1).cast("long").alias("doc_id"), "qualified_name", "location", "docstring",
                 ent.render_document().alias("document"))
    goals = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"))
    return ret.retrieve(goals, hits.join(e, "doc_id"), "qid", ("qualified_name", "location", "docstring", "document"))


_GOAL_CTX_CTE = f"""{O.FILES_CTE}, {O.DOC_ENTITIES_CTE}, {_TFIDF_CTE}, {_KW_CTE},
hj AS (SELECT coalesce(sim.qid, kw.qid) AS qid, coalesce(sim.doc_id, kw.doc_id) AS doc_id,
  round(0.7 * coalesce(similarity, 0.0) + 0.3 * coalesce(keyword_score, 0.0), 6) AS score
  FROM sim FULL OUTER JOIN kw ON sim.qid = kw.qid AND sim.doc_id = kw.doc_id),
hr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM hj),
e AS (SELECT *, CAST(regexp_extract(name, 'doc_([0-9]+)', 1) AS BIGINT) AS doc_id FROM ents),
found AS (SELECT qid, list({{'qualified_name': name, 'location': file_path || ':' || CAST(start_line AS VARCHAR) || '-' || CAST(end_line AS VARCHAR),
  'docstring': docstring, 'document': {_HEADER_SQL} || chr(10) || chr(10) || '```python' || chr(10) || content || chr(10) || '```'}} ORDER BY rank) AS context
  FROM hr JOIN e USING (doc_id) WHERE rank <= 5 GROUP BY qid),
ctx AS (SELECT item_id AS qid, coalesce(context, []) AS context FROM benchmark LEFT JOIN found ON qid = item_id)"""


@register("context_summary", f"""WITH {_GOAL_CTX_CTE} SELECT qid, CASE WHEN len(context) = 0 THEN 'No context retrieved yet.' ELSE
  'Retrieved ' || CAST(len(context) AS VARCHAR) || ' code entities:' || chr(10)
  || array_to_string(list_transform(context, lambda x, i: '  ' || CAST(i AS VARCHAR) || '. ' || x.qualified_name || ' at ' || x.location
     || CASE WHEN coalesce(x.docstring, '') <> '' THEN chr(10) || '     Doc: ' || {O.preview('x.docstring', 80)} ELSE '' END), chr(10)) END AS summary FROM ctx""")
def context_summary_q(spark, sf_dir):
    return _goal_contexts(spark, sf_dir).select("qid", wf.context_summary("context").alias("summary"))


@register("context_code", f"""WITH {_GOAL_CTX_CTE} SELECT qid, CASE WHEN len(context) = 0 THEN 'No code context retrieved.' ELSE
  array_to_string(list_transform(context, lambda x, i:
  chr(10) || '--- Original Code Entity ' || CAST(i AS VARCHAR) || ' ---' || chr(10) || x.document || chr(10)), chr(10)) END AS code FROM ctx""")
def context_code_q(spark, sf_dir):
    return _goal_contexts(spark, sf_dir).select("qid", wf.context_code("context", "Original Code Entity").alias("code"))


@register("fix_context", f"""WITH {_GOAL_CTX_CTE} SELECT qid, concat_ws(chr(10), CASE WHEN len(context) > 0 THEN '## Relevant Code' || chr(10) || chr(10)
  || array_to_string(list_transform(context, lambda x: x.document || chr(10) || chr(10) || '---' || chr(10)), chr(10)) END,
  CASE WHEN qid % 3 > 0 THEN '## Proposed Fix' || chr(10) || chr(10) || 'use ' || qid END,
  CASE WHEN qid % 2 = 0 THEN chr(10) || '## Reviewer Feedback' || chr(10) || chr(10) || 'mind ' || qid END) AS fix_context FROM ctx""")
def fix_context_q(spark, sf_dir):
    qid = F.col("qid").cast("string")
    c = _goal_contexts(spark, sf_dir).withColumns({
        "proposed_fix": F.when(F.col("qid") % 3 > 0, F.concat(F.lit("use "), qid)),
        "feedback": F.when(F.col("qid") % 2 == 0, F.concat(F.lit("mind "), qid))})
    return c.select("qid", wf.fix_context().alias("fix_context"))


_GLOB = "http*://*.example.com/en/*"


@register("glob_filter", f"SELECT page_id, url FROM pages WHERE regexp_matches(url, {_sql_lit(ret.glob_regex(_GLOB))})")
def glob_filter_q(spark, sf_dir):
    return ret.glob_filter(load(spark, sf_dir, "pages").select("page_id", "url"), "url", _GLOB)


@register("retrieve_batch", _vec_sql().replace("SELECT qid, id, distance, 1.0 - distance AS score, rank FROM r WHERE rank <= 5",
          """, top AS (SELECT * FROM r WHERE rank <= 5)
SELECT q.qid, CAST(count(top.id) AS INTEGER) AS n_context, string_agg(CAST(top.id AS VARCHAR), ',' ORDER BY top.rank) AS ids
FROM (SELECT DISTINCT vec_id AS qid FROM embeddings) q LEFT JOIN top ON top.qid = q.qid GROUP BY q.qid"""))
def retrieve_batch(spark, sf_dir):
    """RET-12: top-5 of the whole index per query, collected in rank order; a query
    whose search found nothing keeps a row with an empty context."""
    e = _embeddings(spark, sf_dir)
    hits = ret.vector_topk(e.select(F.col("vec_id").alias("qid"), "embedding"), e, 5, id_col="vec_id")
    goals = e.select(F.col("vec_id").alias("qid"))
    r = ret.retrieve(goals, hits, "qid", ("vec_id", "score"))
    return r.select("qid", F.size("context").cast("int").alias("n_context"),
                    F.when(F.size("context") > 0, F.array_join(F.transform("context", lambda x: x["vec_id"].cast("string")), ","))
                    .alias("ids"))


@register("retrieve_fallback", f"""WITH g AS (SELECT item_id AS qid, text AS user_goal,
  CASE item_id % 4 WHEN 0 THEN split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) WHEN 1 THEN '' WHEN 2 THEN 'zzqqxx' END AS search_query FROM benchmark),
qt AS (SELECT DISTINCT qid, unnest(list_filter(regexp_split_to_array(lower(coalesce(nullif(search_query, ''), user_goal)), '{_TOK}'), lambda x: x <> '')) AS term FROM g),
qn AS (SELECT qid, count(*) AS nq FROM qt GROUP BY qid),
dt AS (SELECT DISTINCT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '{_TOK}'), lambda x: x <> '')) AS term FROM documents),
kw AS (SELECT qt.qid, dt.doc_id, count(*) / max(qn.nq) AS ks FROM qt JOIN dt USING (term) JOIN qn USING (qid) GROUP BY qt.qid, dt.doc_id),
t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(ks, 6) DESC, doc_id) AS rank FROM kw)
SELECT g.qid, CAST(count(t.doc_id) AS INTEGER) AS n_context, string_agg(CAST(t.doc_id AS VARCHAR), ',' ORDER BY t.rank) AS ids
FROM g LEFT JOIN t ON t.qid = g.qid AND t.rank <= 5 GROUP BY g.qid""")
def retrieve_fallback(spark, sf_dir):
    """RET-11: the plan's query over the whole index; a missing or empty one falls back
    to the goal text, and goals whose search finds nothing keep an empty context."""
    text, n = F.col("text"), F.col("item_id") % 4
    g = load(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("qid"), text.alias("user_goal"),
        F.when(n == 0, F.concat_ws(" ", F.split_part(text, F.lit(" "), F.lit(1)), F.split_part(text, F.lit(" "), F.lit(2))))
        .when(n == 1, F.lit("")).when(n == 2, F.lit("zzqqxx")).alias("search_query"))
    q = g.select("qid", ret.search_query().alias("text"))
    top = ret.text_topk(q, ret.build_text_index(load(spark, sf_dir, "documents")), 5, rank_by="keyword_score")
    r = ret.retrieve(g, top, "qid", ("doc_id",))
    return r.select("qid", F.size("context").cast("int").alias("n_context"),
                    F.nullif(F.array_join(F.transform("context", lambda x: x["doc_id"].cast("string")), ","), F.lit("")).alias("ids"))


# ---------------------------------------------------------------- traces (TRC-*)

from ..operators import traces as trc  # noqa: E402


def _calls(spark, sf_dir):
    """Call log stand-in: event type = agent, value = latency, props.k = tokens."""
    ev = load(spark, sf_dir, "events")
    return trc.call_records(ev.select(
        F.col("event_id").alias("call_id"), "ts", F.col("event_type").alias("agent"),
        F.when(F.col("user_id") % 2 == 0, "openai").otherwise("ollama").alias("provider"),
        F.get_json_object("props", "$.k").alias("tokens"), F.col("value").alias("latency_ms")))


@register("call_records", """SELECT event_id AS call_id, event_type AS agent, CAST(NULL AS VARCHAR) AS model,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS tokens, value AS latency_ms FROM events""")
def call_records_q(spark, sf_dir):
    """TRC-01: completed and typed records."""
    return _calls(spark, sf_dir).select("call_id", "agent", "model", "tokens", "latency_ms")


@register("call_metrics", """SELECT event_type AS agent, count(*) AS calls, CAST(sum(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS BIGINT) AS tokens,
  round(avg(value), 6) AS mean_latency_ms, round(quantile_cont(value, 0.95), 6) AS p95_latency_ms FROM events GROUP BY event_type""")
def call_metrics_q(spark, sf_dir):
    return trc.call_metrics(_calls(spark, sf_dir), ["agent"])


@register("call_metrics_sketch", """WITH r AS (SELECT event_type AS agent, value, percent_rank() OVER (PARTITION BY event_type ORDER BY value) AS p FROM events)
SELECT agent, count(*) AS calls, TRUE AS p95_within_half_a_percent FROM r GROUP BY agent""")
def call_metrics_sketch(spark, sf_dir):
    """TRC-02 from the sketch: its p95 must lie between the exact 94.5 and 95.5 per cent."""
    calls = _calls(spark, sf_dir)
    near = trc.call_metrics(calls, ["agent"], exact=False).select("agent", "calls", F.col("p95_latency_ms").alias("p"))
    share = calls.join(near.withColumnRenamed("agent", "a"), F.col("agent") == F.col("a")).groupBy("agent", "calls").agg(
        (F.count_if(F.col("latency_ms") <= F.col("p")) / F.count("latency_ms")).alias("at"))
    return share.select("agent", "calls", F.col("at").between(0.945, 0.955).alias("p95_within_half_a_percent"))


@register("call_metrics_rollup", """SELECT event_type AS agent, CASE WHEN user_id % 2 = 0 THEN 'openai' ELSE 'ollama' END AS provider,
  count(*) AS calls FROM events GROUP BY ROLLUP (event_type, CASE WHEN user_id % 2 = 0 THEN 'openai' ELSE 'ollama' END)""")
def call_metrics_rollup(spark, sf_dir):
    return _calls(spark, sf_dir).rollup("agent", "provider").agg(F.count(F.lit(1)).alias("calls"))


_OUTCOMES_SQL = f"""WITH {_REVIEWS_CTE},
f AS (SELECT goal_id, min(CASE WHEN approved THEN ts END) AS first_ok, count(*) AS n FROM rv GROUP BY goal_id),
b AS (SELECT rv.goal_id, count_if(f.first_ok IS NOT NULL AND rv.ts < f.first_ok) AS n_before FROM rv JOIN f USING (goal_id) GROUP BY rv.goal_id),
g AS (SELECT DISTINCT user_id AS goal_id, 3 AS max_retries FROM events),
j AS (SELECT g.goal_id, g.max_retries, f.first_ok, coalesce(f.n, 0) AS n, b.n_before FROM g LEFT JOIN f USING (goal_id) LEFT JOIN b USING (goal_id)),
s AS (SELECT *, CASE WHEN first_ok IS NOT NULL AND n_before + 1 <= max_retries + 1 THEN 'approved'
                     WHEN n >= max_retries + 1 THEN 'rejected' ELSE 'open' END AS final_status FROM j)
SELECT goal_id, final_status, CAST(CASE final_status WHEN 'approved' THEN n_before WHEN 'rejected' THEN max_retries
  ELSE greatest(n - 1, 0) END AS INTEGER) AS retry_count, CAST(least(n, max_retries + 1) AS INTEGER) AS reviews_used FROM s"""


@register("workflow_metrics", "WITH o AS (" + _OUTCOMES_SQL + ") SELECT final_status, retry_count, count(*) AS goals, "
          "count_if(final_status = 'approved') AS successes, "
          "round(avg(CASE WHEN final_status = 'approved' THEN 1.0 ELSE 0.0 END), 6) AS success_rate FROM o GROUP BY ALL")
def workflow_metrics_q(spark, sf_dir):
    o = outcomes_from_log_q(spark, sf_dir)
    return trc.workflow_metrics(o, ["final_status", "retry_count"])


@register("transition_matrix", """WITH p AS (SELECT role AS from_status, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS to_status FROM conversations)
SELECT from_status, to_status, count(*) AS n FROM p WHERE to_status IS NOT NULL GROUP BY ALL""")
def transition_matrix_q(spark, sf_dir):
    return trc.transition_matrix(load(spark, sf_dir, "conversations"), "conv_id", "turn", "role")


@register("assemble_messages", "SELECT conv_id, string_agg(text, '' ORDER BY turn) AS message FROM conversations GROUP BY conv_id")
def assemble_messages_q(spark, sf_dir):
    return trc.assemble_messages(load(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@register("by_agent", "SELECT event_type AS agent, count(*) AS spans, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY event_type")
def by_agent_q(spark, sf_dir):
    return trc.by_agent(_calls(spark, sf_dir))


@register("event_rates", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_rates_q(spark, sf_dir):
    return trc.event_rates(load(spark, sf_dir, "events"))


# ---------------------------------------------------------------- file names (SRC-03/04)

def _page_files(spark, sf_dir):
    from ..functions.text import path_name
    p = load(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^?#]*)", 1).alias("path"))
    return p.withColumn("file_name", path_name("path"))


_PAGE_SQL = """pf AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS path FROM pages),
pn AS (SELECT page_id, path, regexp_extract(path, '([^/]*)$', 1) AS file_name FROM pf)"""


@register("drop_tests", f"WITH {_PAGE_SQL} SELECT page_id, file_name FROM pn WHERE NOT contains(lower(file_name), '2')")
def drop_tests_q(spark, sf_dir):
    """Names containing the marker are dropped (``2`` for page names, ``test`` for code)."""
    from ..sources.files import drop_tests as _dt
    return _dt(_page_files(spark, sf_dir), marker="2").select("page_id", "file_name")


@register("file_count", f"""WITH {_PAGE_SQL} SELECT count(*) AS files,
  count_if(NOT contains(lower(file_name), '2')) AS files_without_marker FROM pn""")
def file_count_q(spark, sf_dir):
    from ..sources.files import count_files
    f = _page_files(spark, sf_dir)
    without = count_files(f, include_tests=False, marker="2").withColumnRenamed("files", "files_without_marker")
    return count_files(f).unionByName(without, allowMissingColumns=True).agg(
        F.max("files").alias("files"), F.max("files_without_marker").alias("files_without_marker"))


# ---------------------------------------------------------------- more keys of SURVEY §7.3

# User rules that replace a default by name and add one (DET-03 / UDF-02).
OVERRIDE_RULES: tuple[Rule, ...] = (
    Rule("debug_print", r"\bprint\b", "Word 'print' in text", None, "INFO", ("print",)),
    Rule("hardcoded_secret", r"""(password|secret|api_key|token)\s*=\s*"[0-9a-f]{40}\"""",
         "Potential hardcoded secret (40 hex)", "Use environment variables or secret management", "ERROR"),
    Rule("quoted_phrase", r"\"[^\"\n]{1,40}\"", "Quoted phrase", None, "INFO"),
)


def _merged_rules(spark):
    from ..operators.rules import collect_rules, rules_df, with_rules
    base = rules_df(spark, SCAN_RULES)
    extra = rules_df(spark, OVERRIDE_RULES)
    return collect_rules(with_rules(base, extra))


def _merged_rules_static() -> list[Rule]:
    """The same dict-update merge, for writing the oracle SQL."""
    merged = {r.rule: r for r in SCAN_RULES}
    for r in OVERRIDE_RULES:
        merged[r.rule] = r
    return list(merged.values())


@register("rule_overrides", _WITH_FILES + f"""
SELECT path, rule, severity, line_number, hit FROM {O.rule_hits_sql(_merged_rules_static())}""")
def rule_overrides(spark, sf_dir):
    from ..operators.rules import rule_scan
    return rule_scan(files(spark, sf_dir), _merged_rules(spark)).select("path", "rule", "severity", "line_number", "hit")


@register("score_convert", _vec_sql("TRUE", 2).replace(
    "SELECT qid, id, distance, 1.0 - distance AS score, rank FROM r WHERE rank <= 2",
    "SELECT qid, id, 1.0 - distance AS score FROM r WHERE rank <= 2"))
def score_convert(spark, sf_dir):
    """RET-03: similarity = 1 - distance for the two nearest records of every query."""
    e = _embeddings(spark, sf_dir)
    t = ret.vector_topk(e.select(F.col("vec_id").alias("qid"), "embedding"), e, 2, id_col="vec_id")
    return t.select("qid", F.col("vec_id").alias("id"), "score")


@register("compact", f"""WITH {_ATTEMPTS_CTE} SELECT event_id, 'goal ' || CAST(goal_id AS VARCHAR) AS user_goal,
  CAST(NULL AS VARCHAR) AS search_query, retry_count, max_retries, 0 AS retrieved_count, proposed_fix,
  is_approved, feedback, CAST(len(issues) AS INTEGER) AS n_issues FROM att""")
def compact_q(spark, sf_dir):
    """FIX-19: prompt view of attempt rows, the context replaced by its size."""
    a = _attempts(spark, sf_dir).withColumns({
        "user_goal": F.concat(F.lit("goal "), F.col("goal_id").cast("string")),
        "search_query": F.lit(None).cast("string"),
        "context": F.array().cast("array<string>")})
    c = wf.compact(a, keep=("event_id",))
    return c.withColumn("n_issues", F.size("issues")).drop("issues")


@register("stack_frames_all", f"""WITH d AS (SELECT doc_id,
  regexp_extract_all(text, '({O.WORD}+)\\.(\\p{{Nd}}+)@({O.WORD}+)', 1) AS f,
  regexp_extract_all(text, '({O.WORD}+)\\.(\\p{{Nd}}+)@({O.WORD}+)', 2) AS l,
  regexp_extract_all(text, '({O.WORD}+)\\.(\\p{{Nd}}+)@({O.WORD}+)', 3) AS fn FROM documents),
u AS (SELECT doc_id, unnest(range(0, len(f))) AS frame, f, l, fn FROM d WHERE len(f) > 0)
SELECT doc_id, CAST(frame AS INTEGER) AS frame, f[frame + 1] AS file, CAST(l[frame + 1] AS INTEGER) AS line,
  fn[frame + 1] AS function FROM u""")
def stack_frames_all(spark, sf_dir):
    """DET-08, every frame: one row per "<name>.<n>@<host>" frame of each document."""
    from ..sources.reports import stack_frames
    d = _docs(spark, sf_dir).select("doc_id", "text")
    return stack_frames(d, "text", PROSE_FRAME).select("doc_id", "frame", "file", "line", "function")


# Prompt templates per role (our wording; the roles' real texts are user data).
TEMPLATES = (("planner", "Plan a search for: {user_goal} (budget {max_retries})"),
             ("coder", "Write a fix for: {user_goal}"),
             ("reviewer", "Review the fix for: {user_goal}"))


@register("render_prompts", f"""{_WE}, g AS (SELECT id AS goal_id, concat_ws(' ', 'Fix ' || lower(severity),
  'in ' || regexp_extract(file_path, '([^/]*)$', 1), 'at line ' || CAST(line_number AS VARCHAR),
  CASE WHEN coalesce(error_code, '') <> '' THEN '(' || error_code || ')' END, ': ' || message) AS user_goal,
  3 AS max_retries, CASE severity WHEN 'ERROR' THEN 'coder' WHEN 'WARNING' THEN 'planner' ELSE 'writer' END AS role FROM evf),
t AS (SELECT * FROM (VALUES {", ".join(f"({_sql_lit(r)}, {_sql_lit(t)})" for r, t in TEMPLATES)}) v(role, template))
SELECT goal_id, g.role, replace(replace(template, '{{user_goal}}', user_goal), '{{max_retries}}', CAST(max_retries AS VARCHAR)) AS prompt,
  CASE WHEN template IS NULL THEN 'unknown role: ' || g.role END AS prompt_error
FROM g LEFT JOIN t ON t.role = g.role""")
def render_prompts(spark, sf_dir):
    """FIX-05: fill each goal's role template; an unknown role is flagged, not dropped."""
    f = event_findings(spark, sf_dir)
    g = f.select(F.col("id").alias("goal_id"), fnd.goal_text().alias("user_goal"), F.lit(3).alias("max_retries"),
                 F.when(F.col("severity") == "ERROR", "coder").when(F.col("severity") == "WARNING", "planner")
                 .otherwise("writer").alias("role"))
    t = spark.createDataFrame(list(TEMPLATES), "role string, template string")
    r = wf.render_prompt(g, t, "role", ("user_goal", "max_retries"))
    return r.select("goal_id", "role", "prompt", "prompt_error")


# ---------------------------------------------------------------- review prompts and replies (DET-13/14), records (RET-04)

def _doc_candidates(spark, sf_dir):
    e = _doc_functions(spark, sf_dir)
    return det.review_candidates(e.withColumn("import_lines", det.import_lines("content")))


def _doc_path_col():
    from ..sources.tables import doc_path
    return doc_path()


@register("review_prompts", f"""WITH {O.FILES_CTE}, {_DOC_FUNCS_CTE},
c AS (SELECT fe.*, f.path AS file_path FROM fe JOIN (SELECT doc_id, path FROM files) f USING (doc_id)
      WHERE entity_type IN ('FUNCTION', 'METHOD') AND end_line - start_line + 1 BETWEEN 3 AND 100 AND NOT {_TRIVIAL_SQL}),
im AS (SELECT path, array_to_string(list_filter(list_transform(string_split(content, chr(10)), lambda x: {O.py_strip('x')}),
         lambda x: starts_with(x, 'import ') OR starts_with(x, 'from '))[1:10], chr(10)) AS imports FROM files)
SELECT c.doc_id, 'Review this function for bugs.' || chr(10) || chr(10) || 'Function: ' || c.name || chr(10) || 'Location: '
  || c.file_path || ':' || CAST(c.start_line AS VARCHAR) || '-' || CAST(c.end_line AS VARCHAR) || chr(10) || chr(10)
  || '```python' || chr(10) || c.content || chr(10) || '```' || chr(10) || chr(10) || 'Imports of the file:' || chr(10)
  || coalesce(im.imports, '') || chr(10) AS prompt FROM c LEFT JOIN im ON im.path = c.file_path""")
def review_prompts_q(spark, sf_dir):
    p = det.review_prompts(_doc_candidates(spark, sf_dir))
    return p.select("doc_id", "prompt")


def _review_replies(spark, sf_dir):
    """Replayed review replies built from the event log: user u's events become
    issues on document u (line = props.k, omitted when k >= 90; severity = event
    type; message omitted for views)."""
    ev = load(spark, sf_dir, "events")
    issue = F.struct(F.when(F.get_json_object("props", "$.k").cast("int") < 90,
                            F.get_json_object("props", "$.k").cast("int")).alias("line"),
                     F.col("event_type").alias("severity"),
                     F.when(F.col("event_type") != "view", F.concat(F.lit("event "), F.col("event_id").cast("string"))).alias("message"))
    per_user = ev.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", issue.alias("i")))).alias("xs"))
    return per_user.select(F.col("user_id").alias("doc_id"), F.concat(
        F.lit("Here is my review: "), F.to_json(F.struct(F.transform("xs", lambda x: x["i"]).alias("issues"))),
        F.lit(" Thanks.")).alias("reply"))


@register("parse_reviews", f"""WITH {O.FILES_CTE}, {_DOC_FUNCS_CTE},
x AS (SELECT user_id AS doc_id, event_id, CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) < 90
        THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END AS line, event_type AS severity,
        CASE WHEN event_type <> 'view' THEN 'event ' || CAST(event_id AS VARCHAR) END AS message FROM events),
r AS (SELECT x.doc_id, x.event_id, row_number() OVER (PARTITION BY x.doc_id ORDER BY x.event_id) - 1 AS i, x.line, x.severity, x.message,
        f.path AS file_path, fe.start_line, fe.content, fe.name FROM x JOIN fe USING (doc_id) JOIN files f USING (doc_id))
SELECT file_path, coalesce(line, start_line) AS line_number,
  CASE upper(severity) WHEN 'ERROR' THEN 'ERROR' WHEN 'INFO' THEN 'INFO' ELSE 'WARNING' END AS severity,
  coalesce(message, 'Issue found') AS message, substr(content, 1, 200) AS code_snippet, CAST(i AS BIGINT) AS emit_ord FROM r""")
def parse_reviews_q(spark, sf_dir):
    ents = _doc_functions(spark, sf_dir).withColumn("id", F.col("doc_id").cast("string"))
    rep = _review_replies(spark, sf_dir).select(F.col("doc_id").cast("string").alias("entity_id"), "reply")
    f = det.parse_reviews(rep, ents)
    return f.select("file_path", "line_number", "severity", "message", "code_snippet", "emit_ord")


@register("add_chunks", f"""{_WF} SELECT ext, count(*) AS n, count(DISTINCT path) AS ids FROM files GROUP BY ext""")
def add_chunks_q(spark, sf_dir):
    """RET-07: chunks of every document added to an index that holds half of them."""
    chunks = ent.file_chunks(files(spark, sf_dir))
    held = ent.chunks_to_entities(chunks.filter("end_line % 2 = 0")).withColumn("id", ent.entity_id())
    all_ = ret.add_chunks(held, chunks)
    return all_.groupBy(F.regexp_extract("name", r"(\.[^.]*)$", 1).alias("ext")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"))


@register("file_order", f"""{_WF}, {O.LINES_CTE}, {O.BLOCKS_CTE} SELECT path AS file_path, count(*) AS n, 1 AS parts, TRUE AS in_order FROM blocks GROUP BY path""")
def file_order_q(spark, sf_dir):
    """ENT-25: the blocks of a file together in one partition and in order."""
    from pyspark.sql.window import Window
    from ..session import checkpoint_dir
    b = doc_blocks(spark, sf_dir).select(F.col("path").alias("file_path"), "start_line", "end_line")
    placed = ent.order_entities(b).select("file_path", "start_line", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    checkpoint_dir(spark)
    placed = placed.checkpoint()  # the places as they were, whatever follows
    before = F.lag("start_line").over(Window.partitionBy("file_path").orderBy("at"))
    return placed.withColumn("ok", F.coalesce(before <= F.col("start_line"), F.lit(True))).groupBy("file_path").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("part").cast("int").alias("parts"), F.bool_and("ok").alias("in_order"))


@register("rehydrate", f"""{_WF}, {O.DOC_ENTITIES_CTE},
rec AS (SELECT file_path AS id, {_HEADER_SQL} || chr(10) || chr(10) || '```python' || chr(10) || content || chr(10) || '```' AS document,
        CASE WHEN length(content) % 3 = 0 THEN NULL ELSE name END AS m_name,
        CASE WHEN length(content) % 5 = 0 THEN NULL ELSE end_line END AS m_end, file_path, start_line, docstring FROM ents)
SELECT id, 'STANDALONE' AS entity_type, coalesce(m_name, 'unknown') AS name, file_path, start_line,
  coalesce(m_end, 1) AS end_line, nullif(substr(docstring, 1, 1000), '') AS docstring,
  CASE WHEN contains(document, '```python') THEN {O.py_strip("split_part(split_part(document, '```python', 2), '```', 1)")}
       ELSE document END AS content FROM rec""")
def rehydrate_q(spark, sf_dir):
    """RET-04 round trip: documents + metadata JSON of the stand-in entities, with
    some keys removed (by text length) to exercise the defaults."""
    e = doc_entities(spark, sf_dir)
    meta = F.to_json(F.struct(
        F.col("entity_type"),
        F.when(F.length("content") % 3 != 0, F.col("name")).alias("name"),
        F.col("file_path"), F.col("start_line"),
        F.when(F.length("content") % 5 != 0, F.col("end_line")).alias("end_line"),
        F.substring(F.nullif(F.col("docstring"), F.lit("")), 1, 1000).alias("docstring")))
    rec = e.select(F.col("file_path").alias("id"), ent.render_document().alias("document"), meta.alias("metadata"))
    r = ret.rehydrate(rec, distance=None)
    return r.select("id", "entity_type", "name", "file_path", "start_line", "end_line", "docstring", "content")


@register("event_rates_stream", """SELECT * FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n
  FROM events GROUP BY 1, 2) WHERE window_start + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events)""")
def event_rates_stream(spark, sf_dir):
    """TRC-05 as a real stream over the events table: file source, 1-hour
    tumbling windows, 1-hour watermark, append mode to Parquet (availableNow).
    Only windows the watermark has closed are emitted; checkpoint and output
    live under the cluster's checkpoint folder, so a restarted job resumes."""
    import uuid
    from ..session import checkpoint_dir
    from ..streaming.jobs import run_rates_to_table
    base = f"{checkpoint_dir(spark).rstrip('/')}/event_rates_stream/{uuid.uuid4().hex}"
    schema = load(spark, sf_dir, "events").schema
    run_rates_to_table(spark, f"{sf_dir.rstrip('/')}/events.parque[t]", schema, f"{base}/out", f"{base}/ckpt")
    out = spark.read.parquet(f"{base}/out")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


from . import report_queries, source_queries, workflow_queries  # noqa: E402,F401  (register their queries)
