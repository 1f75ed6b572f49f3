"""SQL text shared by the DuckDB oracle queries.

Only used to *check* results: every Spark query in :mod:`quarry.plans.catalog`
has a twin here written in plain SQL over the driver's views.
"""

from __future__ import annotations

from ..functions.regex import sql_literal, to_re2

# file path a document stands for (same as quarry.sources.tables.doc_path)
FILES_CTE = ("files AS (SELECT doc_id, source || '/doc_' || CAST(doc_id AS VARCHAR) || '.' || lang AS path, "
             "'doc_' || CAST(doc_id AS VARCHAR) || '.' || lang AS file_name, '.' || lang AS ext, "
             "text AS content FROM documents)")


def nl(expr: str) -> str:
    return f"(length({expr}) - length(replace({expr}, chr(10), '')))"


# RE2 spelling of a rule with look-around: a look-behind for a comma right after "=" always holds.
RE2_TWINS = {"mutable_default": ("=(?<!,)", "=")}
# The rule with a back-reference: its head names a list, the rest of the line must change it.
LOOP_HEAD, LOOP_NAME, LOOP_CHANGE = r"for\s+\w+\s+in\s+\w+:", r"in\s+(\w+):$", r"\.(remove|append|insert)"
LOOP_RULE = "list_modify_while_iterating"


def _rule_columns(k: int, r) -> str:
    sugg = "NULL" if r.suggestion is None else sql_literal(r.suggestion)
    return (f"path, {k} AS rule_ord, {sql_literal(r.rule)} AS rule, {sql_literal(r.severity)} AS severity, "
            f"{sql_literal(r.message)} AS message, CAST({sugg} AS VARCHAR) AS suggestion")


def _loop_hits_sql(k: int, r, files: str) -> str:
    """Matches of ``LOOP_RULE``. Of a match, later heads on the same line that it
    swallows would be counted again; no such line is in the checked tables."""
    head, name = sql_literal(to_re2(LOOP_HEAD)), sql_literal(to_re2(LOOP_NAME))
    found = (f"regexp_extract(rest, '(?i)^.*?' || regexp_extract(head, {name}, 1) || {sql_literal(LOOP_CHANGE)}, 0)")
    return f"""
SELECT {_rule_columns(k, r)}, CAST(1 + {nl("substr(content, 1, ends - length(head))")} AS INTEGER) AS line_number,
       CAST(row_number() OVER (PARTITION BY path ORDER BY ends) - 1 AS INTEGER) AS match_idx, head || found AS hit
FROM (SELECT *, {found} AS found
      FROM (SELECT *, string_split(substr(content, ends + 1), chr(10))[1] AS rest
            FROM (SELECT path, content, heads[i] AS head,
                         length(array_to_string(pieces[1:i], '')) + length(array_to_string(heads[1:i], '')) AS ends
                  FROM (SELECT *, unnest(generate_series(1, len(heads))) AS i
                        FROM (SELECT path, content, regexp_extract_all(content, {head}) AS heads,
                                     string_split_regex(content, {head}) AS pieces FROM {files}) WHERE len(heads) > 0))))
WHERE found <> ''"""


def rule_hits_sql(rules, files: str = "files") -> str:
    """One row per (file, rule, match) with the start line: the oracle twin of
    :func:`quarry.operators.rules.rule_scan`."""
    branches, loops = [], ""
    for k, r in enumerate(rules):
        if r.rule == LOOP_RULE:
            loops += "\nUNION ALL" + _loop_hits_sql(k, r, files)
            continue
        pat = sql_literal(to_re2(r.pattern.replace(*RE2_TWINS.get(r.rule, ("", "")))))
        branches.append(f"SELECT {_rule_columns(k, r)}, regexp_extract_all(content, {pat}) AS hits, "
                        f"string_split_regex(content, {pat}) AS pieces FROM {files}")
    union = "\nUNION ALL\n".join(branches)
    return f"""(
SELECT path, rule_ord, rule, severity, message, suggestion,
       CAST(1 + coalesce(list_sum(list_transform(pieces[1:i], lambda p: {nl('p')})), 0)
              + coalesce(list_sum(list_transform(hits[1:i-1], lambda h: {nl('h')})), 0) AS INTEGER) AS line_number,
       CAST(i - 1 AS INTEGER) AS match_idx, hits[i] AS hit
FROM (SELECT *, unnest(generate_series(1, len(hits))) AS i FROM ({union}) WHERE len(hits) > 0){loops}
)"""


def rule_findings_sql(rules, detector_ord: int = 3, files: str = "files") -> str:
    """Findings rows from rule hits (id, severity, sev_rank, ... as in to_findings)."""
    return f"""(
SELECT substr(md5(path || ':' || CAST(line_number AS VARCHAR) || ':' || message), 1, 12) AS id,
       'PATTERN_MATCH' AS source, severity,
       CASE severity WHEN 'ERROR' THEN 0 WHEN 'WARNING' THEN 1 WHEN 'INFO' THEN 2 ELSE 3 END AS sev_rank,
       path AS file_path, line_number, CAST(NULL AS INTEGER) AS col, message,
       'pattern-' || rule AS error_code, suggestion AS suggested_fix, hit AS code_snippet,
       {detector_ord} AS detector_ord, CAST(rule_ord AS BIGINT) * 4294967296 + match_idx AS emit_ord
FROM {rule_hits_sql(rules, files)}
)"""


def dedup_sql(src: str, lower: bool = True) -> str:
    key = "lower(substr(message, 1, 50))" if lower else "substr(message, 1, 50)"
    return f"""(
SELECT * EXCLUDE (_rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY file_path, line_number, {key}
                               ORDER BY detector_ord, emit_ord, id) AS _rn
  FROM {src}) WHERE _rn = 1
)"""


PY_SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
WORD = r"[\p{L}\p{N}_]"


def py_strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^{PY_SPACE}+|{PY_SPACE}+$', '', 'g')"


LINES_CTE = ("lines AS (SELECT path, CAST(unnest(range(1, len(string_split(content, chr(10))) + 1)) AS INTEGER) AS line_no, "
             "unnest(string_split(content, chr(10))) AS line FROM files)")

BLOCKS_CTE = """iv AS (SELECT path, line_no AS s, line_no AS e FROM lines WHERE """ + py_strip("line") + """ <> ''),
fl AS (SELECT *, CASE WHEN max(e) OVER w IS NULL OR s > max(e) OVER w + 1 THEN 1 ELSE 0 END AS nw
       FROM iv WINDOW w AS (PARTITION BY path ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
bl AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY path ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS block FROM fl),
blocks AS (SELECT path, block, CAST(min(s) AS INTEGER) AS start_line, CAST(max(e) AS INTEGER) AS end_line FROM bl GROUP BY path, block)"""


def slice_lines(text: str, s: str, e: str) -> str:
    return f"array_to_string(string_split({text}, chr(10))[{s}:{e}], chr(10))"


def preview(expr: str, n: int) -> str:
    t = f"replace({expr}, chr(10), ' ')"
    return f"CASE WHEN length({t}) > {n} THEN substr({t}, 1, {n}) || '...' ELSE {t} END"


def name_block(content: str) -> str:
    """SQL twin of quarry.operators.entities.name_block."""
    ls = f"list_transform(string_split({py_strip(content)}, chr(10)), lambda x: {py_strip('x')})"
    is_assign = "(contains(x, '=') AND NOT starts_with(x, '#'))"
    names = (f"list_filter(list_transform({ls}, lambda x: CASE WHEN {is_assign} THEN "
             f"regexp_extract(x, '^({WORD}+)\\s*=', 1) END), lambda x: x IS NOT NULL AND x <> '')")
    others = f"list_filter({ls}, lambda x: x <> '' AND NOT {is_assign})"
    first_word = f"regexp_extract({others}[1], '^({WORD}+)', 1)"
    return f"""CASE WHEN len(list_filter({ls}, lambda x: regexp_matches(x, '^(import|from)\\s+(.+)$'))) > 0 THEN 'imports'
 WHEN len({names}) > 0 THEN 'assignments_' || array_to_string({names}[1:3], '_')
 WHEN len({others}) > 0 AND {first_word} <> '' THEN 'code_' || {first_word}
 ELSE 'standalone_block' END"""


# stand-in entity table over documents: whole-file chunks, first line as docstring
DOC_ENTITIES_CTE = ("ents AS (SELECT 'STANDALONE' AS entity_type, file_name AS name, content, path AS file_path, "
                    "1 AS start_line, CAST(" + nl("content") + " + 1 AS INTEGER) AS end_line, "
                    "CAST(NULL AS VARCHAR) AS parent, string_split(content, chr(10))[1] AS docstring, "
                    "CAST(NULL AS VARCHAR) AS signature FROM files)")
