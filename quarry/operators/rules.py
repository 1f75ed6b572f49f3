"""Data-driven regex rules over file texts (DET-01…03).

A rule set is small configuration data (tens of rows). :func:`rule_scan`
inlines every rule as a *literal* pattern so each one is compiled once per
task, and evaluates all rules in one projection over the files table: one
scan, no shuffle, no join of texts against rules. Line numbers of matches are
computed natively from ``regexp_extract_all`` + ``split`` on the whole text,
so matches that span lines get the line where they start.
"""

from __future__ import annotations

from dataclasses import dataclass, asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.regex import to_java
from ..functions.text import newline_count
from ..sources.tables import spread


@dataclass(frozen=True)
class Rule:
    rule: str
    pattern: str
    message: str
    suggestion: str | None
    severity: str
    # Optional exact pre-check: lower-case literals of which every match
    # contains at least one. Texts holding none of them skip the regex.
    must_contain: tuple[str, ...] | None = None


# --- fixed values: the default rule set (name, pattern, message, suggestion,
# severity), in this order. Patterns are Python-regex text, compiled with
# MULTILINE and IGNORECASE.
DEFAULT_RULES: tuple[Rule, ...] = (
    Rule("dict_direct_access", r"""\['\"](\w+)['\"]""",
         "Direct dictionary access without .get() - may raise KeyError",
         "Use .get() method or check if key exists first", "WARNING", ("['\"]",)),
    Rule("list_modify_while_iterating", r"for\s+\w+\s+in\s+(\w+):.*?\1\.(remove|append|insert)",
         "Modifying list while iterating over it",
         "Create a new list instead of modifying during iteration", "ERROR", ("for",)),
    Rule("division_no_check", r"return\s+.*/\s*\w+",
         "Division operation without zero check",
         "Add check: if denominator == 0: raise ValueError(...)", "WARNING", ("return",)),
    Rule("len_no_empty_check", r"len\(\w+\)",
         "Using len() without checking if empty first",
         "Check if list is empty before using len() in division", "WARNING", ("len(",)),
    Rule("bare_except", r"except\s*:\s*$",
         "Bare 'except:' clause catches SystemExit and KeyboardInterrupt",
         "Use 'except Exception:' or be more specific", "WARNING", ("except",)),
    Rule("mutable_default", r"def\s+\w+\s*\([^)]*=(?<!,)\s*(\[|{)",
         "Mutable default argument (list or dict)",
         "Use None as default and initialize mutable in function body", "ERROR", ("def",)),
    Rule("hardcoded_secret", r"""(password|secret|api_key|token)\s*[=:]\s*['\"][^'\"]+['\"]""",
         "Potential hardcoded secret",
         "Use environment variables or secret management", "WARNING", ("password", "secret", "api_key", "token")),
    Rule("debug_print", r"print\s*\(",
         "Debug print statement found",
         "Use logging instead of print", "INFO", ("print",)),
    Rule("sql_string_format", r"""(execute|query)\s*\(\s*['\"].*%s""",
         "Potential SQL injection via string formatting",
         "Use parameterized queries", "ERROR", ("%s",)),
    Rule("broad_exception", r"except\s+(Exception|BaseException)\s*:",
         "Overly broad exception handling",
         "Catch specific exceptions", "WARNING", ("except",)),
)

# Severity order used by thresholds and sorts; anything else ranks 3.
SEVERITY_RANK = {"ERROR": 0, "WARNING": 1, "INFO": 2}

RULE_SCHEMA = T.StructType([
    T.StructField("rule", T.StringType(), False),
    T.StructField("pattern", T.StringType(), False),
    T.StructField("message", T.StringType(), False),
    T.StructField("suggestion", T.StringType(), True),
    T.StructField("severity", T.StringType(), False),
    T.StructField("ord", T.IntegerType(), False),
    T.StructField("must_contain", T.ArrayType(T.StringType()), True),
])

# Rules inlined per projection; larger rule sets are split into several
# projections (each one a scan of the files), never a join of texts x rules.
RULES_PER_PASS = 128
# A rule table is configuration; refuse to pull an unbounded one to the driver.
MAX_RULES = 100_000


def sev_rank(col) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return (F.when(c == "ERROR", 0).when(c == "WARNING", 1).when(c == "INFO", 2)
            .otherwise(3).cast("int"))


def default_rules(spark: SparkSession) -> DataFrame:
    """DET-01: the default rule set as a small DataFrame."""
    return rules_df(spark, DEFAULT_RULES)


def rules_df(spark: SparkSession, rules) -> DataFrame:
    rows = [(r.rule, r.pattern, r.message, r.suggestion, r.severity.upper(), i,
             list(r.must_contain) if r.must_contain else None)
            for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def with_rules(rules: DataFrame, extra: DataFrame) -> DataFrame:
    """DET-03: add user rules; a user rule replaces a default of the same name.

    Like a dict update: a replaced rule keeps its position, new rules follow
    in their own order. Returns a new table; ``rules`` itself is unchanged.
    """
    e = extra.select("rule", *[F.col(c).alias("e_" + c) for c in ("pattern", "message", "suggestion", "severity", "ord",
                                                                   "must_contain")])
    j = rules.join(e, "rule", "full_outer")
    has_e = F.col("e_ord").isNotNull()
    pick = lambda c: F.when(has_e, F.col("e_" + c)).otherwise(F.col(c)).alias(c)
    return j.select(
        "rule", pick("pattern"), pick("message"), pick("suggestion"),
        F.upper(pick("severity")).alias("severity"),
        F.coalesce(F.col("ord"), F.lit(1 << 20) + F.col("e_ord")).cast("int").alias("ord"),
        pick("must_contain"))


def collect_rules(rules) -> list[Rule]:
    """Rules as a list: a list passes through; a (small) table is collected."""
    if isinstance(rules, DataFrame):
        n = rules.count()
        if n > MAX_RULES:
            raise ValueError(f"rule table has {n} rows; more than {MAX_RULES} is not a rule set")
        rows = rules.orderBy("ord").collect()
        return [Rule(r["rule"], r["pattern"], r["message"], r["suggestion"], r["severity"],
                     tuple(r["must_contain"]) if "must_contain" in r and r["must_contain"] else None)
                for r in rows]
    return list(rules)


_HIT = T.ArrayType(T.StructType([
    T.StructField("line", T.IntegerType()),
    T.StructField("hit", T.StringType()),
]))


def match_lines(text: Column, java_pattern: str | Column) -> Column:
    """``ARRAY<STRUCT<line INT, hit STRING>>``: every match with its start line.

    Pieces between matches come from ``split`` with the same pattern. Pieces and
    matches are then written as their newlines alone, with a mark at the start of
    each match: the marks on a line of that text are the matches on this line.
    Linear in the text and in the matches.
    """
    pat = F.lit(java_pattern)  # a column stays one
    m = F.regexp_extract_all(text, pat, 0)
    g = F.split(text, pat, -1)
    breaks = lambda x: F.repeat(F.lit("\n"), newline_count(x))
    marked = F.array_join(F.zip_with(F.slice(g, 1, F.size(m)), m,
                                     lambda p, h: F.concat(breaks(p), F.lit("x"), breaks(h))), "")
    at = F.flatten(F.transform(F.split(marked, "\n", -1), lambda x, i: F.array_repeat(i + 1, F.length(x))))
    hits = F.zip_with(at, m, lambda n, h: F.struct(n.alias("line"), h.alias("hit")))

    # split (a second regex pass) only runs for texts that have a match
    return F.when(F.size(m) > 0, hits).otherwise(F.array().cast(_HIT))


def _gated(hits: Column, low: Column, must: tuple[str, ...] | None) -> Column:
    """Skip the regex passes for texts that hold none of the rule's literals."""
    if not must:
        return hits
    cond = F.lit(False)
    for m in must:
        cond = cond | F.contains(low, F.lit(m.lower()))
    return F.when(cond, hits).otherwise(F.array().cast(_HIT))


def _tag(k: int):
    def f(x, i):
        return F.struct(F.lit(k).alias("rule_ord"), x["line"].alias("line"),
                        i.alias("match_idx"), x["hit"].alias("hit"))
    return f


def rule_scan(files: DataFrame, rules, path_col: str = "path", text_col: str = "content",
              keep: tuple[str, ...] = ()) -> DataFrame:
    """DET-02: every match of every rule in every file, one row per match.

    Output: ``path, rule_ord, rule, severity, message, suggestion, line_number,
    match_idx, hit`` (+ ``keep`` columns). ``rules`` is a list of :class:`Rule`
    or a rule table (collected: it is configuration, size-checked).
    """
    rule_list = collect_rules(rules)
    if not rule_list:
        raise ValueError("empty rule set")
    # Lowered once a text: the projection of all rules would do it again for each literal.
    files = spread(files).withColumn("_low", _lowered(text_col))
    passes = []
    for start in range(0, len(rule_list), RULES_PER_PASS):
        chunk = list(enumerate(rule_list))[start:start + RULES_PER_PASS]
        per_rule = [F.transform(_gated(match_lines(F.col(text_col), to_java(r.pattern)), F.col("_low"), r.must_contain), _tag(k))
                    for k, r in chunk]
        hits = F.concat(*per_rule) if len(per_rule) > 1 else per_rule[0]
        passes.append(files.select(F.col(path_col).alias("path"), *keep, F.inline(hits)))
    out = passes[0]
    for p in passes[1:]:
        out = out.unionByName(p)
    meta = F.array(*[F.struct(F.lit(r.rule).alias("rule"), F.lit(r.severity.upper()).alias("severity"),
                              F.lit(r.message).alias("message"),
                              F.lit(r.suggestion).cast("string").alias("suggestion"))
                     for r in rule_list])
    info = F.element_at(meta, F.col("rule_ord") + 1)
    return out.select(
        "path", *keep, F.col("rule_ord").cast("int").alias("rule_ord"),
        info["rule"].alias("rule"), info["severity"].alias("severity"),
        info["message"].alias("message"), info["suggestion"].alias("suggestion"),
        F.col("line").alias("line_number"), F.col("match_idx").cast("int").alias("match_idx"), "hit")


def _lowered(text: str) -> Column:
    # letters that only the ignored case makes equal to ASCII ones
    return F.lower(F.translate(F.col(text), "\u0130\u0131\u017f", "iis"))


def _candidates(literals: list[tuple[str, int]], always: list[int]):
    """Per text, the rules of which it holds a literal, by one automaton for all."""
    def find(batches):
        import ahocorasick
        import pyarrow as pa
        owners: dict[str, list[int]] = {}
        for word, k in literals:
            owners.setdefault(word, []).append(k)
        a = ahocorasick.Automaton()
        for word, ks in owners.items():
            a.add_word(word, ks)
        a.make_automaton()
        for b in batches:
            found = [sorted({k for _, ks in a.iter(low) for k in ks} | set(always)) if low is not None else []
                     for low in b.column(b.num_columns - 1).to_pylist()] if len(a) else [list(always)] * b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.list_(pa.int32()))], [*b.schema.names[:-1], "_rules"])

    return find


def rule_scan_many(files: DataFrame, rules, path_col: str = "path", text_col: str = "content",
                   keep: tuple[str, ...] = ()) -> DataFrame:
    """DET-02/03 for thousands of rules: the same rows as :func:`rule_scan`.

    One automaton of all literals (``must_contain``) gives each text the rules that can
    match it in one run over the text; only these are tried, each on a row of its own, so
    time grows with the texts and the hits and not with the number of rules. Rules
    without a literal are tried on every text."""
    rule_list = collect_rules(rules)
    if not rule_list:
        raise ValueError("empty rule set")
    literals = [(m.lower(), k) for k, r in enumerate(rule_list) for m in r.must_contain or () if m]
    always = [k for k, r in enumerate(rule_list) if not r.must_contain or "" in r.must_contain]
    src = spread(files).select(F.col(path_col).alias("path"), *keep, F.col(text_col).alias("_text"), _lowered(text_col).alias("_low"))
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("_rules", T.ArrayType(T.IntegerType()))])
    tried = src.mapInArrow(_candidates(literals, always), schema).select("path", *keep, "_text", F.explode("_rules").alias("rule_ord"))
    table = files.sparkSession.createDataFrame(
        [(k, to_java(r.pattern), r.rule, r.severity.upper(), r.message, r.suggestion) for k, r in enumerate(rule_list)],
        "rule_ord int, _pattern string, rule string, severity string, message string, suggestion string")
    # At most MAX_RULES short rows.
    hits = tried.join(F.broadcast(table), "rule_ord").select("*", F.posexplode(match_lines(F.col("_text"), F.col("_pattern"))).alias("match_idx", "_m"))
    return hits.select("path", *keep, "rule_ord", "rule", "severity", "message", "suggestion",
                       F.col("_m.line").alias("line_number"), "match_idx", F.col("_m.hit").alias("hit"))


def rule_findings(files: DataFrame, rules, detector_ord: int = 3, **kw) -> DataFrame:
    """Rule matches as ``findings`` rows (source PATTERN_MATCH, code ``pattern-<rule>``)."""
    from .findings import to_findings
    hits = rule_scan(files, rules, **kw)
    return to_findings(hits.select(
        F.lit("PATTERN_MATCH").alias("source"),
        "severity",
        F.col("path").alias("file_path"),
        "line_number",
        "message",
        F.concat(F.lit("pattern-"), F.col("rule")).alias("error_code"),
        F.col("suggestion").alias("suggested_fix"),
        F.col("hit").alias("code_snippet"),
        F.lit(detector_ord).alias("detector_ord"),
        ((F.col("rule_ord").cast("long") * F.lit(1 << 32)) + F.col("match_idx")).alias("emit_ord"),
    ))

