from pyspark.sql import functions as F

from quarry.operators import findings as fnd
from quarry.operators.rules import DEFAULT_RULES, Rule, rule_findings, rule_scan, rules_df, with_rules


def _files(spark, rows):
    return spark.createDataFrame(rows, "path string, content string")


def test_multiline_match_gets_start_line(spark):
    rules = [Rule("sec", r"""token\s*=\s*['"][^'"]+['"]""", "secret", None, "WARNING")]
    f = _files(spark, [("a.py", "x = 1\ntoken =\n  'abc'\ny")])
    rows = rule_scan(f, rules).collect()
    assert [(r.line_number, r.hit) for r in rows] == [(2, "token =\n  'abc'")]


def test_three_matches_in_order_and_case_insensitive(spark):
    rules = [Rule("p", r"print\s*\(", "print", "use logging", "INFO")]
    f = _files(spark, [("a.py", "print(1)\nPRINT (2)\n\nmyprint(3)")])
    rows = sorted(rule_scan(f, rules).collect(), key=lambda r: r.match_idx)
    assert [r.line_number for r in rows] == [1, 2, 4]


def test_bare_except_with_crlf_normalised(spark):
    bare = [r for r in DEFAULT_RULES if r.rule == "bare_except"]
    f = _files(spark, [("a.py", "try:\n  x()\nexcept:\n  pass\n")])
    assert [r.line_number for r in rule_scan(f, bare).collect()] == [3]


def test_backreference_rule_runs_on_jvm(spark):
    lm = [r for r in DEFAULT_RULES if r.rule == "list_modify_while_iterating"]
    same = "for x in items: items.remove(x)\n"
    nxt = "for x in items:\n    items.remove(x)\n"
    f = _files(spark, [("a.py", same), ("b.py", nxt)])
    assert sorted(r.path for r in rule_scan(f, lm).collect()) == ["a.py"]


def test_dict_rule_needs_escaped_bracket_form(spark):
    d = [r for r in DEFAULT_RULES if r.rule == "dict_direct_access"]
    f = _files(spark, [("a.py", "v = d['key']\n")])
    assert rule_scan(f, d).count() == 0


def test_user_rule_replaces_default(spark):
    base = rules_df(spark, DEFAULT_RULES)
    extra = rules_df(spark, [Rule("debug_print", r"echo\(", "echo", None, "info")])
    merged = {r.rule: r for r in with_rules(base, extra).collect()}
    assert merged["debug_print"].pattern == r"echo\(" and merged["debug_print"].severity == "INFO"
    assert len(merged) == 10
    assert base.filter(F.col("rule") == "debug_print").first().pattern == r"print\s*\("


def _findings(spark, rows):
    df = spark.createDataFrame(rows, "file_path string, line_number int, message string, severity string, "
                                     "detector_ord int, emit_ord long, col int, suggested_fix string")
    return fnd.to_findings(df.withColumn("source", F.lit("X")))


def test_dedup_cases(spark):
    f = _findings(spark, [
        ("a.py", 1, "Same message", "ERROR", 1, 0, None, None),
        ("a.py", 2, "Same message", "ERROR", 1, 1, None, None),
        ("a.py", 1, "Same message", "WARNING", 0, 5, None, None),   # identical key, lower detector wins
        ("b.py", 1, "Same message", "ERROR", 1, 2, None, None),
        ("a.py", 3, "x" * 60 + "A", "INFO", 1, 3, None, None),
        ("a.py", 3, "x" * 60 + "B", "INFO", 1, 4, None, None),
        ("a.py", 4, "Case", "INFO", 1, 6, None, None),
        ("a.py", 4, "CASE", "INFO", 1, 7, None, None),
    ])
    ci = fnd.dedup_findings(f)
    assert ci.count() == 5
    kept = ci.filter((F.col("line_number") == 1) & (F.col("file_path") == "a.py")).first()
    assert kept.severity == "WARNING"
    assert fnd.dedup_findings(f, lower=False).count() == 6


def test_location_id_threshold_counts(spark):
    f = _findings(spark, [("p/a.py", 3, "m", "ERROR", 0, 0, None, ""), ("p/a.py", 4, "m", "WARNING", 0, 1, 0, None),
                          ("p/a.py", 5, "m", "INFO", 0, 2, 7, "fix")])
    locs = sorted(r[0] for r in f.select(fnd.location_text()).collect())
    assert locs == ["p/a.py:3", "p/a.py:4", "p/a.py:5:7"]
    import hashlib
    want = hashlib.md5(b"p/a.py:5:7:m").hexdigest()[:12]
    assert f.filter("line_number = 5").first().id == want
    assert fnd.at_least(f, "warning").count() == 2
    c = fnd.severity_counts(f).first()
    assert (c.errors, c.warnings, c.infos, c.auto_fixable, c.total) == (1, 1, 1, 2, 3)
    g = f.select(fnd.goal_text().alias("g")).filter(F.col("g").contains("error")).first().g
    assert g == "Fix error in a.py at line 3 : m"


def test_rule_findings_codes(spark):
    f = _files(spark, [("a.py", "print(1)\n")])
    r = rule_findings(f, [r for r in DEFAULT_RULES if r.rule == "debug_print"]).first()
    assert r.error_code == "pattern-debug_print" and r.severity == "INFO" and r.code_snippet == "print("


SPACED_CODE = """for\u00a0x in items:\u2003items.append(x)
def\u2003f(a, b=[]):
    print\u00a0(a)
    except\u2003Exception: pass
  data['"]K' = "TO\u212aEN = 'abc'" ; pa\u017fsword : 'p'
return a /\u00a0b
execute ( "select %s"
for y in a: b.append(y)
def g(x, y = {
"""


def test_all_default_rules_match_as_python_does(spark):
    import re
    texts = [SPACED_CODE, SPACED_CODE * 3 + "len(x)" * 4, "", "plain text\n", "except:\n" * 20, "print (\n\n" * 7]
    files = _files(spark, [(str(k), t) for k, t in enumerate(texts)])
    got = {(r.path, r.rule, r.match_idx, r.line_number, r.hit) for r in rule_scan(files, DEFAULT_RULES).collect()}
    want = {(str(k), r.rule, i, t.count("\n", 0, m.start()) + 1, m.group())
            for k, t in enumerate(texts) for r in DEFAULT_RULES
            for i, m in enumerate(re.finditer(r.pattern, t, re.MULTILINE | re.IGNORECASE))}
    assert got == want and {r.rule for r in DEFAULT_RULES} == {x[1] for x in want}


def test_rule_oracle_agrees_on_code(spark):
    import duckdb
    import pandas as pd

    from quarry.plans.oracle import rule_hits_sql
    files = pd.DataFrame({"path": ["a", "b"], "content": [SPACED_CODE, "x = 1\n" + SPACED_CODE]})
    con = duckdb.connect()
    con.register("files", files)
    sql = f"SELECT path, rule, match_idx, line_number, hit FROM {rule_hits_sql(DEFAULT_RULES)}"
    got = {tuple(r) for r in rule_scan(_files(spark, list(files.itertuples(index=False, name=None))), DEFAULT_RULES).select(
        "path", "rule", "match_idx", "line_number", "hit").collect()}
    assert set(con.execute(sql).fetchall()) == got


def test_line_numbers_take_linear_time(spark):
    import time
    spent = {}
    for n in (40_000, 40_000, 160_000):
        files = _files(spark, [("a.py", "print(1)\n" * n)]).cache()
        start = time.time()
        last = rule_scan(files, [r for r in DEFAULT_RULES if r.rule == "debug_print"]).agg(F.max("line_number")).first()[0]
        spent[n] = time.time() - start
        assert last == n
    assert spent[160_000] < 10 * max(spent[40_000], 0.5)


def test_distinct_keeps_findings_whose_short_ids_collide(spark):
    f = _findings(spark, [("a.py", 1, "m", "ERROR", 0, 0, None, None), ("a.py", 1, "m", "INFO", 0, 1, None, None),
                          ("a.py", 1, "other", "INFO", 0, 2, None, None)]).withColumn("id", F.lit("same"))
    assert sorted(r.message for r in fnd.distinct_findings(f).collect()) == ["m", "other"]
