import textwrap

from pyspark.sql import functions as F

from quarry.functions.jsonx import extract_json, json_field
from quarry.operators import extract as ex
from quarry.operators import workflow as wf
from quarry.operators.entities import merge_intervals

SRC = textwrap.dedent('''\
    import os
    from . import (
        a,
        b,
    )
    X = 1
    Y = 2


    def add(x: int, y: int = 3) -> int:
        """Add two numbers."""
        return x + 1


    class Box(Base):
        def __init__(self, v):
            self.v = v

        @classmethod
        def make(cls):
            return cls(1)

        @staticmethod
        def util(q):
            try:
                return q
            except ValueError:
                pass

    async def run():
        def inner():
            pass
        return inner
    ''')


def test_entities_and_facts(spark):
    files = spark.createDataFrame([("m.py", SRC), ("bad.py", "def broken(:\n  x\n")], "path string, content string")
    facts = ex.parse_files(files).cache()
    ents = {(r.entity_type, r.name): r for r in ex.extract_entities(files, facts).collect()}
    add = ents[("FUNCTION", "add")]
    assert add.signature == "def add (x: int, y: int) -> int" and add.docstring == "Add two numbers."
    assert (add.start_line, add.end_line) == (10, 12)
    box = ents[("CLASS", "Box")]
    assert box.method_count == 3 and box.signature == "class Box(Base)"
    kinds = {n: ents[("METHOD", n)].method_kind for n in ("__init__", "make", "util")}
    assert kinds == {"__init__": "constructor", "make": "class_method", "util": "static_method"}
    run = ents[("FUNCTION", "run")]
    assert run.is_async and run.has_nested and run.signature.startswith("async def run")
    assert ("NESTED_FUNCTION", "inner") not in ents
    blocks = sorted((r.start_line, r.end_line, r.name) for r in ents.values() if r.entity_type == "STANDALONE"
                    and r.file_path == "m.py")
    assert blocks == [(2, 7, "imports")]
    whole = [r for r in ents.values() if r.file_path == "bad.py"]
    assert len(whole) == 1 and (whole[0].start_line, whole[0].end_line) == (1, 3)
    assert add.imports == ["import os", "from . import a, b"]
    ua = {r.message for r in ex.unused_args(facts).collect()}
    assert ua == {"Potentially unused argument: y"}
    sh = ex.silent_handlers(facts).collect()
    assert len(sh) == 1 and sh[0].line_number == 27


def test_merge_intervals(spark):
    df = spark.createDataFrame([("f", s, e) for s, e in [(1, 2), (3, 3), (5, 9), (6, 7), (10, 10), (12, 12)]],
                               "k string, start_line int, end_line int")
    out = sorted((r.start_line, r.end_line) for r in merge_intervals(df, "k").collect())
    assert out == [(1, 3), (5, 10), (12, 12)]


def test_extract_json_ladder(spark):
    replies = ['```json\n{"a": 1}\n```', '{"a": 2}', 'Sure: {"a": {"b": 3}} done', 'not json', '', '[1, 2]']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, reply string")
    got = {r.i: r.a for r in df.select("i", json_field(extract_json("reply"), "a", "string").alias("a")).collect()}
    assert got[0] == "1" and got[1] == "2" and got[2] == '{"b":3}' and got[3] is None and got[4] is None and got[5] is None
    d = spark.createDataFrame([('{"k": null}',), ('{}',)], "reply string")
    vals = [r.v for r in d.select(json_field(extract_json("reply"), "k", "string", "dflt").alias("v")).collect()]
    assert vals == [None, "dflt"]


def test_validate_goals(spark):
    g = spark.createDataFrame([(1, " 123456789 ", 3), (2, "0123456789", 3), (3, "long enough goal", -1),
                               (4, "long enough goal", 0), (5, "long enough goal", 10), (6, "long enough goal", 11)],
                              "goal_id long, user_goal string, max_retries int")
    good, bad = wf.validate_goals(g)
    assert sorted(r.goal_id for r in good.collect()) == [2, 4, 5]
    assert sorted(int(r.key) for r in bad.collect()) == [1, 3, 6]


def test_rounds_reject_then_approve(spark):
    goals = spark.createDataFrame([(1, "fix the division bug", 3), (2, "always rejected item", 1),
                                   (3, "reply is not json at all", 2)],
                                  "goal_id long, user_goal string, max_retries int")
    replies = spark.createDataFrame(
        [("1", "code", 0, '{"proposed_fix": "a", "confidence_score": 0.9}'),
         ("1", "review", 0, '{"is_approved": false, "feedback": "no", "issues": ["x"]}'),
         ("1", "code", 1, '{"proposed_fix": "b"}'),
         ("1", "review", 1, '{"is_approved": true}'),
         ("2", "code", 0, '{"proposed_fix": "c"}'), ("2", "review", 0, '{"is_approved": false}'),
         ("2", "code", 1, '{"proposed_fix": "d"}'), ("2", "review", 1, '{"is_approved": false}'),
         ("3", "code", 0, "raw text fix"), ("3", "review", 0, "garbled")],
        "prompt_key string, stage string, attempt int, content string")
    rp = wf.replay(replies)
    done, tr = wf.run_rounds(goals, lambda d: rp(d, "code"), lambda d: rp(d, "review"))
    res = {r.goal_id: r for r in done.collect()}
    assert res[1].status == "approved" and res[1].retry_count == 1
    assert res[2].status == "rejected" and res[2].retry_count == 1
    assert res[3].status == "approved" and res[3].proposed_fix == "raw text fix"
    assert res[3].feedback == "Auto-approved (parse error)"
    steps = {(r.goal_id, r.from_status): r["count"] for r in tr.groupBy("goal_id", "from_status").count().collect()}
    assert steps == {(g, s): n for g, n in ((1, 2), (2, 2), (3, 1)) for s in ("coding", "reviewing")}


def test_context_summary_and_retry(spark):
    ctx_t = "array<struct<qualified_name:string,location:string,docstring:string>>"
    rows = [(0, []), (2, [("a", "p:1-2", None), ("b", "p:3-4", "d" * 90)]),
            (7, [(f"e{i}", "p:1-1", None) for i in range(7)])]
    df = spark.createDataFrame(rows, f"n int, context {ctx_t}")
    s = {r.n: r.s for r in df.select("n", wf.context_summary("context").alias("s")).collect()}
    assert s[0] == "No context retrieved yet."
    assert s[2].startswith("Retrieved 2 code entities:\n  1. a at p:1-2\n  2. b at p:3-4\n     Doc: " + "d" * 80 + "...")
    assert s[7].startswith("Retrieved 7 code entities:") and s[7].count("\n") == 5
    r = spark.createDataFrame([(0, "fb", ["i"]), (1, None, []), (1, "fb", ["i1", "i2"])],
                              "retry_count int, feedback string, issues array<string>")
    out = [x.c for x in r.select(wf.retry_context().alias("c")).collect()]
    assert out[0] == "" and out[1] == ""
    assert out[2] == ("\n## Previous Attempt Feedback\n\nThe previous fix was rejected with this feedback:\nfb\n"
                      "\nSpecific issues to address:\n  - i1\n  - i2")


def test_score_hook_reports_failures(spark):
    df = spark.createDataFrame([(1, "p1"), (2, "p2")], "prompt_key long, prompt string")
    ok = wf.score(df, lambda s: s.str.upper()).orderBy("prompt_key").collect()
    assert [r.reply for r in ok] == ["P1", "P2"]

    def boom(s):
        raise RuntimeError("model down")
    bad = wf.score(df, boom).collect()
    assert all(r.reply is None and "model down" in r.error for r in bad)


def test_parse_plans_fallbacks(spark):
    df = spark.createDataFrame([
        (1, "fix the thing here", '{"search_query": "q1", "target_file": "a.py"}'),
        (2, "fix the thing here", "{}"),
        (3, "fix the thing here", "no json at all"),
        (4, "fix the thing here", '```json\n{"search_query": "q4", "keywords": ["k1", "k2"]}\n```')],
        "goal_id long, user_goal string, reply string")
    rows = {r.goal_id: r for r in wf.parse_plans(df).collect()}
    assert (rows[1].search_query, rows[1].keywords, rows[1].target_file) == ("q1", [], "a.py")
    assert (rows[2].search_query, rows[2].keywords) == ("fix the thing here", [])
    assert (rows[3].search_query, rows[3].keywords, rows[3].status) == ("fix the thing here", [], "retrieving")
    assert rows[4].keywords == ["k1", "k2"]


def test_transition_log_has_stamps(spark):
    goals = spark.createDataFrame([(1, "goal number one here", 1)], "goal_id long, user_goal string, max_retries int")
    replies = spark.createDataFrame(
        [("1", "code", 0, '{"proposed_fix": "a"}'), ("1", "review", 0, '{"is_approved": false, "feedback": "no"}'),
         ("1", "code", 1, '{"proposed_fix": "b"}'), ("1", "review", 1, '{"is_approved": false}')],
        "prompt_key string, stage string, attempt int, content string")
    rp = wf.replay(replies)
    done, tr = wf.run_rounds(goals, lambda d: rp(d, "code"), lambda d: rp(d, "review"), stamp="2024-05-01 10:00:00")
    log = sorted(tr.filter("from_status = 'reviewing'").collect(), key=lambda r: r.ts)
    assert tr.filter("from_status = 'coding' AND note = 'Fix generated, confidence: 0.50'").count() == 2
    assert [(str(r.ts), r.to_status, r.note) for r in log] == [
        ("2024-05-01 10:00:00", "coding", "Rejected, preparing retry #1"),
        ("2024-05-01 10:00:01", "rejected", "Max retries (1) exceeded")]
    assert done.first().status == "rejected"


def test_score_isolates_failing_rows(spark):
    df = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, "fine")], "prompt_key long, prompt string")

    def picky(s):
        if (s == "bad").any():
            raise ValueError("cannot score 'bad'")
        return s + "!"
    rows = {r.prompt_key: r for r in wf.score(df.coalesce(1), picky).collect()}
    assert rows["1"].reply == "ok!" and rows["3"].reply == "fine!" and rows["1"].error is None
    assert rows["2"].reply is None and "cannot score" in rows["2"].error


def test_imports_of_a_file_without_functions(spark):
    files = spark.createDataFrame([("m.py", "import os\nX = 1\n"), ("n.py", "Y = 2\n")], "path string, content string")
    got = {r.file_path: r.imports for r in ex.extract_entities(files).collect()}
    assert got == {"m.py": ["import os"], "n.py": []}


EDGES = textwrap.dedent("""\
    import os as o, sys; Z = 1
    from ..pkg import (a as b,
                       c)
    @wrap
    async def f(p, /, q: int = 1, *rest: int, k: str = "x", **more: int) -> list[int]:
        if p:
            def in_if():
                import inner as i
        else:
            def in_else(): pass
    def g(*, k=None):
        for _ in k:
            def in_for(): pass
        class L:
            def m(self): pass
    def h():
        def deep():
            try:
                pass
            finally:
                def last(): pass
    """)


def test_signatures_nesting_imports_and_blocks(spark):
    files = spark.createDataFrame([("e.py", EDGES), ("empty.py", ""), ("none.py", None)], "path string, content string")
    rows = {(r.entity_type, r.name): r for r in ex.extract_entities(files).collect()}
    f, g, h = (rows["FUNCTION", n] for n in "fgh")
    assert f.signature == "async def f (p, /, q: int, *rest, k: str, **more) -> list[int]"
    assert g.signature == "def g (*, k)" and h.signature == "def h ()"
    assert (f.has_nested, g.has_nested, h.has_nested) == (True, False, True)
    assert f.imports == ["import os, sys", "from ..pkg import a, c", "import inner"]
    assert (f.start_line, f.end_line, f.content.split("\n")[0][:11]) == (5, 10, "async def f")
    blocks = [(r.start_line, r.end_line, r.content) for (kind, _), r in rows.items() if kind == "STANDALONE"]
    assert blocks == [(2, 3, "from ..pkg import (a as b,\n                   c)")]
    assert len(rows) == 4


def test_only_the_asked_kinds_are_made(spark):
    files = spark.createDataFrame([("m.py", SRC), ("bad.py", "def broken(:\n  x\n")], "path string, content string")
    whole = ex.parse_files(files).groupBy("kind").count().collect()
    assert {r.kind for r in whole} == set(ex.KINDS)
    for kind in ex.KINDS:
        assert ex.parse_files(files, (kind,)).groupBy("kind").count().collect() == [r for r in whole if r.kind == kind]


def test_a_file_of_one_row_group_is_dealt_out(spark, tmp_path):
    """Its splits are as many as the slots, and all rows are in one of them."""
    from quarry.sources.tables import spread
    spark.range(200_000).selectExpr("id", "repeat(sha2(cast(id as string), 512), 2) AS text").coalesce(1).write.option("compression", "none").option(
        "parquet.block.size", 1 << 30).parquet(str(tmp_path / "t"))
    one = spark.read.parquet(str(tmp_path / "t"))
    assert one.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    sizes = [r["count"] for r in spread(one).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > spark.sparkContext.defaultParallelism and max(sizes) < 2 * min(sizes)
