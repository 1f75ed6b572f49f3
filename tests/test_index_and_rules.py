"""Adding to a bucketed index, many rules by one automaton, detectors that fail when they run."""
import os
import time

from pyspark.sql import functions as F

from quarry.operators import findings as fnd
from quarry.operators import retrieval as ret
from quarry.operators import rules as ru


def test_adding_moves_the_batch_only(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "idx")
    first = spark.createDataFrame([(f"id{k}", k % 5, "old") for k in range(300)], "id string, v int, w string")
    ret.create_index(spark, "idx_a", first.schema, path, "id", 4)
    ret.add_to_index(spark, "idx_a", first)
    new = spark.createDataFrame([(f"id{k}", k % 7, "new") for k in range(250, 400)] * 2 + [("id390", -1, "first"), (None, 1, "null id")],
                                "id string, v int, w string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with an index too large to broadcast
    try:
        plan = ret.fresh_records(spark.table("idx_a"), new)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "Bucketed: true" in plan and "ReadSchema: struct<id:string>" in plan
    # one exchange, by the index's number of buckets: that of the batch
    assert plan.count("Exchange hashpartitioning(id") == 1 and ", 4)" in plan[plan.index("Exchange hashpartitioning(id"):]
    ret.add_to_index(spark, "idx_a", new, order="v")
    ret.add_to_index(spark, "idx_a", new, order="v")  # once more: nothing
    ret.add_to_index(spark, "idx_a", new.filter("1 = 0"))
    rows = {r.id: (r.v, r.w) for r in spark.table("idx_a").collect()}
    assert len(rows) == 400 + (None in rows) and rows["id260"] == (0, "old") and rows["id390"] == (-1, "first") and rows["id399"][1] == "new"
    spark.sql("DROP TABLE idx_a")
    ret.create_index(spark, "idx_b", first.schema, path, "id", 4)  # opened again over the files
    assert spark.table("idx_b").filter("id IS NOT NULL").count() == 400
    ret.add_to_index(spark, "idx_b", first)
    assert spark.table("idx_b").filter("id IS NOT NULL").count() == 400
    spark.sql("DROP TABLE idx_b")


def test_many_rules_give_the_rows_of_the_plain_scan(spark):
    text = ["password = 'x'\nprint(1)\nlen(a)", "def f(a=[]):\n  try:\n    pass\n  except:\n    PRINT (2)\n", "", None, "no match", "word7 and word8\nWORD7 word70"]
    files = spark.createDataFrame([(f"p{k}", t, k) for k, t in enumerate(text)], "path string, content string, extra int")
    rules = [*ru.DEFAULT_RULES, *(ru.Rule(f"r{k}", rf"\bword{k}\b", "m", None, "info", (f"word{k}",)) for k in range(20)),
             ru.Rule("no_literal", r"[a-z]+8", "m", "s", "ERROR")]
    plain = ru.rule_scan(files, rules, keep=("extra",))
    many = ru.rule_scan_many(files, rules, keep=("extra",))
    assert plain.columns == many.columns
    assert sorted(map(tuple, many.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str) != []
    only = [ru.Rule("x", "a", "m", None, "INFO")]
    assert ru.rule_scan_many(files, only).count() == ru.rule_scan(files, only).count()


def test_time_does_not_grow_with_rules_that_match_nothing(spark):
    files = spark.createDataFrame([(f"p{k}", f"some text number{k} " * 50) for k in range(400)], "path string, content string").repartition(4).cache()
    files.count()

    def seconds(n):
        rules = [ru.Rule("hit", r"number\d+", "m", None, "INFO", ("number",)), *(ru.Rule(f"r{k}", rf"literal{k}x\w*", "m", None, "INFO", (f"literal{k}x",)) for k in range(n))]
        start = time.time()
        assert ru.rule_scan_many(files, rules).count() == 400 * 50
        return time.time() - start

    seconds(1)
    assert seconds(3000) < 5 * seconds(10) + 5


def test_a_detector_that_fails_when_it_runs_is_left_out(spark):
    files = spark.createDataFrame([("a", "x"), ("b", "y")], "path string, content string")

    def good(f):
        return f.select(F.col("path").alias("file_path"), F.lit("m").alias("message"), F.lit(1).alias("line_number"))

    def unbuilt(f):
        return f.select("missing")

    def late(f):
        return f.select(F.col("path").alias("file_path"), F.raise_error(F.lit("late failure")).cast("string").alias("message"))

    rows, errors = fnd.DetectorRegistry().register("good", good).register("unbuilt", unbuilt).register("late", late).run(files, stored=True)
    assert sorted((r.file_path, r.detector_ord) for r in rows.collect()) == [("a", 0), ("b", 0)]
    assert [e.split(":")[0] for e in errors] == ["unbuilt", "late"] and "late failure" in errors[1]


def test_a_text_is_lowered_once_for_all_rules(spark):
    from quarry.operators import rules as ru
    plan = ru.rule_scan(spark.createDataFrame([("a", "x")], "path string, content string"), ru.DEFAULT_RULES)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 1
