"""Replies and logged runs (FIX-02, 03, 10, 11, 14, 16, 18, UDF-04) over ``conversations``.

Each turn is a reply: turn 0 plans (and says what its search found), odd turns
propose, the others review. The texts are wrapped as models wrap them: in a fence,
bare, amid prose, or broken. The SQL twins take the values from the columns and
parse nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import workflow as wf
from ..sources.tables import load
from .registry import register

_STAGE = "CASE WHEN turn = 0 THEN 'plan' WHEN turn % 2 = 1 THEN 'code' ELSE 'review' END"
_BROKEN = "(conv_id + turn) % 4 = 3"


def _wrapped(obj):
    how = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4))
    return (F.when(how == 0, F.concat(F.lit("Here you are:\n```json\n"), obj, F.lit("\n```\nDone.")))
            .when(how == 1, obj).when(how == 2, F.concat(F.lit("I think "), obj, F.lit(" is right.")))
            .otherwise(F.concat(F.lit("{broken "), "text")))


def _replies(c: DataFrame) -> DataFrame:
    """``goal_id, seq, stage, content`` of ``conversations``."""
    size = F.length("text")
    plan = F.to_json(F.struct(F.when(F.col("conv_id") % 5 != 0, F.substring("text", 1, 60)).alias("search_query"),
                              F.array(F.lit("k"), size.cast("string")).alias("keywords"), F.lit("a.py").alias("target_file")))
    code = F.to_json(F.struct(F.when(size % 7 == 0, F.lit("")).otherwise(F.col("text")).alias("proposed_fix"),
                              ((size % 100) / 100).alias("confidence_score")))
    review = F.to_json(F.struct((size % 3 == 0).alias("is_approved"), F.substring("text", 1, 40).alias("feedback"),
                                F.array(F.concat(F.lit("size "), size.cast("string")), F.lit("more")).alias("issues")))
    stage = F.expr(_STAGE)
    said = c.select(F.col("conv_id").alias("goal_id"), (F.col("turn") * 10).alias("seq"), stage.alias("stage"),
                    F.when(stage == "plan", _wrapped(plan)).when(stage == "code", _wrapped(code)).otherwise(_wrapped(review)).alias("content"))
    found = c.filter("turn = 0").select(F.col("conv_id").alias("goal_id"), F.lit(1).cast("long").alias("seq"), F.lit("retrieve").alias("stage"),
                                        (size % 6).cast("string").alias("content"))
    return said.unionByName(found)


def _goals(c: DataFrame) -> DataFrame:
    return c.groupBy(F.col("conv_id").alias("goal_id")).agg(F.min_by("text", "turn").alias("user_goal")).withColumn(
        "max_retries", F.pmod("goal_id", F.lit(4)).cast("int"))


def _log(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    goals = _goals(c)
    return _replies(c), goals


_SAID = f"""said AS (SELECT conv_id AS goal_id, turn, {_STAGE} AS stage, text, length(text) AS size, {_BROKEN} AS broken FROM conversations),
goals AS (SELECT conv_id AS goal_id, arg_min(text, turn) AS user_goal, CAST(conv_id % 4 AS INTEGER) AS max_retries FROM conversations GROUP BY conv_id),
plans AS (SELECT goal_id, turn, CASE WHEN broken OR goal_id % 5 = 0 THEN user_goal ELSE substr(text, 1, 60) END AS query, size, broken
          FROM said JOIN goals USING (goal_id) WHERE stage = 'plan'),
fixes AS (SELECT goal_id, turn, CASE WHEN broken THEN '{{broken ' || text WHEN size % 7 = 0 THEN '' ELSE text END AS fix,
          CASE WHEN broken THEN 0.5 ELSE (size % 100) / 100 END AS confidence, broken FROM said WHERE stage = 'code'),
verdicts AS (SELECT goal_id, turn, broken OR size % 3 = 0 AS ok, CASE WHEN broken THEN 'Auto-approved (parse error)' ELSE substr(text, 1, 40) END AS feedback,
             CASE WHEN broken THEN [] ELSE ['size ' || size, 'more'] END AS issues FROM said WHERE stage = 'review')"""


@register("reply_plans", f"""WITH {_SAID} SELECT goal_id, query AS search_query, CASE WHEN broken THEN '' ELSE 'k,' || size END AS keywords,
  CASE WHEN NOT broken THEN 'a.py' END AS target_file FROM plans""")
def reply_plans(spark, sf_dir):
    """FIX-02/03: plan replies; a broken one falls back to the goal."""
    log, goals = _log(spark, sf_dir)
    p = wf.parse_plans(log.filter("stage = 'plan'").join(goals, "goal_id"), "content")
    return p.select("goal_id", "search_query", F.array_join("keywords", ",").alias("keywords"), "target_file")


@register("reply_proposals", f"""WITH {_SAID} SELECT goal_id, turn * 10 AS seq, fix AS proposed_fix, confidence,
  CASE WHEN broken THEN 'Parse error - using raw content' ELSE '' END AS reasoning FROM fixes""")
def reply_proposals(spark, sf_dir):
    """FIX-10: proposal replies; a broken one is itself the fix."""
    log, _ = _log(spark, sf_dir)
    return wf.parse_proposals(log.filter("stage = 'code'"), "content").select("goal_id", "seq", "proposed_fix", "confidence", "reasoning")


@register("reply_verdicts", f"""WITH {_SAID} SELECT goal_id, turn * 10 AS seq, CASE WHEN goal_id % 7 = 0 THEN FALSE ELSE ok END AS is_approved,
  CASE WHEN goal_id % 7 = 0 THEN 'No fix provided' ELSE feedback END AS feedback,
  CASE WHEN goal_id % 7 = 0 THEN 'Missing proposed fix' ELSE array_to_string(issues, ',') END AS issues FROM verdicts""")
def reply_verdicts(spark, sf_dir):
    """FIX-11: verdict replies; a broken one approves, a missing fix is rejected."""
    log, _ = _log(spark, sf_dir)
    r = log.filter("stage = 'review'").withColumn("proposed_fix", F.when(F.col("goal_id") % 7 != 0, "x"))
    return wf.parse_verdicts(r, "content").select("goal_id", "seq", "is_approved", "feedback", F.array_join("issues", ",").alias("issues"))


_MOVES = f"""{_SAID},
c AS (SELECT *, row_number() OVER (PARTITION BY goal_id ORDER BY turn) - 1 AS retry FROM fixes),
v AS (SELECT *, row_number() OVER (PARTITION BY goal_id ORDER BY turn) - 1 AS retry FROM verdicts),
a AS (SELECT goal_id, retry, c.turn AS c_turn, v.turn AS v_turn, c.fix, c.confidence, v.feedback, v.issues, max_retries,
        CASE WHEN c.fix = '' THEN 'rejected' WHEN v.turn IS NULL THEN NULL WHEN v.ok THEN 'approved' WHEN retry < max_retries THEN 'coding' ELSE 'rejected' END AS nxt
      FROM c LEFT JOIN v USING (goal_id, retry) JOIN goals USING (goal_id)),
live AS (SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM a b WHERE b.goal_id = a.goal_id AND b.retry < a.retry AND coalesce(b.nxt, 'open') <> 'coding')),
moves AS (SELECT goal_id, CAST(0 AS BIGINT) AS seq, 'planning' AS from_status, 'retrieving' AS to_status, 'Query: ' || substr(query, 1, 50) AS note, 0 AS retry_count FROM plans
UNION ALL SELECT goal_id, 1, 'retrieving', 'coding', 'Retrieved ' || size % 6 || ' entities', 0 FROM plans
UNION ALL SELECT goal_id, c_turn * 10, 'coding', 'reviewing', 'Fix generated, confidence: ' || format('{{:.2f}}', CAST(confidence AS DOUBLE)), CAST(retry AS INTEGER) FROM live
UNION ALL SELECT goal_id, CASE WHEN fix = '' THEN c_turn ELSE v_turn END * 10, 'reviewing', nxt,
  CASE WHEN fix = '' THEN 'No fix was generated' WHEN nxt = 'approved' THEN 'Fix passed review' WHEN nxt = 'coding' THEN 'Rejected, preparing retry #' || retry + 1
       ELSE 'Max retries (' || max_retries || ') exceeded' END, CAST(retry AS INTEGER) FROM live WHERE nxt IS NOT NULL)"""


@register("workflow_transitions", f"WITH {_MOVES} SELECT * FROM moves")
def workflow_transitions(spark, sf_dir):
    """FIX-16 / UDF-04: every state change of every run, set-based."""
    log, goals = _log(spark, sf_dir)
    return wf.transitions_from_log(wf.steps_from_log(log, goals))


@register("workflow_transitions_stream", f"WITH {_MOVES} SELECT * FROM moves")
def workflow_transitions_stream(spark, sf_dir):
    """The same from keyed state, as a stream over the table; output and checkpoint lie
    under the cluster's checkpoint folder, so a job that is started again resumes."""
    import uuid

    from ..session import checkpoint_dir
    from ..streaming.jobs import _rocksdb, stream_transitions
    _rocksdb(spark)
    c = load(spark, sf_dir, "conversations")
    base = f"{checkpoint_dir(spark).rstrip('/')}/transitions/{uuid.uuid4().hex}"
    turns = spark.readStream.schema(c.schema).parquet(f"{sf_dir.rstrip('/')}/conversations.parque[t]")  # as a pattern: a file or a folder of files
    moves = stream_transitions(wf.steps_from_log(_replies(turns), _goals(c)))
    moves.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option(
        "checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(wf.TRANSITIONS).parquet(f"{base}/out")


@register("workflow_results", f"""WITH {_MOVES},
l AS (SELECT goal_id, arg_max(to_status, seq * 2 + (from_status = 'reviewing')::INT) AS status,
        arg_max(retry_count + (from_status = 'reviewing' AND to_status = 'coding')::INT, seq * 2 + (from_status = 'reviewing')::INT) AS retry_count FROM moves GROUP BY goal_id),
f AS (SELECT goal_id, arg_max(fix, c_turn) AS fix, arg_max(feedback, v_turn) FILTER (fix <> '' AND v_turn IS NOT NULL) AS feedback,
        arg_max(len(issues), v_turn) FILTER (fix <> '' AND v_turn IS NOT NULL) AS n_issues FROM live GROUP BY goal_id)
SELECT goal_id, coalesce(status, 'planning') AS final_status, CAST(coalesce(retry_count, 0) AS INTEGER) AS retry_count, coalesce(status, '') = 'approved' AS success,
  fix, feedback, CAST(coalesce(n_issues, 0) AS INTEGER) AS n_issues FROM goals LEFT JOIN l USING (goal_id) LEFT JOIN f USING (goal_id)""")
def workflow_results(spark, sf_dir):
    """FIX-14/18: the results of the logged runs."""
    log, goals = _log(spark, sf_dir)
    r = wf.result_rows(wf.run_from_log(wf.steps_from_log(log, goals), goals))
    return r.select("goal_id", "final_status", "retry_count", "success", "fix", "feedback", F.size("issues").alias("n_issues"))


@register("score_replies", """SELECT CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) AS prompt_key,
  CASE WHEN length(text) % 9 <> 4 THEN 'size ' || length(text) END AS reply, CASE WHEN length(text) % 9 = 4 THEN 'ValueError: cannot score' END AS error
FROM conversations""")
def score_replies(spark, sf_dir):
    """FIX-17 / UDF-03: every turn through a user function that fails on some rows."""
    def size(prompts):
        n = prompts.str.len()
        if (n % 9 == 4).any():
            raise ValueError("cannot score")
        return "size " + n.astype(str)

    c = load(spark, sf_dir, "conversations")
    return wf.score(c.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("prompt_key"),
                             F.col("text").alias("prompt")), size)
