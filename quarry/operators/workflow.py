"""Batch propose/review workflow as set-based rounds (FIX-01…23).

Work items (goals) advance together: each round scores the open rows with a
user function (FIX-17), parses replies natively, computes the next status with
a ``when`` chain, and splits finished from open rows. Lineage is cut after
every round by writing the round to the shared checkpoint folder, so a lost
executor recomputes at most one round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.jsonx import JSON, json_field, with_json
from ..functions.text import preview
from .entities import py_strip

# --- fixed values: goal and retry bounds
MIN_GOAL_CHARS = 10
DEFAULT_MAX_RETRIES, MAX_RETRIES_LIMIT = 3, 10
DEFAULT_CONFIDENCE = 0.5


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---- validation -----------------------------------------------------------

def validate_goals(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """FIX-01: goal trimmed and >= 10 characters; 0 <= max_retries <= 10.

    Returns ``(good, bad)``; good rows carry the trimmed goal.
    """
    g = py_strip(F.col("user_goal"))
    r = F.coalesce(F.col("max_retries"), F.lit(DEFAULT_MAX_RETRIES))
    reason = (F.when(F.col("user_goal").isNull() | (F.length(g) < MIN_GOAL_CHARS),
                     F.lit("User goal must be at least 10 characters"))
              .when(~r.between(0, MAX_RETRIES_LIMIT), F.lit("max_retries must be between 0 and 10")))
    t = df.withColumn("_reason", reason)
    good = t.filter(F.col("_reason").isNull()).drop("_reason").withColumn("user_goal", g).withColumn("max_retries", r.cast("int"))
    bad = t.filter(F.col("_reason").isNotNull()).select(
        F.lit("goals").alias("stage"), F.col("goal_id").cast("string").alias("key"),
        F.col("_reason").alias("reason"), F.col("user_goal").alias("payload"))
    return good, bad


# ---- reply parsing ---------------------------------------------------------

def _without_json(given: DataFrame, df: DataFrame) -> DataFrame:
    """``df`` without the parsed reply, unless it was ``given``."""
    return df if JSON in given.columns else df.drop(JSON)


def parse_plans(df: DataFrame, reply: str = "reply") -> DataFrame:
    """FIX-02: plan reply -> search_query, keywords, target_file. On a parse
    failure the query is the goal and there are no keywords (the item still
    advances to retrieval; deviation from the reference, which loops)."""
    j = F.col(JSON)
    return _without_json(df, with_json(df, reply).withColumns({
        "search_query": F.when(j.isNull(), F.col("user_goal")).otherwise(
            json_field(j, "search_query", "string", F.col("user_goal"))),
        "keywords": F.when(j.isNull(), F.array().cast("array<string>")).otherwise(
            json_field(j, "keywords", "array<string>", F.array().cast("array<string>"))),
        "target_file": json_field(j, "target_file", "string"),
        "status": F.lit("retrieving"),
    }))


def parse_proposals(df: DataFrame, reply: str = "reply") -> DataFrame:
    """FIX-10: proposal reply -> proposed_fix, confidence (0.5), reasoning. An
    unparsable reply is itself the fix, confidence 0.5."""
    j = F.col(JSON)
    return _without_json(df, with_json(df, reply).withColumns({
        "proposed_fix": F.when(j.isNull(), F.col(reply)).otherwise(json_field(j, "proposed_fix", "string")),
        "confidence": F.when(j.isNull(), F.lit(DEFAULT_CONFIDENCE)).otherwise(
            json_field(j, "confidence_score", "double", DEFAULT_CONFIDENCE)),
        "reasoning": F.when(j.isNull(), F.lit("Parse error - using raw content")).otherwise(
            json_field(j, "reasoning", "string", "")),
        "status": F.lit("reviewing"),
    }))


def parse_verdicts(df: DataFrame, reply: str = "reply") -> DataFrame:
    """FIX-11: verdict reply -> is_approved (false), feedback, issues, severity.
    Unparsable -> approved with a marker feedback (and the item ends approved:
    deviation, the reference loops). No fix at all -> rejected."""
    j = F.col(JSON)
    no_fix = F.coalesce(F.col("proposed_fix"), F.lit("")) == ""
    return _without_json(df, with_json(df, reply).withColumns({
        "is_approved": F.when(no_fix, F.lit(False)).when(j.isNull(), F.lit(True))
        .otherwise(json_field(j, "is_approved", "boolean", False)),
        "feedback": F.when(no_fix, F.lit("No fix provided")).when(j.isNull(), F.lit("Auto-approved (parse error)"))
        .otherwise(json_field(j, "feedback", "string", "")),
        "issues": F.when(no_fix, F.array(F.lit("Missing proposed fix"))).when(j.isNull(), F.array().cast("array<string>"))
        .otherwise(json_field(j, "issues", "array<string>", F.array().cast("array<string>"))),
        "review_severity": json_field(j, "severity", "string", "unknown"),
    }))


# ---- status machine --------------------------------------------------------

def next_status(failed="failed", fix="proposed_fix", approved="is_approved",
                retry="retry_count", max_retries="max_retries") -> Column:
    """FIX-12: failure -> failed; no fix -> rejected; approved -> approved;
    rejected with retries left -> coding; else rejected."""
    return (F.when(F.coalesce(_c(failed), F.lit(False)), F.lit("failed"))
            .when(F.coalesce(_c(fix), F.lit("")) == "", F.lit("rejected"))
            .when(F.coalesce(_c(approved), F.lit(False)), F.lit("approved"))
            .when(_c(retry) < _c(max_retries), F.lit("coding"))
            .otherwise(F.lit("rejected")))


def transition_note(status: Column, retry="retry_count", max_retries="max_retries") -> Column:
    return (F.when(status == "approved", F.lit("Fix passed review"))
            .when(status == "coding", F.concat(F.lit("Rejected, preparing retry #"), (_c(retry) + 1).cast("string")))
            .when(status == "rejected", F.concat(F.lit("Max retries ("), _c(max_retries).cast("string"), F.lit(") exceeded")))
            .otherwise(F.lit("")))


def coding_note(confidence="confidence") -> Column:
    return F.concat(F.lit("Fix generated, confidence: "), F.format_string("%.2f", F.coalesce(_c(confidence), F.lit(DEFAULT_CONFIDENCE))))


def retry_rows(df: DataFrame) -> DataFrame:
    """FIX-13: retry count + 1, status coding; plan, context and feedback kept;
    fix, confidence, reasoning and approval cleared."""
    return df.withColumns({
        "retry_count": (F.col("retry_count") + 1).cast("int"),
        "status": F.lit("coding"),
        "proposed_fix": F.lit(None).cast("string"),
        "confidence": F.lit(None).cast("double"),
        "reasoning": F.lit(None).cast("string"),
        "is_approved": F.lit(None).cast("boolean"),
    })


# ---- prompt context ----------------------------------------------------------

def context_summary(ctx="context", count=None) -> Column:
    """FIX-06: ``Retrieved N code entities:`` then up to 5 ranked entities with
    location and an 80-character doc preview; fixed text when empty.
    ``ctx`` is ``ARRAY<STRUCT<qualified_name, location, docstring>>`` in rank order."""
    c = _c(ctx)

    def item(x, i):
        doc = F.when(F.coalesce(x["docstring"], F.lit("")) != "",
                     F.concat(F.lit("\n     Doc: "), preview(x["docstring"], 80))).otherwise(F.lit(""))
        return F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), x["qualified_name"], F.lit(" at "),
                        x["location"], doc)

    body = F.array_join(F.transform(F.slice(c, 1, 5), item), "\n")
    # ``count``: total context size when only the top rows were collected
    n = F.size(c) if count is None else _c(count)
    return F.when(F.coalesce(n, F.lit(0)) <= 0, F.lit("No context retrieved yet.")).otherwise(
        F.concat(F.lit("Retrieved "), n.cast("string"), F.lit(" code entities:\n"), body))


def context_code(ctx="context", heading: str = "Code Entity") -> Column:
    """FIX-07: numbered listing of context documents (writer: ``Code Entity``,
    reviewer: ``Original Code Entity``); ``ctx`` is ``ARRAY<STRUCT<document>>``."""
    c = _c(ctx)
    items = F.transform(c, lambda x, i: F.concat(F.lit(f"\n--- {heading} "), (i + 1).cast("string"),
                                                 F.lit(" ---\n"), x["document"], F.lit("\n")))
    return F.when(F.coalesce(F.size(c), F.lit(0)) <= 0, F.lit("No code context retrieved.")).otherwise(
        F.array_join(items, "\n"))


def fix_context(ctx="context", fix="proposed_fix", feedback="feedback") -> Column:
    """FIX-08: relevant code, proposed fix, reviewer feedback; each only if present."""
    c = _c(ctx)
    code = F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.concat(
        F.lit("## Relevant Code\n\n"),
        F.array_join(F.transform(c, lambda x: F.concat(x["document"], F.lit("\n\n---\n"))), "\n")))
    fx = F.when(F.coalesce(_c(fix), F.lit("")) != "", F.concat(F.lit("## Proposed Fix\n\n"), _c(fix)))
    fb = F.when(F.coalesce(_c(feedback), F.lit("")) != "", F.concat(F.lit("\n## Reviewer Feedback\n\n"), _c(feedback)))
    return F.concat_ws("\n", code, fx, fb)


def retry_context(retry="retry_count", feedback="feedback", issues="issues") -> Column:
    """FIX-09: empty on the first attempt or with neither feedback nor issues;
    else the feedback and a bullet list of issues."""
    fb, iss = _c(feedback), F.coalesce(_c(issues), F.array().cast("array<string>"))
    bullets = F.when(F.size(iss) > 0, F.concat(F.lit("\nSpecific issues to address:\n"),
                                               F.array_join(F.transform(iss, lambda x: F.concat(F.lit("  - "), x)), "\n")))
    body = F.concat_ws("\n", F.lit("\n## Previous Attempt Feedback\n"),
                       F.concat(F.lit("The previous fix was rejected with this feedback:\n"), F.coalesce(fb, F.lit("None"))),
                       bullets)
    return (F.when(_c(retry) == 0, F.lit(""))
            .when((F.coalesce(fb, F.lit("")) == "") & (F.size(iss) == 0), F.lit(""))
            .otherwise(body))


def render_prompt(df: DataFrame, templates, role_col: str = "role",
                  fields: tuple[str, ...] = ()) -> DataFrame:
    """FIX-05: fill the role's template (``{field}`` placeholders, values
    inserted once like ``str.format``). ``templates`` is a tiny ``(role,
    template)`` table or list (configuration, size-checked); an unknown role
    gives a null prompt and ``prompt_error``, never a failed task."""
    from ..functions.text import fill_template
    if isinstance(templates, DataFrame):
        if templates.count() > 1000:
            raise ValueError("template table too large: it is configuration")
        templates = [(r[0], r[1]) for r in templates.select("role", "template").collect()]
    prompt = F.lit(None).cast("string")
    for role, tpl in reversed(list(templates)):
        prompt = F.when(F.col(role_col) == role, fill_template(tpl, {f: f for f in fields})).otherwise(prompt)
    known = F.col(role_col).isin(*[r for r, _ in templates])
    return df.withColumn("prompt", prompt).withColumn(
        "prompt_error", F.when(~known | F.col(role_col).isNull(), F.concat(F.lit("unknown role: "), F.coalesce(F.col(role_col), F.lit("null")))))


# ---- results ----------------------------------------------------------------

def result_rows(df: DataFrame) -> DataFrame:
    """FIX-18: success, fix, feedback, issues, retries, final status, context count."""
    return df.select(
        "goal_id", (F.col("status") == "approved").alias("success"),
        (F.col("status") == "approved").alias("is_approved"),
        F.col("proposed_fix").alias("fix"), "feedback", "issues", "retry_count",
        F.col("status").alias("final_status"),
        F.coalesce(F.size("context"), F.lit(0)).alias("retrieved_context_count") if "context" in df.columns
        else F.lit(0).alias("retrieved_context_count"))


def compact(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """FIX-19: prompt view; the retrieved context replaced by its size."""
    return df.select(*keep, "user_goal", "search_query", "retry_count", "max_retries",
                     F.coalesce(F.size("context"), F.lit(0)).alias("retrieved_count"),
                     "proposed_fix", "is_approved", "feedback", "issues")


def result_preview(df: DataFrame) -> Column:
    """FIX-20: status line, fix <= 500 chars, feedback <= 200, first 3 issues <= 80 each."""
    fix, fb, iss = F.col("fix"), F.col("feedback"), F.coalesce(F.col("issues"), F.array().cast("array<string>"))
    head = F.concat(F.when(F.col("success"), F.lit("✅ APPROVED")).otherwise(F.lit("❌ REJECTED")),
                    F.lit(" (retries: "), F.col("retry_count").cast("string"), F.lit(")\n"))
    fix_part = F.when(F.coalesce(fix, F.lit("")) != "", F.concat(
        F.lit("\nProposed Fix ("), F.length(fix).cast("string"), F.lit(" chars):\n```python\n"), F.substring(fix, 1, 500),
        F.when(F.length(fix) > 500, F.lit("\n... (truncated)")).otherwise(F.lit("")), F.lit("\n```\n"))).otherwise(F.lit(""))
    fb_part = F.when(F.coalesce(fb, F.lit("")) != "", F.concat(
        F.lit("\nFeedback: "), F.substring(fb, 1, 200), F.when(F.length(fb) > 200, F.lit("...")).otherwise(F.lit("")),
        F.lit("\n"))).otherwise(F.lit(""))
    iss_part = F.when(F.size(iss) > 0, F.concat(
        F.lit("\nIssues ("), F.size(iss).cast("string"), F.lit("):\n"),
        F.array_join(F.transform(F.slice(iss, 1, 3), lambda x: F.concat(F.lit("  - "), F.substring(x, 1, 80), F.lit("\n"))), ""))
    ).otherwise(F.lit(""))
    return F.concat(head, fix_part, fb_part, iss_part)


def report_md(df: DataFrame, stamp: str) -> Column:
    """FIX-21: Markdown report per result (issues numbered from 0). ``stamp`` is
    passed in, so reports are reproducible."""
    fix = F.col("fix")
    formatted = F.when(F.coalesce(fix, F.lit("")) != "", F.concat(F.lit("```python\n"), fix, F.lit("\n```"))) \
        .otherwise(F.lit("No fix generated"))
    iss = F.coalesce(F.col("issues"), F.array().cast("array<string>"))
    issues = F.when(F.size(iss) > 0, F.array_join(
        F.transform(iss, lambda x, i: F.concat(i.cast("string"), F.lit(". "), x, F.lit("\n"))), "")) \
        .otherwise(F.lit("No issues reported"))
    b = lambda c: F.when(c, F.lit("True")).otherwise(F.lit("False"))
    return F.concat(
        F.lit("\n# Fix Result Report\n## Summary\n- **Success**: "), b(F.col("success")),
        F.lit("\n- **Approved**: "), b(F.col("is_approved")),
        F.lit("\n- **Retries**: "), F.col("retry_count").cast("string"),
        F.lit(f"\n- **Timestamp**: {stamp}\n## Proposed Fix\n"), formatted,
        F.lit("\n## Feedback\n"), F.coalesce(F.col("feedback"), F.lit("None")),
        F.lit("\n## Issues Found\n"), issues)


def gate(work: DataFrame, approved: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """FIX-22: items with an approving decision, and the skipped rest."""
    return work.join(approved, key, "left_semi"), work.join(approved, key, "left_anti")


def goals_from_findings(findings: DataFrame, severity: str = "WARNING", max_retries: int = DEFAULT_MAX_RETRIES) -> DataFrame:
    """FIX-23: findings at or above the threshold -> goals with a retry budget."""
    from .findings import at_least, goal_text
    return at_least(findings, severity).select(
        F.col("id").alias("goal_id"), goal_text().alias("user_goal"), F.lit(max_retries).alias("max_retries"))


def outcomes_from_log(reviews: DataFrame, goals: DataFrame) -> DataFrame:
    """FIX-15: outcome per goal from a logged review table, no loop.

    ``reviews(goal_id, ts, approved)``; ``goals(goal_id, max_retries)``. The
    first approval within ``max_retries + 1`` reviews wins; a goal with that
    many rejections first is rejected; otherwise it is still open. Only a goal's first
    ``MAX_RETRIES_LIMIT + 1`` reviews can matter: Spark keeps no more of any goal in a
    task before it shuffles, so the log is read once and a hot goal is no large group.
    """
    w = Window.partitionBy("goal_id").orderBy("ts", F.desc("approved"))  # reviews of one moment: the approving first
    early = reviews.select("goal_id", "ts", "approved").withColumn("at", F.row_number().over(w)).filter(F.col("at") <= MAX_RETRIES_LIMIT + 1)
    seen = early.groupBy("goal_id").agg(F.min(F.when(F.col("approved"), F.col("at"))).alias("ok_at"), F.count(F.lit(1)).alias("n"))
    budget, n = F.col("max_retries") + 1, F.coalesce(F.col("n"), F.lit(0))
    status = (F.when(F.col("ok_at") <= budget, F.lit("approved")).when(n >= budget, F.lit("rejected")).otherwise(F.lit("open")))
    retries = (F.when(status == "approved", F.col("ok_at") - 1).when(status == "rejected", F.col("max_retries"))
               .otherwise(F.greatest(n - 1, F.lit(0))))
    return goals.join(seen, "goal_id", "left").select(
        "goal_id", status.alias("final_status"), retries.cast("int").alias("retry_count"), F.least(n, budget).cast("int").alias("reviews_used"))


# ---- scoring hook and rounds ------------------------------------------------

REPLY_SCHEMA = "prompt_key string, reply string, error string"


def score(df: DataFrame, fn: Callable, key: str = "prompt_key", prompt: str = "prompt") -> DataFrame:
    """FIX-17 / UDF-03: prompt -> reply through a user function, one Arrow batch
    at a time (``fn(pandas.Series[str]) -> pandas.Series[str]``). A failing
    batch never fails the task: it is retried row by row, and only the rows
    that still fail get ``error`` set (and a null reply)."""
    def call(fn_, s):
        import pandas as pd
        return pd.Series(fn_(s), index=s.index).astype(object)

    def run(it):
        import pandas as pd
        for pdf in it:
            prompts = pdf[prompt].astype(object)
            replies = pd.Series([None] * len(pdf), index=pdf.index, dtype=object)
            err = pd.Series([None] * len(pdf), index=pdf.index, dtype=object)
            try:
                replies = call(fn, prompts)
            except Exception:  # noqa: BLE001 - isolate the failing rows
                for i in pdf.index:
                    try:
                        replies.loc[i] = call(fn, prompts.loc[[i]]).iloc[0]
                    except Exception as e:  # noqa: BLE001 - reported as a row
                        err.loc[i] = f"{type(e).__name__}: {e}"
            yield pd.DataFrame({"prompt_key": pdf[key].astype(str), "reply": replies, "error": err})
    return df.select(F.col(key).cast("string").alias(key), F.col(prompt)).mapInPandas(run, REPLY_SCHEMA)


def replay(replies: DataFrame, store: bool = False) -> Callable[[DataFrame, str], DataFrame]:
    """Default scoring: replay a logged reply table ``(prompt_key, stage, attempt,
    content)`` by equi-join instead of calling a model. ``store=True`` writes
    the log once to the shared checkpoint folder (reliable checkpoint), so the
    rounds join a stored table instead of recomputing how it was derived."""
    if store:
        from ..session import checkpoint_dir
        checkpoint_dir(replies.sparkSession)
        replies = replies.checkpoint(eager=True)

    def fn(df: DataFrame, stage: str) -> DataFrame:
        r = replies.filter(F.col("stage") == stage).select(
            F.col("prompt_key").alias("_k"), F.col("attempt").alias("_a"), F.col("content").alias("reply"))
        j = df.join(r, (df["goal_id"].cast("string") == r["_k"]) & (df["retry_count"] == r["_a"]), "left")
        return j.drop("_k", "_a")
    return fn


def run_rounds(goals: DataFrame, propose: Callable[[DataFrame], DataFrame],
               review: Callable[[DataFrame], DataFrame], max_rounds: int | None = None,
               checkpoint: Callable[[DataFrame], DataFrame] | None = None,
               stamp: str = "1970-01-01 00:00:00") -> tuple[DataFrame, DataFrame]:
    """FIX-14: propose -> review rounds until no item is open.

    ``goals`` has ``goal_id, user_goal, max_retries`` (+ any context columns).
    ``propose(df)`` must add a ``reply`` for the writer stage; ``review(df)`` a
    ``reply`` for the reviewer stage (see :func:`replay`). Each round is cut
    from the lineage with ``checkpoint`` (default: reliable ``DataFrame.checkpoint``
    into the cluster's shared checkpoint folder). Returns ``(finished, transitions)``;
    transitions (FIX-16; of coding and of reviewing) carry ``ts`` = ``stamp`` + round seconds, passed in so
    reruns give the same rows.
    """
    from ..session import checkpoint_dir
    spark = goals.sparkSession
    if checkpoint is None:
        checkpoint_dir(spark)
        checkpoint = lambda d: d.checkpoint(eager=True)
    limit = max_rounds or (MAX_RETRIES_LIMIT + 1)
    open_ = goals.withColumns({"retry_count": F.lit(0), "status": F.lit("coding"),
                               "proposed_fix": F.lit(None).cast("string"), "feedback": F.lit(None).cast("string"),
                               "issues": F.array().cast("array<string>")})
    finished, transitions = [], []
    for rnd in range(limit):
        drafted = parse_proposals(propose(open_.drop("reply") if "reply" in open_.columns else open_)).drop("reply")
        drafted = checkpoint(drafted)
        reviewed = parse_verdicts(review(drafted)).drop("reply")
        st = next_status(F.lit(False))
        stepped = checkpoint(reviewed.withColumn("next", st).withColumn("note", transition_note(F.col("next"))))
        ts = (F.to_timestamp(F.lit(stamp)) + F.make_interval(secs=F.lit(rnd))).alias("ts")
        transitions.append(drafted.select("goal_id", ts, F.lit("coding").alias("from_status"), F.lit("reviewing").alias("to_status"),
                                          coding_note().alias("note"), "retry_count"))
        transitions.append(stepped.select("goal_id", ts, F.lit("reviewing").alias("from_status"),
                                          F.col("next").alias("to_status"), "note", "retry_count"))
        done = stepped.filter(F.col("next") != "coding").withColumn("status", F.col("next")).drop("next", "note")
        finished.append(done)
        open_ = retry_rows(stepped.filter(F.col("next") == "coding").drop("next", "note"))
        if open_.isEmpty():
            break
    finished.append(open_)  # goals still open at the limit stay in the result, as "coding"
    out = finished[0]
    for d in finished[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    tr = transitions[0]
    for d in transitions[1:]:
        tr = tr.unionByName(d)
    return out, tr


# ---- a whole run from its log (FIX-14, 16, UDF-04) ------------------------------

STEP_SCHEMA = T.StructType([
    T.StructField("goal_id", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("stage", T.StringType()),
    T.StructField("max_retries", T.IntegerType()), T.StructField("note", T.StringType()),
    T.StructField("proposed_fix", T.StringType()), T.StructField("is_approved", T.BooleanType()),
    T.StructField("feedback", T.StringType()), T.StructField("issues", T.ArrayType(T.StringType()))])
TRANSITIONS = "goal_id long, seq long, from_status string, to_status string, note string, retry_count int"
FINISHED = ("approved", "rejected", "failed")


def steps_from_log(log: DataFrame, goals: DataFrame) -> DataFrame:
    """The parsed steps (``STEP_SCHEMA``) of a logged run.

    ``log(goal_id, seq, stage, content)`` holds every reply in the order of ``seq``:
    ``plan``, ``code`` and ``review`` replies as text, ``retrieve`` the number of records
    that the search found; ``goals(goal_id, user_goal, max_retries)``. Rows of other
    goals or stages are left out. Replies are parsed by column expressions, so the same
    function serves a stream (joined to static goals) and a table."""
    j = log.join(goals.select(F.col("goal_id"), "user_goal", F.col("max_retries").cast("int").alias("max_retries")), "goal_id")
    j = j.filter(F.col("stage").isin("plan", "retrieve", "code", "review")).withColumnRenamed("content", "reply")
    j = with_json(j, "reply")
    plan = parse_plans(j).drop("keywords", "target_file", "status").withColumnRenamed("search_query", "query")
    code = parse_proposals(plan).drop("reasoning", "status").withColumnsRenamed({"proposed_fix": "fix"})
    # A verdict is read as it stands; whether there was a fix is known from the step before.
    verdict = parse_verdicts(code.withColumn("proposed_fix", F.lit("-"))).drop("review_severity", "proposed_fix")
    at = F.col("stage")
    note = (F.when(at == "plan", F.concat(F.lit("Query: "), F.substring("query", 1, 50)))
            .when(at == "retrieve", F.concat(F.lit("Retrieved "), F.coalesce(F.col("reply").try_cast("int"), F.lit(0)).cast("string"), F.lit(" entities")))
            .when(at == "code", coding_note()))
    of = lambda stage, c: F.when(at == stage, F.col(c)).alias(c if c != "fix" else "proposed_fix")
    return verdict.select(F.col("goal_id").cast("long"), F.col("seq").cast("long"), "stage", "max_retries", note.alias("note"),
                          of("code", "fix"), of("review", "is_approved"), of("review", "feedback"), of("review", "issues"))


def transitions_from_log(steps: DataFrame) -> DataFrame:
    """FIX-16 / UDF-04: one row per state change (``TRANSITIONS``) of a logged run, with
    no loop: planning, retrieving, and coding and reviewing of each attempt.

    The ``i``-th code and review of a goal are its attempt ``i``; at most
    ``MAX_RETRIES_LIMIT + 1`` of each are read (Spark cuts a goal with more rows before it
    shuffles). The first review that doesn't lead back to coding ends the goal; later rows
    say nothing. An attempt without a fix is rejected without a review."""
    w = Window.partitionBy("goal_id", "stage").orderBy("seq")
    taken = steps.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= MAX_RETRIES_LIMIT + 1)
    first = taken.filter(F.col("stage").isin("plan", "retrieve") & (F.col("n") == 1))
    start = F.when(F.col("stage") == "plan", F.lit("planning")).otherwise(F.lit("retrieving"))
    end = F.when(F.col("stage") == "plan", F.lit("retrieving")).otherwise(F.lit("coding"))
    early = first.select("goal_id", "seq", start.alias("from_status"), end.alias("to_status"), "note", F.lit(0).alias("retry_count"))
    retry = (F.col("n") - 1).cast("int").alias("retry_count")
    code = taken.filter("stage = 'code'").select("goal_id", retry, F.col("seq").alias("code_seq"), "max_retries", "note", "proposed_fix")
    review = taken.filter("stage = 'review'").select("goal_id", retry, F.col("seq").alias("review_seq"), "is_approved")
    both = code.join(review, ["goal_id", "retry_count"], "left")
    no_fix = F.coalesce("proposed_fix", F.lit("")) == ""
    to = F.when(no_fix | F.col("review_seq").isNotNull(), next_status(F.lit(False)))
    judged = both.withColumn("to", to)
    attempts = Window.partitionBy("goal_id").orderBy("retry_count").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.max(F.coalesce(F.col("to") != "coding", F.lit(True))).over(attempts), F.lit(False))
    live = judged.withColumn("ended", ended).filter("NOT ended")
    coded = F.struct(F.col("code_seq").alias("seq"), F.lit("coding").alias("from_status"), F.lit("reviewing").alias("to_status"), F.col("note").alias("note"))
    reviewed = F.when(F.col("to").isNotNull(), F.struct(
        F.coalesce(F.when(~no_fix, F.col("review_seq")), F.col("code_seq")).alias("seq"), F.lit("reviewing").alias("from_status"), F.col("to").alias("to_status"),
        F.when(no_fix, F.lit("No fix was generated")).otherwise(transition_note(F.col("to"))).alias("note")))
    late = live.select("goal_id", "retry_count", F.explode(F.array_compact(F.array(coded, reviewed))).alias("t")).select(
        "goal_id", "t.seq", "t.from_status", "t.to_status", "t.note", "retry_count")
    return early.unionByName(late)


def run_from_log(steps: DataFrame, goals: DataFrame) -> DataFrame:
    """FIX-14/18: the goals of a logged run with status, retries, last fix, feedback and
    issues; a goal whose log stops early stays in the status that it had reached."""
    moves = transitions_from_log(steps)
    # Coding is left and entered at the same place when there is no fix: the later status wins.
    order = F.struct("seq", (F.col("from_status") == "reviewing").alias("late"), "to_status", "retry_count")
    last = moves.groupBy("goal_id").agg(F.max(order).alias("m"))
    done = last.select("goal_id", F.col("m.to_status").alias("status"), F.col("m.seq").alias("last_seq"),
                       (F.col("m.retry_count") + (F.col("m.late") & (F.col("m.to_status") == "coding")).cast("int")).alias("retry_count"))
    said = steps.join(done, "goal_id").filter("seq <= last_seq").groupBy("goal_id").agg(
        F.max_by("proposed_fix", F.when(F.col("stage") == "code", F.col("seq"))).alias("proposed_fix"),
        F.max(F.when(F.col("stage") == "review", F.struct("seq", "feedback", "issues"))).alias("r"))
    j = goals.join(done, "goal_id", "left").join(said, "goal_id", "left")
    return j.select("goal_id", "user_goal", "max_retries", F.coalesce("status", F.lit("planning")).alias("status"),
                    F.coalesce("retry_count", F.lit(0)).cast("int").alias("retry_count"), "proposed_fix",
                    F.col("r.feedback").alias("feedback"), F.coalesce("r.issues", F.array().cast("array<string>")).alias("issues"))
