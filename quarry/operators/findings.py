"""Findings algebra (FND-01…23): ids, texts, union, dedup, threshold, roll-ups.

A finding is a row of :data:`FINDING_COLUMNS`. ``detector_ord`` (registration
order of the detector that produced it) and ``emit_ord`` (order within that
detector) make every "first one wins" rule deterministic on a cluster, where
row order is not.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import path_name, path_stem, preview
from .rules import sev_rank

FINDING_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("sev_rank", T.IntegerType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("line_number", T.IntegerType()),
    T.StructField("col", T.IntegerType()),
    T.StructField("end_line", T.IntegerType()),
    T.StructField("message", T.StringType()),
    T.StructField("error_code", T.StringType()),
    T.StructField("suggested_fix", T.StringType()),
    T.StructField("code_snippet", T.StringType()),
    T.StructField("tool_output", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("detector_ord", T.IntegerType()),
    T.StructField("emit_ord", T.LongType()),
])
FINDING_COLUMNS = [f.name for f in FINDING_SCHEMA.fields]

# --- fixed values: display markers per severity, and the fallback marker.
SEVERITY_ICON = {"ERROR": "❌", "WARNING": "⚠️", "INFO": "ℹ️"}
UNKNOWN_ICON = "❓"


def to_findings(df: DataFrame) -> DataFrame:
    """Complete a partial findings frame: missing columns are typed nulls,
    ``sev_rank`` and ``id`` are derived when absent."""
    cols = set(df.columns)
    sel = []
    for f in FINDING_SCHEMA.fields:
        if f.name == "sev_rank":
            sel.append(sev_rank("severity").alias("sev_rank") if "sev_rank" not in cols
                       else F.col("sev_rank").cast("int"))
        elif f.name in cols:
            sel.append(F.col(f.name).cast(f.dataType).alias(f.name))
        elif f.name == "detector_ord":
            sel.append(F.lit(0).alias(f.name))
        elif f.name == "emit_ord":
            sel.append(F.lit(0).cast("long").alias(f.name))
        else:
            sel.append(F.lit(None).cast(f.dataType).alias(f.name))
    extra = [c for c in df.columns if c not in FINDING_COLUMNS]
    return finding_id(df.select(*sel, *extra))


# ---- per-row texts -------------------------------------------------------

def location_text(path="file_path", line="line_number", col="col") -> Column:
    """FND-02: ``path:line`` plus ``:col`` when the column is set and not 0."""
    p, l, c = (F.col(x) if isinstance(x, str) else x for x in (path, line, col))
    return F.concat(p, F.lit(":"), l.cast("string"),
                    F.when(c.isNotNull() & (c != 0), F.concat(F.lit(":"), c.cast("string"))).otherwise(F.lit("")))


def finding_id(df: DataFrame) -> DataFrame:
    """FND-01: first 12 hex digits of MD5(``location:message``); a given id is kept."""
    computed = F.substring(F.md5(F.concat(location_text(), F.lit(":"), F.col("message"))), 1, 12)
    return df.withColumn("id", F.when(F.col("id").isNull() | (F.col("id") == ""), computed).otherwise(F.col("id")))


def short_name(df: DataFrame) -> Column:
    """FND-03: ``stem:line:code`` (``BUG`` when there is no code)."""
    code = F.coalesce(F.nullif(F.col("error_code"), F.lit("")), F.lit("BUG"))
    return F.concat(path_stem("file_path"), F.lit(":"), F.col("line_number").cast("string"), F.lit(":"), code)


def is_fixable() -> Column:
    """FND-04: a suggestion exists (an empty one counts)."""
    return F.col("suggested_fix").isNotNull()


def goal_text() -> Column:
    """FND-05: ``Fix <sev> in <name> at line <n> [(<code>)] : <message>``."""
    code = F.when(F.coalesce(F.col("error_code"), F.lit("")) != "",
                  F.concat(F.lit("("), F.col("error_code"), F.lit(")")))
    return F.concat_ws(" ",
                       F.concat(F.lit("Fix "), F.lower("severity")),
                       F.concat(F.lit("in "), path_name("file_path")),
                       F.concat(F.lit("at line "), F.col("line_number").cast("string")),
                       code,
                       F.concat(F.lit(": "), F.col("message")))


def findings_json() -> Column:
    """FND-06: JSON object with nested location; tool output and metadata left out."""
    return F.to_json(F.struct(
        "id", "source", "severity",
        F.struct(F.col("file_path"), F.col("line_number"), F.col("col").alias("column"),
                 F.col("end_line")).alias("location"),
        "message", "error_code", "suggested_fix", "code_snippet",
        is_fixable().alias("is_auto_fixable")), {"ignoreNullFields": "false"})


def display_line() -> Column:
    """FND-07: ``<icon> [<source>] <location> - <message>``."""
    icon = F.coalesce(F.create_map(*[x for k, v in SEVERITY_ICON.items() for x in (F.lit(k), F.lit(v))])[F.col("severity")],
                      F.lit(UNKNOWN_ICON))
    return F.concat(icon, F.lit(" ["), F.col("source"), F.lit("] "), location_text(), F.lit(" - "), F.col("message"))


def snippet_preview() -> Column:
    """FND-21: first 100 characters of the snippet, newlines as spaces, ``...`` when cut."""
    return preview("code_snippet", 100)


# ---- set operations ------------------------------------------------------

def union_findings(*dfs: DataFrame) -> DataFrame:
    """FND-08: union in registration order; each input's position is its ``detector_ord``."""
    parts = [to_findings(d.withColumn("detector_ord", F.lit(i))).select(*FINDING_COLUMNS) for i, d in enumerate(dfs)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def dedup_key(lower: bool = True) -> list[Column]:
    msg = F.substring(F.col("message"), 1, 50)
    return [F.col("file_path"), F.col("line_number"), (F.lower(msg) if lower else msg).alias("_k_msg")]


def _first_per_key(df: DataFrame, keys: list[Column]) -> DataFrame:
    """Keep the first row per key by (detector_ord, emit_ord, id).

    ``row_number() == 1`` plans as WindowGroupLimit before the exchange: each
    map task keeps one row per key, so a hot key is cut down before the shuffle.
    """
    key_names = []
    tmp = df
    for i, k in enumerate(keys):
        n = f"_k{i}"
        tmp = tmp.withColumn(n, k)
        key_names.append(n)
    w = Window.partitionBy(*key_names).orderBy("detector_ord", "emit_ord", "id")
    return (tmp.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1)
            .drop("_rn", *key_names))


def dedup_findings(df: DataFrame, lower: bool = True) -> DataFrame:
    """FND-09/10: one finding per (path, line, first 50 chars of message)."""
    msg = F.substring(F.col("message"), 1, 50)
    return _first_per_key(df, [F.col("file_path"), F.col("line_number"), F.lower(msg) if lower else msg])


def distinct_findings(df: DataFrame) -> DataFrame:
    """FND-11: one finding per id. The short id is for display: findings that share
    it by chance differ in the whole hash and both stay."""
    whole = F.md5(F.concat_ws(":", location_text(), F.col("message")))
    return _first_per_key(df, [F.col("id"), whole])


def threshold_rank(severity: str) -> int:
    return {"ERROR": 0, "WARNING": 1, "INFO": 2}.get((severity or "").upper(), 0)


def at_least(df: DataFrame, severity: str) -> DataFrame:
    """FND-12: keep findings at or above ``severity`` (unknown threshold = ERROR)."""
    return df.filter(F.col("sev_rank") <= F.lit(threshold_rank(severity)))


def sort_findings(df: DataFrame) -> DataFrame:
    """FND-13: errors first; ties in detector then emit order."""
    return df.orderBy("sev_rank", "detector_ord", "emit_ord", "file_path", "id")


def by_severity(df: DataFrame, severity: str) -> DataFrame:
    return df.filter(F.col("severity") == severity.upper())


def by_source(df: DataFrame, source: str) -> DataFrame:
    return df.filter(F.col("source") == source)


def severity_counts(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """FND-14: error / warning / info / auto-fixable / total counts, one pass."""
    aggs = [
        F.count_if(F.col("severity") == "ERROR").alias("errors"),
        F.count_if(F.col("severity") == "WARNING").alias("warnings"),
        F.count_if(F.col("severity") == "INFO").alias("infos"),
        F.count_if(is_fixable()).alias("auto_fixable"),
        F.count(F.lit(1)).alias("total"),
    ]
    return df.groupBy(*(by or [])).agg(*aggs)


def tools_used(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """FND-17: sorted list of distinct sources, comma-joined."""
    return df.groupBy(*(by or [])).agg(
        F.array_join(F.array_sort(F.collect_set("source")), ", ").alias("tools"))


def cap_findings(df: DataFrame, n: int) -> DataFrame:
    """FND-18: the first ``n`` findings in sorted order (TakeOrderedAndProject)."""
    return df.orderBy("sev_rank", "detector_ord", "emit_ord", "file_path", "id").limit(n)


def top_listing(df: DataFrame, n: int) -> DataFrame:
    """FND-19: numbered ``i. <display line>[ [AUTO-FIXABLE]]`` for the first ``n``."""
    top = cap_findings(df, n)
    w = Window.orderBy("sev_rank", "detector_ord", "emit_ord", "file_path", "id")  # over <= n rows
    return top.select(
        F.row_number().over(w).alias("pos"),
        F.concat(F.row_number().over(w).cast("string"), F.lit(". "), display_line(),
                 F.when(is_fixable(), F.lit(" [AUTO-FIXABLE]")).otherwise(F.lit(""))).alias("listing"))


#: Descriptions of one automaton.
TOGETHER = 5000


def match_finding(findings: DataFrame, requests: DataFrame) -> DataFrame:
    """FND-20: per request ``(req_id, file_path, description)`` the first finding in
    that file whose message contains the description, case-insensitively.

    The distinct descriptions of a file make automata (of ``TOGETHER`` each); a message
    runs through one once, whatever the number of descriptions. Every task keeps the
    first finding per description, and Spark the first of these: messages of a file that
    holds most of the findings are split over tasks (a skewed join), and no pairs leave
    a task. Null descriptions match nothing, empty ones every message."""
    low = lambda c: F.lower(F.col(c))
    asked = requests.select("file_path", low("description").alias("d")).filter("file_path IS NOT NULL AND d IS NOT NULL").distinct()
    sizes = asked.groupBy("file_path").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).alias("packs"))
    packs = asked.join(sizes, "file_path").withColumn("pack", F.pmod(F.xxhash64("d"), "packs")).groupBy("file_path", "pack").agg(
        F.collect_list("d").alias("ds"))
    said = findings.select("file_path", "id", "message", "detector_ord", "emit_ord").filter("message IS NOT NULL")
    pairs = said.join(packs, "file_path").select("file_path", "pack", "ds", low("message").alias("m"), "detector_ord", "emit_ord", "id", "message")
    schema = "file_path string, d string, detector_ord int, emit_ord long, id string, message string"
    first = pairs.mapInArrow(_first_matches, schema).groupBy("file_path", "d").agg(
        F.min(F.struct(*(F.coalesce(F.col(c), F.lit(-1)).alias(f"_{c}") for c in ("detector_ord", "emit_ord")),
                       "detector_ord", "emit_ord", "id", "message")).alias("f"))
    return requests.join(first.withColumnRenamed("d", "_d"), (requests["file_path"] == first["file_path"]) & (low("description") == F.col("_d"))).select(
        *(requests[c] for c in requests.columns), "f.id", "f.message", "f.detector_ord", "f.emit_ord")


def _first_matches(batches):
    """The first finding of each (file, description) in this task."""
    import ahocorasick
    import pyarrow as pa
    automata: dict = {}
    best: dict = {}
    for b in batches:
        file, pack, _, m, detector, emit, ids, message = (b.column(c).to_pylist() if c != 2 else None for c in range(8))
        for r in range(b.num_rows):
            key = (file[r], pack[r])
            if key not in automata:
                if len(automata) > 64:
                    automata.clear()
                a = ahocorasick.Automaton()
                for d in b.column(2)[r].as_py():
                    a.add_word(d, d) if d else None
                a.make_automaton()
                automata[key] = a, any(not d for d in b.column(2)[r].as_py())
            a, every = automata[key]
            found = {d for _, d in a.iter(m[r])} if len(a) else set()
            row = (-1 if detector[r] is None else detector[r], -1 if emit[r] is None else emit[r], ids[r] or "", detector[r], emit[r], ids[r], message[r])
            for d in found | {""} if every else found:
                old = best.get((file[r], d))
                if old is None or row[:3] < old[:3]:
                    best[file[r], d] = row
    rows = [(f, d, *row[3:]) for (f, d), row in best.items()]
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string())
    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)],
                                     ["file_path", "d", "detector_ord", "emit_ord", "id", "message"])


#: Lines of a file that one task sweeps.
SWEEP_LINES = 1 << 16


def attach_entity(findings: DataFrame, entities: DataFrame, lines: int = SWEEP_LINES) -> DataFrame:
    """FND-22: innermost entity whose line range holds the finding (smallest span, then
    latest start, then id); null where there is none.

    One sweep: findings and entities of a stretch of ``lines`` lines of a file are
    sorted together by line, and a heap holds the ranges that are open. An entity moves
    once for each stretch that it reaches into, as a rule once; a long file is split, and a
    task holds only its open ranges. Every row of ``findings`` gives one row."""
    w = F.lit(lines)
    own = [c for c in findings.columns if c not in ("file_path", "line_number")]
    f = findings.select(F.col("file_path").alias("_path"), F.floor(F.col("line_number") / w).cast("long").alias("_part"),
                        F.col("line_number").alias("_line"), F.lit(1).alias("_kind"), F.struct(*own).alias("_f"))
    start, end = F.col("start_line"), F.col("end_line")
    e = entities.filter("file_path IS NOT NULL AND start_line <= end_line").select(
        F.col("file_path").alias("_path"), F.explode(F.sequence(F.floor(start / w).cast("long"), F.floor(end / w).cast("long"))).alias("_part"),
        start.alias("e_start"), end.alias("e_end"), F.col("id").alias("entity_id"), F.col("name").alias("entity_name"))
    e = e.withColumns({"_line": F.greatest(F.col("e_start"), F.col("_part") * w).cast("int"), "_kind": F.lit(0)})
    rows = f.unionByName(e, allowMissingColumns=True)
    sorted_rows = rows.repartition("_path", "_part").sortWithinPartitions("_path", "_part", "_line", "_kind")
    order = ["_path", "_part", "_line", "_kind", "_f", "e_start", "e_end", "entity_id", "entity_name"]
    schema = T.StructType([sorted_rows.schema[c] for c in ("_path", "_line", "_f", "e_start", "e_end", "entity_id", "entity_name")])
    swept = sorted_rows.select(*order).mapInArrow(_sweep, schema)
    return swept.select(*(F.col("_path").alias(c) if c == "file_path" else F.col("_line").alias(c) if c == "line_number" else F.col(f"_f.{c}")
                          for c in findings.columns), "entity_id", "entity_name", "e_start", "e_end")


def _sweep(batches):
    import heapq

    import pyarrow as pa
    at, heap = None, []
    for b in batches:
        path, part, line, kind = (b.column(c).to_pylist() for c in range(4))
        start, end, ids, names = (b.column(c).to_pylist() for c in range(5, 9))
        rows, found = [], []
        for r in range(b.num_rows):
            if (path[r], part[r]) != at:
                at, heap = (path[r], part[r]), []
            if kind[r] == 0:
                heapq.heappush(heap, (end[r] - start[r], -start[r], ids[r] or "", start[r], end[r], ids[r], names[r]))
                continue
            while heap and heap[0][4] < line[r]:
                heapq.heappop(heap)  # lines ascend: it stays closed
            rows.append(r)
            found.append(heap[0][3:] if heap and path[r] is not None else (None,) * 4)
        if rows:
            take = pa.array(rows)
            columns = [b.column(c).take(take) for c in (0, 2, 4)] + [pa.array([x[c] for x in found], b.schema.field(5 + c).type) for c in range(4)]
            yield pa.RecordBatch.from_arrays(columns, ["_path", "_line", "_f", "e_start", "e_end", "entity_id", "entity_name"])


def fix_counters(outcomes: DataFrame) -> DataFrame:
    """FND-23: total / fixed / failed / skipped over a work list with ``outcome``."""
    return outcomes.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("outcome") == "fixed").alias("fixed"),
        F.count_if(F.col("outcome") == "failed").alias("failed"),
        F.count_if(F.col("outcome") == "skipped").alias("skipped"))


def run_summary(findings: DataFrame, files: DataFrame) -> DataFrame:
    """FND-16: one row: files analysed, tools, totals per severity.

    Files and findings are tagged and unioned so one aggregate pass (partial
    on every task) produces the row; no join.
    """
    f = files.select(F.lit(True).alias("_file"), F.lit(None).cast("string").alias("source"),
                     F.lit(None).cast("string").alias("severity"), F.lit(False).alias("_fx"))
    s = findings.select(F.lit(False).alias("_file"), "source", "severity", is_fixable().alias("_fx"))
    u = f.unionByName(s)
    return u.agg(
        F.count_if(F.col("_file")).alias("files_analyzed"),
        F.array_join(F.array_sort(F.collect_set("source")), ", ").alias("tools"),
        F.count_if(~F.col("_file")).alias("total"),
        F.count_if(F.col("severity") == "ERROR").alias("errors"),
        F.count_if(F.col("severity") == "WARNING").alias("warnings"),
        F.count_if(F.col("severity") == "INFO").alias("infos"),
        F.count_if(F.col("_fx")).alias("auto_fixable"))


class DetectorRegistry:
    """UDF-01: detectors are plain ``files -> findings`` DataFrame functions.
    Registration order is detector order (first wins in dedup); a detector that
    cannot be built is left out of the plan and reported, never failing the run."""

    def __init__(self):
        self._detectors: list[tuple[str, object]] = []

    def register(self, name: str, fn) -> "DetectorRegistry":
        self._detectors.append((name, fn))
        return self

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self._detectors]

    def run(self, files: DataFrame, stored: bool = False) -> tuple[DataFrame, list[str]]:
        """Findings of all detectors, and a line for each that failed. A plan may also fail
        when it runs: with ``stored`` each detector's findings are written to the shared
        checkpoint folder first, so such a detector is left out too."""
        outs, errors = [], []
        for name, fn in self._detectors:
            try:
                found = fn(files)
                if stored:
                    from ..session import checkpoint_dir
                    checkpoint_dir(files.sparkSession)
                    found = to_findings(found).checkpoint()
                outs.append(found)
            except Exception as e:  # noqa: BLE001 - reported, never failing the run
                errors.append(f"{name}: {type(e).__name__}: {str(e)[:500]}")
        if not outs:
            return files.sparkSession.createDataFrame([], FINDING_SCHEMA), errors
        return union_findings(*outs), errors
