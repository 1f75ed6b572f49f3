"""Entities with exact line ranges and their derived texts (ENT-08…25).

Native Catalyst expressions only. The Python-parser part (ENT-01…07, 11)
lives in :mod:`quarry.operators.extract` and produces rows of the same shape.

Entity columns: ``id, entity_type, name, content, file_path, start_line,
end_line, parent, docstring, signature, imports ARRAY<STRING>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import line_count, path_name, path_suffix, preview

CALLABLE_TYPES = ("FUNCTION", "METHOD", "NESTED_FUNCTION", "CLASS")
ENTITY_TYPES = ("FUNCTION", "CLASS", "METHOD", "NESTED_FUNCTION", "MODULE", "STANDALONE")

# Python's str.strip() whitespace, spelled for Java and RE2 alike.
PY_SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
WORD = r"[\p{L}\p{N}_]"


def py_strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{PY_SPACE}+|{PY_SPACE}+$", "")


def explode_lines(df: DataFrame, text: str = "content", keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """ENT-14: one row per line with its 1-based number (``line_no``, ``line``)."""
    return df.select(*keep, F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "line")) \
        .select(*keep, (F.col("pos") + 1).cast("int").alias("line_no"), "line")


def file_chunks(files: DataFrame) -> DataFrame:
    """ENT-12: one whole-file chunk per file: start 1, end = newlines + 1."""
    return files.select(
        F.col("content"), F.col("path").alias("file_path"), F.lit(1).alias("start_line"),
        path_name("path").alias("filename"), path_suffix("path").alias("extension"),
        line_count("content").alias("end_line"), F.lit(True).alias("is_file_level"))


def chunks_to_entities(chunks: DataFrame) -> DataFrame:
    """ENT-13: chunk row -> STANDALONE entity; name defaults to ``unknown``,
    end line to the start line."""
    return chunks.select(
        F.lit("STANDALONE").alias("entity_type"),
        F.coalesce(F.col("filename"), F.lit("unknown")).alias("name"),
        "content", "file_path", "start_line",
        F.coalesce(F.col("end_line"), F.col("start_line")).alias("end_line"),
        F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("docstring"),
        F.lit(None).cast("string").alias("signature"), F.array().cast("array<string>").alias("imports"))


def merge_ranges(starts, ends, gap: int = 1) -> Column:
    """ENT-08 inside a row: the ranges ``starts[i]..ends[i]`` (arrays, in any order)
    as islands, ``ARRAY<STRUCT<start_line, end_line>>``: a range joins the block before
    it when it starts at most ``gap`` after the furthest end so far.

    With starts and ends sorted apart, a block ends behind place ``i`` exactly when
    ``ends[i] + gap < starts[i + 1]``: only the first ``i + 1`` ranges can end that early.
    Sorting aside it is linear, and no rows move: a file's ranges are in its own row."""
    s, e = F.array_sort(starts), F.array_sort(ends)
    breaks = F.zip_with(F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), F.slice(e, 1, F.greatest(F.size(e) - 1, F.lit(0))),
                        lambda x, y: F.when(y + gap < x, F.struct(x.alias("x"), y.alias("y"))))
    cut = F.filter(breaks, lambda b: b.isNotNull())
    firsts = F.concat(F.slice(s, 1, 1), F.transform(cut, lambda b: b["x"]))
    lasts = F.concat(F.transform(cut, lambda b: b["y"]), F.slice(e, -1, 1))
    some = F.zip_with(firsts, lasts, lambda x, y: F.struct(x.alias("start_line"), y.alias("end_line")))
    return F.when(F.size(s) > 0, some).otherwise(F.slice(some, 1, 0))


def paragraph_blocks(df: DataFrame, text: str = "content", keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """Islands of the lines that aren't blank: ``keep, block, start_line, end_line``
    (blocks from 1), from each file's own row."""
    lines = F.transform(F.split(F.col(text), "\n", -1), lambda x, i: F.when(py_strip(x) != "", (i + 1).cast("int")))
    df = df.select(*keep, F.array_compact(lines).alias("_at"))
    return df.select(*keep, F.posexplode(merge_ranges(F.col("_at"), F.col("_at"))).alias("_n", "_b")).select(
        *keep, (F.col("_n") + 1).alias("block"), F.col("_b.start_line"), F.col("_b.end_line"))


def merge_intervals(df: DataFrame, key: str, start: str = "start_line", end: str = "end_line", gap: int = 1) -> DataFrame:
    """ENT-08 over a table of ranges: ``key, block, start_line, end_line`` (ranges
    inclusive, blocks from 1), by a running maximum of the ends before. The ranges of
    one file are sorted together, with spilling; where they come from a file's text,
    :func:`merge_ranges` needs no sort over rows at all."""
    w = Window.partitionBy(key).orderBy("_s", "_e")
    prev_max = F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = df.select(key, F.col(start).alias("_s"), F.col(end).alias("_e")).withColumn(
        "_new", F.when(prev_max.isNull() | (F.col("_s") > prev_max + gap), 1).otherwise(0))
    blocks = flagged.withColumn("block", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return blocks.groupBy(key, "block").agg(F.min("_s").alias("start_line"), F.max("_e").alias("end_line"))


def name_block(content) -> Column:
    """ENT-09: name a block from its text: ``imports`` if any line is an import;
    else ``assignments_<first 3 names>``; else ``code_<first word>``; else
    ``standalone_block``."""
    c = F.col(content) if isinstance(content, str) else content
    ls = F.transform(F.split(py_strip(c), "\n", -1), py_strip)
    is_assign = lambda x: F.contains(x, F.lit("=")) & ~F.startswith(x, F.lit("#"))
    has_import = F.exists(ls, lambda x: x.rlike(r"^(import|from)\s+(.+)$"))
    names = F.filter(F.transform(ls, lambda x: F.when(is_assign(x), F.regexp_extract(x, f"^({WORD}+)\\s*=", 1))),
                     lambda x: x.isNotNull() & (x != ""))
    others = F.filter(ls, lambda x: (x != "") & ~is_assign(x))
    first_word = F.regexp_extract(F.get(others, 0), f"^({WORD}+)", 1)
    return (F.when(has_import, F.lit("imports"))
            .when(F.size(names) > 0, F.concat(F.lit("assignments_"), F.array_join(F.slice(names, 1, 3), "_")))
            .when((F.size(others) > 0) & (first_word != ""), F.concat(F.lit("code_"), first_word))
            .otherwise(F.lit("standalone_block")))


def validate_ranges(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ENT-15: split into valid rows and ``bad_rows`` (start >= 1, end >= start)."""
    reason = (F.when(F.col("start_line") < 1, F.concat(F.lit("start_line must be >= 1, got "),
                                                       F.col("start_line").cast("string")))
              .when(F.col("end_line") < F.col("start_line"),
                    F.concat(F.lit("end_line ("), F.col("end_line").cast("string"),
                             F.lit(") must be >= start_line ("), F.col("start_line").cast("string"), F.lit(")"))))
    tagged = df.withColumn("_reason", reason)
    good = tagged.filter(F.col("_reason").isNull()).drop("_reason")
    bad = tagged.filter(F.col("_reason").isNotNull()).select(
        F.lit("entities").alias("stage"), entity_id().alias("key"), F.col("_reason").alias("reason"),
        F.to_json(F.struct(*[F.col(c) for c in df.columns if c in ("file_path", "name", "start_line", "end_line")])).alias("payload"))
    return good, bad


def qualified_name() -> Column:
    return F.when(F.coalesce(F.col("parent"), F.lit("")) != "",
                  F.concat(F.col("parent"), F.lit("."), F.col("name"))).otherwise(F.col("name"))


def location() -> Column:
    return F.concat(F.col("file_path"), F.lit(":"), F.col("start_line").cast("string"), F.lit("-"),
                    F.col("end_line").cast("string"))


def add_derived(df: DataFrame) -> DataFrame:
    """ENT-16: qualified name, location text, line count, is-callable."""
    return df.withColumns({
        "qualified_name": qualified_name(),
        "location": location(),
        "line_count": (F.col("end_line") - F.col("start_line") + 1).cast("int"),
        "is_callable": F.col("entity_type").isin(*CALLABLE_TYPES),
    })


def context_header() -> Column:
    """ENT-17: ``# TYPE: name`` / ``# Signature:`` / ``# Location:`` / ``# Docstring:`` lines."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("# "), F.col("entity_type"), F.lit(": "), qualified_name()),
        F.when(F.coalesce(F.col("signature"), F.lit("")) != "", F.concat(F.lit("# Signature: "), F.col("signature"))),
        F.concat(F.lit("# Location: "), location()),
        F.when(F.coalesce(F.col("docstring"), F.lit("")) != "",
               F.concat(F.lit("# Docstring: "), preview("docstring", 100))))


def render_document() -> Column:
    """ENT-18: index document = header, blank line, fenced code."""
    return F.concat(context_header(), F.lit("\n\n```python\n"), F.col("content"), F.lit("\n```"))


def to_metadata() -> Column:
    """ENT-19: metadata JSON; optional keys only when non-empty (docstring <= 1000
    chars, imports <= 10). ``to_json`` drops the null ones."""
    return F.to_json(F.struct(
        F.col("entity_type"), F.col("name"), qualified_name().alias("qualified_name"),
        F.col("file_path"), F.col("start_line"), F.col("end_line"),
        (F.col("end_line") - F.col("start_line") + 1).alias("line_count"),
        F.coalesce(F.nullif(F.col("parent"), F.lit("")), F.lit("")).alias("parent"),
        F.col("entity_type").isin(*CALLABLE_TYPES).alias("is_callable"),
        F.nullif(F.col("signature"), F.lit("")).alias("signature"),
        F.substring(F.nullif(F.col("docstring"), F.lit("")), 1, 1000).alias("docstring"),
        F.when(F.size("imports") > 0, F.slice("imports", 1, 10)).alias("imports")))


def document_code(doc) -> Column:
    """ENT-20: code out of an index document: after the first python fence up to
    the next fence, whitespace-stripped; the whole document when there is none."""
    d = F.col(doc) if isinstance(doc, str) else doc
    after = F.element_at(F.split(d, "```python", 2), 2)
    code = F.element_at(F.split(after, "```", 2), 1)
    return F.when(F.contains(d, F.lit("```python")), py_strip(code)).otherwise(d)


def entity_id() -> Column:
    """ENT-21: record id ``path:start:end:name``."""
    return F.concat_ws(":", F.col("file_path"), F.col("start_line").cast("string"),
                       F.col("end_line").cast("string"), F.col("name"))


def dedup_entities(df: DataFrame) -> DataFrame:
    """ENT-22: one entity per (path, start, end, name); deterministic winner."""
    w = Window.partitionBy("file_path", "start_line", "end_line", "name").orderBy("entity_type", "content")
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def type_breakdown(df: DataFrame) -> DataFrame:
    """ENT-23: entity count by type."""
    return df.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))


def ingest_summary(df: DataFrame) -> DataFrame:
    """ENT-24: one row (also for empty input): distinct files, entities, per-type counts."""
    return df.agg(
        F.count_distinct("file_path").alias("files_processed"),
        F.count(F.lit(1)).alias("entities_extracted"),
        *[F.count_if(F.col("entity_type") == t).alias(t.lower()) for t in ENTITY_TYPES])


def order_entities(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """ENT-25: entities of a file together, ordered by (start, end) inside it."""
    d = df.repartition(partitions, "file_path") if partitions else df.repartition("file_path")
    return d.sortWithinPartitions("file_path", "start_line", "end_line")
