"""Source trees as tables (SRC-01…04) and result sinks (SRC-12…14)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import path_name, path_suffix

# --- fixed values: default source extensions
DEFAULT_EXTS = (".py", ".pyw")


def scan_files(spark: SparkSession, path: str, exts=DEFAULT_EXTS) -> DataFrame:
    """SRC-01: files under ``path`` (recursively; a single file also works) with
    one of ``exts``: ``files(path, file_name, ext, bytes)``. A missing path is
    an error (raised by the reader at plan time)."""
    return _file_columns(_reader(spark.read, exts).load(path))


def stream_files(spark: SparkSession, path: str, exts=DEFAULT_EXTS) -> DataFrame:
    """SRC-01 as a stream: the same columns, and so the same ids, as :func:`scan_files`."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return _file_columns(_reader(spark.readStream, exts).schema(schema).load(path))


def _reader(reader, exts):
    glob = "*.{" + ",".join(e.lstrip(".") for e in exts) + "}" if len(exts) > 1 else "*" + exts[0]
    return reader.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)


def _file_columns(raw: DataFrame) -> DataFrame:
    p = F.regexp_replace(F.col("path"), r"^file:", "")
    return raw.select(p.alias("path"), path_name(p).alias("file_name"), path_suffix(p).alias("ext"),
                      F.col("content").alias("bytes"))


def keep_utf8(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-02: decode as UTF-8; undecodable files go to ``bad_rows``. Line ends
    are normalised to ``\\n`` as text-mode reading does."""
    text = F.try_validate_utf8(F.col("bytes").cast("string")) if hasattr(F, "try_validate_utf8") else \
        F.when(F.is_valid_utf8(F.col("bytes").cast("string")), F.col("bytes").cast("string"))
    t = df.withColumn("content", F.regexp_replace(text, "\r\n?", "\n"))
    good = t.filter(F.col("content").isNotNull()).drop("bytes")
    bad = t.filter(F.col("content").isNull()).select(
        F.lit("files").alias("stage"), F.col("path").alias("key"),
        F.lit("not valid UTF-8").alias("reason"), F.lit(None).cast("string").alias("payload"))
    return good, bad


def drop_tests(df: DataFrame, name_col: str = "file_name", marker: str = "test") -> DataFrame:
    """SRC-03: drop files whose *name* (not path) contains ``test``, any case."""
    return df.filter(~F.contains(F.lower(F.col(name_col)), F.lit(marker.lower())))


def count_files(df: DataFrame, include_tests: bool = True, name_col: str = "file_name", marker: str = "test") -> DataFrame:
    """SRC-04: number of source files, tests optionally left out."""
    d = df if include_tests else drop_tests(df, name_col, marker)
    return d.agg(F.count(F.lit(1)).alias("files"))


def write_index(entities: DataFrame, path: str, mode: str = "append") -> None:
    """SRC-12: persist index records as Parquet partitioned by entity type."""
    entities.write.mode(mode).partitionBy("entity_type").parquet(path)


def write_results_json(results: DataFrame, path: str, stamp: str) -> None:
    """SRC-13: result rows as JSON lines with the run stamp."""
    results.withColumn("timestamp", F.lit(stamp)).write.mode("append").json(path)


def write_results_md(reports: DataFrame, path: str, col: str = "report") -> None:
    """SRC-14: Markdown reports, one text record per result."""
    reports.select(F.col(col).alias("value")).write.mode("append").text(path)
