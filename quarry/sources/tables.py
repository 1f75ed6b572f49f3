"""Driver tables and the stand-in views the operators run on.

The driver's tables are prose and logs, not source trees, so each operator
family reads a view that maps them onto its inputs (SURVEY §7.3):

* ``documents`` -> files: ``path = source || '/doc_' || doc_id || '.' || lang``
* ``events``    -> findings / calls / attempts
* ``embeddings``-> index records (``label`` = entity type)
* ``pages.url`` -> file paths for name and glob filters

Every view is a projection of the scan, so Catalyst prunes columns and pushes
filters into the Parquet reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def doc_path(df: DataFrame | None = None) -> Column:
    """File path a document stands for."""
    return F.concat(F.col("source"), F.lit("/doc_"), F.col("doc_id").cast("string"),
                    F.lit("."), F.col("lang"))


def files_from_documents(docs: DataFrame) -> DataFrame:
    """``files(path, file_name, ext, content, doc_id)`` view of ``documents``."""
    path = doc_path()
    return docs.select(
        F.col("doc_id"),
        path.alias("path"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang")).alias("file_name"),
        F.concat(F.lit("."), F.col("lang")).alias("ext"),
        F.col("text").alias("content"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files, spread over the task slots (text work is CPU-bound)."""
    return spread(files_from_documents(load(spark, sf_dir, "documents")))


#: Tasks a slot that CPU-heavy work is dealt out over.
TASKS_A_SLOT = 4


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out evenly over the cluster, unless its files alone do that.

    CPU-heavy per-row work (regex scans, parsing) must not run in a few tasks because a
    table is few files. The number of splits doesn't tell: a row group is read by one task,
    so a large file of one row group has many splits and all rows in one of them. Only
    the number of files is a sure bound. Rows go by a hash of their plain columns: no
    sort before the shuffle, and the same place when a task is run again. Done twice in a
    row, Spark does it once. A stream has no files to count and stays as it is.
    """
    tasks = TASKS_A_SLOT * df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or len(df.inputFiles()) >= tasks:
        return df
    plain = [f.name for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]
    return df.repartition(tasks, *plain)
