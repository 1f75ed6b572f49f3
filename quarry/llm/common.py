"""What the operators of this subpackage share: projections, checkpoints, ids."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from ..sources.tables import load  # noqa: F401  (re-exported for the queries)

#: Stands for a null id wherever ids are compared: larger than all others.
NULL_ID = (1 << 63) - 1


def order_id(col: str) -> Column:
    """The id as BIGINT, null last."""
    return F.coalesce(F.col(col).cast("bigint"), F.lit(NULL_ID))


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the cluster's shared checkpoint folder:
    later reads survive lost executors and don't compute it again."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def text_bytes(df: DataFrame, text_col: str = "text") -> int:
    return df.agg(F.sum(F.octet_length(F.col(text_col))).alias("b")).first()["b"] or 0


def parts(spark: SparkSession, nbytes: float, each: int = 64 << 20) -> int:
    """Shuffle partitions for ``nbytes``: never fewer than the session's setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(nbytes / each))


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name
