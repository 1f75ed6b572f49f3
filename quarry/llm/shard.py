"""Uniform shuffle into shards of exact sizes.

For a uniform random permutation of all rows cut into shards, the number of rows
that input partition ``p`` gives to shard ``s`` is a multivariate hypergeometric
draw. Drawing that matrix first fixes every count, so the rest is local:

1. count the rows of each partition, fix the shard sizes (at most one apart) and
   draw the partition-to-shard matrix row by row;
2. each partition permutes the labels of its row of the matrix over its rows,
   and gives each row a random key;
3. exchange by shard and by the key's leading part (a block), and order each
   block by the key: a second uniform permutation. A row's slot is the number of
   rows in the shard's earlier blocks plus its place in its own.

All draws are seeded by ``(seed, partition)``, so a lost task gives the same rows
again. Both reads must see the same partitions, which holds for a scan of files;
a task that meets another number of rows than was counted raises. For other
inputs give ``staged=True``: the rows are checkpointed first.

Defined results: columns of the input named ``shard`` or ``slot`` are replaced;
nulls in any column are kept; repeated rows are separate rows
with a slot each; an empty table gives an empty result; with fewer rows than
shards some shards stay empty.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, stored

#: Rows of one block of a shard, and the most blocks of one shard.
BLOCK_ROWS, MOST_BLOCKS = 2048, 1 << 16
KEY_BITS = 62


def communication_matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows given by each partition to each shard; shard sizes are at most one apart."""
    total = sum(counts)
    left = np.array([total // shards + (s < total % shards) for s in range(shards)], dtype=np.int64)
    out = np.zeros((len(counts), shards), dtype=np.int64)
    for p, n in enumerate(counts):
        rng, need, pool = np.random.default_rng([seed, 0, p]), n, int(left.sum())
        for s in range(shards):
            pool -= int(left[s])
            if need and left[s]:
                out[p, s] = need if not pool else _hypergeometric(rng, int(left[s]), pool, need)
                need -= int(out[p, s])
        left -= out[p]
    return out


def _hypergeometric(rng, good: int, bad: int, sample: int) -> int:
    """numpy draws up to a billion rows; beyond, by inversion around the mean (the
    mass beyond 12 standard deviations is below what doubles can hold)."""
    n = good + bad
    if n < 10**9:
        return int(rng.hypergeometric(good, bad, sample))
    mean = sample * good / n
    wide = 12 * math.sqrt(mean * (bad / n) * ((n - sample) / (n - 1))) + 12
    low, high = max(0, sample - bad, int(mean - wide)), min(good, sample, int(mean + wide))
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log(good - k) + np.log(sample - k) - np.log(k + 1) - np.log(bad - sample + k + 1)
    log_mass = np.concatenate([[0.0], np.cumsum(steps)])
    mass = np.cumsum(np.exp(log_mass - log_mass.max()))
    return low + int(np.searchsorted(mass, rng.random() * mass[-1]))


def _draws(matrix: np.ndarray, p: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard and random key of every row of partition ``p``, in its order."""
    drawn = matrix[p] if p < len(matrix) else np.zeros(matrix.shape[1], np.int64)
    rng = np.random.default_rng([seed, 1, p])
    labels = rng.permutation(np.repeat(np.arange(matrix.shape[1], dtype=np.int32), drawn))
    return labels, rng.integers(0, 1 << KEY_BITS, len(labels), dtype=np.int64)


def _block(key, blocks: int):
    """Which of a shard's ``blocks`` a key is in: its leading 30 bits, scaled."""
    return ((key >> (KEY_BITS - 30)) * blocks) >> 30


def shard_rows(rows: DataFrame, shards: int = 8, seed: int = 7, staged: bool = False,
               block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in a shard)."""
    rows = rows.drop("shard", "slot")
    key, block, place, before = (free_name(rows, n) for n in ("key", "block", "place", "before"))
    if staged:
        rows = stored(rows)
    spark = rows.sparkSession
    counted = {r["p"]: r["n"] for r in rows.select(F.spark_partition_id().alias("p")).groupBy("p").agg(
        F.count("*").alias("n")).collect()}
    counts = [counted.get(p, 0) for p in range(max(counted, default=-1) + 1)]
    total = sum(counts)
    matrix = spark.sparkContext.broadcast(communication_matrix(counts, shards, seed))
    blocks = min(max(1, math.ceil(total / shards / block_rows)), MOST_BLOCKS)
    schema = T.StructType([*rows.schema.fields, T.StructField("shard", T.IntegerType()),
                           T.StructField(key, T.LongType()), T.StructField(block, T.IntegerType())])

    def label(batches):
        labels, keys = _draws(matrix.value, TaskContext.get().partitionId(), seed)
        at = 0
        for b in batches:
            to = at + b.num_rows
            if to > len(labels):
                raise RuntimeError("the input changed between two reads; use staged=True")
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(labels[at:to]), pa.array(keys[at:to]),
                 pa.array(_block(keys[at:to], blocks).astype(np.int32))],
                [*b.schema.names, "shard", key, block])
            at = to
        if at < len(labels):
            raise RuntimeError("the input changed between two reads; use staged=True")

    def sizes(batches):
        # The draws depend on the counts alone: no row is read for the block sizes.
        for b in batches:
            for p in b.column(0).to_pylist():
                labels, keys = _draws(matrix.value, p, seed)
                cell, n = np.unique(labels.astype(np.int64) * blocks + _block(keys, blocks), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((cell // blocks).astype(np.int32)), pa.array((cell % blocks).astype(np.int32)),
                     pa.array(n)], ["shard", block, "n"])

    earlier = Window.partitionBy("shard").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = spark.range(0, len(counts), 1, max(1, min(len(counts), 64))).mapInArrow(
        sizes, f"shard int, `{block}` int, n long").groupBy("shard", block).agg(F.sum("n").alias("n")).select(
        "shard", block, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before))
    placed = rows.mapInArrow(label, schema).withColumn(
        place, F.row_number().over(Window.partitionBy("shard", block).orderBy(key)) - 1)
    # At most shards x MOST_BLOCKS small rows, whatever the input.
    return placed.join(F.broadcast(offsets), ["shard", block]).withColumn(
        "slot", F.col(before) + F.col(place)).select(*rows.columns, "shard", "slot")


def op2_shard(spark, sf_dir):
    from .common import load
    docs = load(spark, sf_dir, "documents")
    return shard_rows(docs).select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 1).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
