"""Structured Streaming forms (TRC-05, TRC-06).

``stream_rates``: event counts per tumbling window with a watermark; late
rows (behind the watermark) are dropped, closed windows are emitted in append
mode. ``stream_ingest``: new source files are parsed and added to the index once
per id, by keyed state. ``stream_transitions``: state changes of goals from the
replies as they arrive, by keyed state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor


def stream_rates(events: DataFrame, ts: str = "ts", by: str = "event_type", width: str = "1 hour",
                 watermark: str = "1 hour") -> DataFrame:
    """TRC-05: ``window_start, <by>, n`` per tumbling window (streaming or batch)."""
    e = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", watermark)
    return e.groupBy(F.window("_ts", width).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), by, "n")


def run_rates_to_table(spark: SparkSession, source_dir: str, schema, table_path: str, checkpoint: str,
                       width: str = "1 hour", watermark: str = "1 hour", glob: str | None = None):
    """Parquet files in ``source_dir`` -> closed windows appended to ``table_path``.
    ``availableNow`` processes what is there and stops; the checkpoint makes
    the job restartable after a lost driver or executor."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    src = reader.parquet(source_dir)
    q = (stream_rates(src, width=width, watermark=watermark).writeStream.outputMode("append")
         .format("parquet").option("path", table_path).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def _rocksdb(spark: SparkSession) -> None:
    """State in RocksDB: on disk, so it may exceed a worker's memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream_ingest(spark: SparkSession, source_dir: str, index_path: str, checkpoint: str,
                  exts=(".py",)):
    """TRC-06: new files under ``source_dir`` -> entities -> index (by id, first wins).

    Ids already seen are kept in a keyed state store, so a micro-batch looks up its own
    ids only and never reads the stored index. The file sink commits each batch once: a
    batch that is run again after a failure adds nothing twice. The stream owns
    ``index_path``; records that come from elsewhere are added by RET-06."""
    from ..operators.entities import entity_id
    from ..operators.extract import extract_entities
    from ..sources.files import keep_utf8, stream_files

    _rocksdb(spark)
    src = keep_utf8(stream_files(spark, source_dir, exts))[0].select("path", "content")
    fresh = extract_entities(src).withColumn("id", entity_id()).dropDuplicates(["id"])
    q = (fresh.writeStream.format("parquet").option("path", index_path).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def _goal_processor() -> StatefulProcessor:
    """The processor of :func:`stream_transitions`. Its class is made here, so that it travels by
    value: the driver's own Python worker, which Spark starts to read the state's schema,
    doesn't see the package that :func:`quarry.session.ship` sends to the executors."""
    goal = T.StructType([T.StructField("status", T.StringType()), T.StructField("retry", T.IntegerType())])

    class Goal(StatefulProcessor):
        """State of one goal: its status and retries. Rows that don't fit the status say nothing."""

        def init(self, handle) -> None:
            self._state = handle.getValueState("goal", goal)

        def handleInputRows(self, key, rows, timerValues):
            import pandas as pd
            status, retry = self._state.get() if self._state.exists() else ("planning", 0)
            out = []

            def move(row, to, note):
                nonlocal status
                out.append((key[0], int(row.seq), status, to, note, retry))
                status = to

            expects = {"plan": "planning", "retrieve": "retrieving", "code": "coding", "review": "reviewing"}
            for row in pd.concat(list(rows)).sort_values("seq").itertuples():
                if expects[row.stage] != status:
                    continue
                if row.stage == "plan":
                    move(row, "retrieving", row.note)
                elif row.stage == "retrieve":
                    move(row, "coding", row.note)
                elif row.stage == "code":
                    move(row, "reviewing", row.note)
                    if not isinstance(row.proposed_fix, str) or not row.proposed_fix:
                        move(row, "rejected", "No fix was generated")
                elif row.is_approved == True:  # noqa: E712  (may be a missing value)
                    move(row, "approved", "Fix passed review")
                elif retry < row.max_retries:
                    move(row, "coding", f"Rejected, preparing retry #{retry + 1}")
                    retry += 1
                else:
                    move(row, "rejected", f"Max retries ({row.max_retries}) exceeded")
            self._state.update((status, retry))
            yield pd.DataFrame(out, columns=["goal_id", "seq", "from_status", "to_status", "note", "retry_count"]).astype(
                {"goal_id": "int64", "seq": "int64", "retry_count": "int32"})

        def close(self) -> None:
            pass

    return Goal()


def stream_transitions(steps: DataFrame) -> DataFrame:
    """FIX-16 / UDF-04 over a stream of steps (:func:`quarry.operators.workflow.steps_from_log`):
    a row per state change as replies arrive, from keyed state. Its batch twin is
    :func:`quarry.operators.workflow.transitions_from_log`."""
    from ..operators.workflow import TRANSITIONS
    slim = steps.select("goal_id", "seq", "stage", "max_retries", "note", "proposed_fix", "is_approved")
    return slim.groupBy("goal_id").transformWithStateInPandas(
        statefulProcessor=_goal_processor(), outputStructType=TRANSITIONS, outputMode="Append", timeMode="None")


def run_transitions_to_table(spark: SparkSession, source_dir: str, schema, goals: DataFrame, table_path: str, checkpoint: str,
                             files_a_batch: int | None = None):
    """A folder of logged replies (Parquet) -> transitions appended to ``table_path``; restartable."""
    from ..operators.workflow import steps_from_log
    _rocksdb(spark)
    reader = spark.readStream.schema(schema)
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    q = (stream_transitions(steps_from_log(reader.parquet(source_dir), goals)).writeStream.outputMode("append").format("parquet")
         .option("path", table_path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q
