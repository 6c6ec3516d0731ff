"""Structured Streaming jobs: incremental sync, live task state, fan-out and page streams."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quillgrid.operators.entities import latest, task_states
from quillgrid.operators.sync import plan_sync

Sink = Callable[[DataFrame, int], None]


def stream_files(
    spark: SparkSession, path: str, schema: T.StructType, *, fmt: str = "parquet", files_per_trigger: int | None = None
) -> DataFrame:
    """Rows of files as they arrive; ``files_per_trigger`` bounds a micro-batch."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def run_available(df: DataFrame, sink: Sink, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what has arrived so far, then stop; a rerun goes on where this one ended."""
    return (
        df.writeStream.foreachBatch(sink)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _to_folder(folder: str) -> Sink:
    """Sink that writes each micro-batch to its own sub-folder, so that a replayed batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return write


def sync_stream(
    listing: DataFrame, target: Callable[[], DataFrame], out: str, checkpoint: str, *, root: str, prefix: str, delay: str = "1 hour"
) -> StreamingQuery:
    """Plan transfers for a stream of listing rows and write them below ``out``.

    A (path, revision) seen before within ``delay`` is dropped. The delay counts
    from arrival, so an old file that is listed late is still planned. ``target``
    is called for every micro-batch and lists the store as it is then.
    """
    fresh = (
        listing.withColumn("path_lower", F.lower("path_display"))
        .withColumn("seen_at", F.current_timestamp())
        .withWatermark("seen_at", delay)
        .dropDuplicatesWithinWatermark(["path_lower", "rev"])
        .drop("seen_at", "path_lower")
    )
    write = _to_folder(out)

    def plan(batch: DataFrame, batch_id: int) -> None:
        write(plan_sync(batch, target(), root=root, prefix=prefix), batch_id)

    return run_available(fresh, plan, checkpoint)


def task_state_stream(events: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keep the state of every task; each micro-batch writes the states it changed."""
    return run_available(task_states(events), _to_folder(out), checkpoint, mode="update")


def read_task_states(spark: SparkSession, out: str) -> DataFrame:
    """Current state of every task from the output of ``task_state_stream``."""
    return latest(spark.read.parquet(out), ["task_id"], ["batch"]).drop("batch")


def tee_stream(df: DataFrame, sinks: Sequence[Sink], checkpoint: str) -> StreamingQuery:
    """Feed every micro-batch to all sinks while reading it once. A failing sink fails the query."""

    def fan_out(batch: DataFrame, batch_id: int) -> None:
        shared = batch.persist()
        try:
            for sink in sinks:
                sink(shared, batch_id)
        finally:
            shared.unpersist()

    return run_available(df, fan_out, checkpoint)


def folder_sink(folder: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> Sink:
    write = _to_folder(folder)
    return lambda batch, batch_id: write(transform(batch), batch_id)
