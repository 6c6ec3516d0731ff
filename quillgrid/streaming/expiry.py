"""Live task state that expires, and the compaction of what a state stream has written.

The state of a task lives in Spark's state store (RocksDB, so not on the heap)
and is dropped by an event-time timer once the task has been silent for a while.
So the store holds the tasks of a span of time, not all tasks there ever were.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillgrid.operators.entities import latest
from quillgrid.streaming.jobs import _to_folder, run_available

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Tasks(StatefulProcessor):
    """Folds the events of a task; a NULL field leaves the earlier value, as in ``task_states``."""

    def __init__(self, fields: Sequence[str], keep_ms: int):
        self._fields, self._keep_ms = list(fields), keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        each = [f"v{i} string, at{i} timestamp, id{i} bigint" for i in range(len(self._fields))]
        self._state = handle.getValueState("task", ", ".join(["created_at timestamp, updated_at timestamp, event_id bigint", *each]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = list(self._state.get()) if self._state.exists() else None
        for frame in rows:
            for row in frame.itertuples(index=False):
                moment = (row.updated_at.to_pydatetime(), int(row.event_id))
                if held is None:
                    held = [moment[0], *moment] + [None, None, None] * len(self._fields)
                held[0] = min(held[0], moment[0])
                held[1:3] = max(tuple(held[1:3]), moment)
                for i, field in enumerate(self._fields):
                    value, at = getattr(row, field), 3 + 3 * i
                    if value is not None and (held[at + 1] is None or tuple(held[at + 1 : at + 3]) <= moment):
                        held[at : at + 3] = [value, *moment]
        self._state.update(tuple(held))
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        self._handle.registerTimer(int(pd.Timestamp(held[1]).timestamp() * 1000) + self._keep_ms)
        yield self._row(key, held, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = list(self._state.get())
        self._state.clear()
        yield self._row(key, held, True)

    def _row(self, key, held: list, expired: bool) -> pd.DataFrame:
        values = {f: [held[3 + 3 * i]] for i, f in enumerate(self._fields)}
        moments = {"created_at": [held[0]], "updated_at": [held[1]], "event_id": [held[2]]}
        return pd.DataFrame({"task_id": [key[0]], **moments, **values, "expired": [expired]})

    def close(self) -> None:
        pass


def expiring_task_states(events: DataFrame, keep: str = "30 days", delay: str = "1 hour") -> DataFrame:
    """A stream of task states: a row for every task that a micro-batch changes, and a last one when its state expires.

    ``events`` has ``task_id, updated_at, event_id`` and string fields. A task that has had no event for ``keep`` of event
    time is ``expired`` and leaves the store; a later event begins it anew. Events later than ``delay`` are dropped.
    The session's state store must be RocksDB (``ROCKSDB``).
    """
    fields = [c for c in events.columns if c not in ("task_id", "updated_at", "event_id")]
    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    timed = events.withColumn("updated_at", F.col("updated_at").cast("timestamp")).withWatermark("updated_at", delay)
    columns = ["task_id string", "created_at timestamp", "updated_at timestamp", "event_id bigint", *[f"{f} string" for f in fields], "expired boolean"]
    return timed.groupBy("task_id").transformWithStateInPandas(_Tasks(fields, keep_ms), ", ".join(columns), "Append", "EventTime")


def expiring_task_stream(events: DataFrame, out: str, checkpoint: str, keep: str = "30 days", delay: str = "1 hour") -> StreamingQuery:
    """Write the rows of ``expiring_task_states`` as they arrive; read them with ``read_latest``."""
    return run_available(expiring_task_states(events, keep, delay), _to_folder(out), checkpoint)


def _numbered(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    """Numbers of the finished sub-folders ``<prefix>=<n>``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    found = [s.getPath() for s in system.listStatus(path) if s.getPath().getName().startswith(prefix + "=")]
    done = [p for p in found if system.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().split("=")[1]) for p in done)


def _upto(spark: SparkSession, out: str) -> int:
    return max(_numbered(spark, f"{out}/compacted", "upto"), default=-1)


def read_latest(spark: SparkSession, out: str, key: str = "task_id") -> DataFrame:
    """The last row of every key among those that a stream wrote below ``out``: the compacted ones and the batches since."""
    start = _upto(spark, out)
    parts = [spark.read.parquet(f"{out}/compacted/upto={start}")] if start >= 0 else []
    for batch in _numbered(spark, out, "batch"):
        if batch > start:
            parts.append(spark.read.parquet(f"{out}/batch={batch}").withColumn("__batch", F.lit(batch).cast("bigint")))
    if not parts:
        raise ValueError(f"no batch below {out}")
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    moment = [c for c in ("updated_at", "event_id", "expired") if c in rows.columns]
    return latest(rows, [key], ["__batch", *moment]).drop("__batch")


def compact(spark: SparkSession, out: str, key: str = "task_id") -> int:
    """Write the last rows of all batches so far as one folder, which replaces them for later reads; returns the last batch.

    Later reads see one row per key and the batches written since. The old batch folders may then be removed.
    """
    batches = _numbered(spark, out, "batch")
    last = max(batches, default=-1)
    if last > _upto(spark, out):
        rows = read_latest(spark, out, key).withColumn("__batch", F.lit(last).cast("bigint"))
        rows.write.mode("overwrite").parquet(f"{out}/compacted/upto={last}")
    return last
