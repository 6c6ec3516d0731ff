"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.session import written  # noqa: F401  (the operators here take it from this module)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that what a worker derives from a batch stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it (names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def fold_of(doc_id: Column) -> Column:
    """Remainder by 3 of the CRC-32 of the id as text; 1 marks held-out rows."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def training_labels(labels: DataFrame, column: str) -> DataFrame:
    """``doc_id, label`` of every labelled id that is not held out; an id labelled twice keeps its larger label."""
    return (
        labels.select(F.col("doc_id"), F.col(column).cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (fold_of(F.col("doc_id")) != 1))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )


def labelled_sample(labels: DataFrame, column: str, max_rows: int) -> DataFrame:
    """``doc_id, label``: at most ``max_rows`` training labels, the ones with the smallest id hash.

    Held-out rows and rows without an id or label are left out; an id labelled
    twice keeps its larger label. ``max_rows`` bounds the result, which may
    therefore be broadcast.
    """
    rows = training_labels(labels, column)
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def sampled_texts(documents: DataFrame, labels: DataFrame, column: str, max_rows: int) -> DataFrame:
    """``doc_id, text, label`` of a bounded labelled sample, without moving the other texts."""
    sample = labelled_sample(labels, column, max_rows)
    # At most max_rows pairs of numbers, see labelled_sample.
    return documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
