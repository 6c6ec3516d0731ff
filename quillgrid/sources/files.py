"""Reading document files and writing objects."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.functions.files import basename, has_suffix
from quillgrid.functions.metadata import plain_path
from quillgrid.operators.documents import with_identity

# Hooks hand rows on in pieces of about this size.
_ROWS_OUT = 1_000
_BYTES_OUT = 32 * 1024 * 1024
_FETCHED = ["key", "content", "content_type", "metadata", "error"]


def scan_files(
    spark: SparkSession, folder: str, *, suffix: str = ".pdf", recursive: bool = True, case_sensitive: bool = False
) -> DataFrame:
    """``path, name, length, modification_time`` of files with the suffix; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.filter(has_suffix(F.col("path"), suffix, case_sensitive)).select(
        plain_path(F.col("path")).alias("path"),
        basename(F.col("path")).alias("name"),
        "length",
        F.col("modificationTime").alias("modification_time"),
    )


def load_documents(spark: SparkSession, path: str | None = None, data: DataFrame | None = None) -> DataFrame:
    """Documents with identity, from files below ``path`` or a DataFrame with a binary ``content``.

    ``path`` wins if both are given. A path that does not exist raises Spark's
    AnalysisException.
    """
    if path is None and data is None:
        raise ValueError("give either path or data")
    if path is not None:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        located = files.select(plain_path(F.col("path")).alias("source_path"), "content")
        return with_identity(located, "source_path", "content", "local")
    unnamed = data.withColumn("source_path", F.lit(None).cast("string"))
    return with_identity(unnamed, "source_path", "content", "bytes")


def map_pages(pages: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, partitions: int | None = None) -> DataFrame:
    """Apply a user function to Arrow batches of pages; column expressions are faster where they can say it.

    ``partitions`` bounds how many calls run at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    spread = pages if partitions is None else pages.repartition(partitions)
    return spread.mapInPandas(run, schema)


def explode_pages(documents: DataFrame, parse: Callable[[bytes], list[dict]], schema: str, id_col: str = "doc_id") -> DataFrame:
    """One row per page or block of each document, through a user's parser of the binary ``content``."""
    names = [id_col, *[part.strip().split()[0] for part in schema.split(",")]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[dict] = []
            for doc, content in zip(batch[id_col], batch["content"], strict=True):
                rows += [{id_col: doc, **row} for row in parse(bytes(content))]
                if len(rows) >= _ROWS_OUT:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names)

    key = documents.schema[id_col].dataType.simpleString()
    return documents.select(id_col, "content").mapInPandas(run, f"{id_col} {key}, {schema}")


def embed(documents: DataFrame, make_model: Callable[[], Callable], *, input_col: str, batch_size: int = 64) -> DataFrame:
    """Add ``embedding array<float>`` from a user's model, built once per Python worker.

    ``make_model`` returns a function from a batch of inputs to a 2-D float array.
    The model sees no NULL: a row without input has no embedding.
    """
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, FloatType

    def make():
        import numpy as np

        predict = make_model()

        def known(inputs):
            there = pd.notna(inputs)
            if there.all():
                return predict(inputs)
            found = np.asarray(predict(inputs[there])) if there.any() else np.empty((0, 0), "float32")
            out = np.zeros((len(inputs), found.shape[1]), found.dtype)
            out[there] = found
            return out

        return known

    model = predict_batch_udf(make, return_type=ArrayType(FloatType()), batch_size=batch_size)
    return documents.withColumn("embedding", F.when(F.col(input_col).isNotNull(), model(F.col(input_col))))


def _uploads(plan: DataFrame, content_type: str) -> DataFrame:
    stamp = F.date_format("client_modified", "yyyy-MM-dd'T'HH:mm:ss")
    metadata = F.map_filter(
        F.create_map(F.lit("dropbox_rev"), F.col("rev"), F.lit("dropbox_client_modified"), stamp),
        lambda _, v: v.isNotNull(),
    )
    return plan.filter(F.col("action") != "skip").select(
        "path_display", "key", F.lit(content_type).alias("content_type"), metadata.alias("metadata")
    )


def objects_to_upload(plan: DataFrame, contents: DataFrame, content_type: str = "application/pdf") -> DataFrame:
    """``key, content, content_type, metadata`` of the planned uploads.

    ``contents`` has ``path_display`` and ``content`` and is shuffled for the
    join; ``fetch_objects`` leaves contents where they are read.
    """
    return _uploads(plan, content_type).join(contents, "path_display").select("key", "content", "content_type", "metadata")


def fetch_objects(
    plan: DataFrame, make_fetch: Callable[[], Callable[[str], bytes]], content_type: str = "application/pdf"
) -> DataFrame:
    """Read the planned uploads with a user's function from path to bytes, made once per task.

    Adds ``error`` (NULL if the file was read): a file that cannot be read does
    not fail the job. Only paths are shuffled, to spread the reads evenly.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fetch = make_fetch()
        for batch in batches:
            held, rows = 0, []
            for row in batch.itertuples(index=False):
                content, error = None, None
                try:
                    content = fetch(row.path_display)
                except Exception as e:  # counted, not raised
                    error = f"{type(e).__name__}: {e}"
                rows.append((row.key, content, row.content_type, row.metadata, error))
                held += len(content or b"")
                if held >= _BYTES_OUT:
                    yield pd.DataFrame(rows, columns=_FETCHED, dtype=object)
                    held, rows = 0, []
            if rows:
                yield pd.DataFrame(rows, columns=_FETCHED, dtype=object)

    uploads = _uploads(plan, content_type)
    schema = "key string, content binary, content_type string, metadata map<string,string>, error string"
    return uploads.repartition("path_display").mapInPandas(run, schema)


def write_objects(objects: DataFrame, folder: str, mode: str = "append") -> None:
    objects.write.mode(mode).parquet(folder)


def put_objects(objects: DataFrame, make_put: Callable[[], Callable]) -> None:
    """Hand every row to a user's put function, made once per task. A retried task repeats its puts."""

    def send(rows) -> None:
        put = make_put()
        for row in rows:
            put(row)

    objects.foreachPartition(send)


def write_cluster_report(clusters: DataFrame, folder: str, fmt: str = "json") -> None:
    """``file, cluster, x, y`` rows as JSON lines or Parquet."""
    clusters.write.mode("overwrite").format(fmt).save(folder)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
