"""WARC archives through a chunked record table.

Payloads travel as rows of record identifier and chunk number, so no task holds
more of an oversized record than a chunk. The writer streams these rows into
archives, one gzip member per record, and the reader streams archives back into
such rows; both carry the SHA-256 of the payload from chunk to chunk.
"""

from __future__ import annotations

import gzip
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from hashlib import sha256
from urllib.parse import quote, unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import written
from quillgrid.operators.skew import salted_join
from quillgrid.session import scratch_path

CHUNK_BYTES = 1 << 20
LEAST_REVISIT = 100
ARCHIVE_BYTES = 1 << 28
_BATCH_BYTES = 8 << 20
_URN = "urn:page:"
_DATE = "1970-01-01T00:00:00Z"  # the table has no capture times
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def plan_records(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``page_id, payload_digest, payload_bytes, record_type, refers_to`` of every distinct page and payload.

    Of equal payloads of at least ``least`` bytes the smallest page id is the
    response and the others revisit it.
    """
    raw = F.coalesce("html", F.lit("")).cast("binary")
    seen = pages.select("page_id", F.sha2(raw, 256).alias("payload_digest"), F.octet_length(raw).cast("bigint").alias("payload_bytes"))
    seen = written(seen.distinct(), "warc-digests")
    first = seen.filter(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"))
    typed = salted_join(seen, first, ["payload_digest"], spread=[F.col("page_id")], how="left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return typed.select(
        "page_id",
        "payload_digest",
        "payload_bytes",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"),
    )


def chunk_rows(pages: DataFrame, records: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The record table: a row per chunk of each page's payload; revisits have one row without data."""
    raw = F.coalesce("html", F.lit("")).cast("binary")
    keyed = pages.select(F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("id"), "url", raw.alias("raw"), F.sha2(raw, 256).alias("payload_digest"))
    named = records.withColumn("id", F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    joined = keyed.join(named.drop("page_id"), ["id", "payload_digest"])
    chunks = F.when(F.col("record_type") == "revisit", F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil(F.col("payload_bytes") / chunk_bytes)))
    each = joined.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), (chunks - 1).cast("int")))).withColumn("chunks", chunks.cast("int"))
    data = F.when(F.col("record_type") == "response", F.substring("raw", F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes)))
    return each.select("id", "url", "payload_digest", "payload_bytes", "record_type", F.col("refers_to").cast("string").alias("refers_to"), "chunk_no", "chunks", data.alias("data"))


@contextmanager
def _opened(uri: str, mode: str):
    """A binary file of any file system that the cluster's workers can reach."""
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        if mode == "wb":
            os.makedirs(os.path.dirname(parts.path), exist_ok=True)
        with open(parts.path, mode) as f:
            yield f
    else:
        from pyarrow.fs import FileSystem

        fs, path = FileSystem.from_uri(uri)
        if mode == "wb":
            fs.create_dir(os.path.dirname(path), recursive=True)
        with fs.open_output_stream(path) if mode == "wb" else fs.open_input_stream(path) as f:
            yield f


def header(row: dict) -> bytes:
    """Header block of a record, up to the empty line."""
    revisit = row["record_type"] == "revisit"
    fields = {
        "WARC-Type": row["record_type"],
        "WARC-Record-ID": f"<{_URN}{quote(row['id'])}>",
        "WARC-Date": _DATE,
        "WARC-Target-URI": None if row["url"] is None else re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), row["url"]),
        "WARC-Payload-Digest": f"sha256:{row['payload_digest']}",
        "WARC-Profile": _PROFILE if revisit else None,
        "WARC-Refers-To": f"<{_URN}{quote(row['refers_to'])}>" if revisit else None,
        "X-Payload-Length": str(row["payload_bytes"]) if revisit else None,  # an extension: revisits hold no payload
        "Content-Type": "text/html; charset=utf-8",
        "Content-Length": "0" if revisit else str(row["payload_bytes"]),
    }
    lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in fields.items() if v is not None]]
    return "\r\n".join(lines).encode() + b"\r\n\r\n"


def write_archives(chunks: DataFrame, folder: str) -> DataFrame:
    """Stream the record table into archives below ``folder``; returns ``archive, records``, written.

    A task that is run again writes archives under new names, and only those of
    the attempt that Spark accepts are in the result.
    """
    names = ["id", "url", "payload_digest", "payload_bytes", "record_type", "refers_to", "chunk_no", "chunks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (
            (dict(zip(names, head)), batch.column(len(names))[i].as_py() or b"")
            for batch in batches
            for i, head in enumerate(zip(*(batch.column(c).to_pylist() for c in range(len(names)))))
        )
        row = next(rows, None)
        while row is not None:
            uri, size, records = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
            with _opened(uri, "wb") as f:
                while row is not None and not (size >= ARCHIVE_BYTES and row[0]["chunk_no"] == 0):
                    head, data = row
                    if head["chunk_no"] == 0:
                        packer, digest = zlib.compressobj(3, wbits=31), sha256()
                        size += f.write(packer.compress(header(head)))
                    digest.update(data)
                    size += f.write(packer.compress(data))
                    if head["chunk_no"] == head["chunks"] - 1:
                        if head["record_type"] == "response" and digest.hexdigest() != head["payload_digest"]:
                            raise ValueError(f"chunks of page {head['id']} are not in order")
                        size += f.write(packer.compress(b"\r\n\r\n") + packer.flush())
                        records += 1
                    row = next(rows, None)
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([records], pa.int64())], names=["archive", "records"])

    return written(chunks.select(*names, "data").mapInArrow(run, "archive string, records bigint"), "warc-archives")


def records_of(stream, chunk_bytes: int = CHUNK_BYTES) -> Iterator[dict]:
    """Rows of the record table from one archive, read front to back."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        left, digest, n, size = int(fields["content-length"]), sha256(), 0, 0
        ident = lambda name: unquote(fields[name][1:-1].removeprefix(_URN)) if name in fields else None
        revisit = fields["warc-type"] == "revisit"
        while True:
            data = stream.read(min(chunk_bytes, left))
            if left and not data:
                raise EOFError("archive ends within a record")
            left, size = left - len(data), size + len(data)
            digest.update(data)
            yield {
                "id": ident("warc-record-id"),
                "record_type": fields["warc-type"],
                "refers_to": ident("warc-refers-to"),
                "chunk_no": n,
                "last": left == 0,
                "data": data,
                "payload_bytes": int(fields["x-payload-length"]) if revisit else size,
                "payload_digest": fields["warc-payload-digest"].partition(":")[2] if revisit else digest.hexdigest(),
            }
            n += 1
            if not left:
                break


def read_archives(archives: DataFrame, chunk_bytes: int = CHUNK_BYTES, data: bool = True) -> DataFrame:
    """The record table of all ``archive`` files; digest and length are those of the payload up to the chunk.

    Of a revisit they are what its header says. ``data=False`` leaves the bytes out.
    """
    schema = pa.schema([("id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("chunk_no", pa.int32()), ("last", pa.bool_()), ("data", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                held, size = [], 0
                with _opened(uri, "rb") as f, gzip.GzipFile(fileobj=f) as stream:
                    for row in records_of(stream, chunk_bytes):
                        size += len(row["data"]) + 200
                        held.append(row if data else row | {"data": None})
                        if size >= _BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    kinds = "id string, record_type string, refers_to string, chunk_no int, last boolean, data binary, payload_bytes bigint, payload_digest string"
    # A fixed number of tasks: Spark would judge the few short names worth one task.
    n = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("archive").repartition(n, "archive").mapInArrow(run, kinds)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write every page as a WARC record and read the archives back: one row per page.

    Columns: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.
    A NULL html is an empty payload. Rows with the same id and payload are the
    same record written again and have the same type; a page without an id is a
    response only if no page with an id has its payload. Other columns but
    ``url`` are ignored, and an empty table gives no rows.
    """
    folder = scratch_path(pages.sparkSession, "warc")
    archives = write_archives(chunk_rows(pages, plan_records(pages)), folder)
    rows = read_archives(archives, data=False).filter("last")
    kind = pages.schema["page_id"].dataType

    def typed(name):
        return F.when(F.col(name) != "", F.col(name)).cast(kind)

    return rows.select(typed("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", typed("refers_to").alias("refers_to"))
