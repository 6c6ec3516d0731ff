"""Looking up every unit of all texts in a table as large as the corpus, without a shuffled row per occurrence.

Texts are read in slabs of a few million characters. A slab keeps the order of
its units (words, pairs of words) as numbers into a dictionary of its distinct
units, and only dictionaries are shuffled by unit: in pieces, one per slab and
hash bucket. The values come back by slab and bucket, in the order of the
dictionary, and are put together with the slab's numbers.

A slab either keeps its units as numbers (``slab_rows``, ``assemble``) or its
texts, from which the units are taken anew (``text_slabs``, ``joined``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm.common import sliced

SLAB_CHARS = 32 << 20
# Codes below this are one byte; the others have two more.
_SHORT = 240


def buckets(spark: SparkSession) -> int:
    """Hash buckets of the units: as many as shuffle partitions, so that both grow with the corpus."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value."""
    heads = np.array([len(arrays), *[a.nbytes for a in arrays]], "<i8")
    return zstandard.ZstdCompressor(3).compress(heads.tobytes() + b"".join(a.tobytes() for a in arrays))


def unpack_arrays(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(raw, "<i8", len(kinds), 8)
    out, at = [], 8 * (len(kinds) + 1)
    for size, kind in zip(sizes, kinds):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += int(size)
    return out


def pack_codes(codes: np.ndarray) -> bytes:
    """Non-negative numbers, small ones more frequent, as one compressed value."""
    if codes.max(initial=0) >= (256 - _SHORT) << 16:
        wide = codes.astype("<u8").view(np.uint8).reshape(-1, 8).T  # equal bytes side by side
        return pack_arrays(np.array([8], "<i8"), np.ascontiguousarray(wide).ravel(), *[np.empty(0, np.uint8)] * 2)
    rest = codes[codes >= _SHORT]
    first = np.where(codes < _SHORT, codes, _SHORT + (codes >> 16))
    return pack_arrays(np.array([1], "<i8"), *[(x & 255).astype(np.uint8) for x in (first, rest, rest >> 8)])


def unpack_codes(blob: bytes) -> np.ndarray:
    width, first, low, high = unpack_arrays(blob, "<i8", "u1", "u1", "u1")
    if width[0] == 8:
        return np.ascontiguousarray(first.reshape(8, -1).T).ravel().view("<u8").astype(np.int64)
    codes = first.astype(np.int64)
    long = codes >= _SHORT
    codes[long] = ((codes[long] - _SHORT) << 16) + (high.astype(np.int64) << 8) + low
    return codes


def slab_rows(documents: DataFrame, split: Callable, n: int) -> DataFrame:
    """``slab, ids, sizes, seq, units``: one row per slab.

    ``split`` takes the slab's ids and texts, and returns the units of all texts
    one after another as numbers of distinct units, the count of units per text,
    a hash of each distinct unit, and a function that packs distinct units given
    by their numbers. Hash buckets hold their units from the most frequent on; a
    unit's code is its place there times the number of buckets, plus the bucket,
    so that frequent units have small codes. A slab ends with the text that fills it.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        ids, texts, chars = [], [], 0

        def row():
            numbers, sizes, hashes, pack = split(ids, texts)
            bucket = hashes % n
            order = np.lexsort((-np.bincount(numbers, minlength=len(hashes)), bucket))
            ends = np.searchsorted(bucket[order], np.arange(n + 1))
            code = np.empty(len(hashes), np.int64)
            code[order] = (np.arange(len(hashes)) - ends[bucket[order]]) * n + bucket[order]
            pieces = [pack(order[a:b]) for a, b in zip(ends, ends[1:])]
            seq = pack_codes(code[numbers])
            columns = [[(part << 32) + made], [ids], [sizes.tolist()], [seq], [pieces]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        schema = None
        for batch in sliced(batches):
            if schema is None:
                schema = pa.schema([("slab", pa.int64()), ("ids", pa.list_(batch.schema.field(0).type)), ("sizes", pa.list_(pa.int64())), ("seq", pa.binary()), ("units", pa.list_(pa.binary()))])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(doc)
                texts.append(text)
                chars += len(text)
                if chars >= SLAB_CHARS:
                    yield row()
                    made += 1
                    ids, texts, chars = [], [], 0
        if ids:
            yield row()

    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(run, f"slab bigint, ids array<{kind}>, sizes array<bigint>, seq binary, units array<binary>")


def pack_sorted(values: np.ndarray) -> list[np.ndarray]:
    """Ascending numbers below 2**48 as steps, in three arrays of 16 bits."""
    steps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    return [(steps >> np.uint64(shift)).astype("<u2") for shift in (0, 16, 32)]


def unpack_sorted(*parts: np.ndarray) -> np.ndarray:
    steps = sum(part.astype(np.int64) << 16 * i for i, part in enumerate(parts))
    return np.cumsum(steps)


def bucket_ranges(buckets: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Start and end of each bucket in the ascending ``buckets``."""
    at = np.searchsorted(buckets, np.arange(n + 1)).tolist()
    return list(zip(at, at[1:]))


def text_slabs(documents: DataFrame, units: Callable | None = None, size: int = SLAB_CHARS) -> DataFrame:
    """``slab, ids, sizes, raw, units``: one row per slab of texts of about ``size`` bytes.

    ``raw`` has the texts' UTF-8 one after another, compressed; a NULL text is empty. ``units`` takes the
    texts' ids, the slab's bytes and the texts' sizes, and returns a binary value for each bucket; without it the
    column is NULL, and ``slab_units`` takes them from the written slabs.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        ids, texts, held = [], [], 0

        def row():
            sizes = np.array([len(t) for t in texts], np.int64)
            raw = b"".join(texts)
            packed = pack_arrays(np.frombuffer(raw, np.uint8))
            columns = [[(part << 32) + made], [ids], [sizes.tolist()], [packed], [units and units(ids, raw, sizes)]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        schema = None
        for batch in sliced(batches, 64):
            if schema is None:
                schema = pa.schema([("slab", pa.int64()), ("ids", pa.list_(batch.schema.field(0).type)), ("sizes", pa.list_(pa.int64())), ("raw", pa.binary()), ("units", pa.list_(pa.binary()))])
            for doc, text in zip(*(batch.column(i).to_pylist() for i in range(2))):
                ids.append(doc)
                texts.append(text)
                held += len(text) + 1
                if held >= size:
                    yield row()
                    made += 1
                    ids, texts, held = [], [], 0
        if ids:
            yield row()

    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return texts.mapInArrow(run, f"slab bigint, ids array<{kind}>, sizes array<bigint>, raw binary, units array<binary>")


def slab_units(texts: DataFrame, units: Callable) -> DataFrame:
    """``slab, units`` of rows of ``text_slabs``, made from their texts when they are looked up, and so not stored.

    ``texts`` has ``slab, sizes, raw`` and one more column. ``units`` takes a slab's bytes, the texts' sizes and that
    column's value, and returns a binary value for each bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            slab, sizes, packed, other = (batch.column(i)[0].as_py() for i in range(4))
            (raw,) = unpack_arrays(packed, "u1")
            found = units(raw.tobytes(), np.array(sizes, np.int64), other)
            yield pa.RecordBatch.from_arrays([pa.array([slab]), pa.array([found], pa.list_(pa.binary()))], names=["slab", "units"])

    return texts.mapInArrow(run, "slab bigint, units array<binary>")


def joined(texts: DataFrame, others: list[DataFrame], finish: Callable, schema: str, n: int) -> DataFrame:
    """Bring rows ``slab, bucket, value`` of ``others`` to the rows of ``text_slabs``.

    ``finish`` takes a slab's name, its ids as an Arrow array, the texts' sizes, their bytes and its values in
    the order of the buckets, and yields record batches of ``schema``.
    """
    columns, last = ("ids", "sizes", "raw"), 1 << 30
    empty = [F.lit(None).cast(texts.schema[c].dataType).alias(c) for c in columns]
    both = texts.select("slab", F.lit(last).alias("bucket"), F.lit(None).cast("binary").alias("value"), *columns)
    for other in others:
        both = both.unionByName(other.select("slab", "bucket", "value", *empty))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        for batch in sliced(batches, 64):
            for i, bucket in enumerate(batch.column(1).to_pylist()):
                if bucket < last:
                    held.append(batch.column(2)[i].as_py())
                    continue
                sizes = np.array(batch.column(4)[i].as_py(), np.int64)
                (raw,) = unpack_arrays(batch.column(5)[i].as_py(), "u1")
                yield from finish(batch.column(0)[i].as_py(), batch.column(3)[i].values, sizes, raw.tobytes(), held)
                held = []

    dealt = both.repartition(n, "slab").sortWithinPartitions("slab", "bucket")
    return dealt.select("slab", "bucket", "value", *columns).mapInArrow(run, schema)


def matched(texts: DataFrame, values: DataFrame, finish: Callable, schema: str, n: int) -> DataFrame:
    """``joined`` with one frame of values; where a query has it twice with equal ``texts`` and ``n``, they are shuffled once."""

    def run(own: pa.Table, found: pa.Table) -> pa.Table:
        held = found.sort_by("bucket").column("value").to_pylist()
        slab, ids, sizes, packed = (own.column(c)[0] for c in ("slab", "ids", "sizes", "raw"))
        (raw,) = unpack_arrays(packed.as_py(), "u1")
        return pa.Table.from_batches(finish(slab.as_py(), ids.values, np.array(sizes.as_py(), np.int64), raw.tobytes(), held))

    dealt = texts.select("slab", "ids", "sizes", "raw").repartition(n, "slab")
    return dealt.groupBy("slab").cogroup(values.select("slab", "bucket", "value").groupBy("slab")).applyInArrow(run, schema)


def look_up(slabs: DataFrame, answer: Callable, n: int, passed: int = 0) -> DataFrame:
    """``slab, bucket, value``: each dictionary piece with what ``answer`` makes of it.

    ``answer`` takes an iterator of ``slab, piece`` over all pieces of one bucket
    and yields ``slab, value``. A unit is in one bucket only, so all that is
    known of it meets in one call. The first ``passed`` values of a slab are no
    pieces: they come back as they are, as buckets below 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(3))))
        row = next(rows, None)
        while row is not None:
            bucket = row[1]
            if bucket < 0:
                yield pa.RecordBatch.from_arrays([pa.array([row[0]]), pa.array([bucket], pa.int32()), pa.array([row[2]], pa.binary())], names=["slab", "bucket", "value"])
                row = next(rows, None)
                continue

            def pieces():
                nonlocal row
                while row is not None and row[1] == bucket:
                    yield row[0], row[2]
                    row = next(rows, None)

            for slab, value in answer(pieces()):
                yield pa.RecordBatch.from_arrays([pa.array([slab]), pa.array([bucket], pa.int32()), pa.array([value], pa.binary())], names=["slab", "bucket", "value"])

    pieces = slabs.select("slab", F.posexplode("units").alias("bucket", "piece"))
    place = F.col("bucket")
    if passed:
        pieces = pieces.withColumn("bucket", F.col("bucket") - passed)
        place = F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("slab"), F.lit(n)).cast("int")).otherwise(F.col("bucket"))
    dealt = pieces.repartitionById(n, place).sortWithinPartitions("bucket", "slab")
    return dealt.mapInArrow(run, "slab bigint, bucket int, value binary")


def assemble(slabs: DataFrame, values: DataFrame, unpack: Callable, finish: Callable, schema: str, n: int) -> DataFrame:
    """Bring the values back to their slabs.

    ``unpack`` makes the parts of a value, the first of which has an entry per
    unit. ``finish`` takes the slab's unpacked values in the order of the buckets,
    its texts' units as places in their concatenation, the texts' sizes, and their
    ids as an Arrow array, and returns a record batch of ``schema``.
    """
    empty = [F.lit(None).cast(slabs.schema[c].dataType).alias(c) for c in ("ids", "sizes", "seq")]
    back = values.select("slab", "bucket", "value", *empty)
    own = slabs.select("slab", F.lit(n).alias("bucket"), F.lit(None).cast("binary").alias("value"), "ids", "sizes", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            for i, (bucket, value, sizes, seq) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2, 4, 5)))):
                if bucket < n:
                    held.append(unpack(value))
                else:
                    counts = np.array([len(parts[0]) for parts in held], np.int64)
                    place, bucket = np.divmod(unpack_codes(seq), n)
                    units = (np.cumsum(counts) - counts)[bucket] + place
                    yield finish(held, units, np.array(sizes, np.int64), batch.column(3)[i].values)
                    held = []

    both = own.unionByName(back).repartition(n, "slab").sortWithinPartitions("slab", "bucket")
    return both.select("slab", "bucket", "value", "ids", "sizes", "seq").mapInArrow(run, schema)
