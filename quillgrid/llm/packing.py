"""Best-fit packing of documents into fixed-length training sequences.

Only a histogram of piece lengths, at most one row per length, reaches the
driver. Best fit is planned on counts: bins with the same room are one entry, so
the plan has a size that depends on the capacity and not on the documents. The
planned slots become a distributed table, and pieces take them by an equi-join
on their length and their rank within that length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import sliced, written
from quillgrid.operators.numbering import with_position

CAPACITY = 1024
END_OF_TEXT = 2
_SPECIAL = "<|endoftext|>"
_SPACES = re.compile(r"\s\s")
_SLOTS_PER_ROW = 50_000


class TextEncoder:
    """Ids of whole texts, equal to those of the tokenizer file ``vocabulary``.json.

    The tokenizers library is the definition and encodes texts that contain its
    special token. For other texts the same vocabulary as ranks gives the same
    ids several times faster. Where no two white-space characters meet, a
    pattern without look-ahead splits a text in the same places.
    """

    def __init__(self, vocabulary: str = "byte_bpe_50k"):
        import base64

        import tiktoken

        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        plain = public_tokenizers.PATTERN.replace(r"|\s+(?!\S)|\s+", r"|\s")

        def encoder(name: str, pattern: str):
            return tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

        self._fast, self._full = encoder("plain", plain), encoder("full", public_tokenizers.PATTERN)
        self._json, self._exact = public_tokenizers.path(f"{vocabulary}.json"), None

    def __call__(self, text: str) -> list[int]:
        if _SPECIAL in text:
            if self._exact is None:
                from tokenizers import Tokenizer

                self._exact = Tokenizer.from_file(self._json)
            return self._exact.encode(text, add_special_tokens=False).ids
        return (self._full if _SPACES.search(text) else self._fast).encode_ordinary(text)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``n`` tokens; only the first may be shorter than the capacity."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *[(at, capacity) for at in range(first, n, capacity)]]


def token_pieces(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: every document tokenized, ended by an id and cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = TextEncoder(vocabulary)
        for batch in sliced(batches):
            row, cols = [], ([], [], [], [])
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = np.array([*encode(text), END_OF_TEXT], "<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    row.append(i)
                    crc = zlib.crc32(ids[start : start + length].tobytes())
                    for col, x in zip(cols, (k, start, length, crc)):
                        col.append(x)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            arrays = [batch.column(0).take(pa.array(row, pa.int64())), *[pa.array(c, k) for c, k in zip(cols, kinds)]]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Returns runs ``(length, first rank, bins, pieces per bin, first bin, offset)``:
    the ranks of a length from the first on fill the bins one after another.
    Equal pieces stay in a bin until it has no room for another, which is what
    best fit does one at a time: the bin just used is the tightest that fits.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # by room left: runs of bins
    runs, bins = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            tight = min((r for r in room if r >= length), default=None)
            if tight is None:
                at, count, tight = bins, -(-left // (capacity // length)), capacity
                bins += count
            else:
                at, count = room[tight].pop()
                if not room[tight]:
                    del room[tight]
            per = tight // length
            used = min(count, left // per) or 1
            per = min(per, left)
            runs.append((length, rank, used, per, at, capacity - tight))
            for start, n, rest in ((at, used, tight - per * length), (at + used, count - used, tight)):
                if n and rest:
                    room.setdefault(rest, []).append((start, n))
            left -= used * per
            rank += used * per
    return runs


def slots(spark, runs: list[tuple]) -> DataFrame:
    """``length, rank, sequence_id, offset``: one row per planned place."""
    schema = "length bigint, first bigint, bins bigint, per bigint, bin bigint, at bigint"
    table = spark.createDataFrame(runs, schema)
    step = F.greatest(F.lit(1), (F.lit(_SLOTS_PER_ROW) / F.col("per")).cast("bigint"))
    # Long runs are split into several rows, which are dealt out before they grow.
    begins = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bins") - 1, step))
    split = table.withColumn("step", step).withColumn("b0", begins)
    dealt = split.repartition("length", "first", "b0")
    each = dealt.withColumn("b", F.explode(F.sequence("b0", F.least(F.col("b0") + F.col("step"), "bins") - 1)))
    each = each.withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("per") - 1)))
    return each.select(
        "length",
        (F.col("first") + F.col("b") * F.col("per") + F.col("j")).alias("rank"),
        (F.col("bin") + F.col("b")).alias("sequence_id"),
        (F.col("at") + F.col("j") * F.col("length")).alias("offset"),
    )


def pack(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """Pack every document of ``documents``; one row per piece, with its sequence and its place there.

    Columns: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. A
    NULL or empty text is the end id alone. Longer documents than ``capacity``
    are cut, the first piece taking the remainder. Repeated rows, and rows
    without an id, are packed like any other. An empty table gives no rows.
    """
    spark = documents.sparkSession
    pieces = written(token_pieces(documents, capacity, vocabulary), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = [F.col("doc_id"), F.col("piece"), F.col("start"), F.col("ids_crc32")]
    ranked = with_position(pieces, ["length"], order, position="rank").withColumn("rank", F.col("rank") - 1)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    # The slots grow with the pieces, which their statistics do not show: never broadcast them.
    places = slots(spark, plan(histogram, capacity)).hint("merge")
    return ranked.join(places, ["length", "rank"]).select(*names)
