"""Quality selection by importance resampling (Xie et al., 2023).

A target model (texts labelled as good) and a raw model (all texts) count
hashed n-grams over one set of buckets. A text's importance weight is the
product of its n-grams' likelihood ratios, and k texts are drawn without
replacement, in proportion to the weights, as the k largest of log weight plus
Gumbel noise. The noise is a hash of the id, so a repeated run draws the same.

The tokens are word shapes, not words: the classes of characters in the order
they come, a length class, and whether the word repeats the one before. Names
and topics then don't matter, and a text that is copied a thousand times does
not become unlikely because the raw model has seen it too often.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import fresh, sampled_texts, sliced, written

BUCKETS = 1 << 16
SMOOTHING = 1.0
MAX_LABELLED = 20_000
# Log weight below zero by which a text may miss being likelier under the target and still count towards k.
TOLERANCE = 4.0
_CACHED = 100_000
_LONGEST = 32
_DEALT = 20_000


def shape(word: str) -> str:
    """Character classes of a word, runs as one, and a length class."""
    out, last = [], ""
    for c in word:
        kind = "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "x" if c.isalpha() else c
        if kind != last:
            out.append(kind)
            last = kind
    return "".join(out) + str(len(word) // 8)


def tokens(text: str) -> list[str]:
    """White-space words; longer ones than ``_LONGEST``, as in scripts without spaces, in pieces of that length."""
    words = text.split()
    if max(map(len, words), default=0) <= _LONGEST:
        return words
    return [w[at : at + _LONGEST] for w in words for at in range(0, len(w), _LONGEST)]


class _Shapes(dict):
    """A stable number for the shape of each written form."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= _CACHED:
            self.clear()
        self[word] = found = xxhash.xxh32_intdigest(shape(word))
        return found


def features(texts: list[str], shapes: _Shapes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams (one and two tokens) of the texts, one text after another, and their number per text."""
    parts, sizes = [], []
    number = shapes.__getitem__
    for text in texts:
        words = tokens(text)
        n = len(words)
        ids = np.fromiter(map(number, words), np.uint64, n)
        again = np.zeros(n, np.uint64)
        if n > 1:
            again[1:] = [a == b for a, b in zip(words, words[1:])]
        ids = ids * np.uint64(2) + again
        mixed = ids * np.uint64(0x9E3779B97F4A7C15)
        pairs = (mixed[:-1] ^ (ids[1:] * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0x165667B19E3779F9)
        parts += [mixed >> np.uint64(48), pairs >> np.uint64(48)]
        sizes.append(max(2 * n - 1, 0))
    joined = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    return joined.astype(np.int64) % BUCKETS, np.array(sizes, np.int64)


def log_weights(texts: list[str], shapes: _Shapes, ratios: np.ndarray) -> np.ndarray:
    """Log importance weight of each text; 0 for a text without words."""
    buckets, sizes = features(texts, shapes)
    sums = np.concatenate([[0.0], np.cumsum(ratios[buckets])])
    ends = np.cumsum(sizes)
    return sums[ends] - sums[ends - sizes]


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How often each bucket occurs in the whole of ``texts``; one sum per bucket and task is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes, counts = _Shapes(), np.zeros(BUCKETS, np.int64)
        for batch in sliced(batches):
            counts += np.bincount(features(batch.column(0).to_pylist(), shapes)[0], minlength=BUCKETS)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["bucket", "n"])

    text = texts.select(F.coalesce("text", F.lit("")).alias("text"))
    counted = text.mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(BUCKETS)
    for r in counted.collect():  # at most BUCKETS rows
        counts[r["bucket"]] = r["n"]
    return counts


def fit(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> np.ndarray:
    """Log-likelihood ratio of each bucket, target against raw.

    The target is at most ``max_labelled`` training labels' texts with quality 1;
    the raw model counts all of ``documents``. Without such labels all ratios are 0.
    """
    sample = sampled_texts(documents, labels, "quality", max_labelled)
    target = bucket_counts(sample.filter("label = 1"))
    if not target.any():
        return np.zeros(BUCKETS)
    raw = bucket_counts(documents)
    # The raw counts lend both models their smoothing, so that an unseen bucket says nothing.
    prior = (raw + SMOOTHING) / (raw.sum() + SMOOTHING * BUCKETS)
    weight = SMOOTHING * BUCKETS
    return np.log((target + weight * prior) / (target.sum() + weight)) - np.log(prior)


def gumbel(doc_id: Column) -> Column:
    """Standard Gumbel noise that depends on the id only."""
    uniform = (F.shiftrightunsigned(F.xxhash64(doc_id.cast("string"), F.lit("gumbel")), 11) + 0.5) / float(1 << 53)
    return -F.log(-F.log(uniform))


def weights(documents: DataFrame, ratios: np.ndarray) -> DataFrame:
    """``doc_id, log_weight, sort_key`` of every row; the key is the log weight with Gumbel noise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = _Shapes()
        for batch in sliced(batches):
            found = log_weights(batch.column(1).to_pylist(), shapes, ratios)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "log_weight"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    weighed = texts.mapInArrow(run, f"doc_id {kind}, log_weight double")
    return weighed.withColumn("sort_key", F.col("log_weight") + gumbel(F.col("doc_id")))


def kth_largest(keys: DataFrame, column: str, k: int, bins: int = 1000) -> float:
    """The k-th largest value of ``column``, exactly, from histograms of ever smaller ranges.

    The driver sees ``bins`` counts, and in the end at most ``_DEALT`` values.
    """
    low, high, n = keys.agg(F.min(column), F.max(column), F.count(column)).first()
    if k <= 0 or n == 0:
        return math.inf
    if k >= n:
        return low
    inside = keys.select(F.col(column).alias("x")).filter(F.col("x").isNotNull())
    while n > _DEALT and low < high:
        width = (high - low) / bins
        if low + width <= low:
            break
        at = F.least(F.floor((F.col("x") - low) / width), F.lit(bins - 1)).alias("bin")
        found = inside.groupBy(at).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        for r in sorted(found.collect(), key=lambda r: -r["bin"]):
            if k <= r["n"]:
                low, high, n = r["low"], r["high"], r["n"]
                break
            k -= r["n"]
        inside = inside.filter(F.col("x").between(low, high))
    if low == high:
        return low
    return sorted((r["x"] for r in inside.collect()), reverse=True)[k - 1]


def cutoff(weighed: DataFrame, k: int | None = None, tolerance: float = TOLERANCE) -> float:
    """The smallest key that is drawn.

    ``k`` defaults to the number of texts whose log weight is above ``-tolerance``:
    those that the target model finds likelier than the raw one, or nearly so.
    """
    if k is None:
        k = weighed.filter(F.col("log_weight") > -tolerance).count()
    return kth_largest(weighed, "sort_key", k)


def resample(documents: DataFrame, ratios: np.ndarray, k: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """``doc_id, log_weight, sort_key, selected`` of every row of ``documents``.

    ``selected`` is 1 for the k largest keys; rows that tie with the last one,
    such as repeated rows, are drawn with it. A NULL or empty text has log weight
    0. Other columns are ignored, and an empty table gives an empty result.
    """
    found = written(weights(documents, ratios), "importance")
    return found.withColumn("selected", (F.col("sort_key") >= cutoff(found, k, tolerance)).cast("int"))


def selected_rows(documents: DataFrame, ratios: np.ndarray, k: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """The rows of ``documents`` that ``resample`` selects, with all their columns and without moving their texts."""
    least = cutoff(written(weights(documents, ratios), "importance"), k, tolerance)
    text, noise = documents.columns.index("text"), len(documents.columns)
    column = fresh(documents, "gumbel")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = _Shapes()
        for batch in sliced(batches):
            texts = [t or "" for t in batch.column(text).to_pylist()]
            keys = log_weights(texts, shapes, ratios) + batch.column(noise).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(keys >= least))

    noisy = documents.withColumn(column, gumbel(F.col("doc_id")))
    return noisy.mapInArrow(run, noisy.schema).select(*documents.columns)
