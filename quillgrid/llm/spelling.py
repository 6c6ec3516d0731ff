"""Spelling variants grouped by asymmetric q-chunks.

Two words within one edit of each other: of the longer one two disjoint chunks
are taken, the first floor(n / 2) letters and the next ones. One edit spares one
of them, which then is a gram of the other word at the same place or one place
beside it. So the longer word contributes its two chunks, the other its grams
with their places, and both meet in an equi-join on gram, length and place
(Qin et al., "Efficient exact edit similarity query processing with the
asymmetric signature scheme", SIGMOD 2011). An exact distance follows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import sliced, written

LETTERS = 6
OCCURRENCES = 5
# A word is a variant of a near one that is so many times as frequent.
RATIO = 5
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
# Distinct words that a worker holds before it hands their counts on.
_HELD = 200_000


def word_counts(
    documents: DataFrame, letters: int = LETTERS, occurrences: int = OCCURRENCES, change: Callable[[str, list[str]], list[str]] | None = None
) -> DataFrame:
    """``word, n``: runs of Latin letters, A-Z in lower case, of at least ``letters`` letters, and how often they occur.

    ``change`` may replace the runs of a text, given its id as text; runs of all
    lengths are passed to it. Workers add up counts before the shuffle, so a word
    comes once from each stretch of texts, however frequent it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def rows():
            words = [w for w in held if len(w) >= letters]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([held[w] for w in words], pa.int64())], names=["word", "n"])

        for batch in sliced(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = _RUN.findall(text.encode().lower().decode())  # bytes: A-Z only
                held.update(change(doc, found) if change else found)
                if len(held) > _HELD:
                    yield rows()
                    held.clear()
        yield rows()

    texts = documents.filter(F.col("text").isNotNull()).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")
    counts = texts.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") >= occurrences)


def near_pairs(words: DataFrame) -> DataFrame:
    """``word, other`` in both directions: distinct words of ``words`` (column ``word``) that one edit turns into each other.

    Words need two letters at least; shorter ones have no two chunks and are left out.
    """
    size = F.char_length("word")
    q = F.floor(size / 2).cast("int")

    def key(length: Column, gram: Column, place: Column) -> Column:
        return F.struct(length.alias("length"), gram.alias("gram"), place.cast("int").alias("place"))

    def chunks(_: Column) -> Column:
        out = []
        for start in (F.lit(0), F.col("q")):
            # A gram may lie one place beside the chunk that it equals.
            out += [key(F.col("size"), F.substr("word", start + 1, F.col("q")), start + shift) for shift in (-1, 0, 1)]
        return F.array(*out)

    def grams(longer: int) -> Column:
        length = F.col("size") + longer
        width = F.floor(length / 2).cast("int")
        places = F.array_distinct(F.array(*[x + s for x in (F.lit(0), width) for s in (-1, 0, 1)]))
        fitting = F.filter(places, lambda p: (p >= 0) & (p + width <= F.col("size")))
        return F.transform(fitting, lambda p: key(length, F.substr(F.col("word"), p + 1, width), p))

    sized = words.select("word", size.cast("int").alias("size"), q.alias("q")).filter("size >= 2")
    long = sized.select(F.col("word").alias("long"), F.explode(chunks(F.col("word"))).alias("key"))
    short = sized.select(F.col("word").alias("short"), F.explode(F.concat(grams(0), grams(1))).alias("key"))
    met = long.join(short, "key").filter((F.char_length("long") > F.char_length("short")) | (F.col("long") > F.col("short")))
    near = met.select("long", "short").filter(F.levenshtein("long", "short", 1) == 1).distinct()
    both = F.explode(F.array(F.struct(F.col("long").alias("word"), F.col("short").alias("other")), F.struct(F.col("short").alias("word"), F.col("long").alias("other"))))
    return near.select(both.alias("p")).select("p.word", "p.other")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of every row of ``forms`` (``word, form``): the word at the end of its forms.

    Forms ascend in frequency, so they have no cycles. Each round doubles the step; the rounds grow with the
    logarithm of the longest way.
    """
    steps = written(forms.select("word", F.col("form").alias("root")), "spelling-steps")
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = steps.join(ahead, "root", "left")
        moved = written(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-steps")
        steps = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return steps


def group_variants(counts: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every row of ``counts`` (``word, n``; words are distinct).

    A word's form is its near word of largest ``n`` (ties: the smallest in
    code-point order), if that is at least ``ratio`` times as frequent; else it
    is NULL, and so is ``form_n``. ``root`` follows forms to the last, and
    ``n_near`` counts all near words. An empty table gives no rows.
    """
    counts = written(counts.select("word", "n"), "spelling-counts")
    named = counts.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    # The smallest of these is the near word of largest n.
    rank = F.struct((-F.col("other_n")).alias("rank"), F.col("other").alias("word"))
    best = near_pairs(counts).join(named, "other").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(rank).alias("best"))
    joined = counts.join(best, "word", "left")
    chosen = -F.col("best.rank") >= ratio * F.col("n")
    found = written(
        joined.select(
            "word",
            F.when(chosen, F.col("best.word")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(chosen, -F.col("best.rank")).alias("form_n"),
        ),
        "spelling-forms",
    )
    ends = roots(found.filter("form IS NOT NULL"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def with_misspellings(doc: str, runs: list[str]) -> list[str]:
    """The runs of a text, of which one in 199, by the CRC-32 of id and run, loses a letter."""
    seed = zlib.crc32(f"{doc}:".encode())
    out = []
    for run in runs:
        h = zlib.crc32(run.encode(), seed)
        if h % 199 == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        out.append(run)
    return out


def variants(documents: DataFrame) -> DataFrame:
    """Groups of the words of all texts of ``documents``, with the planted misspellings of ``with_misspellings``.

    A NULL text has no words, and a row without an id counts with an empty id.
    Repeated rows count as often as they occur. Other columns are ignored.
    """
    return group_variants(word_counts(documents, change=with_misspellings))
