"""Cross-entropy difference (Moore and Lewis, 2010) with matched bigram models.

A target model (texts labelled as good) and a background model (all texts) are
bigram models over one vocabulary, all words of the corpus, with the same
smoothing. A document's score is the mean over its tokens of target loss minus
background loss: low scores are more like the target than the corpus is. Counts
of words and bigrams are exact and cover the whole corpus. Their tables are
partitioned by 64-bit hashes and never leave the executors; a text meets the
counts of its words and bigrams through the dictionary of its slab.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm import slabs
from quillgrid.llm.common import training_labels, written

# Weight of the unigram distribution in a bigram's, and of the uniform one in a unigram's.
BIGRAM_PRIOR = 200.0
UNIGRAM_PRIOR = 1000.0
SLAB_BYTES = 6 << 20
# The word in front of a text's first; no white-space word equals it.
_START = " "
_MIX = np.uint64(0x9E3779B97F4A7C15)
_REST = np.uint64((1 << 48) - 1)


def words_of(text: str) -> list[str]:
    return text.lower().split()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class _Units:
    """Distinct words and bigrams of a slab, by bucket and hash, and where each token finds its own."""

    def __init__(self, raw: bytes, sizes: np.ndarray, n: int):
        known = {_START: 0}
        rows, self.tokens, at = [], np.zeros(len(sizes), np.int64), 0
        for i, size in enumerate(sizes.tolist()):
            words = words_of(raw[at : at + size].decode())
            at += size
            self.tokens[i] = len(words)
            rows.append(np.fromiter([known.setdefault(w, len(known)) for w in words], np.int32, len(words)))
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in known), np.uint64, len(known))
        self.word = np.concatenate(rows) if rows else np.empty(0, np.int32)
        ends = np.cumsum(self.tokens)
        self.first = (ends - self.tokens)[self.tokens > 0]
        del rows
        self.before = np.append(np.int32(0), self.word[:-1])[: len(self.word)]
        self.before[self.first] = 0
        joint = hashes[self.before]
        joint *= _MIX
        joint += hashes[self.word]
        pairs, places = np.unique(_mixed(joint), return_inverse=True)
        self.pair = places.astype(np.int32)  # numbers of 64 bits would be most of a task's memory
        del joint, places
        self.words = self._dealt(_mixed(hashes), n)
        self.pairs = self._dealt(pairs, n)

    @staticmethod
    def _dealt(h: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
        bucket, rest = (h % np.uint64(n)).astype(np.int64), (h // np.uint64(n)) & _REST
        order = np.lexsort((rest, bucket))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return order, place, bucket[order], rest[order]

    def pieces(self, good: np.ndarray, n: int) -> list[bytes]:
        """By bucket the words and bigrams with their counts in all texts and in the good ones."""
        weight = np.repeat(good.astype(float), self.tokens)
        parts = []
        for numbers, (order, _, bucket, rest), first in ((self.word, self.words, True), (self.pair, self.pairs, False)):
            counts = [np.bincount(numbers, w, len(order)).astype(np.int64) for w in (None, weight)]
            if first:  # a text with words begins once
                counts[0][0], counts[1][0] = len(self.first), int(good[self.tokens > 0].sum())
            parts.append([(rest[a:b], *(c[order[a:b]] for c in counts)) for a, b in slabs.bucket_ranges(bucket, n)])
        return [slabs.pack_arrays(*(x for h, *c in of for x in (*slabs.pack_sorted(h), *(y.astype("<i8") for y in c)))) for of in zip(*parts)]


def _sums(pieces: Iterator) -> Iterator:
    """Per piece the counts in the whole corpus; and once, as slab -1, the number of words and the sums of bigram counts."""
    held = []
    for slab, piece in pieces:
        parts = slabs.unpack_arrays(piece, *["<u2", "<u2", "<u2", "<i8", "<i8"] * 2)
        held.append((slab, *[(slabs.unpack_sorted(*parts[i : i + 3]), *parts[i + 3 : i + 5]) for i in (0, 5)]))
    answers, totals = [], []
    for kind in (1, 2):
        keys, where = np.unique(np.concatenate([h[kind][0] for h in held]), return_inverse=True)
        sums = []
        for c in (1, 2):
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, where, np.concatenate([h[kind][c] for h in held]))
            sums.append(total)
        ends = np.cumsum([len(h[kind][0]) for h in held])
        answers.append([[s[w] for s in sums] for w in np.split(where, ends[:-1])])
        totals.append((len(keys), *(int(s.sum()) for s in sums)))
    yield -1, f"{totals[0][0]},{totals[1][1]},{totals[1][2]}".encode()
    for (slab, *_), words, pairs in zip(held, *answers):
        yield slab, slabs.pack_arrays(*(x.astype("<i8") for x in (*words, *pairs)))


def score(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, target_loss, background_loss, score`` of every row of ``documents``; losses are means in nats.

    The target is the texts of all training labels of quality 1, and the
    background all texts. Bigrams begin with a start mark.
    A NULL or empty text has no token, losses and score 0. Without a target its
    model is uniform. Repeated rows give repeated results and count as often as
    they occur; rows without an id are scored too; an id labelled twice counts
    as good if one label does; other columns are ignored; an empty table gives
    no rows.
    """
    spark = documents.sparkSession
    n = slabs.buckets(spark)
    kind = documents.schema["doc_id"].dataType.simpleString()
    good = training_labels(labels, "quality").filter("label = 1").select("doc_id")
    table = written(slabs.text_slabs(documents, size=SLAB_BYTES), "lm-slabs")
    # Only ids meet the labels. What goes back to the texts is a place per good text, few bytes enough for Spark to
    # broadcast them; no text moves before its slab is scored.
    placed = table.select("slab", F.posexplode("ids").alias("place", "doc_id")).join(good, "doc_id")
    places = written(placed.groupBy("slab").agg(F.collect_list("place").alias("good")), "lm-places")
    marked = table.select("slab", "sizes", "raw").join(places, "slab", "left")

    def units(raw: bytes, sizes: np.ndarray, places: list | None) -> list[bytes]:
        good = np.zeros(len(sizes), bool)
        good[places or []] = True
        return _Units(raw, sizes, n).pieces(good, n)

    values = written(slabs.look_up(slabs.slab_units(marked, units), _sums, n), "lm-counts")
    numbers = F.split(F.col("value").cast("string"), ",")
    totals = [F.coalesce(F.sum(numbers[i].cast("bigint")), F.lit(0)) for i in range(3)]
    distinct, every, good = values.filter("slab < 0").agg(*totals).first()
    distinct = max(distinct - 1, 1)  # without the start mark

    def losses(c: int, total: int, word, before, pair) -> np.ndarray:
        p = (word + UNIGRAM_PRIOR / distinct) / (total + UNIGRAM_PRIOR)
        return -np.log((pair + BIGRAM_PRIOR * p) / (before + BIGRAM_PRIOR))

    def finish(_name: int, ids: pa.Array, sizes: np.ndarray, raw: bytes, counts: list[bytes]):
        found = _Units(raw, sizes, n)
        parts = [np.concatenate(x) for x in zip(*(slabs.unpack_arrays(v, *["<i8"] * 4) for v in counts))]
        ends, means = np.cumsum(found.tokens), []
        word, pair = found.words[1][found.word], found.pairs[1][found.pair]
        before = found.words[1][found.before]
        for c, total in ((0, every), (1, good)):
            per_token = losses(c, total, parts[c][word], parts[c][before], parts[2 + c][pair])
            sums = np.concatenate([[0.0], np.cumsum(per_token)])
            means.append((sums[ends] - sums[ends - found.tokens]) / np.maximum(found.tokens, 1))
        columns = [pa.array(found.tokens), pa.array(means[1]), pa.array(means[0]), pa.array(means[1] - means[0])]
        yield pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    schema = f"doc_id {kind}, n_tokens bigint, target_loss double, background_loss double, score double"
    return slabs.joined(table, [values.filter("slab >= 0")], finish, schema, n)
