"""Toxic passages as maximum-scoring segments of token log-odds.

A token's score is the log-odds that a token like it comes from a toxic text,
with nested Dirichlet priors: the prior of a word is what its first seven letters
say, whose prior is what the first six say, and so on down to the share of all
toxic tokens; so inflected and compound forms that were never seen inherit the
score of their stem. A margin makes the expected score
negative, so that in clean text sums of scores drift down and every maximal
segment above zero (Ruzzo and Tompa, 1999) is a passage that stands out. By the
extreme-value law of such segments (Karlin and Altschul, 1990) a clean text of n
tokens is expected to hold E = K * n * exp(-lambda * s) segments of score s or
more. A segment is worth log(1 + 1 / E); the worths of a text's segments are
summed, and a logistic curve maps the logarithm of the sum to a probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import fold_of, sampled_texts, sliced, written

THRESHOLD = 0.7
PREFIXES = (3, 4, 5, 6, 7)
PRIOR = 20.0
MARGIN = 1.5
# Added to a text's worth, so that texts without a segment have a logarithm.
FLOOR = 1e-3
# Bound of what is learned from: labelled texts. Words and prefixes that get a score of their own are some of theirs.
MAX_LABELLED = 20_000
_CACHED = 100_000
_EDGES = " \t\n.,;:!?\"'()[]{}<>*%$&#|-_/\\"


def clean(word: str) -> str:
    return word.lower().strip(_EDGES)


class _Scores(dict):
    """Score of each written form of a word, worked out when it is first met."""

    def __init__(self, words: dict[str, float], prefixes: dict[str, float], base: float):
        super().__init__()
        self._words, self._prefixes, self._base = words, prefixes, base

    def __missing__(self, written_form: str) -> float:
        if len(self) >= _CACHED:
            self.clear()
        word = clean(written_form)
        score = self._words.get(word)
        if score is None:
            known = (self._prefixes.get(word[:k]) for k in reversed(PREFIXES) if k < len(word))
            score = next((s for s in known if s is not None), self._base)
        self[written_form] = score
        return score


def maximal_segments(scores: list[float]) -> list[tuple[float, int, int]]:
    """Score, start and end of all maximal-scoring segments, in one pass (Ruzzo and Tompa).

    Every candidate knows the nearest one before it with a smaller sum on its left, so the search for such a one
    skips all between. Once the running sum is below all left sums, nothing can join the candidates any more, and
    they are set aside.
    """
    done: list[tuple[float, int, int]] = []
    open_: list[tuple[float, float, int, int, int]] = []  # sum before, sum after, start, end, place of the smaller one
    total = 0.0
    for i, s in enumerate(scores):
        left, total = total, total + s
        if s <= 0:
            continue
        start = i
        while True:
            j = len(open_) - 1
            while j >= 0 and open_[j][0] >= left:
                j = open_[j][4]
            if j < 0:
                done += [(after - before, a, b) for before, after, a, b, _ in open_]
                open_.clear()
            elif open_[j][1] < total:
                left, start = open_[j][0], open_[j][2]
                del open_[j:]
                continue
            open_.append((left, total, start, i + 1, j))
            break
    return done + [(after - before, a, b) for before, after, a, b, _ in open_]


def _softplus(x: float) -> float:
    return x if x > 30 else math.log1p(math.exp(x))


@dataclass
class Model:
    """Scores of words and prefixes, the extreme-value law, and the map from worth to probability."""

    words: dict[str, float] = field(default_factory=dict)
    prefixes: dict[str, float] = field(default_factory=dict)
    base: float = -MARGIN
    decay: float = 1.0
    scale: float = 1.0
    slope: float = 1.0
    intercept: float = -1.0

    def scorer(self) -> _Scores:
        return _Scores(self.words, self.prefixes, self.base)

    def passages(self, scores: list[float]) -> list[tuple[float, int, int]]:
        """Worth, first and last token of every maximal segment."""
        if not scores or max(scores) <= 0:
            return []
        limit = math.log(self.scale * len(scores))
        return [(_softplus(self.decay * s - limit), a, b) for s, a, b in maximal_segments(scores)]

    def probability(self, worth: float) -> float:
        x = self.slope * math.log(worth + FLOOR) + self.intercept
        return 1.0 / (1.0 + math.exp(-max(min(x, 500.0), -500.0)))


def _decay(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of E[exp(x * score)] = 1."""
    if not (scores > 0).any():
        return 1.0
    low, high = 0.0, 1.0
    mean = lambda x: float(np.sum(weights * np.exp(np.minimum(x * scores, 700.0))) / weights.sum())
    while mean(high) < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) < 1 else (low, mid)
    return high


def _logistic(x: np.ndarray, positive: np.ndarray, negative: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic fit to counts at ``x``, with half a case added at both ends."""
    x = np.concatenate([x, [math.log(FLOOR), max(x.max(initial=0.0), 1.0)]])
    p, n = np.concatenate([positive, [0.0, 0.5]]), np.concatenate([negative, [0.5, 0.0]])
    a, b = 1.0, -1.0
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([np.sum((p - (p + n) * q) * x), np.sum(p - (p + n) * q)])
        w = (p + n) * q * (1 - q)
        h = np.array([[np.sum(w * x * x), np.sum(w * x)], [np.sum(w * x), np.sum(w)]]) + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, g - 1e-2 * np.array([a, b]))
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def _worths(texts: DataFrame, model: Model, keep: str, kind: str) -> DataFrame:
    """``<keep>, worth`` of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer().__getitem__
        for batch in sliced(batches):
            worth = [sum(w for w, _, _ in model.passages(list(map(score, t.split())))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(worth, pa.float64())], names=[keep, "worth"])

    return texts.select(keep, "text").mapInArrow(run, f"{keep} {kind}, worth double")


def fit(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Learn from at most ``max_labelled`` texts with a training label.

    Held-out rows are never read. Without labels of both kinds the model knows
    no toxic word and finds every text alike. Words and prefixes whose score is
    near that of their shorter prefix inherit it; all others of the sample are collected.
    """
    texts = written(sampled_texts(documents, labels, "toxic", max_labelled), "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            counts: dict[str, list[int]] = {}
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for w in {clean(w) for w in text.split()}:
                    counts.setdefault(w, [0, 0])[label > 0] += 1
            arrays = [pa.array(list(counts), pa.string()), *[pa.array([c[k] for c in counts.values()], pa.int64()) for k in (0, 1)]]
            yield pa.RecordBatch.from_arrays(arrays, names=["word", "c0", "c1"])

    sums = [F.sum("c0").alias("c0"), F.sum("c1").alias("c1")]
    # Copies of a text count once, or all its words would look like its label.
    counted = texts.select("text", "label").distinct().mapInArrow(count, "word string, c0 bigint, c1 bigint")
    words = written(counted.groupBy("word").agg(*sums), "toxicity-words")
    n0, n1 = words.agg(F.coalesce(F.sum("c0"), F.lit(0)), F.coalesce(F.sum("c1"), F.lit(0))).first()
    if not n0 or not n1:
        return Model()
    share = n1 / (n0 + n1)
    odds = math.log(share / (1 - share))

    def log_odds(p):
        return F.log(p / (1 - p)) - odds - MARGIN

    posterior = (F.col("c1") + PRIOR * F.col("prior")) / (F.col("c0") + F.col("c1") + PRIOR)

    def judged(counts: DataFrame, name: str) -> DataFrame:
        """Posterior share, score, and how far the score is from that of the shorter prefix."""
        found = counts.withColumn("p", posterior).withColumn("score", log_odds(F.col("p")))
        return found.withColumn("gap", F.abs(F.col("score") - log_odds(F.col("prior")))).withColumnRenamed(name, "key")

    def kept(rows: DataFrame) -> dict[str, float]:
        # Bounded by the distinct words of the labelled sample.
        return {r["key"]: r["score"] for r in rows.filter("gap > 0.2").select("key", "score").collect()}

    model, parents = Model(), None
    level = words.withColumn("prior", F.lit(share))
    for k in PREFIXES:
        cut = words.filter(F.length("word") > k).withColumn("prefix", F.substring("word", 1, k)).groupBy("prefix").agg(*sums)
        if parents is None:
            cut = cut.withColumn("prior", F.lit(share))
        else:
            cut = cut.withColumn("up", F.substring("prefix", 1, k - 1)).join(parents, "up").drop("up")
        rows = written(judged(cut, "prefix"), "toxicity-prefixes")
        model.prefixes |= kept(rows)
        parents = rows.select(F.col("key").alias("up"), F.col("p").alias("prior"))
        # A word's prior is the longest prefix that is shorter than the word.
        here = F.when(F.length("word") > k, F.substring("word", 1, k))
        level = level.withColumn("up", here).join(parents.withColumnRenamed("prior", "longer"), "up", "left")
        level = level.withColumn("prior", F.coalesce("longer", "prior")).drop("up", "longer")
    scored = written(judged(level, "word"), "toxicity-scored")
    model.words = kept(scored)

    rounded = F.round("score", 1)
    # What clean texts are expected to hold, words that were only seen in toxic ones included.
    clean_count = (F.col("c0") + F.col("c1")) * (1 - F.col("p"))
    dist = scored.groupBy(rounded.alias("s")).agg(F.sum(clean_count).alias("n")).collect()  # a few hundred bins
    scores, weights = np.array([r["s"] for r in dist]), np.array([r["n"] for r in dist], float)
    model.decay = _decay(scores, weights)
    drift = -float(np.sum(scores * weights) / weights.sum())
    model.scale = max(model.decay * max(drift, 0.1), 1e-3)

    step = 0.05
    worth = _worths(texts, model, "label", "int").withColumn("bin", F.floor(F.log(F.col("worth") + FLOOR) / step))
    bins = worth.groupBy("bin").agg(F.sum((F.col("label") > 0).cast("int")).alias("p"), F.count(F.lit(1)).alias("n")).collect()
    x = np.array([(r["bin"] + 0.5) * step for r in bins])
    p, n = np.array([r["p"] for r in bins], float), np.array([r["n"] for r in bins], float)
    model.slope, model.intercept = _logistic(x, p, n - p)
    return model


def score(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``documents``.

    A NULL or empty text has no segment and gets the score of a text without
    toxic words. Repeated rows give repeated results; a row without an id is
    scored and not held out. Other columns are ignored.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    worth = _worths(texts, model, "doc_id", kind)
    x = model.slope * F.log(F.col("worth") + FLOOR) + model.intercept
    probability = 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(500.0)), F.lit(-500.0))))
    return worth.select(
        "doc_id",
        F.coalesce(fold_of(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"),
        probability.alias("score"),
        (probability >= THRESHOLD).cast("int").alias("predicted"),
    )


def passages(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id, start, end, worth``: every maximal segment, as a range of white-space words.

    A worth above 0.7 means less than one such segment expected in a clean text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_score = model.scorer().__getitem__
        for batch in sliced(batches):
            found = [(i, *p) for i, t in enumerate(batch.column(1).to_pylist()) for p in model.passages(list(map(word_score, t.split())))]
            ids = batch.column(0).take(pa.array([f[0] for f in found], pa.int64()))
            cols = [pa.array([f[k] for f in found], t) for k, t in ((2, pa.int64()), (3, pa.int64()), (1, pa.float64()))]
            yield pa.RecordBatch.from_arrays([ids, *cols], names=["doc_id", "start", "end", "worth"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(run, f"doc_id {kind}, start bigint, end bigint, worth double")


def without_toxic(documents: DataFrame, model: Model) -> DataFrame:
    """The rows of ``documents`` that score below the threshold, with all their columns."""
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_score = model.scorer().__getitem__
        for batch in sliced(batches):
            texts = batch.column(at).to_pylist()
            worth = (sum(w for w, _, _ in model.passages(list(map(word_score, (t or "").split())))) for t in texts)
            yield batch.filter(pa.array([model.probability(w) < THRESHOLD for w in worth], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
