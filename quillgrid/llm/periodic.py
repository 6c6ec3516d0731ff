"""Periodic runs of words, found by uniting suffix classes from the longest common prefix down.

Suffixes of one text that share their first l words are a class. Uniting
neighbours of the suffix order by decreasing common prefix, as Kruskal unites
edges, goes through all classes of all l. Each class keeps its positions in
order. When two classes meet at prefix l, positions u < v that are neighbours for
the first time agree in exactly l words. If v - u is at most l, the stretch of
v - u + l words from u on has the period v - u, and no smaller one: a smaller
period would have put a position between them earlier. It is a whole run if the
word before it breaks the period.

A run of at least ``LENGTH`` words and ``EXPONENT`` periods makes two positions
agree in 16 words or more. So only texts that hold some 16 words twice are
sorted, and only neighbours with so long a prefix are united.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import sliced

LENGTH = 24
EXPONENT = 3
# Words of the texts that are handled together; a longer text is handled alone.
_TOGETHER = 1 << 19
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def least_prefix(length: int = LENGTH, exponent: int = EXPONENT) -> int:
    """Words in which the first two periods of the shortest run agree: a run of period q agrees in its length - q words."""
    return max(min(max(length - q, (exponent - 1) * q) for q in range(1, length + 1)), 1)


def _repeats(numbers: np.ndarray, owner: np.ndarray, gram: int) -> np.ndarray:
    """Owners (texts) that hold some ``gram`` words twice; equal hashes of different words may add some.

    ``gram`` is a power of two.
    """
    if len(numbers) < gram:
        return np.empty(0, np.int64)
    h = (numbers.astype(np.uint64) + np.uint64(1)) * _MULTIPLIER
    h ^= h >> np.uint64(29)
    size, factor = 1, int(_MULTIPLIER)
    while size < gram:
        h = h[:-size] * np.uint64(factor) + h[size:]
        factor = factor * factor % (1 << 64)
        size *= 2
    mine = owner[: len(h)]
    whole = mine == owner[gram - 1 :]
    h = (h ^ (h >> np.uint64(31))) * _MULTIPLIER + mine.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    h, mine = h[whole], mine[whole]
    order = np.argsort(h)
    h, mine = h[order], mine[order]
    twice = (h[1:] == h[:-1]) & (mine[1:] == mine[:-1])
    return np.unique(mine[1:][twice])


def suffix_order(numbers: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of all suffixes, those of one text together, and the words that each shares with the one before it.

    Texts follow one another in ``numbers``; ``owner`` ascends. Prefixes are doubled, and only suffixes
    whose prefix is not alone in its text are sorted again.
    """
    n = len(numbers)
    end = np.searchsorted(owner, owner, "right")
    _, first = np.unique(owner.astype(np.int64) * (int(numbers.max(initial=0)) + 1) + numbers, return_inverse=True)
    order = np.argsort(first, kind="stable")
    starts = np.flatnonzero(np.diff(first[order], prepend=-1))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(starts, np.diff(np.append(starts, n)))
    levels, k = [rank.astype(np.int32 if n < 1 << 31 else np.int64)], 1
    while True:
        here = rank[order]
        alone = np.diff(here, prepend=-1, append=n) != 0
        open_ = np.flatnonzero(~(alone[:-1] & alone[1:]))  # places in the order that a group of two or more holds
        if not len(open_):
            break
        at = order[open_]
        ahead = at + k
        inside = ahead < end[at]
        second = np.where(inside, rank[np.minimum(ahead, n - 1)] + 1, 0)
        by = np.lexsort((second, here[open_]))
        at, second, group = at[by], second[by], here[open_]
        order[open_] = at
        fresh = (np.diff(group, prepend=-1) != 0) | (np.diff(second, prepend=-1) != 0)
        begin = np.flatnonzero(fresh)
        rank = rank.copy()
        rank[at] = np.repeat(open_[begin], np.diff(np.append(begin, len(at))))
        levels.append(rank.astype(levels[0].dtype))
        k *= 2
    left, right = order[:-1].copy(), order[1:].copy()
    shared = np.zeros(len(left), np.int64)
    live = np.flatnonzero(owner[left] == owner[right])
    for i in range(len(levels) - 1, -1, -1):
        a, b = left[live] + shared[live], right[live] + shared[live]
        inside = (a < end[left[live]]) & (b < end[right[live]])
        level = levels[i]
        equal = inside & (level[np.minimum(a, n - 1)] == level[np.minimum(b, n - 1)])
        shared[live[equal]] += 1 << i
    return order, np.concatenate([[0], shared]) if n else np.empty(0, np.int64)


def seeds(order: np.ndarray, shared: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """``u, v, l`` of positions that become neighbours in a class at prefix ``l``, with ``v - u <= l``."""
    places = np.flatnonzero(shared >= least)
    places = places[np.argsort(-shared[places], kind="stable")]
    parent: dict[int, int] = {}
    sets: dict[int, list[int]] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent[x]
        return root

    for x, y, size in zip(order[places - 1].tolist(), order[places].tolist(), shared[places].tolist()):
        a, b = find(x), find(y)
        one, two = sets.pop(a, None) or [a], sets.pop(b, None) or [b]
        if len(one) < len(two):
            a, b, one, two = b, a, two, one
        parent[b] = a
        where = [bisect_left(one, v) for v in two]
        for k, (i, v) in enumerate(zip(where, two)):
            # Within one gap only the first and the last get new neighbours.
            if i and v - one[i - 1] <= size and (not k or where[k - 1] < i):
                yield one[i - 1], v, size
            if i < len(one) and one[i] - v <= size and (k + 1 == len(two) or where[k + 1] > i):
                yield v, one[i], size
        if len(two) < 8:
            for v in two:
                insort(one, v)
        else:
            one += two
            one.sort()  # ascending stretches: linear
        sets[a] = one


def find_runs(
    numbers: np.ndarray, sizes: np.ndarray, length: int = LENGTH, exponent: int = EXPONENT
) -> dict[int, list[tuple[int, int, int]]]:
    """Runs ``start, length, period`` of the texts that have any, by the text's place; words are given as numbers.

    They are sorted by start, then period.
    """
    least = least_prefix(length, exponent)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    few = _repeats(numbers, owner, 1 << (least.bit_length() - 1))
    if not len(few):
        return {}
    taken = np.isin(owner, few)
    words, whose = numbers[taken], owner[taken]
    order, shared = suffix_order(words, whose)
    begins = np.searchsorted(whose, few)
    found: dict[int, set] = {}
    flat, begin_of = words.tolist(), dict(zip(few.tolist(), begins.tolist()))
    text_of = whose.tolist()
    for u, v, size in seeds(order, shared, least):
        period = v - u
        if period + size >= max(length, exponent * period):
            text = text_of[u]
            start = begin_of[text]
            if text_of[v] == text and (u == start or flat[u - 1] != flat[v - 1]):
                found.setdefault(text, set()).add((u - start, period + size, period))
    return {k: sorted(x, key=lambda r: (r[0], r[2])) for k, x in found.items()}


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words outside of all runs, and the first period of each run unless another run drops it."""
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def collapse(documents: DataFrame, length: int = LENGTH, exponent: int = EXPONENT) -> DataFrame:
    """``doc_id, runs, text`` of every row of ``documents``: its periodic runs, and its text with one period of each.

    A run is a stretch of words with a smallest period q that repeats at least
    ``exponent`` times and holds at least ``length`` words, as long as the
    period goes on. ``runs`` has its first word (from 0), its words and q, by
    start, then period. ``text`` joins the kept words by single spaces. A NULL
    or empty text has no runs and gives an empty text. Repeated rows and rows
    without an id are treated like any other, other columns are ignored, and an
    empty table gives no rows. A text is handled in one task; its memory grows
    with its words.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(ids: list[pa.Array], texts: list[list[bytes]], numbers: list[np.ndarray]):
            sizes = np.array([len(x) for x in numbers], np.int64)
            found = find_runs(np.concatenate(numbers), sizes, length, exponent)
            runs = [[{"start": s, "length": n, "period": q} for s, n, q in found.get(i, ())] for i in range(len(texts))]
            out = [b" ".join(kept_words(w, found[i]) if i in found else w).decode() for i, w in enumerate(texts)]
            columns = [pa.concat_arrays(ids), pa.array(runs, runs_type), pa.array(out, pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "runs", "text"])

        runs_type = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
        known: dict[bytes, int] = {}
        ids, texts, numbers, held = [], [], [], 0
        for batch in sliced(batches, 64):
            for i, raw in enumerate(batch.column(1).to_pylist()):
                words = raw.split()  # of bytes: at \x20 and \x09-\x0d
                ids.append(batch.column(0).slice(i, 1))
                texts.append(words)
                numbers.append(np.fromiter([known.setdefault(w, len(known)) for w in words], np.int64, len(words)))
                held += len(words) + 1
                if held >= _TOGETHER:
                    yield answer(ids, texts, numbers)
                    known, ids, texts, numbers, held = {}, [], [], [], 0
        if ids:
            yield answer(ids, texts, numbers)

    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return texts.mapInArrow(run, f"doc_id {kind}, runs {RUNS}, text string")


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; the first of equal ones, NULL without runs."""
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(runs, none, lambda best, r: F.when(better(best, r), r).otherwise(best))


def with_periodic_ends(documents: DataFrame) -> DataFrame:
    """``doc_id, text`` of ``documents``, where one text in ten, by its id's CRC-32, gets a periodic end.

    With h the checksum of the decimal id, g = h div 10 and n words, words from
    a = g mod n on repeat with the period 1 + (n - a) div (3 + g mod 8) if 10 divides h.
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    n = F.size("__words").cast("bigint")
    a = F.col("__g") % n
    period = 1 + F.floor((n - a) / (3 + F.col("__g") % 8))
    place = F.struct(a.alias("a"), period.alias("p"), n.alias("n"))
    chosen = F.when((h % 10 == 0) & F.col("text").isNotNull(), words)
    rows = documents.select("doc_id", "text", g.alias("__g"), chosen.alias("__words"))
    rows = rows.withColumn("__place", F.when(F.size("__words") > 0, place))
    a, p, n = (F.col(f"__place.{c}") for c in "apn")

    def word(i: Column) -> Column:
        return F.get("__words", F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))

    ended = F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), word), " ")
    return rows.select("doc_id", F.when(a.isNotNull(), ended).otherwise(F.col("text")).alias("text"))


def run_digests(documents: DataFrame) -> DataFrame:
    """One row per row of ``documents``: its number of runs, the strongest one, and digests of all runs and of the collapsed text."""
    found = collapse(with_periodic_ends(documents)).withColumn("best", strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )
