"""SimHash near duplicates, found by pigeonring filtering of the fingerprints.

A fingerprint's 64 bits are cut into nine consecutive segments on a ring. If two
fingerprints differ in at most ``DISTANCE`` bits, some start on the ring has the
property that the first l segments from it differ in at most l * DISTANCE / 9
bits, for every l (Qin and Xiao, "Pigeonring", VLDB 2018). A chain of six such
segments has budgets 0, 0, 1, 1, 2 and 2 bits: its first two segments agree, of
the first four at most one differs, and of all six at most two. So the four
segments that agree, in one of five arrangements from one of nine starts, are an
exact join key of about 28 bits. Pairs that share a key must then pass the bit
budgets of the whole chain before their full Hamming distance is taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import sliced, written
from quillgrid.operators.components import connected_components
from quillgrid.operators.skew import salted_join

DISTANCE = 4
SHINGLE = 4
SEED = 42
SEGMENTS = 9
CHAIN = 6
# Fingerprints of one key that one call compares; larger keys are dealt out in blocks of half the size.
BLOCK = 4096


def shingle_hashes(raw: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of the word shingles of a text; fewer words than a shingle has are one."""
    words = raw.lower().split()  # of bytes: A-Z only, and \x20 \x09-\x0d
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate([len(w) + 1 for w in words]))
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_intdigest
    n = max(len(words) - shingle + 1, 1)
    last = ends[min(shingle, len(words)) - 1 :]
    return np.fromiter((digest(joined[a : b - 1], SEED) for a, b in zip(starts, last)), np.uint64, n)


def text_fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of one text: majority vote over the 64-bit hashes of its word shingles, 0 without words."""
    hashes = shingle_hashes(raw, shingle)
    n = len(hashes)
    votes = np.zeros(64, np.int64)
    for at in range(0, n, 65536):  # bounds the unpacked bits of a very long text
        block = hashes[at : at + 65536].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(documents: DataFrame) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long) of every document; a NULL text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            values = np.array([text_fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
            fp = pa.array(values.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), fp], names=["doc_id", "fp"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return texts.mapInArrow(run, f"doc_id {kind}, fp bigint")


def segment_masks(segments: int = SEGMENTS) -> list[int]:
    """Bit mask of each segment of the ring."""
    cuts = [round(64 * i / segments) for i in range(segments + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]


def budget(length: int, segments: int = SEGMENTS, distance: int = DISTANCE) -> int:
    """Bits by which the first ``length`` segments of a chain may differ."""
    return length * distance // segments


def key_masks() -> list[tuple[int, int]]:
    """Start and mask of every arrangement of agreeing segments that the chain's budgets allow."""
    rings = segment_masks()
    found = []
    for start in range(SEGMENTS):
        chain = [rings[(start + i) % SEGMENTS] for i in range(CHAIN)]
        for a in range(CHAIN):
            for b in range(a + 1, CHAIN):
                if all(sum(x < n for x in (a, b)) <= budget(n) for n in range(1, CHAIN + 1)):
                    found.append((start, sum(m for i, m in enumerate(chain) if i not in (a, b))))
    return found


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether fingerprints differ in at most ``DISTANCE`` bits; a chain within budget comes first."""
    differ = a ^ b
    parts = np.stack([np.bitwise_count(differ & np.uint64(m)) for m in segment_masks()])
    chained = np.zeros(differ.shape, bool)
    for start in range(SEGMENTS):
        total = np.zeros(differ.shape, np.uint8)
        good = np.ones(differ.shape, bool)
        for n in range(1, CHAIN + 1):
            total = total + parts[(start + n - 1) % SEGMENTS]
            good &= total <= budget(n)
        chained |= good
    out = np.zeros(differ.shape, bool)
    out[chained] = np.bitwise_count(differ[chained]) <= DISTANCE
    return out


def _forest(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """A spanning forest of the near pairs of distinct ``values``; quadratic in their number."""
    left = values
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            node = queue.pop()
            hit = near(np.full(len(left), node), left)
            for other in left[hit]:
                queue.append(other)
                yield node, other
            left = left[~hit]


def _linked(keys: np.ndarray, values: np.ndarray) -> tuple[list, list]:
    """Links among the values of each key; both arrays are sorted by key."""
    cuts = np.flatnonzero(np.diff(keys)) + 1
    starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])
    sizes = ends - starts
    pair = starts[sizes == 2]
    a, b = values[pair], values[pair + 1]
    hit = near(a, b)
    us, vs = list(a[hit]), list(b[hit])
    for s, e in zip(starts[sizes > 2], ends[sizes > 2]):
        for u, v in _forest(np.unique(values[s:e])):
            us.append(u)
            vs.append(v)
    return us, vs


def dealt_keys(keyed: DataFrame, name: str, block: int = BLOCK) -> DataFrame:
    """``keyed`` (``fp``, ``key`` and others), with keys of over ``block`` rows replaced by keys of pairs of their blocks."""
    crowded = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > block)
    # A crowded key needs over `block` of the rows; written, as it is used twice.
    crowded = written(crowded.select("key", F.ceil(F.col("rows") / (block // 2)).cast("int").alias("parts")), name)
    if crowded.isEmpty():
        return keyed
    others = [c for c in keyed.columns if c != "key"]
    own = F.pmod(F.xxhash64("fp", F.lit(len(key_masks()))), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    marked = keyed.join(crowded, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    placed = marked.withColumn("own", own).withColumn("other", other)
    blocks = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    return placed.select(*others, F.when(F.col("parts") == 1, F.col("key")).otherwise(blocks).alias("key"))


def links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """``a, b``: links between distinct fingerprints ``fp`` that connect all that are near.

    Of the near pairs that share a key only a spanning forest is returned, so
    the result stays in proportion to the keys, whatever the size of a group of
    copies. A key with more than ``block`` fingerprints is split: every pair of
    its blocks is compared in a task of its own.
    """
    every = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for i, (_, m) in enumerate(key_masks())])
    keyed = fps.select("fp", F.explode(every).alias("key"))
    dealt = dealt_keys(keyed, "simhash-crowded", block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_v = np.empty(0, np.int64), np.empty(0, np.int64)

        def found(keys, values):
            us, vs = _linked(keys, values.view(np.uint64))
            cols = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (us, vs)]
            return pa.RecordBatch.from_arrays(cols, names=["a", "b"])

        for batch in batches:
            values = np.concatenate([held_v, batch.column(0).to_numpy(zero_copy_only=False)])
            keys = np.concatenate([held_k, batch.column(1).to_numpy(zero_copy_only=False)])
            if not len(keys):
                continue
            done = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
            held_k, held_v = keys[done:], values[done:]
            if done:
                yield found(keys[:done], values[:done])
        if len(held_k):
            yield found(held_k, held_v)

    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a bigint, b bigint").distinct()


def components(fingerprinted: DataFrame) -> DataFrame:
    """``fp, root``: the component of every distinct fingerprint of ``fingerprinted``, named by one of its fingerprints."""
    fps = fingerprinted.select("fp").distinct()
    linked = connected_components(links(fps))
    return fps.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("component", "fp").alias("root")
    )


def near_duplicates(documents: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``documents``.

    Texts whose fingerprints differ in at most four bits are linked, and
    ``component_id`` is the smallest id that links lead to. A NULL or empty
    text, or one without words, has fingerprint zero and is linked like any
    other. Repeated rows give repeated results. A row without an id is linked
    too; its component has no id only if all its rows have none. Other columns
    are ignored, and an empty table gives an empty result.
    """
    found = written(fingerprints(documents), "simhash")
    smallest = found.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    rooted = written(components(found).join(smallest, "fp"), "simhash-roots")
    named = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_fp = salted_join(rooted.select("root", "fp"), named, ["root"], spread=[F.col("fp")], how="left").select("fp", "component_id")
    out = salted_join(found, by_fp, ["fp"], spread=[F.col("doc_id")], how="left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
