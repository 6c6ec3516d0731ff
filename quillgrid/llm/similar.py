"""Near copies by exact Jaccard similarity of word shingles, found by prefix filtering.

Two sets whose similarity is at least t share an element among the first
n - ceil(t * n) + 1 of each, in any order of all elements that both follow. So
these elements are exact join keys: no similar pair is lost. Shingles that a
sample holds more than once come last in the order, which keeps common passages
out of the keys; that changes the work, not the result.

Of the sets with one key, the one with the smallest name is the centre, and all
sets that share keys with a centre are its block. Near copies share most keys,
so their keys have few centres, and a set is in few blocks however many keys it
has. Sets that share a key are in one block, so comparing sets within blocks
is complete. A block is searched breadth first, once by bit sketches, whose
differences are never more than those of the sets, and then by whole sets, for
which the texts of the members that the sketches leave open are fetched once per
block. Only links that span what is connected leave a task, less than one per
member. Texts are read once and kept compressed in the meantime.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from quillgrid.llm import simhash, slabs
from quillgrid.llm.common import sliced, written
from quillgrid.llm.simhash import BLOCK, dealt_keys, shingle_hashes, text_fingerprint
from quillgrid.operators.components import connected_components

SHINGLE = 5
# Smallest similarity of near copies, as a ratio of integers.
SIMILARITY = (4, 5)
# For the order of the shingles, one text in so many is read, more if they are few, and so many common shingles are
# named; neither changes the result.
_STEP, _SAMPLED = 20, 2000
_COMMON = 500_000
# Characters of the texts whose keys are handed on together.
_SLAB_CHARS = 8 << 20
# Bytes of whole sets that one search keeps at a time.
_KEPT_BYTES = 256 << 20


def shingle_set(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of the lower-cased text; a text of fewer words is one shingle."""
    return np.unique(shingle_hashes(text.lower().encode(), shingle))


def sketch(items: np.ndarray) -> bytes:
    """Bits that say whether an odd number of elements fall on them; at least two bits an element, a power of two."""
    bits = max(64, 1 << (2 * len(items)).bit_length())
    odd = np.bincount((items & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _common(documents: DataFrame, shingle: int) -> np.ndarray:
    """Sorted shingles that more than one of some sampled texts hold; only their place in the order depends on it."""
    step = min(max(documents.count() // _SAMPLED, 1), _STEP)
    text = F.coalesce("text", F.lit(""))
    hashed = documents.select(text.alias("text"), F.xxhash64(text).alias("hash"))
    sampled = hashed.filter(F.pmod("hash", F.lit(step)) == 0).dropDuplicates(["hash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text, shingle).view(np.int64))], names=["item"])

    counts = sampled.select("text").mapInArrow(run, "item bigint").groupBy("item").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    top = counts.orderBy(F.desc("n"), "item").limit(_COMMON).select("item").toArrow()  # at most _COMMON numbers
    return np.sort(top.column(0).to_numpy().view(np.uint64))


def prefix(items: np.ndarray, common: np.ndarray, similarity: tuple[int, int] = SIMILARITY) -> np.ndarray:
    """The elements of a set that are its join keys."""
    n = len(items)
    if not n:
        return items
    if len(common):
        last = common[np.minimum(np.searchsorted(common, items), len(common) - 1)] == items
        items = np.concatenate([items[~last], items[last]])
    return items[: n - -(-n * similarity[0] // similarity[1]) + 1]


def _pack_keys(keys: list[np.ndarray], names: list[int], n: int) -> list[bytes]:
    """By bucket the keys of distinct sets and the sets' names."""
    owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    flat = np.concatenate(keys) if keys else np.empty(0, np.uint64)
    bucket, rest = (flat % np.uint64(n)).astype(np.int64), (flat // np.uint64(n)).astype(np.uint32)
    order = np.lexsort((rest, bucket))
    names, pieces = np.array(names, np.int64), []
    for a, b in slabs.bucket_ranges(bucket[order], n):
        at = order[a:b]
        sets, place = np.unique(owner[at], return_inverse=True)
        pieces.append(slabs.pack_arrays(*slabs.pack_sorted(rest[at]), place.astype("<u4"), names[sets].astype("<i8")))
    return pieces


def _marked(documents: DataFrame, shingle: int, similarity: tuple[int, int], fingerprints: bool = False) -> DataFrame:
    """Every row with a number of its own, its other columns as ``rest``, its text compressed, its set's name, size and sketch.

    With ``fingerprints`` also its SimHash, as ``simhash``; else that is NULL.

    The last row of a slab of texts has the keys of the slab's distinct sets, by bucket, as ``units``.
    """
    spark = documents.sparkSession
    n = slabs.buckets(spark)
    shared = spark.sparkContext.broadcast(_common(documents, shingle))
    rest = F.struct(*[F.col(c) for c in documents.columns if c != "text"])
    rows = documents.select(rest.alias("rest"), "text")
    plain = {"uid": LongType(), "ztext": BinaryType(), "fp": LongType(), "size": LongType(), "sketch": BinaryType(), "simhash": LongType(), "units": ArrayType(BinaryType())}
    schema = StructType([StructField("rest", rows.schema["rest"].dataType), *[StructField(c, k) for c, k in plain.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, compress = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(3).compress
        keys: dict[int, np.ndarray] = {}
        held, chars = None, 0

        def batch_of(rest, columns, units):
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.binary()))
            arrays = [pa.array(c, k) for c, k in zip((*columns, units), kinds)]
            return pa.RecordBatch.from_arrays([rest, *arrays], names=["rest", *plain])

        def closed():
            nonlocal keys, chars
            rest, columns = held
            units = [None] * len(rest)
            units[-1] = _pack_keys(list(keys.values()), list(keys), n)
            keys, chars = {}, 0
            return batch_of(rest, columns, units)

        for batch in sliced(batches):
            if not batch.num_rows:
                continue
            if held:  # the batch before this one
                yield closed() if chars >= _SLAB_CHARS else batch_of(*held, [None] * len(held[0]))
            columns = ([], [], [], [], [], [])
            for text in batch.column(1).to_pylist():
                items = shingle_set(text or "", shingle)
                fp = int(np.uint64(xxhash.xxh64_intdigest(items.tobytes())).view(np.int64))
                keys.setdefault(fp, prefix(items, shared.value, similarity))
                made, chars = made + 1, chars + len(text or "")
                ztext = None if text is None else compress(text.encode())
                bits = int(np.uint64(text_fingerprint((text or "").encode())).view(np.int64)) if fingerprints else None
                for column, x in zip(columns, ((part << 33) + made, ztext, fp, len(items), sketch(items), bits)):
                    column.append(x)
            held = batch.column(0), columns
        if held:
            yield closed()

    return rows.mapInArrow(run, schema)


def _blocks(marked: DataFrame) -> DataFrame:
    """``key, fp``: every set that shares keys with the centre ``key``, centres included; only blocks of two or more."""
    n = slabs.buckets(marked.sparkSession)
    pieces = marked.filter(F.col("units").isNotNull()).select("uid", F.posexplode("units").alias("bucket", "piece"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of_bucket(held):
            keys, names = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((names, keys))
            keys, names = keys[order], names[order]
            begin = np.flatnonzero(np.diff(keys, prepend=-1) != 0)
            ends = np.append(begin, len(keys))[1:]
            # Names ascend within a key: the first is the centre, and the last equals it if the key has one set.
            several = names[begin] != names[ends - 1]
            of = np.repeat(np.flatnonzero(several), (ends - begin)[several])
            pairs = np.unique(np.stack([names[begin[of]], names[np.repeat(several, ends - begin)]]), axis=1) if len(of) else np.empty((2, 0), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["key", "fp"])

        held, bucket = [], None
        for batch in batches:
            for b, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and b != bucket:
                    yield of_bucket(held)
                    held = []
                bucket = b
                *steps, place, names = slabs.unpack_arrays(piece, "<u2", "<u2", "<u2", "<u4", "<i8")
                held.append((slabs.unpack_sorted(*steps), names[place]))
        if held:
            yield of_bucket(held)

    dealt = pieces.select("bucket", "piece").repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "key bigint, fp bigint").distinct()


def _folded(sketches: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By width in bytes: the places of the sketches that have it or twice as much, and these at that width."""
    out = {}
    widths = np.array([len(s) for s in sketches])
    for width in np.unique(widths).tolist():
        at = np.flatnonzero((widths == width) | (widths == 2 * width))
        rows = [np.bitwise_xor.reduce(np.frombuffer(sketches[i], np.uint64).reshape(-1, width // 8), axis=0) for i in at.tolist()]
        out[width] = at, np.stack(rows)
    return out


class _Open:
    """Which members of a block may be similar to one of them, by their sizes and sketches."""

    def __init__(self, sizes: np.ndarray, sketches: list[bytes], similarity: tuple[int, int]):
        self._sizes, self._similarity = sizes, similarity
        self._widths = np.array([len(s) for s in sketches])
        self._folded = _folded(sketches)

    def __call__(self, i: int, waiting: np.ndarray) -> np.ndarray:
        """Those of the sorted places ``waiting`` that may be similar to member ``i``."""
        t, u = self._similarity
        sizes, n = self._sizes[waiting], self._sizes[i]
        waiting = waiting[np.minimum(sizes, n) * u >= np.maximum(sizes, n) * t]
        found = []
        # Similar sets have sketches of one width or of neighbouring ones.
        for width, chosen in ((self._widths[i], None), (self._widths[i] // 2, self._widths[i] // 2)):
            if width not in self._folded:
                continue
            at, rows = self._folded[width]
            others = waiting[self._widths[waiting] == chosen] if chosen else waiting[self._widths[waiting] >= width]
            others = others[self._widths[others] <= 2 * width]
            places = np.searchsorted(at, others)
            differ = np.bitwise_count(rows[places] ^ rows[np.searchsorted(at, i)]).sum(axis=1)
            # At a similarity of t / u the sets differ in at most (u - t) / (u + t) of their elements.
            found.append(others[differ * (u + t) <= (self._sizes[others] + n) * (u - t)])
        return np.concatenate(found) if found else waiting[:0]


def _spanning(members: int, linked: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, int]]:
    """Links that span the members: ``linked`` tells which of some places are linked to one. Breadth first."""
    waiting = np.arange(members)
    while len(waiting) > 1:
        queue, waiting = [int(waiting[0])], waiting[1:]
        while queue and len(waiting):
            node = queue.pop()
            hit = linked(node, waiting)
            if len(hit):
                yield from ((node, int(i)) for i in hit)
                queue.extend(hit.tolist())
                waiting = np.setdiff1d(waiting, hit, assume_unique=True)


def _per_key(rows: DataFrame, answer: Callable, schema: str) -> DataFrame:
    """``answer`` of all rows of each key; it takes lists of the other columns and yields record batches."""
    names = [c for c in rows.columns if c != "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, [[] for _ in names]
        for batch in sliced(batches):
            for k, *values in zip(*(batch.column(i).to_pylist() for i in range(len(names) + 1))):
                if k != key and held[0]:
                    yield from answer(key, *held)
                    held = [[] for _ in names]
                key = k
                for column, x in zip(held, values):
                    column.append(x)
        if held[0]:
            yield from answer(key, *held)

    return rows.select("key", *names).repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, schema)


def _once(fps: list[int]) -> list[int]:
    """Places of the distinct names; equal ones stand side by side."""
    return [i for i, fp in enumerate(fps) if not i or fps[i - 1] != fp]


def links(marked: DataFrame, shingle: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """``a, b``: pairs of similar sets that connect all that similar pairs connect; less than one per member of a block.

    A block of over ``block`` sets is dealt out in pairs of parts.
    """
    t, u = similarity
    sets = marked.select("fp", "size", "sketch").dropDuplicates(["fp"])
    keyed = dealt_keys(written(_blocks(marked), "similar-blocks"), "similar-crowded", block)

    def open_members(key: int, fps: list, sizes: list, sketches: list) -> Iterator[pa.RecordBatch]:
        once = _once(fps)
        may = _Open(np.array([sizes[i] for i in once]), [sketches[i] for i in once], similarity)
        used = sorted({i for pair in _spanning(len(once), may) for i in pair})
        if used:
            fp = pa.array([fps[once[i]] for i in used], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(used), pa.int64()), fp], names=["key", "fp"])

    left = _per_key(keyed.join(sets, "fp").select("key", "fp", "size", "sketch"), open_members, "key bigint, fp bigint")
    left = written(left, "similar-open")
    texts = marked.select("fp", F.coalesce("ztext", F.lit(b"")).alias("ztext"))
    texts = texts.join(left.select("fp").distinct(), "fp", "left_semi").dropDuplicates(["fp"])

    def verified(key: int, fps: list, ztexts: list) -> Iterator[pa.RecordBatch]:
        once, expand = _once(fps), zstandard.ZstdDecompressor().decompress
        kept: dict[int, np.ndarray] = {}
        held = 0

        def items(i: int) -> np.ndarray:
            nonlocal held
            if i not in kept:
                blob = ztexts[once[i]]
                found = shingle_set(expand(blob).decode() if blob else "", shingle)
                if held > _KEPT_BYTES:
                    kept.clear()
                    held = 0
                kept[i] = found
                held += found.nbytes
            return kept[i]

        sizes, sketches = np.empty(len(once), np.int64), []
        for i in range(len(once)):
            sizes[i] = len(items(i))
            sketches.append(sketch(items(i)))
        may = _Open(sizes, sketches, similarity)

        def similar(i: int, waiting: np.ndarray) -> np.ndarray:
            good = []
            for j in may(i, waiting).tolist():
                both = len(np.intersect1d(items(i), items(j), assume_unique=True))
                if both * u >= (sizes[i] + sizes[j] - both) * t:
                    good.append(j)
            return np.array(good, np.int64)

        pairs = list(_spanning(len(once), similar))
        if pairs:
            columns = [pa.array([fps[once[p[side]]] for p in pairs], pa.int64()) for side in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b"])

    return _per_key(left.join(texts, "fp").select("key", "fp", "ztext"), verified, "a bigint, b bigint")


def _fingerprint_links(marked: DataFrame) -> DataFrame:
    """``a, b``: pairs of sets that connect those of rows whose SimHash fingerprints are linked."""
    prints = marked.select("fp", F.col("simhash").alias("print")).distinct()
    roots = simhash.components(prints.select(F.col("print").alias("fp"))).withColumnRenamed("fp", "print")
    rooted = written(prints.join(roots, "print").select("fp", "root").distinct(), "similar-prints")
    first = rooted.groupBy("root").agg(F.min("fp").alias("a"))
    return rooted.join(first, "root").filter("a <> fp").select("a", F.col("fp").alias("b"))


def without_near_duplicates(
    documents: DataFrame, shingle: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY, block: int = BLOCK, fingerprints: bool = False
) -> DataFrame:
    """The rows of ``documents`` without near copies: of each group of linked texts one row stays.

    Texts whose sets of word shingles are at least as similar as asked are
    linked, and with ``fingerprints`` also texts whose SimHash fingerprints are
    (see ``simhash``); lower and upper case are equal, and texts without words are equal
    to each other and to NULL. The row with the smallest id stays; rows without an id come
    last, and of equal ids the smallest text hash, then any one row. All columns
    are kept as they are, and an empty table gives no rows.
    """
    marked = written(_marked(documents, shingle, similarity, fingerprints), "similar-rows")
    pairs = links(marked, shingle, similarity, block)
    if fingerprints:
        pairs = pairs.unionByName(_fingerprint_links(marked))
    linked = connected_components(written(pairs, "similar-links"))
    rank = F.struct(F.col("rest.doc_id").isNull().alias("last"), F.col("rest.doc_id").alias("id"), F.xxhash64("ztext").alias("hash"), "uid")
    first = marked.groupBy("fp").agg(F.min(rank).alias("first"))
    rooted = first.join(linked.withColumnRenamed("node", "fp"), "fp", "left")
    kept = rooted.groupBy(F.coalesce("component", "fp").alias("root")).agg(F.min("first").alias("first"))
    rows = marked.select("uid", "rest", "ztext").join(kept.select(F.col("first.uid").alias("uid")), "uid", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in sliced(batches):
            texts = [None if z is None else expand(z).decode() for z in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["rest", "text"])

    plain = rows.select("rest", "ztext").mapInArrow(run, StructType([rows.schema["rest"], documents.schema["text"]]))
    return plain.select(*[F.col("text") if c == "text" else F.col("rest")[c].alias(c) for c in documents.columns])
