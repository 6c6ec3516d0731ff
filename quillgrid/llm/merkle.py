"""Document fingerprints: a Merkle tree over sections, paragraphs and spans of a text.

Sections end at blank lines, paragraphs at line ends. A paragraph's leaves are
spans of about eight words, cut where the bytes before a space say so; an edit
therefore moves no cut but those it touches. Longer spans, as in text that
repeats itself, are cut again at fixed places. A leaf is a digest of its bytes, a
paragraph one of its leaves' digests, a section one of its paragraphs', and the
root one of the sections'. Every byte of a text is in one leaf, so equal roots
mean equal texts. A fingerprint is the root, then every node in the order of the
tree: 24 bits of its digest and the number of bytes below it. Two fingerprints
are compared from the top: equal sections are set aside whole, then equal
paragraphs of the rest, and only what still differs is compared leaf by leaf. In
the same way ``edit_ranges`` descends to the bytes that were edited.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import sliced

SPAN_WORDS = 8
# Hex digits of a leaf: six of its digest, two of its length.
_LEAF = 8
_WINDOW = 8
_WEIGHTS = np.array([7, 31, 131, 547, 2221, 9029, 36697, 149113], np.uint32)
_ANYWHERE = 512  # without spaces, a span has about so many bytes
_LONGEST = 255  # bytes of a leaf, so that two hex digits hold its length


def _spans(raw: bytes) -> list[bytes]:
    """The paragraph cut after about every eighth space, and rarely elsewhere, by the eight bytes before."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(b) <= _WINDOW:
        return [raw]
    n = len(b) - _WINDOW
    window = b[:n] * _WEIGHTS[0]
    for k in range(1, _WINDOW):
        window += b[k : n + k] * _WEIGHTS[k]
    mixed = (window * np.uint32(2654435761)) >> 16
    cut = ((b[_WINDOW:] == 32) & (mixed % SPAN_WORDS == 0)) | (mixed % _ANYWHERE == 0)
    cuts = (np.flatnonzero(cut) + _WINDOW + 1).tolist()
    spans = [raw[i:j] for i, j in zip([0, *cuts], [*cuts, len(raw)]) if i < j]
    if max(map(len, spans), default=0) <= _LONGEST:
        return spans
    return [x[i : i + _LONGEST] for x in spans for i in range(0, len(x), _LONGEST)]


def _leaf(span: bytes) -> bytes:
    return blake2b(span, digest_size=16).digest()


def _node(digest: bytes, size: int, mark: str, below: str) -> str:
    return f"{digest.hex()[:6]}{size:x}{mark}{below}"


def fingerprint(text: str) -> str:
    """Root and nodes of ``text``; the empty text has a root and no node."""
    tops, sections, digests, paragraphs, size = [], [], [], [], 0

    def close() -> None:
        nonlocal size
        tops.append(_leaf(b"".join(digests)))
        sections.append(_node(tops[-1], size, ".", ";".join(paragraphs)))
        digests.clear()
        paragraphs.clear()
        size = 0

    for line in text.encode().splitlines(keepends=True) if text else []:
        spans = _spans(line)
        leaves = [_leaf(x) for x in spans]
        digests.append(_leaf(b"".join(leaves)))
        paragraphs.append(_node(digests[-1], len(line), ",", "".join([d.hex()[:6] + f"{len(x):02x}" for d, x in zip(leaves, spans)])))
        size += len(line)
        if not line.strip():
            close()
    if paragraphs:
        close()
    return sha256(b"".join(tops)).hexdigest()[:32] + ":" + "/".join(sections)


def _split(node: str, mark: str) -> list[str]:
    return [x for x in node.split(mark) if x]


def _size(node: str, mark: str) -> int:
    """Bytes of text below a section (``mark`` is a full stop) or a paragraph (a comma)."""
    return int(node[6 : node.index(mark)], 16)


def _leaves(paragraph: str) -> list[str]:
    plain = paragraph[paragraph.index(",") + 1 :]
    return [plain[i : i + _LEAF] for i in range(0, len(plain), _LEAF)]


def likeness(a: str, b: str) -> float:
    """Share of the text of two fingerprints, in bytes, whose nodes they have in common; 1 if the roots are equal."""
    (root_a, body_a), (root_b, body_b) = a.split(":", 1), b.split(":", 1)
    if root_a == root_b:
        return 1.0
    left_a, left_b = (Counter(_split(body, "/")) for body in (body_a, body_b))
    total = sum(_size(x, ".") * n for left in (left_a, left_b) for x, n in left.items())
    if not total:
        return 0.0
    common = 0
    for mark in ".,":
        same = left_a & left_b
        common += sum(_size(x, mark) * n for x, n in same.items())
        below_a, below_b = Counter(), Counter()
        for below, left in ((below_a, left_a - same), (below_b, left_b - same)):
            for x, n in left.items():
                for child in _split(x[x.index(".") + 1 :], ";") if mark == "." else _leaves(x):
                    below[child] += n
        left_a, left_b = below_a, below_b
    common += sum(int(x[6:], 16) * n for x, n in (left_a & left_b).items())
    return 2 * common / total


def edit_ranges(a: str, b: str) -> list[tuple[int, int, int, int]]:
    """``a_start, a_end, b_start, b_end`` in bytes of the stretches in which the texts of two fingerprints differ, in order.

    Only branches whose digests differ are followed, so the ranges are as wide as the leaves that hold an edit.
    """
    (root_a, body_a), (root_b, body_b) = a.split(":", 1), b.split(":", 1)
    if root_a == root_b:
        return []
    out: list[tuple[int, int, int, int]] = []

    def sizes(nodes: list[str], mark: str) -> int:
        return sum(int(x[6:], 16) if mark == "" else _size(x, mark) for x in nodes)

    def descend(nodes_a: list[str], nodes_b: list[str], mark: str, at_a: int, at_b: int) -> None:
        for kind, i, j, k, m in SequenceMatcher(None, nodes_a, nodes_b, autojunk=False).get_opcodes():
            wide_a, wide_b = sizes(nodes_a[i:j], mark), sizes(nodes_b[k:m], mark)
            if kind == "equal":
                pass
            elif mark and i < j and k < m:
                below = [
                    [c for x in nodes for c in (_split(x[x.index(".") + 1 :], ";") if mark == "." else _leaves(x))]
                    for nodes in (nodes_a[i:j], nodes_b[k:m])
                ]
                descend(*below, "," if mark == "." else "", at_a, at_b)
            elif out and out[-1][1] == at_a and out[-1][3] == at_b:
                out[-1] = (out[-1][0], at_a + wide_a, out[-1][2], at_b + wide_b)
            else:
                out.append((at_a, at_a + wide_a, at_b, at_b + wide_b))
            at_a, at_b = at_a + wide_a, at_b + wide_b

    descend(_split(body_a, "/"), _split(body_b, "/"), ".", 0, 0)
    return out


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by the start of the next text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _range_of(value: Column, bounds: list) -> Column:
    """How many of the ascending ``bounds`` are above ``value``, in two steps of about sqrt(n) comparisons."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds) - 1) + 1
    chunks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    below = F.size(F.filter(F.array(*[F.lit(c[-1]) for c in chunks]), lambda b: b <= value))  # chunks wholly at or below
    chunk = F.element_at(F.array(*[F.array(*map(F.lit, c)) for c in [*chunks, chunks[-1][-1:]]]), below + 1)
    inside = F.size(F.filter(chunk, lambda b: b <= value))
    # Past the last chunk all bounds are at or below the value, and the stand-in chunk counts nothing more.
    at_or_below = F.when(below == len(chunks), F.lit(len(bounds))).otherwise(below * step + inside)
    return F.lit(len(bounds)) - at_or_below


def compare_with_next(documents: DataFrame) -> DataFrame:
    """Fingerprint every text, its edited form, and compare both with each other and with the next document.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``. The next document is the one with the next smaller
    id; after the last comes the first. Rows without an id come last, rows with
    the same id in the order of their text hashes. A NULL text is empty; a table of
    one row is its own next. Other columns are ignored.

    Texts are shuffled once, into ranges of ids. The first text of each range,
    one per task, is copied behind the last of the range before it.
    """
    spark = documents.sparkSession
    source = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    source = source.withColumn("hash", F.xxhash64("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / n for i in range(1, n)] or [0.5]
    found = source.agg(F.percentile_approx("doc_id", shares, 10 * n + 1000)).first()[0] or []
    ranged = source.withColumn("range", F.when(F.col("doc_id").isNull(), F.lit(n)).otherwise(_range_of(F.col("doc_id"), sorted(set(found)))))
    # At most one row per range.
    first = ranged.groupBy("range").agg(F.max(F.struct("doc_id", (-F.col("hash")).alias("minus"))).alias("m")).orderBy("range").collect()
    kind = documents.schema["doc_id"].dataType.simpleString()
    heads = [(r["m"]["doc_id"], -r["m"]["minus"], first[i - 1]["range"]) for i, r in enumerate(first)]
    copies = F.broadcast(spark.createDataFrame(heads, f"id {kind}, h bigint, range int"))
    matched = source.join(copies, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("h")))
    tails = matched.dropDuplicates(["range"]).select("doc_id", "text", "hash", "range", F.lit(1).alias("copy"))
    rows = ranged.withColumn("copy", F.lit(0)).unionByName(tails)
    rows = rows.repartition("range").sortWithinPartitions("range", "copy", F.desc_nulls_last("doc_id"), "hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        before = None  # the row that waits for its next one: id as an array of one, text, fingerprint, range
        for batch in sliced(batches):
            ids, columns = [], ([], [], [], [], [], [])
            for i, (text, where, copy) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 3, 4)))):
                mark = fingerprint(text)
                if before is not None and before[3] == where:
                    own, own_text, own_mark, _ = before
                    changed = edited(own_text, text)
                    changed_mark = fingerprint(changed)
                    row = (len(own_text), sha256(changed.encode()).hexdigest(), own_mark, changed_mark, likeness(own_mark, changed_mark), likeness(own_mark, mark))
                    ids.append(own)
                    for column, x in zip(columns, row):
                        column.append(x)
                before = None if copy else (batch.column(0).slice(i, 1), text, mark, where)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=names)

    schema = f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.select("doc_id", "text", "hash", "range", "copy").mapInArrow(run, schema)
