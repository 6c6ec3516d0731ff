"""Exact top-k by inner product with vector-approximation files.

The approximation file holds a block of vectors per row: for each dimension
where its 256 cells begin and how wide they are, and for each component the
number of its cell in one byte. A scan reads these bytes only. They bound the
inner product with a query from above and below, by one matrix product per block
of queries; blocks meet through an equi-join on a stripe number, so each query
block goes through every stripe once. A query keeps the rows that its k-th best
lower bound does not rule out. Exact vectors are then fetched by row number in
the order of the upper bounds: first k per query, and after their scores only
those whose bound still reaches the k-th. Vectors with components too large for
exact 64-bit floats are not approximated but scored in integers.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.llm.common import written

K = 20
SCALE = 64
QUERY_EVERY = 20
CELLS = 256
BLOCK_ROWS = 4096
QUERY_ROWS = 512
# From this size on a 64-bit float is a whole number.
WHOLE = 1 << 53


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """``vec_id, v array<double>``: the components rounded down to whole 64ths, without any error.

    Left out are vectors that are NULL or empty or hold a NULL or non-finite
    component, and rows without an id.
    """
    def part(x):
        x = x.cast("double")
        return F.when(F.abs(x) < WHOLE, F.floor(x * SCALE).cast("double") / SCALE).otherwise(x)

    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    whole = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    return embeddings.filter(whole).filter(fine).select("vec_id", F.transform("embedding", part).alias("v"))


def _numbered(embeddings: DataFrame) -> DataFrame:
    """``uid, dim, large, vec_id, v``: the integer vectors, each row with a number of its own, written."""
    rows = integer_vectors(embeddings).withColumn("dim", F.size("v"))
    # Sums of products of smaller components are exact 64-bit floats.
    most = F.floor(F.sqrt(F.lit(float(WHOLE)) / F.col("dim"))) / SCALE
    large = F.array_max(F.transform("v", F.abs)) > most
    return written(rows.select(F.monotonically_increasing_id().alias("uid"), "dim", large.alias("large"), "vec_id", "v"), "topk-vectors")


def _blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """``dim, <name>, rows``: at most about ``size`` vectors of one length together."""
    counts = rows.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int")
    dealt = rows.join(counts, "dim").withColumn(name, block)
    return dealt.groupBy("dim", name).agg(F.collect_list(F.struct("uid", "vec_id", "v")).alias("rows"))


def cells_of(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where the cells of each dimension begin, their steps, how far values lie above their cell's beginning, and the cells.

    Values are whole numbers, so cells of one number each leave nothing open.
    """
    low = v.min(axis=0)
    span = v.max(axis=0) - low
    step = np.where(span < CELLS, 1.0, span / (CELLS - 1))
    cell = np.minimum(np.floor((v - low) / step), CELLS - 1).astype(np.uint8)
    return low, step, np.where(span < CELLS, 0.0, step), cell


def _approximations(blocks: DataFrame) -> DataFrame:
    """The approximation file: ``dim, block, uids, vec_ids, low, step, width, cells`` per block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, block, rows in zip(*(batch.column(i).to_pylist() for i in range(3))):
                low, step, width, cells = cells_of(np.array([r["v"] for r in rows], float) * SCALE)
                ids = [[r[c] for r in rows] for c in ("uid", "vec_id")]
                columns = [[dim], [block], *([x] for x in ids), [low.tolist()], [step.tolist()], [width.tolist()], [cells.tobytes()]]
                kinds = [pa.int32(), pa.int32(), *[pa.list_(pa.int64())] * 2, *[pa.list_(pa.float64())] * 3, pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    names = ["dim", "block", "uids", "vec_ids", "low", "step", "width", "cells"]
    return blocks.mapInArrow(run, "dim int, block int, uids array<bigint>, vec_ids array<bigint>, low array<double>, step array<double>, width array<double>, cells binary")


def bounds(q: np.ndarray, low: np.ndarray, step: np.ndarray, width: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products of queries with the vectors in the cells."""
    base = (q @ low)[:, None] + (q * step) @ cells.T.astype(float)
    largest = np.maximum(np.abs(low), np.abs(low + step * (CELLS - 1)))
    slack = 1e-12 * (np.abs(q) @ largest)[:, None]  # of floating-point sums
    return base + (np.minimum(q, 0) @ width)[:, None] - slack, base + (np.maximum(q, 0) @ width)[:, None] + slack


def _candidates(asked: DataFrame, file: DataFrame, k: int, stripes: int) -> DataFrame:
    """``query, uid, lower, upper``: per query and block the rows that the block's k-th best lower bound leaves open."""
    data = file.withColumn("stripe", F.pmod("block", F.lit(stripes)))
    used = data.select("dim", "stripe").distinct()  # only stripes that hold a block; there are at most ``stripes``
    pairs = asked.join(used, "dim").join(data, ["dim", "stripe"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                dim = batch.column(0)[r].as_py()
                rows = batch.column(1)[r].as_py()
                q = np.array([x["v"] for x in rows], float) * SCALE
                query, own = (np.array([x[c] for x in rows], np.int64) for c in ("uid", "vec_id"))
                uids, ids, low, step, width = (batch.column(c)[r].values.to_numpy(zero_copy_only=False) for c in range(2, 7))
                cells = np.frombuffer(batch.column(7)[r].as_py(), np.uint8).reshape(-1, dim)
                lower, upper = bounds(q, low, step, width, cells)
                mine = own[:, None] == ids[None, :]
                lower[mine] = upper[mine] = -np.inf
                sure = np.partition(lower, -k, axis=1)[:, -k][:, None] if k < len(ids) else -np.inf
                i, j = np.nonzero((upper >= sure) & ~mine)
                columns = [query[i], uids[j], lower[i, j], upper[i, j]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query", "uid", "lower", "upper"])

    read = pairs.select("dim", F.col("q_rows"), "uids", "vec_ids", "low", "step", "width", "cells")
    return read.mapInArrow(run, "query bigint, uid bigint, lower double, upper double")


def _exact(pairs: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """``query, uid, vec_id, score`` of pairs ``query, uid``, whose vectors are fetched for this."""
    fetched = pairs.join(vectors.select("uid", "vec_id", "v"), "uid").join(queries.select(F.col("uid").alias("query"), F.col("v").alias("q")), "query")
    product = F.aggregate(F.zip_with("q", "v", lambda a, b: (a * SCALE) * (b * SCALE)), F.lit(0.0), lambda so_far, x: so_far + x)
    return fetched.select("query", "uid", "vec_id", product.cast("bigint").alias("score"))


def _kth(rows: DataFrame, column: str, k: int) -> DataFrame:
    """``query, least``: the k-th largest value of each query that has so many."""
    # A limit on row_number cuts every task's rows before the shuffle.
    largest = Window.partitionBy("query").orderBy(F.desc(column))
    top = rows.withColumn("n", F.row_number().over(largest)).filter(F.col("n") <= k)
    return top.groupBy("query").agg(F.max(F.when(F.col("n") == k, F.col(column))).alias("least")).filter("least IS NOT NULL")


def _by_approximation(vectors: DataFrame, queries: DataFrame, k: int, stripes: int) -> DataFrame:
    """``query, uid, vec_id, score``: rows that hold the k best of each query among vectors that are not large."""
    file = written(_approximations(_blocks(vectors, BLOCK_ROWS, "block")), "topk-cells")
    asked = _blocks(queries, QUERY_ROWS, "query_block").withColumnRenamed("rows", "q_rows")
    found = written(_candidates(asked, file, k, stripes), "topk-bounds")
    ruled = found.join(_kth(found, "lower", k), "query", "left")
    left = ruled.filter(F.col("least").isNull() | (F.col("upper") >= F.col("least"))).drop("least")
    order = Window.partitionBy("query").orderBy(F.desc("upper"), "uid")
    left = written(left.withColumn("n", F.row_number().over(order)), "topk-left")
    first = written(_exact(left.filter(F.col("n") <= k).select("query", "uid"), queries, vectors), "topk-first")
    rest = left.filter(F.col("n") > k).join(_kth(first, "score", k), "query").filter(F.col("upper") >= F.col("least"))
    return first.unionByName(_exact(rest.select("query", "uid"), queries, vectors))


def _integers(v: np.ndarray) -> np.ndarray:
    """Vectors of 64ths as Python integers."""
    whole = [[int(x) * SCALE if abs(x) >= WHOLE else int(x * SCALE) for x in row] for row in v.tolist()]
    return np.array(whole, object).reshape(v.shape)


def best_in_integers(qid: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> tuple[list, list, list]:
    """Query index, vector index and score of each query's ``k`` best, for vectors of 64ths of any size.

    Scores are 64-bit integers where these are wide enough, and else Python's. One that the result's type can't hold is
    an error, not a missing row.
    """
    left, right = _integers(q), _integers(v)
    if q.shape[1] * int(abs(left).max()) * int(abs(right).max()) < 1 << 62:
        left, right = left.astype(np.int64), right.astype(np.int64)
    out: tuple[list, list, list] = ([], [], [])
    for i, x in enumerate(left):
        rows = ((-s, int(ids[j]), j) for j, s in enumerate((right @ x).tolist()) if ids[j] != qid[i])
        for score, _, j in heapq.nsmallest(k, rows):
            if not -(1 << 63) <= -score < 1 << 63:
                raise OverflowError(f"the score of vectors {qid[i]} and {ids[j]} exceeds a bigint")
            out[0].append(i)
            out[1].append(j)
            out[2].append(-score)
    return out


def _by_integers(vectors: DataFrame, queries: DataFrame, k: int, stripes: int) -> DataFrame:
    """``query, uid, vec_id, score``: the k best of each query and block, all products taken."""
    data = _blocks(vectors, BLOCK_ROWS, "block").withColumn("stripe", F.pmod("block", F.lit(stripes)))
    used = data.select("dim", "stripe").distinct()
    asked = _blocks(queries, QUERY_ROWS, "query_block").withColumnRenamed("rows", "q_rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_rows, rows in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                (q, qid), (v, ids) = ((np.array([x["v"] for x in of], float), np.array([x["vec_id"] for x in of], np.int64)) for of in (q_rows, rows))
                at, which, score = best_in_integers(qid, q, ids, v, k)
                columns = [[q_rows[i]["uid"] for i in at], [rows[j]["uid"] for j in which], [int(ids[j]) for j in which], score]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query", "uid", "vec_id", "score"])

    pairs = asked.join(used, "dim").join(data, ["dim", "stripe"])
    return pairs.select("q_rows", "rows").mapInArrow(run, "query bigint, uid bigint, vec_id bigint, score bigint")


def top_k(embeddings: DataFrame, k: int = K, every: int = QUERY_EVERY, stripes: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best of all other rows for each row whose id ``every`` divides.

    Scores are integer inner products of ``integer_vectors``; ties go to the
    smaller id. Vectors of different lengths are not compared. Repeated rows are
    candidates each, and no row is a candidate for a query with its own id; a
    repeated query is answered once. Other columns are ignored.
    """
    vectors = _numbered(embeddings)
    # Queries with one id but different vectors stay apart.
    asked = vectors.filter(F.col("vec_id") % every == 0).groupBy("dim", "large", "vec_id", "v").agg(F.min("uid").alias("uid"))
    queries = written(asked, "topk-queries")
    n = stripes or int(embeddings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small, large = F.lit(False) == F.col("large"), F.col("large")
    scored = _by_approximation(vectors.filter(small), queries.filter(small), k, n)
    if not vectors.filter(large).isEmpty():
        scored = scored.unionByName(_by_integers(vectors, queries.filter(large), k, n))
        scored = scored.unionByName(_by_integers(vectors.filter(large), queries.filter(small), k, n))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "uid")
    ranked = scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    named = ranked.join(queries.select(F.col("uid").alias("query"), F.col("vec_id").alias("query_id")), "query")
    return named.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
