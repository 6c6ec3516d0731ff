"""A stored semantic index: coarse cells, product-quantised residues, exact re-ranking.

Vectors are compared by cosine, so they are scaled to unit length. A bounded
sample fixes the coarse centres and, for what is left of a vector after its
centre is taken off, one codebook per stretch of dimensions. Every row is then
stored in the folder of its cell, with a byte per stretch, its vector and its
other columns; more rows can be added at any time. A search looks at the cells
nearest to each query, ranks their rows by the codes, and orders the best ones by
their exact vectors. Filters on the stored columns act in the scan, and only the
folders of wanted cells are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgrid.session import materialise

# Bounds of what is fitted: sampled rows, coarse cells, and codes of a stretch.
SAMPLED = 20_000
MOST_CELLS = 4096
CODES = 256
_ROUNDS = 12
# Rows of a cell, and queries of a cell, that one search task handles.
_ROWS = 100_000
_QUERIES = 512
_BATCH = 2048


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.sqrt((vectors**2).sum(axis=1)), 1e-300)[:, None]


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * a @ b.T


def _means(data: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's k-means from distinct rows; a centre without rows moves to the row farthest from its own."""
    centres = data[rng.choice(len(data), min(n, len(data)), replace=False)].copy()
    for _ in range(_ROUNDS):
        apart = _squared(data, centres)
        nearest = apart.argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, data)
        counts = np.bincount(nearest, minlength=len(centres))
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        empty = np.flatnonzero(counts == 0)
        centres[empty] = data[np.argsort(-apart.min(axis=1))[: len(empty)]]
    return centres


@dataclass
class Quantiser:
    """Coarse centres ``(cells, d)`` and codebooks ``(stretches, codes, width)``; dimensions are padded with zeros."""

    centres: np.ndarray
    books: np.ndarray

    @property
    def dimensions(self) -> int:
        return self.centres.shape[1]

    def padded(self, vectors: np.ndarray) -> np.ndarray:
        return np.pad(vectors, ((0, 0), (0, self.dimensions - vectors.shape[1])))

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and codes of unit vectors."""
        cell = _squared(vectors, self.centres).argmin(axis=1)
        rest = (vectors - self.centres[cell]).reshape(len(vectors), len(self.books), -1)
        codes = [_squared(rest[:, i], book).argmin(axis=1) for i, book in enumerate(self.books)]
        return cell, np.stack(codes, axis=1).astype(np.uint8)

    def tables(self, cell: int, queries: np.ndarray) -> np.ndarray:
        """Squared distances ``(queries, stretches, codes)`` of the stretches of queries to the codes of a cell."""
        rest = (queries - self.centres[cell]).reshape(len(queries), len(self.books), -1)
        return np.stack([_squared(rest[:, i], book) for i, book in enumerate(self.books)], axis=1)


def fit(
    vectors: DataFrame, cells: int = 64, stretches: int = 16, *, id_col: str = "id", vector_col: str = "embedding", sampled: int = SAMPLED, seed: int = 0
) -> Quantiser:
    """Centres and codebooks from at most ``sampled`` rows, the ones with the smallest id hash."""
    if not 0 < cells <= MOST_CELLS:
        raise ValueError(f"between 1 and {MOST_CELLS} cells")
    rows = _vectors(vectors, id_col, vector_col)
    few = rows.orderBy(F.xxhash64("id"), "id").limit(sampled).select("v").toPandas()["v"]  # at most ``sampled`` vectors
    if few.empty:
        raise ValueError("no vector to fit the index on")
    data = _unit(np.stack([np.asarray(x, float) for x in few]))
    data = np.pad(data, ((0, 0), (0, -data.shape[1] % stretches)))
    rng = np.random.default_rng(seed)
    centres = _means(data, cells, rng)
    rest = (data - centres[_squared(data, centres).argmin(axis=1)]).reshape(len(data), stretches, -1)
    return Quantiser(centres, np.stack([_means(rest[:, i], CODES, rng) for i in range(stretches)]))


def _vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, v`` and the other columns; rows without a vector, or with a zero one, have no direction and are left out."""
    others = [c for c in df.columns if c not in (id_col, vector_col)]
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), *others)
    return rows.filter(F.col("v").isNotNull() & F.exists("v", lambda x: x != 0))


def add(vectors: DataFrame, path: str, model: Quantiser, *, id_col: str = "id", vector_col: str = "embedding") -> None:
    """Store every row of ``vectors`` below ``path``, one folder per cell; rows stored before stay."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)  # its size is bounded by MOST_CELLS and CODES
    rows = _vectors(vectors, id_col, vector_col)
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if batch.num_rows:
                data = np.stack([np.asarray(x, float) for x in batch.column(1).to_pylist()])
                cell, codes = m.encode(m.padded(_unit(data)))
                columns = [*batch.columns, pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "cell", "code"])

    stored = rows.mapInArrow(run, f"{kind}, cell int, code binary")
    # Rows of a cell go to few files, however many tasks hold them; large cells are split.
    stored.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).write.partitionBy("cell").mode("append").parquet(path)


def _nearest_cells(queries: DataFrame, model: Quantiser, probes: int) -> DataFrame:
    """``query_id, q, cell``: each query (a unit vector) with its nearest cells."""
    shared = queries.sparkSession.sparkContext.broadcast(model)
    kind = queries.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            data = m.padded(_unit(np.stack([np.asarray(x, float) for x in batch.column(1).to_pylist()])))
            near = np.argsort(_squared(data, m.centres), axis=1, kind="stable")[:, :probes]
            row = np.repeat(np.arange(len(data)), near.shape[1])
            columns = [batch.column(0).take(pa.array(row)), pa.array(data[row].tolist(), pa.list_(pa.float64())), pa.array(near.ravel(), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "q", "cell"])

    return queries.mapInArrow(run, f"query_id {kind}, q array<double>, cell int")


def _shares(probed: DataFrame, rows: DataFrame) -> DataFrame:
    """``cell, stripes, blocks``: into how many parts the rows and the queries of a cell are dealt."""
    n = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / _ROWS).cast("int").alias("stripes"))
    q = probed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / _QUERIES).cast("int").alias("blocks"))
    return n.join(q, "cell")


def _best_by_code(probed: DataFrame, rows: DataFrame, model: Quantiser, kept: int) -> DataFrame:
    """``query_id, id, cell, apart``: of each part of a cell the ``kept`` rows nearest to each query by their codes."""
    shared = probed.sparkSession.sparkContext.broadcast(model)
    shares = materialise(_shares(probed, rows))
    query_kind, id_kind = probed.schema["query_id"].dataType.simpleString(), rows.schema["id"].dataType.simpleString()

    def every(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    def own(name: str, count: str) -> Column:
        return F.pmod(F.xxhash64(name), F.col(count)).cast("int")

    none = {"q": F.lit(None).cast("array<double>"), "code": F.lit(None).cast("binary"), "id": F.lit(None).cast(id_kind), "query_id": F.lit(None).cast(query_kind)}
    q = probed.join(shares, "cell").withColumn("block", own("query_id", "blocks")).withColumn("stripe", every("stripes"))
    r = rows.join(shares, "cell").withColumn("stripe", own("id", "stripes")).withColumn("block", every("blocks"))
    names = ["cell", "stripe", "block", "query_id", "q", "id", "code"]
    both = q.withColumns({c: none[c] for c in ("id", "code")}).select(*names).unionByName(r.withColumns({c: none[c] for c in ("query_id", "q")}).select(*names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        key, queries, vectors, ids, codes, best, kinds = None, [], [], [], [], None, None

        def scored():
            nonlocal best, ids, codes
            if queries and ids:
                tables = m.tables(key[0], np.array(vectors)) if best is None else best[0]
                found = np.frombuffer(b"".join(codes), np.uint8).reshape(len(ids), -1)
                apart = sum(tables[:, i, found[:, i]] for i in range(found.shape[1]))
                every_id, every_apart = (list(ids), apart) if best is None else (best[1] + ids, np.concatenate([best[2], apart], axis=1))
                if len(every_id) > kept:
                    near = np.unique(np.argpartition(every_apart, kept - 1, axis=1)[:, :kept])
                    every_id, every_apart = [every_id[i] for i in near.tolist()], every_apart[:, near]
                best = tables, every_id, every_apart
            ids, codes = [], []

        def answer():
            scored()
            if best is not None:
                _, names, apart = best
                order = np.argsort(apart, axis=1, kind="stable")[:, :kept]
                row = np.repeat(np.arange(len(queries)), order.shape[1])
                columns = [
                    pa.array([queries[i] for i in row.tolist()], kinds[0]),
                    pa.array([names[i] for i in order.ravel().tolist()], kinds[1]),
                    pa.array(np.full(len(row), key[0]), pa.int32()),
                    pa.array(np.take_along_axis(apart, order, axis=1).ravel()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "id", "cell", "apart"])

        for batch in batches:
            kinds = batch.schema.field(3).type, batch.schema.field(5).type
            for cell, stripe, block, query_id, q, row_id, code in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if (cell, stripe, block) != key:
                    if key is not None:
                        yield from answer()
                    key, queries, vectors, best = (cell, stripe, block), [], [], None
                    ids, codes = [], []
                if code is None:
                    queries.append(query_id)
                    vectors.append(q)
                else:
                    ids.append(row_id)
                    codes.append(code)
                    if len(ids) >= _BATCH:
                        scored()
        if key is not None:
            yield from answer()

    dealt = both.repartition("cell", "stripe", "block").sortWithinPartitions("cell", "stripe", "block", F.col("code").isNotNull())
    return dealt.mapInArrow(run, f"query_id {query_kind}, id {id_kind}, cell int, apart double")


def search(
    spark: SparkSession,
    path: str,
    model: Quantiser,
    queries: DataFrame,
    k: int = 100,
    probes: int = 8,
    reranked: int | None = None,
    *,
    where: Column | None = None,
    id_col: str = "id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, id, score`` and the stored columns: up to ``k`` rows most similar to each query.

    ``probes`` cells are searched per query, and the best ``reranked`` rows by
    code (by default four times ``k``, at least 100) are ordered by exact cosine; ties by id.
    ``where`` filters the stored rows before they are ranked. Queries without a
    direction have no result.
    """
    reranked = reranked or max(4 * k, 100)
    asked = _vectors(queries.select(id_col, vector_col), id_col, vector_col).withColumnRenamed("id", "query_id")
    probed = materialise(_nearest_cells(asked, model, probes))
    wanted = [r["cell"] for r in probed.select("cell").distinct().collect()]  # at most MOST_CELLS numbers
    rows = spark.read.parquet(path).filter(F.col("cell").isin(wanted) if wanted else F.lit(False))
    rows = rows if where is None else rows.filter(where)
    near = _best_by_code(probed.select("query_id", "q", "cell"), rows.select("id", "code", "cell"), model, reranked)
    # A limit on row_number cuts the rows of every task before the shuffle.
    closest = Window.partitionBy("query_id").orderBy("apart", "id")
    near = near.withColumn("n", F.row_number().over(closest)).filter(F.col("n") <= reranked).select("query_id", "id", "cell")
    exact = near.join(rows.drop("code"), ["cell", "id"]).join(asked.select("query_id", F.col("v").alias("q")), "query_id")

    def product(a: str, b: str) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda so_far, x: so_far + x)

    scored = exact.withColumn("score", product("v", "q") / F.sqrt(product("v", "v") * product("q", "q")))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    others = [c for c in rows.columns if c not in ("id", "v", "cell", "code")]
    return ranked.select("query_id", "rank", "id", "score", *others)


def probes_for(
    spark: SparkSession, path: str, model: Quantiser, recall: float = 0.95, k: int = 10, sampled: int = 128
) -> int:
    """The fewest cells a search must look at to hold the share ``recall`` of the ``k`` nearest rows, on sampled queries.

    ``sampled`` stored rows are the queries; every row is compared with them in one pass.
    """
    rows = spark.read.parquet(path).select("id", "v", "cell")
    few = rows.orderBy(F.xxhash64("id"), "id").limit(sampled).select("v").toPandas()["v"]  # at most ``sampled`` vectors
    if few.empty:
        return 1
    queries = model.padded(_unit(np.stack([np.asarray(x, float) for x in few])))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, cell = np.full((len(queries), k), -np.inf), np.zeros((len(queries), k), np.int64)
        for batch in batches:
            if batch.num_rows:
                data = model.padded(_unit(np.stack([np.asarray(x, float) for x in batch.column(0).to_pylist()])))
                every = np.concatenate([score, queries @ data.T], axis=1)
                cells = np.concatenate([cell, np.broadcast_to(np.array(batch.column(1)), (len(queries), batch.num_rows))], axis=1)
                top = np.argsort(-every, axis=1, kind="stable")[:, :k]
                score, cell = np.take_along_axis(every, top, axis=1), np.take_along_axis(cells, top, axis=1)
        i, j = np.nonzero(np.isfinite(score))
        columns = [pa.array(i, pa.int32()), pa.array(score[i, j]), pa.array(cell[i, j], pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, names=["query", "score", "cell"])

    closest = Window.partitionBy("query").orderBy(F.desc("score"))
    found = rows.select("v", "cell").mapInArrow(nearest, "query int, score double, cell int")
    held = found.withColumn("n", F.row_number().over(closest)).filter(F.col("n") <= k).toPandas()  # at most sampled * k rows
    order = np.argsort(np.argsort(_squared(queries, model.centres), axis=1, kind="stable"), axis=1)
    place = np.sort(order[held["query"].to_numpy(), held["cell"].to_numpy()])
    return int(place[min(int(np.ceil(recall * len(place))), len(place)) - 1]) + 1
