"""Exact neighbourhoods of vectors in many dimensions, by recursive cuts of the space.

A cell with too many points is cut across a direction, at places that give its
parts equal shares of the points. A point belongs to one part, and is a guest of
every other one that lies within ``eps`` of it along the direction. A projection
never makes distances larger, so all points within ``eps`` of a cell's own
points are in the cell. Of several directions the one that makes the fewest
guests in a sample is taken, so cuts follow the gaps of the data, and the pairs
to look at stay in proportion to the points as long as these have neighbours in
a part of the space only.

All cells of a level are cut in one pass. The tables of a level are written, and
a cell is compared within one task, its own points against its guests in
blocks. Where all points are about equally far apart, every point would be a
guest everywhere, so a cut that leaves most pairs is not made: the cell stays
whole, and its own points are dealt to tasks in chunks, each compared with all
points of the cell as they stream by. Pairs are then quadratic, but a row is
written once, and memory is bounded by the chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.operators.search import total
from quillgrid.session import materialise

# Own points of a cell that are not cut further, parts of a cut, and points of a cell that its direction is chosen from.
LEAF = 2048
PARTS = 4
SAMPLED = 64
_DIRECTIONS = 8
_DEEPEST = 24
# Floating-point slack of the screening by matrix products, relative to the squared lengths.
_SLACK = 1e-9
# Guests that are compared with a cell's own points at a time.
_BLOCK = 256
# A cut must leave at most this share of a cell's pairs, or it copies more rows than it saves comparisons.
WORTH = 0.75
# Nor may the cells of a cut hold more rows than this many for each of its points.
COPIES = 8
# Own points that one task compares of a cell that no cut helps.
CHUNK = 16384


def _direction(sample: np.ndarray, eps: float, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """A unit vector and the places of the cuts along it: of several far pairs' directions the one with the fewest guests."""
    rng = np.random.default_rng(len(sample))
    best = None
    for start in rng.integers(0, len(sample), _DIRECTIONS):
        far = sample[((sample - sample[start]) ** 2).sum(axis=1).argmax()]
        other = sample[((sample - far) ** 2).sum(axis=1).argmax()]
        length = np.sqrt(((far - other) ** 2).sum())
        if length == 0:
            continue
        unit = (far - other) / length
        at = np.sort(sample @ unit)
        # Equal shares, each cut moved to the widest gap nearby.
        cuts = []
        for i in range(1, parts):
            low, high = (max(int((i + s) * len(at) / parts), 0) for s in (-0.3, 0.3))
            gaps = np.diff(at[low : high + 1])
            if len(gaps):
                widest = low + int(gaps.argmax())
                cuts.append((at[widest] + at[widest + 1]) / 2)
        cuts = np.unique(cuts)
        guests = sum(int(((at > c - eps) & (at < c + eps)).sum()) for c in cuts)
        if best is None or guests < best[0]:
            best = guests, unit, cuts
    return (np.zeros(sample.shape[1]), np.empty(0)) if best is None else best[1:]


def _cuts(rows: DataFrame, cells: DataFrame, eps: float, parts: int) -> DataFrame:
    """``cell, unit, cuts`` of every cell of ``cells``, from at most ``SAMPLED`` of its own points."""
    few = Window.partitionBy("cell").orderBy(F.xxhash64("pt"), "pt")
    own = rows.filter("own").join(cells, "cell").withColumn("n", F.row_number().over(few)).filter(F.col("n") <= SAMPLED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_direction(np.array(s, float), eps, parts) for s in batch.column(1).to_pylist()]
            kind = pa.list_(pa.float64())
            columns = [pa.array([f[i].tolist() for f in found], kind) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["cell", "unit", "cuts"])

    sampled = own.groupBy("cell").agg(F.collect_list("coords").alias("sample"))
    return sampled.mapInArrow(run, "cell bigint, unit array<double>, cuts array<double>")


def _worthwhile(children: DataFrame) -> DataFrame:
    """``cell``: those whose cut leaves at most ``WORTH`` of the pairs of own points and all points, and few copies."""
    kept = children.groupBy("cell", "part").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("own") & (F.col("part") == F.col("home"))).alias("own"),
        F.count_if(F.col("part") == F.col("home")).alias("rows"),
    )
    pairs = (F.col(c).cast("double") for c in ("n", "own"))
    sums = kept.groupBy("cell").agg(F.sum(next(pairs) * next(pairs)).alias("pairs"), F.sum("own").alias("own"), F.sum("rows").alias("rows"), F.sum("n").alias("n"))
    few = F.col("n") <= COPIES * F.col("own")
    return sums.filter(few & (F.col("pairs") <= WORTH * F.col("own").cast("double") * F.col("rows"))).select("cell")


def cells(points: DataFrame, eps: float, leaf: int = LEAF, parts: int = PARTS, *, chunk: int = CHUNK) -> DataFrame:
    """``cell, pt, coords, own, chunks`` of ``points`` (``pt, coords`` and other columns, which are kept).

    Every point is in one cell of its own and a guest of all cells that hold a point within ``eps`` of it. Points of a
    cell are cut while there are more than ``leaf``, unless they are all equal or no cut helps; ``chunks`` tells in how
    many parts of about ``chunk`` own points such a cell is compared.
    """
    rows = materialise(points.withColumn("cell", F.lit(1).cast("bigint")).withColumn("own", F.lit(True)))
    rows = rows.withColumn("chunks", F.lit(1))
    done = None
    for _ in range(_DEEPEST):
        sizes = rows.filter("own").groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        crowded = materialise(sizes.filter(F.col("n") > leaf).select("cell", F.ceil(F.col("n") / chunk).cast("int").alias("__chunks")))
        small = rows.join(crowded, "cell", "left_anti")
        done = small if done is None else done.unionByName(small)
        if crowded.isEmpty():
            return done
        cuts = materialise(_cuts(rows, crowded.select("cell"), eps, parts))
        placed = rows.join(cuts, "cell").withColumn("at", total(F.zip_with("coords", "unit", lambda x, u: x * u)))

        def part(at: Column) -> Column:
            return F.size(F.filter("cuts", lambda c: c <= at))

        slack = F.lit(eps * (1 + _SLACK)) + _SLACK * F.abs("at")
        home = part(F.col("at"))
        reached = F.explode(F.sequence(part(F.col("at") - slack), part(F.col("at") + slack)))
        children = placed.withColumn("home", home).withColumn("part", reached)
        worth = materialise(_worthwhile(children))
        # A cell whose points are all alike has no cuts, and stays as it is like one that no cut helps.
        whole = rows.join(crowded, "cell").join(worth, "cell", "left_anti")
        done = done.unionByName(whole.withColumn("chunks", F.col("__chunks")).drop("__chunks"))
        if worth.isEmpty():
            return done
        step = children.join(worth, "cell").select(
            (F.col("cell") * parts + F.col("part")).alias("next"),
            (F.col("own") & (F.col("part") == F.col("home"))).alias("mine"),
            *[c for c in rows.columns if c not in ("cell", "own")],
        ).withColumnsRenamed({"next": "cell", "mine": "own"})
        rows = materialise(step)
    return done.unionByName(rows)


def _near(own: np.ndarray, others: np.ndarray, eps: float) -> np.ndarray:
    """Whether each of ``own`` lies within ``eps`` of each of ``others``: by a matrix product, close calls by differences."""
    squares = (own**2).sum(axis=1)[:, None] + (others**2).sum(axis=1)[None, :]
    rough = squares - 2 * own @ others.T
    near = rough <= eps * eps
    i, j = np.nonzero(np.abs(rough - eps * eps) <= _SLACK * (squares + eps * eps))
    near[i, j] = ((own[i] - others[j]) ** 2).sum(axis=1) <= eps * eps
    return near


def _by_cell(rows: DataFrame, own_first: type, schema: str) -> DataFrame:
    """Feed each chunk of a cell to an ``own_first``: ``own(ids, coords, weights)`` once, ``guests(...)`` in blocks, then ``rows()``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, state, held = None, None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            cell_of, chunk_of, own_of, pt, weight = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2, 3, 5))
            coords = batch.column(4).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            new = (np.diff(cell_of) != 0) | (np.diff(chunk_of) != 0) | (own_of[1:] != own_of[:-1])
            bounds = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
            for a, b in zip(bounds, bounds[1:]):
                here, mine = (cell_of[a], chunk_of[a]), own_of[a]
                if held and (here != cell or not mine):
                    state, held = own_first(*(np.concatenate(c) for c in zip(*held))), []
                if here != cell:
                    if state is not None:
                        yield from state.rows()
                    cell, state = here, None
                if mine:
                    held.append((pt[a:b], coords[a:b], weight[a:b]))
                elif state is not None:
                    for at in range(a, b, _BLOCK):
                        part = slice(at, min(at + _BLOCK, b))
                        state.guests(pt[part], coords[part], weight[part])
        if held:
            state = own_first(*(np.concatenate(c) for c in zip(*held)))
        if state is not None:
            yield from state.rows()

    chunks = F.col("chunks") if "chunks" in rows.columns else F.lit(1)
    dealt = rows.withColumn("__chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))
    mine = F.col("own") & (F.pmod(F.xxhash64("pt"), chunks).cast("int") == F.col("__chunk"))
    named = dealt.select("cell", F.col("__chunk").alias("chunk"), mine.alias("own"), "pt", "coords", "weight")
    return named.repartition("cell", "chunk").sortWithinPartitions("cell", "chunk", F.desc("own")).mapInArrow(run, schema)


def neighbour_counts(celled: DataFrame, eps: float) -> DataFrame:
    """``pt, near``: the summed ``weight`` of the points within ``eps`` of each point, itself included."""

    class Counts:
        def __init__(self, ids, coords, weights):
            self.ids, self.coords, self.near = ids, coords, np.zeros(len(ids), np.int64)
            for at in range(0, len(ids), _BLOCK):
                self.guests(None, coords[at : at + _BLOCK], weights[at : at + _BLOCK])

        def guests(self, _ids, coords, weights):
            self.near += _near(self.coords, coords, eps) @ weights

        def rows(self):
            yield pa.RecordBatch.from_arrays([pa.array(self.ids), pa.array(self.near)], names=["pt", "near"])

    kind = celled.schema["pt"].dataType.simpleString()
    return _by_cell(celled, Counts, f"pt {kind}, near bigint")


def links(celled: DataFrame, eps: float) -> DataFrame:
    """``a, b``: pairs of points within ``eps`` that connect all that such pairs connect.

    Of the pairs of a cell only as many are returned as join its own points and its guests.
    """

    class Links:
        def __init__(self, ids, coords, _weights):
            self.ids, self.coords, self.root, self.pairs = ids, coords, np.arange(len(ids)), []
            waiting = np.arange(len(ids))
            while len(waiting):
                start, waiting = int(waiting[0]), waiting[1:]
                queue = [start]
                while queue and len(waiting):
                    nodes, queue = np.array(queue[:_BLOCK]), queue[_BLOCK:]
                    near = _near(coords[waiting], coords[nodes], eps)
                    met = near.any(axis=1)
                    found = waiting[met]
                    self.pairs += zip(ids[nodes[near[met].argmax(axis=1)]], ids[found])
                    self.root[found] = start
                    queue += found.tolist()
                    waiting = waiting[~met]

        def guests(self, ids, coords, _weights):
            near = _near(self.coords, coords, eps)
            for i in np.flatnonzero(near.any(axis=0)).tolist():
                mine = np.flatnonzero(near[:, i])
                groups, first = np.unique(self.root[mine], return_index=True)
                self.pairs += [(self.ids[mine[k]], ids[i]) for k in first]
                if len(groups) > 1:
                    self.root[np.isin(self.root, groups)] = groups[0]

        def rows(self):
            if self.pairs:
                columns = [pa.array([p[k].item() for p in self.pairs]) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, names=["a", "b"])

    kind = celled.schema["pt"].dataType.simpleString()
    return _by_cell(celled, Links, f"a {kind}, b {kind}")


def candidate_pairs(celled: DataFrame) -> int:
    """Pairs of points that the cells compare: own points times all points."""
    sizes = celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("own").cast("bigint")).alias("own"))
    return sizes.agg(F.coalesce(F.sum(F.col("n") * F.col("own")), F.lit(0))).first()[0]
