"""Density clustering of vectors, 2-D layout, and the document clustering job.

``density_clusters`` computes DBSCAN*: the flat cut at distance ``eps`` of the
hierarchy of Campello et al. (2013). A point with at least ``min_samples``
points (itself included) within ``eps`` is a core point; core points within
``eps`` of each other are linked; components of fewer than ``min_cluster_size``
points, and all other points, are noise (-1).

The work is done on grid cells with a diagonal of ``eps``. All points of a cell
are within ``eps`` of each other, so a crowded cell needs no pairs at all:
equal points are merged first, and the points of two crowded cells are compared
through ever smaller sub-cells instead of pair by pair. Vectors of more
dimensions than a grid can be matched in are cut recursively instead (see
``metric``). The result is exact.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import product
from operator import add, and_

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.operators import metric
from quillgrid.operators.components import connected_components
from quillgrid.operators.search import total
from quillgrid.operators.skew import HOT_ROWS, salted_join
from quillgrid.session import materialise

NOISE = -1
# Cells are matched on their position in this many dimensions, the widest ones.
_GRID_DIMENSIONS = 4
# Two units of at most this many points are compared pair by pair.
_SMALL_UNIT = 64
# Distances of up to this many dimensions are written out; longer ones use array functions.
_WRITTEN_OUT = 4
_DEEPEST = 40
# Points whose neighbours are looked at to choose eps, and the share of them that eps makes core points.
SAMPLED = 256
CORE_SHARE = 0.5


def _finite(vector: str) -> Column:
    """Whether there is a vector and all its elements are finite numbers."""
    numbers = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return F.coalesce(numbers, F.lit(False))


def _square_sum(parts: Column) -> Column:
    return total(F.transform(parts, lambda x: x * x))


def _distance2(a: str, b: str, dimensions: int) -> Column:
    if dimensions > _WRITTEN_OUT:
        return _square_sum(F.zip_with(a, b, lambda x, y: x - y))
    steps = [F.col(a)[i] - F.col(b)[i] for i in range(dimensions)]
    return reduce(add, [s * s for s in steps])


def _gaps(pick: Callable[[Column, Column], Column]) -> Column:
    """Per dimension, ``pick`` of how far one box's end lies beyond the other's start, both ways."""
    return F.zip_with(
        F.zip_with("a_hi", "b_lo", lambda hi, lo: hi - lo), F.zip_with("b_hi", "a_lo", lambda hi, lo: hi - lo), pick
    )


def _nearest2() -> Column:
    """Squared distance between the closest points two boxes ``a`` and ``b`` could hold."""
    return _square_sum(_gaps(lambda p, q: F.greatest(-p, -q, F.lit(0.0))))


def _farthest2() -> Column:
    """Squared distance between the farthest points two boxes ``a`` and ``b`` could hold."""
    return _square_sum(_gaps(lambda p, q: F.greatest(p, q)))


def _bounds(dimensions: int) -> list[Column]:
    c = F.col("coords")
    return [
        F.array(*[F.min(c[i]) for i in range(dimensions)]).alias("lo"),
        F.array(*[F.max(c[i]) for i in range(dimensions)]).alias("hi"),
    ]


def _sub_cell(coords: Column, side: float, level: int) -> Column:
    # Scaling by a power of two is exact, so levels nest.
    return F.transform(coords, lambda c: F.floor((c / side) * float(2**level)).cast("bigint"))


def _widest(points: DataFrame, dimensions: int) -> list[int]:
    """Indices of the dimensions with the largest variance."""
    spread = points.agg(*[F.var_pop(F.col("coords")[i]).alias(f"d{i}") for i in range(dimensions)]).first()
    ranked = sorted(range(dimensions), key=lambda i: (-(spread[i] or 0.0), i))
    return sorted(ranked[:_GRID_DIMENSIONS])


def _neighbour_cells(
    cells: DataFrame, dims: list[int], reach: int, eps: float, hot_rows: int, rows: int
) -> DataFrame:
    """Pairs ``a, b`` of different cells (each pair once) that could hold points within ``eps``.

    Cells lie in blocks of ``reach`` cells; each looks at its own block and the
    half of the surrounding ones that comes after it.
    """
    steps = [s for s in product((-1, 0, 1), repeat=len(dims)) if s >= (0,) * len(dims)]
    block = [F.floor(F.col("cell")[i] / reach).cast("bigint") for i in dims]
    keys = [f"g{n}" for n in range(len(dims))]
    homes = cells.select(
        F.col("cid").alias("b"),
        F.col("lo").alias("b_lo"),
        F.col("hi").alias("b_hi"),
        *[c.alias(k) for c, k in zip(block, keys, strict=True)],
    )
    offsets = F.array(*[F.array(*[F.lit(x) for x in s]) for s in steps])
    probes = cells.withColumn("step", F.explode(offsets)).select(
        F.col("cid").alias("a"),
        F.col("lo").alias("a_lo"),
        F.col("hi").alias("a_hi"),
        *[(c + F.col("step")[n]).alias(k) for n, (c, k) in enumerate(zip(block, keys, strict=True))],
        (F.array_max(F.transform("step", F.abs)) == 0).alias("same"),
    )
    met = salted_join(probes, homes, keys, spread=[F.col("a")], hot_rows=hot_rows, rows=rows * len(steps))
    # A few plain comparisons leave little for the full distance.
    close = [
        (F.col("a_lo")[i] - F.col("b_hi")[i] <= eps) & (F.col("b_lo")[i] - F.col("a_hi")[i] <= eps) for i in dims
    ]
    once = ~F.col("same") | (F.col("a") < F.col("b"))
    return met.filter(reduce(and_, close, once) & (_nearest2() <= eps * eps)).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    )


def _core_points(
    points: DataFrame, pairs: DataFrame, dimensions: int, eps: float, k: int, hot_rows: int, rows: int
) -> DataFrame:
    """Points with at least ``k`` points within ``eps``.

    Only points of cells with fewer than ``k`` points look at their neighbours,
    so a crowded cell meets few probes.
    """
    crowded = points.filter(F.col("cell_weight") >= k)
    lone = points.filter(F.col("cell_weight") < k)
    directed = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    probes = lone.join(directed, lone["cid"] == directed["a"]).select(
        F.col("pt").alias("probe"), F.col("coords").alias("probe_coords"), F.col("b").alias("cid")
    )
    met = salted_join(
        points.select("cid", "pt", "coords", "weight"),
        probes,
        ["cid"],
        spread=[F.col("pt")],
        spread_right=[F.col("probe")],
        hot_rows=hot_rows,
        rows=rows,
    )
    near = (
        met.filter(_distance2("coords", "probe_coords", dimensions) <= eps * eps)
        .groupBy(F.col("probe").alias("pt"))
        .agg(F.sum("weight").alias("near"))
    )
    found = (
        lone.join(near, "pt", "left")
        .filter(F.col("cell_weight") + F.coalesce("near", F.lit(0)) >= k)
        .select(*points.columns)
    )
    return crowded.unionByName(found)


def _units(core: DataFrame, dimensions: int) -> DataFrame:
    """Point count and tight bounds per unit (``cid, sub``)."""
    return core.groupBy("cid", "sub").agg(F.count(F.lit(1)).alias("n"), *_bounds(dimensions))


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}_{c}") for c in df.columns])


def _linked_cells(
    core: DataFrame, pairs: DataFrame, eps: float, side: float, dimensions: int, hot_rows: int, rows: int
) -> DataFrame:
    """Pairs ``a, b`` of cells with core points within ``eps`` of each other.

    A pair of units is settled by its bounds where possible, and otherwise split
    into sub-cells of half the size; small ones are compared point by point.
    """
    limit = eps * eps
    whole = core.withColumn("sub", F.array().cast("array<bigint>"))
    units = _units(whole, dimensions)
    candidates = (
        pairs.join(_prefixed(units, "a"), F.col("a") == F.col("a_cid"))
        .join(_prefixed(units, "b"), F.col("b") == F.col("b_cid"))
        .drop("a", "b")
    )
    linked = None
    parent = whole.withColumn("parent", F.col("sub"))
    for level in range(1, _DEEPEST + 1):
        rated = materialise(
            candidates.filter(_nearest2() <= limit)
            .withColumn("far", _farthest2())
            .select(
                "a_cid", "a_sub", "b_cid", "b_sub",
                (F.col("far") <= limit).alias("sure"),
                ((F.col("a_n") <= _SMALL_UNIT) & (F.col("b_n") <= _SMALL_UNIT)).alias("small"),
            )
        )
        sure = rated.filter("sure").select("a_cid", "b_cid").distinct()
        open_pairs = rated.filter("not sure").join(sure, ["a_cid", "b_cid"], "left_anti")
        last = level == _DEEPEST
        compare = open_pairs if last else open_pairs.filter("small")
        left = parent.select(F.col("cid").alias("a_cid"), F.col("sub").alias("a_sub"), F.col("coords").alias("a_coords"))
        right = parent.select(F.col("cid").alias("b_cid"), F.col("sub").alias("b_sub"), F.col("coords").alias("b_coords"))
        sides = salted_join(left, compare.select("a_cid", "a_sub", "b_cid", "b_sub"), ["a_cid", "a_sub"],
                            spread=[F.col("a_coords")], spread_right=[F.col("b_cid"), F.col("b_sub")],
                            hot_rows=hot_rows, rows=rows)
        close = (
            salted_join(sides, right, ["b_cid", "b_sub"], spread=[F.col("a_coords")], hot_rows=hot_rows)
            .filter(_distance2("a_coords", "b_coords", dimensions) <= limit)
            .select("a_cid", "b_cid")
            .distinct()
        )
        found = materialise(sure.unionByName(close).distinct())
        linked = found if linked is None else linked.unionByName(found)
        if last or rated.filter("not sure and not small").isEmpty():
            break
        # A pair found by its small units needs no further splitting.
        rest = materialise(open_pairs.filter("not small").join(found, ["a_cid", "b_cid"], "left_anti"))
        if rest.isEmpty():
            break
        open_cells = rest.select(F.col("a_cid").alias("cid")).unionByName(rest.select(F.col("b_cid").alias("cid"))).distinct()
        parent = materialise(
            parent.join(open_cells, "cid", "left_semi")
            .withColumn("parent", F.col("sub"))
            .withColumn("sub", _sub_cell(F.col("coords"), side, level))
        )
        children = _units(parent, dimensions).join(
            parent.select("cid", "sub", "parent").distinct(), ["cid", "sub"]
        )
        candidates = (
            rest.join(
                _prefixed(children, "a").withColumnsRenamed({"a_sub": "a_child", "a_parent": "a_sub"}), ["a_cid", "a_sub"]
            )
            .join(_prefixed(children, "b").withColumnsRenamed({"b_sub": "b_child", "b_parent": "b_sub"}), ["b_cid", "b_sub"])
            .drop("a_sub", "b_sub", "sure", "small")
            .withColumnsRenamed({"a_child": "a_sub", "b_child": "b_sub"})
        )
    return linked.select(F.col("a_cid").alias("a"), F.col("b_cid").alias("b")).distinct()


def neighbour_distances(
    data: DataFrame, k: int = 4, sampled: int = SAMPLED, *, id_col: str = "id", vector_col: str = "coords"
) -> DataFrame:
    """``id, distance``: how far the k-th closest vector is from each of ``sampled`` vectors, itself counted as the first.

    A point is a core point for every eps from this distance on. The sample is
    the ids with the smallest MD5; each is compared with all vectors, and a task
    passes on its k smallest distances. With fewer than k vectors the distance
    is NULL. Rows without a vector are left out.
    """
    rows = data.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("coords"))
    vectors = rows.filter(F.col("coords").isNotNull())
    sample = vectors.orderBy(F.md5(F.col("id").cast("string").cast("binary")), "id").limit(sampled).collect()
    places = [r["coords"] for r in sample]  # at most ``sampled`` vectors
    sizes = sorted({len(p) for p in places})
    if len(sizes) > 1:
        raise ValueError(f"vectors have {sizes[0]} to {sizes[-1]} elements")

    def nearest(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        best = np.full((len(places), k), np.inf)
        for batch in batches:
            lengths = set(batch.column(0).value_lengths().to_pylist())
            if lengths - {len(places[0])}:
                raise ValueError(f"vectors have {len(places[0])} and {max(lengths)} elements")
            points = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for i, place in enumerate(places):
                found = np.concatenate([best[i], np.sqrt(((points - place) ** 2).sum(axis=1))])
                best[i] = np.partition(found, k - 1)[:k]
        at, _ = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(best[np.isfinite(best)])], names=["at", "distance"])

    # The limit on row_number cuts every task's rows to k per sampled point before the shuffle.
    closest = Window.partitionBy("at").orderBy("distance")
    kth = (
        vectors.select("coords").mapInArrow(nearest, "at int, distance double")
        .withColumn("n", F.row_number().over(closest)).filter(F.col("n") <= k)
        .groupBy("at").agg(F.max(F.when(F.col("n") == k, F.col("distance"))).alias("distance"))
    )
    ids = data.sparkSession.createDataFrame([(i, r["id"]) for i, r in enumerate(sample)], f"at int, id {rows.schema['id'].dataType.simpleString()}")
    return ids.join(kth, "at").select("id", "distance")


def suggested_eps(
    data: DataFrame, k: int = 4, core_share: float = CORE_SHARE, *, id_col: str = "id", vector_col: str = "coords"
) -> float:
    """The eps at which ``core_share`` of a bounded sample of vectors are core points.

    Vectors with k copies of themselves don't count, or eps could be 0.
    """
    found = neighbour_distances(data, k, id_col=id_col, vector_col=vector_col).filter("distance > 0")
    eps = found.agg(F.percentile("distance", core_share)).first()[0]
    return 1e-6 if eps is None else eps


def density_clusters(
    data: DataFrame,
    eps: float | None = None,
    min_cluster_size: int = 4,
    min_samples: int | None = None,
    *,
    id_col: str = "id",
    vector_col: str = "coords",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``id, cluster`` of every row; a cluster is named after its smallest id.

    Unlike HDBSCAN, ``eps`` is one cut for all clusters and is not chosen per
    branch; without it, ``suggested_eps`` is taken. ``min_samples`` defaults to
    ``min_cluster_size``. Rows without a vector are noise, and so are those with
    an element that is not a finite number, which are near to nothing.
    """
    k = min_samples or min_cluster_size
    if eps is None:
        eps = suggested_eps(data, k, id_col=id_col, vector_col=vector_col)
    noise = F.lit(NOISE).cast("bigint")
    rows = data.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("coords"))
    vectors = rows.filter(_finite("coords"))
    first = vectors.select(F.size("coords")).first()
    if first is None:
        return rows.select("id", noise.alias("cluster"))
    dimensions = first[0]
    side = eps / math.sqrt(dimensions) * (1 - 1e-9)
    reach = math.floor(eps / side) + 1

    merged = vectors.groupBy("coords").agg(F.min("id").alias("pt"), F.count(F.lit(1)).alias("weight"))
    placed = materialise(merged.withColumn("cell", _sub_cell(F.col("coords"), side, 0)))
    longest = F.max(F.size("coords"))
    count, shortest, longest = placed.agg(F.count(F.lit(1)), F.min(F.size("coords")), longest).first()
    if shortest != longest:
        raise ValueError(f"vectors have {shortest} to {longest} elements")
    if dimensions > _GRID_DIMENSIONS:
        by_point = _clustered_by_cuts(placed.drop("cell"), eps, k, min_cluster_size, hot_rows, count)
        return _every_row(rows, vectors, by_point, hot_rows)
    cells = materialise(
        placed.groupBy("cell").agg(
            F.min("pt").alias("cid"), F.sum("weight").alias("cell_weight"), *_bounds(dimensions)
        )
    )
    of_cell = cells.select("cell", "cid", "cell_weight")
    points = salted_join(placed, of_cell, ["cell"], spread=[F.col("pt")], hot_rows=hot_rows, rows=count).drop("cell")
    points = materialise(points)

    dims = _widest(points, dimensions)
    pairs = materialise(_neighbour_cells(cells, dims, reach, eps, hot_rows, count))
    core = materialise(_core_points(points, pairs, dimensions, eps, k, hot_rows, count))

    edges = _linked_cells(core, pairs, eps, side, dimensions, hot_rows, count)
    components = connected_components(edges, hot_rows)
    core_cells = core.groupBy("cid").agg(F.min("pt").alias("first"), F.sum("weight").alias("size"))
    labelled = core_cells.join(components, core_cells["cid"] == components["node"], "left").withColumn(
        "component", F.coalesce("component", "cid")
    )
    sizes = labelled.groupBy("component").agg(F.min("first").alias("cluster"), F.sum("size").alias("members"))
    kept = sizes.filter(F.col("members") >= min_cluster_size).select("component", "cluster")
    by_cell = salted_join(
        labelled.select("component", "cid"), kept, ["component"], spread=[F.col("cid")], hot_rows=hot_rows, rows=count
    ).select("cid", "cluster")
    by_point = salted_join(core.select("cid", "coords"), by_cell, ["cid"], spread=[F.col("coords")], hot_rows=hot_rows, rows=count)
    return _every_row(rows, vectors, by_point, hot_rows)


def _clustered_by_cuts(
    points: DataFrame, eps: float, k: int, min_cluster_size: int, hot_rows: int, rows: int
) -> DataFrame:
    """``coords, cluster`` of the core points among the distinct ``points`` (``pt, coords, weight``), for many dimensions."""
    celled = materialise(metric.cells(points, eps))
    core = materialise(metric.neighbour_counts(celled, eps).filter(F.col("near") >= k).select("pt"))
    linked = connected_components(materialise(metric.links(celled.join(core, "pt"), eps)), hot_rows)
    cored = points.join(core, "pt").join(linked.withColumnRenamed("node", "pt"), "pt", "left")
    labelled = materialise(cored.withColumn("component", F.coalesce("component", "pt")))
    sizes = labelled.groupBy("component").agg(F.min("pt").alias("cluster"), F.sum("weight").alias("members"))
    kept = sizes.filter(F.col("members") >= min_cluster_size).select("component", "cluster")
    return salted_join(labelled, kept, ["component"], spread=[F.col("pt")], hot_rows=hot_rows, rows=rows).select("coords", "cluster")


def _every_row(rows: DataFrame, vectors: DataFrame, by_point: DataFrame, hot_rows: int) -> DataFrame:
    """``id, cluster`` of all rows; those that are no core point are noise."""
    noise = F.lit(NOISE).cast("bigint")
    out = salted_join(
        vectors,
        by_point.select("coords", "cluster"),
        ["coords"],
        spread=[F.col("id")],
        how="left",
        hot_rows=hot_rows,
    )
    # Rows without a vector stay out of the join, where they would all meet in one task.
    return out.select("id", F.coalesce("cluster", noise).alias("cluster")).unionByName(
        rows.filter(~_finite("coords")).select("id", noise.alias("cluster"))
    )


def layout_2d(vectors: DataFrame, id_col: str = "id", vector_col: str = "coords") -> DataFrame:
    """``id, x, y``: the first two principal components, signs fixed by the largest loading.

    The components are those of the vectors whose elements are all finite; others lie at NaN.
    """
    known = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("coords"), _finite(vector_col).alias("finite"))
    data = known.select("id", "finite", array_to_vector("coords").alias("v"))
    own = data.filter("finite").select("v")
    if own.limit(2).count() < 2:  # one point has no spread
        place = F.when(F.col("finite"), 0.0).otherwise(math.nan)
        return data.select("id", place.alias("x"), place.alias("y"))
    model = PCA(k=2, inputCol="v", outputCol="p").fit(own)
    loadings = model.pc.toArray()
    x_sign, y_sign = (1.0 if col[abs(col).argmax()] >= 0 else -1.0 for col in loadings.T)
    p = vector_to_array("p")
    x, y = (F.when(F.col("finite"), c).otherwise(math.nan) for c in (p[0] * x_sign, p[1] * y_sign))
    return model.transform(data).select("id", x.alias("x"), y.alias("y"))


def cluster_documents(
    documents: DataFrame,
    eps: float | None = None,
    min_cluster_size: int = 4,
    *,
    id_col: str = "doc_id",
    file_col: str = "file",
    vector_col: str = "embedding",
) -> DataFrame:
    """The clustering job: ``file, cluster, x, y`` of every document; without an embedding it is noise without a place.

    An embedding with an element that is not a finite number makes noise as well, at NaN. Clusters are formed on the full vectors, not on the layout.
    """
    vectors = documents.select(F.col(id_col).alias("id"), F.col(file_col).alias("file"), F.col(vector_col).alias("coords"))
    # The user's model runs once, not once per step.
    every = materialise(vectors)
    vectors = every.filter(F.col("coords").isNotNull())
    clusters = density_clusters(vectors, eps, min_cluster_size)
    layout = layout_2d(vectors)
    placed = vectors.select("id", "file").join(clusters, "id").join(layout, "id").select("file", "cluster", "x", "y")
    none = F.lit(None).cast("double")
    lacking = every.filter(F.col("coords").isNull())
    return placed.unionByName(lacking.select("file", F.lit(NOISE).cast("bigint").alias("cluster"), none.alias("x"), none.alias("y")))
