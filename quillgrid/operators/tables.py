"""Rows and columns of tables, from the places of their text blocks.

Along an axis, every place is covered by some of a table's blocks. Bands of
places that much is covered at are its rows or columns, and the gaps between
them separate these. A block that reaches over several columns covers the gaps
between them, but alone; so a place counts as a gap as long as the blocks there
are low (or, across rows, narrow) altogether, compared with the fullest place.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Share of the fullest place's cover up to which a place is a gap.
GAP_SHARE = 0.34

# Blocks above which a table is not swept in memory.
LARGE_TABLE = 100_000

# Hashes of keys by which blocks are counted first.
BUCKETS = 65_536

# Blocks that are swept at a time.
BATCH_BLOCKS = 50_000

COORDINATES = ("x0", "y0", "x1", "y1")
CELL = ("row_no", "row_span", "col_no", "col_span")


def bands(blocks: DataFrame, keys: Sequence[str], axis: str, gap_share: float = GAP_SHARE) -> DataFrame:
    """``keys, bands``: for each table its bands between gaps along ``x`` or ``y``, an array of ``start, end`` in order.

    Ends are swept in order; where one block ends and another begins, there is no gap. Flat blocks cover nothing.
    """
    low, high, extent = F.col(f"{axis}0"), F.col(f"{axis}1"), F.col("y1") - F.col("y0") if axis == "x" else F.col("x1") - F.col("x0")
    solid = blocks.filter((low < high) & (extent > 0))
    ends = F.array(F.struct(low.alias("at"), extent.alias("step")), F.struct(high.alias("at"), (-extent).alias("step")))
    # All steps of one place are taken together.
    places = solid.select(*keys, F.explode(ends).alias("end")).groupBy(*keys, F.col("end.at").alias("at")).agg(F.sum("end.step").alias("step"))
    sweep = Window.partitionBy(*keys).orderBy("at")
    covered = places.withColumns({"cover": F.sum("step").over(sweep), "until": F.lead("at").over(sweep)})
    most = F.max("cover").over(Window.partitionBy(*keys))
    dense = covered.withColumn("dense", F.col("cover") > gap_share * most)
    begins = F.col("dense") & ~F.coalesce(F.lag("dense").over(sweep), F.lit(False))
    numbered = dense.withColumn("band", F.sum(begins.cast("int")).over(sweep)).filter("dense")
    spans = numbered.groupBy(*keys, "band").agg(F.min("at").alias("start"), F.max("until").alias("end"))
    return spans.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("bands"))


def _first(found: Column, low: str) -> Column:
    """Bands that end at or before the block: the number of its first band."""
    return F.size(F.filter(found, lambda b: b["end"] <= F.col(low)))


def _last(found: Column, high: str) -> Column:
    return F.size(F.filter(found, lambda b: b["start"] < F.col(high))) - 1


def _cells_of_bands(blocks: DataFrame, keys: Sequence[str], gap_share: float) -> DataFrame:
    """``extract_cells`` by ``bands`` and joins: for tables of any size."""
    rows = bands(blocks, keys, "y", gap_share).withColumnRenamed("bands", "__rows")
    columns = bands(blocks, keys, "x", gap_share).withColumnRenamed("bands", "__columns")
    placed = blocks.join(rows, list(keys), "left").join(columns, list(keys), "left")
    out = {}
    for name, low, high in (("row", "y0", "y1"), ("col", "x0", "x1")):
        found = F.col("__rows" if name == "row" else "__columns")
        first = _first(found, low)
        out[f"{name}_no"] = F.when(found.isNotNull(), F.least(first, F.size(found) - 1))
        out[f"{name}_span"] = F.when(found.isNotNull(), F.greatest(F.lit(1), _last(found, high) - first + 1))
    return placed.withColumns(out).drop("__rows", "__columns")


def together(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of one table in one partition. What is made of each row later needs no further shuffle in ``extract_cells``.

    Rows are dealt by a hash of the keys, as Spark may leave out a shuffle by the keys themselves after a join by them, and
    read what remains in other parts.
    """
    return rows.repartition(F.xxhash64(*keys))


def _changes(column: pa.ChunkedArray) -> np.ndarray:
    """Whether each key but the first differs from the one before, as Spark compares them."""
    if pa.types.is_floating(column.type):
        values = column.to_numpy()
        return ~_equal(values[1:], values[:-1])
    return pc.not_equal(column[1:], column[:-1]).to_numpy()


def _equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b) | (np.isnan(a) & np.isnan(b))


def _less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Spark's order: NaN is above all numbers."""
    return (a < b) | (~np.isnan(a) & np.isnan(b))


def _running_sums(steps: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums up to each step, from the first one of its table on and in order: no rounding reaches another table."""
    sums = steps.copy()
    long = sizes > 64
    for at, size in zip(first[long], sizes[long]):
        sums[at : at + size] = np.cumsum(steps[at : at + size])
    order = np.argsort(-sizes[~long], kind="stable")
    first, sizes = first[~long][order], sizes[~long][order]
    for i in range(1, sizes[0] if len(sizes) else 0):
        at = first[: np.searchsorted(-sizes, -i)] + i  # of tables with more than i steps
        sums[at] += sums[at - 1]
    return sums


def _sweep(of: np.ndarray, low: np.ndarray, high: np.ndarray, extent: np.ndarray, gap_share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``bands`` of many tables at once: table, start and end of each, in order. ``of`` numbers the blocks' tables."""
    if not len(of):
        return of, low, high
    at, step, of = np.concatenate([low, high]), np.concatenate([extent, -extent]), np.concatenate([of, of])
    order = np.lexsort((at, of))
    at, step, of = at[order], step[order], of[order]
    # All steps of one place are taken together.
    places = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | ~_equal(at[1:], at[:-1])]))
    at, step, of = at[places], np.add.reduceat(step, places), of[places]
    opens = np.concatenate([[True], of[1:] != of[:-1]])
    closes = np.concatenate([opens[1:], [True]])
    first = np.flatnonzero(opens)
    sizes = np.diff(np.append(first, len(of)))
    cover = _running_sums(step, first, sizes)
    dense = cover > gap_share * np.repeat(np.maximum.reduceat(cover, first), sizes)
    begins = dense & (opens | ~np.concatenate([[False], dense[:-1]]))
    ends = dense & (closes | ~np.concatenate([dense[1:], [False]]))
    # Nothing follows a table's last place.
    until = np.where(closes, np.where(begins, np.nan, at), np.append(at[1:], np.nan))
    return of[begins], at[begins], until[ends]


def _count_below(of: np.ndarray, bound: np.ndarray, sought_of: np.ndarray, sought: np.ndarray, side: str, tables: int) -> np.ndarray:
    """For each sought value, how many of its table's bounds are below it (``right``: or equal). Bounds are in order."""
    values = np.unique(bound)
    ranks = of * (len(values) + 1) + np.searchsorted(values, bound)
    before = np.searchsorted(of, np.arange(tables))
    return np.searchsorted(ranks, sought_of * (len(values) + 1) + np.searchsorted(values, sought, side)) - before[sought_of]


def _place(blocks: pa.Table, of: np.ndarray, gap_share: float) -> pa.Table:
    """``blocks`` of whole tables, numbered by ``of``, with their cells."""
    tables = int(of[-1]) + 1
    x0, y0, x1, y1 = (blocks.column(name).to_numpy() for name in COORDINATES)  # a null is NaN here
    known = {name: blocks.column(name).is_valid().to_numpy() for name in COORDINATES}
    every = known["x0"] & known["y0"] & known["x1"] & known["y1"]
    for name, axis, low, high, extent in (("row", "y", y0, y1, x1 - x0), ("col", "x", x0, x1, y1 - y0)):
        solid = every & _less(low, high) & _less(np.zeros(len(of)), extent)
        band_of, start, end = _sweep(of[solid], low[solid], high[solid], extent[solid], gap_share)
        found = np.bincount(band_of, minlength=tables)[of]
        first = np.where(known[f"{axis}0"], _count_below(band_of, end, of, low, "right", tables), 0)
        last = np.where(known[f"{axis}1"], _count_below(band_of, start, of, high, "left", tables), 0) - 1
        for what, number in (("no", np.minimum(first, found - 1)), ("span", np.maximum(1, last - first + 1))):
            blocks = blocks.append_column(f"{name}_{what}", pa.array(number.astype("int32"), mask=found == 0))
    return blocks


def _placed_batches(batches: Iterator[pa.RecordBatch], keys: Sequence[str], gap_share: float) -> Iterator[pa.RecordBatch]:
    """Cells of blocks in the order of ``keys``. Many whole tables are taken at a time; the last one waits for its rest."""
    waiting, rows, enough = [], 0, BATCH_BLOCKS
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            waiting.append(batch)
            rows += batch.num_rows
        if not rows or (batch is not None and rows < enough):
            continue
        blocks = pa.Table.from_batches(waiting).combine_chunks()
        changes = np.zeros(rows - 1, dtype=bool)
        for key in keys:
            changes |= _changes(blocks.column(key))
        of = np.concatenate([[0], np.cumsum(changes)])
        whole = rows if batch is None else int(np.searchsorted(of, of[-1]))
        if whole:
            with np.errstate(invalid="ignore"):
                placed = _place(blocks.slice(0, whole), of[:whole], gap_share)
            yield from placed.to_batches(max_chunksize=BATCH_BLOCKS)
        waiting, rows = blocks.slice(whole).to_batches(), rows - whole
        enough = rows + BATCH_BLOCKS


def large_tables(rows: DataFrame, keys: Sequence[str], most: int) -> DataFrame:
    """``keys`` that more than ``most`` rows share.

    Rows are first counted by ``BUCKETS`` hashes of the keys, which shuffles next to nothing, and keys only where a hash
    has so many rows.
    """
    held = rows.select(*keys).withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)))
    above = F.col("count") > most
    full = held.groupBy("__bucket").count().filter(above).select("__bucket")
    return held.join(F.broadcast(full), "__bucket", "left_semi").groupBy(*keys).count().filter(above).select(*keys)


def extract_cells(blocks: DataFrame, keys: Sequence[str], gap_share: float = GAP_SHARE, large: DataFrame | None = None) -> DataFrame:
    """``blocks`` (``x0, y0, x1, y1``) with ``row_no, row_span, col_no, col_span``: each block's cell in the table named by ``keys``.

    Numbers begin at 0. A block within a gap belongs to the next row or column. A
    table whose blocks are all flat has no rows or columns; its blocks have NULL cells,
    as have blocks without a key.

    Blocks are shuffled once (see ``together``), and the tables of a partition are swept many at a time. Tables of more
    than ``LARGE_TABLE`` blocks, which are few, take ``bands`` and joins, as do nested keys and coordinates that are not
    doubles. ``large`` holds the keys of the large tables, where a caller can tell them at less cost than by counting blocks.
    """
    keys, kinds = list(keys), {field.name: field.dataType for field in blocks.schema}
    swept = [kinds.get(name) == T.DoubleType() for name in COORDINATES] + [isinstance(kinds.get(key), T.AtomicType) for key in keys]
    if not keys or not all(swept):
        return _cells_of_bands(blocks, keys, gap_share)
    blocks = blocks.select(*keys, *[name for name in blocks.columns if name not in keys])
    schema = T.StructType(blocks.schema.fields + [T.StructField(name, T.IntegerType()) for name in CELL])
    named = F.lit(True)
    for key in keys:
        named &= F.col(key).isNotNull()
    large = F.broadcast(large_tables(blocks.filter(named), keys, LARGE_TABLE) if large is None else large)
    small = together(blocks.filter(named).join(large, keys, "left_anti"), keys).sortWithinPartitions(*keys)
    placed = small.mapInArrow(lambda batches: _placed_batches(batches, keys, gap_share), schema)
    by_bands = _cells_of_bands(blocks.filter(named).join(large, keys, "left_semi"), keys, gap_share)
    unnamed = blocks.filter(~named).select("*", *[F.lit(None).cast("int").alias(name) for name in CELL])
    return placed.unionByName(by_bands).unionByName(unnamed)


def table_shapes(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, n_rows, n_cols, n_cells, n_spanning`` of every table of ``extract_cells``."""
    spanning = (F.col("row_span") > 1) | (F.col("col_span") > 1)
    return cells.groupBy(*keys).agg(
        F.max(F.col("row_no") + F.col("row_span")).alias("n_rows"),
        F.max(F.col("col_no") + F.col("col_span")).alias("n_cols"),
        F.count(F.lit(1)).alias("n_cells"),
        F.sum(F.coalesce(spanning, F.lit(False)).cast("int")).alias("n_spanning"),
    )
