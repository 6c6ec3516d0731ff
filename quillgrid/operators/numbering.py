"""Positions within ordered groups, whatever the size of a group.

A plain ``row_number`` window puts a whole group into one task. Here a bounded
sample of the group and order columns fixes cut points first, and the segment of
a row follows from comparing it with them. So a large group is spread over many
segments, rows are shuffled once, and at most two summary rows per segment turn
local numbers into positions within the whole group. Where a count of the groups
shows that all are short, a plain window gives the same numbers.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import isqrt
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_SEGMENT = "__segment"
# Sampled rows per segment that fix the cut points.
SAMPLED_PER_SEGMENT = 40
# Groups of at most so many rows are numbered by a plain window, whatever the size of the table.
SHORT_GROUP = 20_000
# Spark's own limit for cutting groups before a row_number window (windowGroupLimitThreshold), and the parts that a
# group is cut in first.
_SHORT = 1000
_PARTS = 32

# A column to order by, ascending, or with True for descending. NULL is the smallest value.
Key = Column | tuple[Column, bool]


def _pair(key: Key) -> tuple[Column, bool]:
    return (key, False) if isinstance(key, Column) else key


def sort_columns(order: Sequence[Key]) -> list[Column]:
    """The keys as columns for ``orderBy`` and windows."""
    return [c.desc() if down else c.asc() for c, down in map(_pair, order)]


def _same(left: str, names: Sequence[str], right: str) -> Column:
    pairs = [F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}")) for n in names]
    return reduce(and_, pairs)


def _group_sizes(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """Rows of the largest group and of all groups."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    largest, rows = counts.agg(F.max("n"), F.sum("n")).first()
    return largest or 0, rows or 0


def _cut_points(df: DataFrame, sort: Sequence[Key], segments: int, rows: int) -> DataFrame:
    """Rows at which segments begin, in order: at most ``segments - 1``, from a sample of a bounded size.

    The result is a local table with the columns ``c0, c1, ...``.
    """
    narrow = df.select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(map(_pair, sort))])
    wanted = SAMPLED_PER_SEGMENT * segments
    sample = narrow.sample(wanted / rows, seed=1) if rows > wanted else narrow
    downs = [down for _, down in map(_pair, sort)]
    ordered = sample.orderBy(*sort_columns([(F.col(f"c{i}"), down) for i, down in enumerate(downs)])).collect()
    step = -(-len(ordered) // segments) or 1
    cuts = list(dict.fromkeys(ordered[step::step]))
    return df.sparkSession.createDataFrame(cuts, narrow.schema)


def _segment_of(sort: Sequence[Key], cuts: list, schema: StructType) -> Column:
    """How many of the ordered cut points are at or before the row, in two steps of about sqrt(n) comparisons."""
    if not cuts:
        return F.lit(0)

    def literal(cut) -> Column:
        return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(cut, schema)])

    def reached(cut: Column) -> Column:
        found = F.lit(True)
        for i, (c, down) in reversed(list(enumerate(map(_pair, sort)))):
            row, at = F.struct(c.alias("c")), F.struct(cut[f"c{i}"].alias("c"))  # structs compare NULLs too
            found = (row < at if down else row > at) | ((row == at) & found)
        return found

    step = isqrt(len(cuts) - 1) + 1
    chunks = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    heads = F.array(*[literal(c[0]) for c in chunks])
    # Cut points ascend, so all chunks before the last one whose head is reached are reached wholly.
    chunk = F.size(F.filter(heads, reached))
    inside = F.element_at(F.array(*[F.array(*map(literal, c)) for c in chunks]), F.greatest(chunk, F.lit(1)))
    return F.when(chunk == 0, F.lit(0)).otherwise((chunk - 1) * step + F.size(F.filter(inside, reached)))


def _spanning(rows: DataFrame, cuts: DataFrame, keys: Sequence[str], sort: Sequence[Column], neighbour: str | None) -> DataFrame:
    """What a segment must know of the rest of the groups that go on in other segments.

    Those hold a cut point, so there are at most two rows per segment, however
    large the table is.
    """
    names = [_SEGMENT, *keys]
    if keys:
        split = cuts.select(*[F.col(f"c{i}").alias(k) for i, k in enumerate(keys)]).distinct()
        # At most one row per cut point.
        rows = rows.alias("r").join(F.broadcast(split).alias("e"), _same("r", keys, "e"), "left_semi")
    summary = [F.count(F.lit(1)).alias("__rows")]
    if neighbour:
        local = Window.partitionBy(*names).orderBy(*sort)
        rows = rows.withColumn("__local", F.row_number().over(local))
        value = F.struct(neighbour)
        summary += [
            F.max(F.when(F.col("__local") == 1, value))[neighbour].alias("__first"),
            F.max_by(value, "__local")[neighbour].alias("__last"),
        ]
    spans = rows.groupBy(*names).agg(*summary)
    across = Window.partitionBy(*keys).orderBy(_SEGMENT)
    so_far = F.sum("__rows").over(across.rowsBetween(Window.unboundedPreceding, -1))
    added = {
        "__before": F.coalesce(so_far, F.lit(0)),
        "__all": F.sum("__rows").over(Window.partitionBy(*keys)),
    }
    if neighbour:
        added["__left"] = F.lag("__last").over(across)
        added["__right"] = F.lead("__first").over(across)
    return spans.withColumns(added).drop("__rows", "__first", "__last")


def _plain(
    df: DataFrame, keys: Sequence[str], order: Sequence[Key], position: str, total: str | None, neighbour: str | None
) -> DataFrame:
    """``with_position`` of short groups, by a window over whole groups."""
    group = Window.partitionBy(*keys)
    ordered = group.orderBy(*sort_columns(order))
    added = {position: F.row_number().over(ordered).cast("bigint")}
    if total:
        added[total] = F.count(F.lit(1)).over(group)
    if neighbour:
        added |= {f"previous_{neighbour}": F.lag(neighbour).over(ordered), f"next_{neighbour}": F.lead(neighbour).over(ordered)}
    return df.select(*df.columns, *[c.alias(name) for name, c in added.items()])


def with_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Key],
    *,
    position: str = "position",
    total: str | None = None,
    neighbour: str | None = None,
) -> DataFrame:
    """Add the 1-based ``position`` of each row within its group.

    ``order`` holds columns of plain types, or pairs ``(column, True)`` for
    descending ones. It should end in a column that is unique within the group:
    rows that tie on it all fall into one segment and get an arbitrary order.
    ``keys`` may be empty, which numbers the whole table. ``total`` adds the
    group size under that name; ``neighbour`` adds ``previous_<name>`` and
    ``next_<name>``. The group and order columns of ``df`` are evaluated four
    times, its rows once: write them first if they are costly or not
    deterministic. The cut points are taken when this function is called.
    """
    spark = df.sparkSession
    largest, count = _group_sizes(df, keys)
    if largest <= SHORT_GROUP:
        return _plain(df, keys, order, position, total, neighbour)
    segments = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = [*[F.col(k) for k in keys], *order]
    cuts = _cut_points(df, keyed, segments, count)
    rows = df.withColumn(_SEGMENT, _segment_of(keyed, cuts.collect(), cuts.schema))

    names, sort = [_SEGMENT, *keys], sort_columns(order)
    local = Window.partitionBy(*names).orderBy(*sort)
    inside = {"__local": F.row_number().over(local)}
    if total or neighbour:
        inside["__here"] = F.count(F.lit(1)).over(Window.partitionBy(*names))
    if neighbour:
        inside |= {"__lag": F.lag(neighbour).over(local), "__lead": F.lead(neighbour).over(local)}
    numbered = rows.repartitionById(segments, F.col(_SEGMENT)).withColumns(inside)
    spans = _spanning(rows, cuts, keys, sort, neighbour)
    # At most two rows per segment, see _spanning.
    joined = numbered.alias("r").join(F.broadcast(spans).alias("s"), _same("r", names, "s"), "left")

    out = [F.col(f"r.{c}").alias(c) for c in df.columns]
    out.append((F.coalesce("__before", F.lit(0)) + F.col("__local")).cast("bigint").alias(position))
    if total:
        out.append(F.coalesce("__all", "__here").cast("bigint").alias(total))
    if neighbour:
        first, last = F.col("__local") == 1, F.col("__local") == F.col("__here")
        out.append(F.when(first, F.col("__left")).otherwise(F.col("__lag")).alias(f"previous_{neighbour}"))
        out.append(F.when(last, F.col("__right")).otherwise(F.col("__lead")).alias(f"next_{neighbour}"))
    return joined.select(*out)


def slice_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Key], start: int = 0, stop: int | None = None
) -> DataFrame:
    """Rows ``start <= index < stop`` of each ordered group; ``stop=None`` means to the end."""
    start = max(start, 0)
    if stop is not None and stop <= start:
        return df.filter(F.lit(False))
    if stop is not None and stop <= _SHORT:
        if not keys:
            return df.orderBy(*sort_columns(order)).offset(start).limit(stop - start)
        # With so low a bound on row_number every task cuts its groups before the shuffle. Parts of a group are cut
        # first, so the task that gets a whole group sees a bounded number of its rows, however many tasks there are.
        sort = sort_columns(order)
        parts = df.withColumn("__part", F.spark_partition_id() % _PARTS)
        cut = parts.withColumn("__n", F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(*sort)))
        few = cut.filter(F.col("__n") <= stop).drop("__part", "__n")
        numbered = few.withColumn("__position", F.row_number().over(Window.partitionBy(*keys).orderBy(*sort)))
    else:
        numbered = with_position(df, keys, order, position="__position")
    kept = numbered.filter(F.col("__position") > start)
    if stop is not None:
        kept = kept.filter(F.col("__position") <= stop)
    return kept.drop("__position")


def batch_number(index: Column, size: int) -> Column:
    """Number of the batch of ``size`` rows that holds the 0-based ``index``."""
    return F.floor(index / size).cast("int")
