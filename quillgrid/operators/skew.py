"""Equi-join that splits keys holding very many rows over several tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.session import written

HOT_ROWS = 1_000_000


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS, within: Sequence[Column] = ()) -> DataFrame | None:
    """Keys with more than ``hot_rows`` rows and the parts to split each into; None if there are none.

    A part holds about ``hot_rows`` rows, whatever the size of the table. ``within`` are functions of the keys, with far
    fewer values: keys are only counted where so many rows share these.
    """
    if within:
        wide = [f"__within{i}" for i in range(len(within))]
        df = df.select(*keys, *[c.alias(name) for c, name in zip(within, wide)])
        crowded = hot_keys(df, wide, hot_rows)
        if crowded is None:
            return None
        df = df.join(crowded.select(*wide), wide, "left_semi")
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    largest = counts.agg(F.max("__rows")).first()[0]
    if (largest or 0) <= hot_rows:
        return None
    parts = F.ceil(F.col("__rows") / hot_rows).cast("int").alias("__parts")
    # Written, so that Spark knows how few they are and need not shuffle the rows to find them.
    return written(counts.filter(F.col("__rows") > hot_rows).select(*keys, parts), "hot-keys")


def _marked(df: DataFrame, hot: DataFrame | None, keys: Sequence[str], name: str) -> DataFrame:
    """Add the number of parts of the row's key."""
    if hot is None:
        return df.withColumn(name, F.lit(1))
    # No hint: Spark broadcasts the hot keys if they are few, and else splits them as skewed.
    marks = hot.withColumnRenamed("__parts", name)
    return df.join(marks, list(keys), "left").withColumn(name, F.coalesce(name, F.lit(1)))


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    *,
    spread: Sequence[Column],
    spread_right: Sequence[Column] = (),
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
    rows: int | None = None,
    within: Sequence[Column] = (),
) -> DataFrame:
    """Join on ``keys``; rows of a hot left key are spread over parts by a hash of ``spread``.

    The matching right rows are copied to every part. With ``spread_right``,
    hot right keys are split the same way (inner joins only). Both must name
    columns that tell the rows of one key apart. ``how`` is ``inner`` or
    ``left``; the columns of ``keys`` must not be NULL. ``rows`` is an upper
    bound of the left rows, if one is known: a small one saves the count, and
    ``within`` makes it cheap, see ``hot_keys``.
    """
    if spread_right and how != "inner":
        raise ValueError("only an inner join can split its right side")
    small = rows is not None and rows <= hot_rows
    hot_left = None if small else hot_keys(left, keys, hot_rows, within)
    hot_right = hot_keys(right, keys, hot_rows, within) if spread_right else None
    if hot_left is None and hot_right is None:
        return left.join(right, list(keys), how)

    def part(columns: Sequence[Column], count: str) -> Column:
        return F.pmod(F.xxhash64(*columns), F.col(count)).cast("int") if columns else F.lit(0)

    def every(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    salted = []
    for df, own, own_part, other_part in (
        (left, spread, "__left_part", "__right_part"),
        (right, spread_right, "__right_part", "__left_part"),
    ):
        both = _marked(_marked(df, hot_left, keys, "__left_parts"), hot_right, keys, "__right_parts")
        placed = both.withColumn(own_part, part(own, own_part + "s")).withColumn(other_part, every(other_part + "s"))
        salted.append(placed.drop("__left_parts", "__right_parts"))
    return salted[0].join(salted[1], [*keys, "__left_part", "__right_part"], how).drop("__left_part", "__right_part")
