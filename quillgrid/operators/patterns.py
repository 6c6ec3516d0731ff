"""Cyclic patterns in a graph: triangles and four-cycles.

Joining a cycle's edges one after another makes all open paths, which are many
times the cycles. Here nodes are put in order of their degree, and work starts
from the lower end of an edge: at most about sqrt(2 m) of the m edges lead from
a node to higher ones, so lists of these stay short and at most m * sqrt(2 m)
paths are looked at, however many edges one node has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.operators.skew import HOT_ROWS, salted_join
from quillgrid.session import materialise

# Paths that one task walks and counts.
TASK_PATHS = 500_000


def _ordered(edges: DataFrame) -> DataFrame:
    """``low, high, low_rank, high_rank``: each undirected edge once, from the end that is lower by degree, then by name."""
    a, b = edges.columns[:2]
    once = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a < b").distinct()
    once = materialise(once)
    ends = once.select(F.explode(F.array("a", "b")).alias("node"))
    degree = ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    ranked = once.join(degree.select(F.col("node").alias("a"), F.col("degree").alias("da")), "a").join(
        degree.select(F.col("node").alias("b"), F.col("degree").alias("db")), "b"
    )
    first, second = (F.struct(F.col(d).alias("degree"), F.col(n).alias("node")) for d, n in (("da", "a"), ("db", "b")))
    return materialise(ranked.select(F.least(first, second).alias("low"), F.greatest(first, second).alias("high")))


def _names(*columns: Column) -> list[Column]:
    """The three or two nodes in ascending order, as ``a, b, c``."""
    sorted_ = F.array_sort(F.array(*columns))
    return [sorted_[i].alias(name) for i, name in zip(range(len(columns)), "abc")]


def triangles(edges: DataFrame) -> DataFrame:
    """``a, b, c`` with ``a < b < c``: every three nodes that are linked with each other in ``edges`` (its first two columns).

    Edges have no direction; repeated ones, loops and NULL ends don't count. Each
    edge's two lists of higher neighbours are intersected, so no open path becomes a row.
    Of the lower end's list only neighbours above the edge's upper end are moved.
    """
    ordered = _ordered(edges)
    # A list holds higher neighbours only, see above, in order.
    above = ordered.groupBy("low").agg(F.sort_array(F.collect_list("high")).alias("above"))
    left = above.select("low", "above", F.posexplode("above").alias("at", "high")).filter(F.col("at") + 1 < F.size("above"))
    rest = F.slice(F.col("above")["node"], F.col("at") + 2, F.size("above"))
    left = left.select(F.col("low"), F.col("high"), rest.alias("left"))
    right = above.select(F.col("low").alias("high"), F.col("above")["node"].alias("right"))
    both = left.join(right, "high").withColumn("third", F.explode(F.array_intersect("left", "right")))
    return both.select(*_names(F.col("low.node"), F.col("high.node"), F.col("third")))


def _parts(up: DataFrame, either: DataFrame) -> int:
    """Tasks to walk the paths in, so that one counts about ``TASK_PATHS`` however many there are."""
    ups, all_ = (df.groupBy("middle").agg(F.count(F.lit(1)).alias(n)) for df, n in ((up, "ups"), (either, "all")))
    paths = ups.join(all_, "middle").agg(F.sum(F.col("ups") * F.col("all"))).first()[0] or 0
    return max(1, -(-paths // TASK_PATHS))


def four_cycles(edges: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``a, b, between, cycles``: opposite corners ``a < b`` of four-cycles, the nodes between them, and the cycles these make.

    Each cycle of four different nodes counts once, for the pair of corners that
    holds its highest node by degree; of the nodes between the corners only those below that one count.
    """
    ordered = _ordered(edges)
    either = ordered.select(F.col("low").alias("middle"), F.col("high").alias("end")).unionByName(
        ordered.select(F.col("high").alias("middle"), F.col("low").alias("end"))
    )
    up = ordered.select(F.col("low").alias("middle"), F.col("high").alias("top"))
    # A node with very many neighbours is split on both sides.
    up, either = (df.repartition(parts, "middle") for parts in [_parts(up, either)] for df in (up, either))
    paths = salted_join(up, either, ["middle"], spread=[F.col("top.node")], spread_right=[F.col("end.node")], hot_rows=hot_rows)
    corners = paths.filter(F.col("end") < F.col("top")).groupBy("top", "end").agg(F.count(F.lit(1)).alias("between"))
    found = corners.filter(F.col("between") > 1)
    cycles = F.expr("between * (between - 1) div 2").alias("cycles")
    return found.select(*_names(F.col("top.node"), F.col("end.node")), "between", cycles)
