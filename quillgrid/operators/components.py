"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.operators.skew import HOT_ROWS, salted_join
from quillgrid.session import materialise


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one other node that itself hangs on none."""
    parents = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    torn = parents.filter("n > 1").select("u")
    chained = edges.select(F.col("v").alias("u")).join(parents.select("u"), "u", "left_semi")
    return torn.unionByName(chained).isEmpty()


def _with_minimum(edges: DataFrame, hot_rows: int, rows: int) -> DataFrame:
    """Edges ``u, v`` with ``m``, the smallest of ``u`` and its neighbours."""
    smallest = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return salted_join(edges, smallest, ["u"], spread=[F.col("v")], hot_rows=hot_rows, rows=rows)


def connected_components(edges: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``node, component`` of every node of the undirected ``edges`` (first two columns).

    The component is named after its smallest node. The number of rounds grows
    with the logarithm of the graph; each is checkpointed.
    """
    a, b = edges.columns[:2]
    stars = materialise(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    )
    # No step adds edges; both directions make two rows of each.
    bound = 2 * stars.count()
    while not _all_stars(stars):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = materialise(
            _with_minimum(both, hot_rows, bound)
            .filter("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        hung = _with_minimum(large, hot_rows, bound)
        small = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        stars = materialise(small.unionByName(hung.select("u", F.col("m").alias("v"))).distinct())
    roots = stars.select(F.col("v").alias("node")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
