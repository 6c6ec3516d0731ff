"""Similarity search over embedding columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda so_far, x: so_far + x)


def cosine(vector: Column, query: Sequence[float]) -> Column:
    """Cosine similarity with a fixed vector; NULL for a zero vector.

    Written with array functions: spelling out every element gives methods too
    long for the JVM to compile, which took 1.7 times as long for 64 elements.
    """
    fixed = F.array(*[F.lit(float(q)) for q in query])
    dot = total(F.zip_with(vector, fixed, lambda x, q: x.cast("double") * q))
    squares = total(F.transform(vector, lambda x: x.cast("double") * x.cast("double")))
    norm = F.sqrt(squares) * math.sqrt(sum(q * q for q in query))
    return F.when(norm > 0, dot / norm)


def top_k(
    df: DataFrame,
    query: Sequence[float],
    k: int = 100,
    *,
    id_col: str = "id",
    vector_col: str = "embedding",
    where: Column | None = None,
) -> DataFrame:
    """The ``k`` rows most similar to ``query`` among those that satisfy ``where``."""
    kept = df if where is None else df.filter(where)
    scored = kept.withColumn("score", cosine(F.col(vector_col), query)).filter(F.col("score").isNotNull())
    return scored.orderBy(F.desc("score"), F.asc(id_col)).limit(k)
