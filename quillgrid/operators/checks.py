"""Analytics over documents' rows: totals checks, category sums, summaries, graph steps."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def totals_check(
    rows: DataFrame, declared: DataFrame, amount: str, key: str = "doc_id", tolerance: str = "0.00"
) -> DataFrame:
    """Compare the summed ``amount`` of each document with its ``declared_total``, in decimals."""
    summed = rows.groupBy(key).agg(F.sum(F.col(amount).cast("decimal(18,2)")).alias("summed_total"))
    difference = F.col("summed_total") - F.col("declared_total")
    return (
        declared.join(summed, key, "left")
        .withColumn("difference", difference)
        .withColumn("matches", F.coalesce(F.abs("difference") <= F.lit(tolerance).cast("decimal(18,2)"), F.lit(False)))
    )


def category_sums(df: DataFrame, category: str, amount: str, over: float) -> DataFrame:
    return (
        df.filter(F.col(amount) > over)
        .groupBy(category)
        .agg(F.sum(F.col(amount).cast("decimal(18,2)")).alias("total"))
    )


def match_step(edges: DataFrame, nodes: DataFrame, via: str, node_id: str, where: Column | None = None) -> DataFrame:
    """One pattern step: from each row along ``via`` to the node it names, kept if ``where`` holds."""
    reached = edges.join(nodes, edges[via] == nodes[node_id], "inner")
    return reached if where is None else reached.filter(where)


def summarise_groups(
    df: DataFrame,
    key: str,
    text: str,
    partial: Callable[[pd.Series], dict],
    merge: Callable[[pd.DataFrame], dict],
    schema: str,
    fan_in: int = 64,
) -> DataFrame:
    """Per-group summary of a text column by a user's two functions.

    ``partial`` turns texts of one group into a summary row (a dict of the
    fields in ``schema``); ``merge`` folds several summary rows into one and
    must not depend on their order. Every task folds its own rows first, and
    the tasks' rows are merged in two rounds, so a large group is never
    gathered in one task.
    """
    fields = [part.strip().split()[0] for part in schema.split(",")]
    out = f"{key} {df.schema[key].dataType.simpleString()}, {schema}"

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket = TaskContext.get().partitionId() % fan_in
        pending: dict = {}

        def flush() -> pd.DataFrame:
            rows = [
                {key: k, **(parts[0] if len(parts) == 1 else merge(pd.DataFrame(parts))), "bucket": bucket}
                for k, parts in pending.items()
            ]
            pending.clear()
            return pd.DataFrame(rows, columns=[key, *fields, "bucket"])

        for batch in batches:
            for k, part in batch.groupby(key, sort=False, dropna=False):
                parts = pending.setdefault(k, [])
                parts.append(partial(part[text]))
                if len(parts) >= fan_in:
                    parts[:] = [merge(pd.DataFrame(parts))]
            if len(pending) > 10_000:
                yield flush()
        if pending:
            yield flush()

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{key: group[key].iloc[0], **merge(group[fields])}], columns=[key, *fields])

    parts = df.select(key, text).mapInPandas(fold, f"{out}, bucket int")
    halfway = parts.groupBy(key, "bucket").applyInPandas(merged, out)
    return halfway.groupBy(key).applyInPandas(merged, out)


def class_overview(classes: DataFrame, labels: DataFrame, indices: DataFrame) -> DataFrame:
    """Classes with their label, original flag and page index, defaulted if missing."""
    return (
        classes.join(labels, "classification", "left")
        .join(indices, "classification", "left")
        .withColumns(
            {
                "label": F.coalesce("label", F.lit("")),
                "is_original": F.coalesce("is_original", F.lit(False)),
                "page_index": F.coalesce("page_index", F.lit(0)),
            }
        )
    )


def resolve_uris(clusters: DataFrame, objects: DataFrame, path: str = "file") -> DataFrame:
    """Replace each known local path by its object URI; others keep their value.

    ``objects`` has ``local_path`` and ``uri``. The whole path is the key, so
    equal file names in two folders do not collide.
    """
    known = objects.select(F.col("local_path").alias(path), "uri")
    return clusters.join(known, path, "left").withColumn(path, F.coalesce("uri", path)).drop("uri")


def apply_all(df: DataFrame, steps: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Compose DataFrame functions, left to right."""
    for step in steps:
        df = df.transform(step)
    return df
