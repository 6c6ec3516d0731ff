"""File catalogue: filters, ordering, navigation and totals."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.functions.files import has_suffix, parent_folder
from quillgrid.operators.numbering import Key, sort_columns, with_position


def in_folder(files: DataFrame, folder: str) -> DataFrame:
    """Direct children of ``folder``; an empty folder means the root."""
    current = folder if folder.startswith("/") else f"/{folder}"
    inside = parent_folder(F.col("path")) == current
    if current != "/":
        # Parquet can use the prefix to skip row groups; the exact test follows.
        inside = F.col("path").startswith(current.rstrip("/") + "/") & inside
    return files.filter(inside)


def from_source(files: DataFrame, source: str = "all") -> DataFrame:
    return files if source == "all" else files.filter(F.col("source") == source)


def of_types_lenient(files: DataFrame, extensions: Sequence[str], png_disables: bool = True) -> DataFrame:
    """Keep folders and the given extensions. An empty list, or one with ``png``, keeps everything."""
    if not extensions or (png_disables and "png" in extensions):
        return files
    return files.filter((F.col("file_type") == "folder") | F.col("file_ext").isin(list(extensions)))


def of_types_strict(files: DataFrame, extensions: Sequence[str]) -> DataFrame:
    return files.filter(F.col("file_ext").isin(list(extensions))) if extensions else files


def ignoring(files: DataFrame, pattern: str) -> DataFrame:
    """Drop paths that match ``pattern`` in any case. An invalid pattern is skipped with a warning."""
    if not pattern:
        return files
    insensitive = f"(?i){pattern}"
    try:
        # A constant is evaluated while planning, without a job.
        files.sparkSession.sql("select 1").select(F.lit("").rlike(insensitive)).first()
    except PySparkException:
        warnings.warn(f"invalid pattern skipped: {pattern}", stacklevel=2)
        return files
    return files.filter(~F.coalesce(F.col("path").rlike(insensitive), F.lit(False)))


def named_like(files: DataFrame, text: str) -> DataFrame:
    """Names containing ``text`` in any case; empty text matches all."""
    return files.filter(F.contains(F.lower(F.col("name")), F.lit(text.lower()))) if text else files


def pdf_paths(files: DataFrame, path: str = "path", case_sensitive: bool = False) -> DataFrame:
    return files.filter(has_suffix(F.col(path), ".pdf", case_sensitive)).orderBy(path)


def name_keys(descending: bool = False, collation: str | None = "UNICODE") -> list[Key]:
    """Folders first whatever the direction, then by name, then by id."""
    name = F.collate(F.col("name"), collation) if collation else F.col("name")
    return [F.when(F.col("file_type") == "folder", 0).otherwise(1), (name, descending), F.col("id")]


def name_order(descending: bool = False, collation: str | None = "UNICODE") -> list[Column]:
    """``name_keys`` as columns for ``orderBy``."""
    return sort_columns(name_keys(descending, collation))


def time_keys(descending: bool = False) -> list[Key]:
    return [(F.col("modified_time"), descending), F.col("id")]


def time_order(descending: bool = False) -> list[Column]:
    """``time_keys`` as columns for ``orderBy``."""
    return sort_columns(time_keys(descending))


def browse(
    files: DataFrame,
    folder: str = "",
    *,
    source: str = "all",
    extensions: Sequence[str] = (),
    ignore: str = "",
) -> DataFrame:
    """All listing filters together; the caller orders the result with ``name_order``."""
    kept = from_source(in_folder(files, folder), source)
    return ignoring(of_types_lenient(kept, extensions), ignore)


def navigation(files: DataFrame, keys: Sequence[str], order: Sequence[Key]) -> DataFrame:
    """Position, group size and the neighbours' ids of every file in its ordered group."""
    return with_position(files, keys, order, total="file_count", neighbour="id")


def pager(positions: DataFrame, position: str = "position", total: str = "sample_count") -> DataFrame:
    """Add 0-based ``index`` with ``previous_index`` and ``next_index`` clamped to the group."""
    index = F.col(position) - 1
    return positions.withColumns(
        {
            "index": index,
            "previous_index": F.greatest(index - 1, F.lit(0)),
            "next_index": F.least(index + 1, F.col(total) - 1),
        }
    )


def library_totals(files: DataFrame, keys: Sequence[str] = (), overall: str | None = None) -> DataFrame:
    """Files and bytes per group. ``overall`` adds a row for all files, with that name in every key, from the same scan."""
    sums = [F.count(F.lit(1)).alias("file_count"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size")]
    if overall is None:
        return files.groupBy(*keys).agg(*sums)
    # The grouping id tells a group of NULLs from the row for all.
    every = files.groupingSets([[F.col(k) for k in keys], []], *[F.col(k) for k in keys]).agg(*sums, F.grouping_id().alias("__set"))
    named = {k: F.when(F.col("__set") > 0, F.lit(overall)).otherwise(F.col(k)) for k in keys}
    return every.withColumns(named).drop("__set")


def facet_counts(files: DataFrame, facets: Sequence[str]) -> DataFrame:
    """Rows ``facet, value, n``: matches per value of every facet, in one pass."""
    sets = [[F.col(f)] for f in facets]
    counted = files.groupingSets(sets, *[F.col(f) for f in facets]).agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("__set")
    )
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    every = (1 << len(facets)) - 1
    for i, facet in enumerate(facets):
        mine = F.col("__set") == every - (1 << (len(facets) - 1 - i))
        name = F.when(mine, F.lit(facet)).otherwise(name)
        value = F.when(mine, F.col(facet).cast("string")).otherwise(value)
    return counted.select(name.alias("facet"), value.alias("value"), "n")


def auto_label(path: Column, rules: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """Label of the first rule ``(regex, label)`` that matches; rules come in priority order."""
    label = F.lit(default)
    for pattern, name in reversed(rules):
        label = F.when(path.rlike(pattern), F.lit(name)).otherwise(label)
    return label
