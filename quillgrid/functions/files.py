"""Paths, sizes and display text of catalogue entries, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Size units above bytes and their powers of 1024.
SIZE_UNITS = {"KB": 1, "MB": 2, "GB": 3, "TB": 4}
_EM_DASH = "—"


def has_suffix(name: Column, suffix: str = ".pdf", case_sensitive: bool = False) -> Column:
    return F.endswith(name if case_sensitive else F.lower(name), F.lit(suffix))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_folder(path: Column) -> Column:
    """Text before the last slash, or ``/`` if that is empty."""
    return F.coalesce(F.nullif(F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1), F.lit("")), F.lit("/"))


def object_uri(bucket: str, key: Column) -> Column:
    return F.concat(F.lit(f"s3://{bucket}/"), key)


def target_key(path: Column, root: str, prefix: str, strict_prefix: bool = True) -> Column:
    """Key in the target store of a source path.

    ``strict_prefix=False`` removes the root text wherever it occurs in the
    path; the default removes it only at the front, on a
    folder boundary.
    """
    relative = F.ltrim(path, F.lit("/"))
    root = root.lstrip("/")
    if root and strict_prefix:
        folder = root.rstrip("/")
        relative = F.when(
            F.startswith(relative, F.lit(folder + "/")), F.substring(relative, len(folder) + 2, 1 << 30)
        ).otherwise(relative)
    elif root:
        relative = F.replace(relative, F.lit(root), F.lit(""))
    joined = F.concat(F.lit(prefix.rstrip("/") + "/"), F.ltrim(relative, F.lit("/")))
    return F.replace(joined, F.lit("//"), F.lit("/"))


def _whole_div(value: Column, by: int) -> Column:
    return F.call_function("div", value, F.lit(by).cast("bigint"))


def _hundredths(size: Column, unit: int) -> Column:
    """``size / unit`` with two decimals, halves rounded up, in whole numbers."""
    size = size.cast("bigint")
    cents = _whole_div((size % unit) * 100 + unit // 2, unit)
    whole = _whole_div(size, unit) + _whole_div(cents, 100)
    return F.concat(whole.cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def human_size(size: Column) -> Column:
    """``512 B``, ``1.50 KB``, up to TB; a missing size is ``0 B``."""
    size = F.coalesce(size, F.lit(0))
    text = F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
    for unit, power in SIZE_UNITS.items():
        label = F.concat(_hundredths(size, 1024**power), F.lit(f" {unit}"))
        text = text.otherwise(label) if unit == "TB" else text.when(size < 1024 ** (power + 1), label)
    return text


def size_in_mb(size: Column) -> Column:
    return F.concat(_hundredths(size, 1024**2), F.lit(" MB"))


def display_time(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "dd MMM yyyy HH:mm"), F.lit(_EM_DASH))


def percent_decode(segment: Column) -> Column:
    """Percent-decoding that keeps ``+``; NULL for a bad escape."""
    return F.try_url_decode(F.replace(segment, F.lit("+"), F.lit("%2B")))


def breadcrumbs(path: Column) -> Column:
    """Array of ``struct<name,path>``: ``Home`` first, then one entry per path segment."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    crumbs = F.transform(
        segments,
        lambda s, i: F.struct(
            percent_decode(s).alias("name"),
            F.array_join(F.slice(segments, F.lit(1), i + 1), "/").alias("path"),
        ),
    )
    home = F.struct(F.lit("Home").alias("name"), F.lit("").alias("path"))
    return F.concat(F.array(home), crumbs)


def shared_initials(shared_with: Column, shown: int = 3) -> Column:
    """Upper-case first letters of the first entries; ``?`` for a missing name."""
    return F.transform(
        F.slice(shared_with, 1, shown),
        lambda who: F.coalesce(F.nullif(F.upper(F.left(who["name"], F.lit(1))), F.lit("")), F.lit("?")),
    )


def vision_status(has_results: Column, table_count: Column) -> Column:
    found = F.concat(table_count.cast("string"), F.lit(" Tables Found"))
    return F.when(has_results, found).when(~has_results, F.lit("Not Processed"))
