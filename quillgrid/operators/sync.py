"""Incremental sync: which source files have to be copied to the target store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.functions.files import has_suffix, target_key


def pdf_files(listing: DataFrame) -> DataFrame:
    """File entries named ``*.pdf`` in any case; folders and other files are dropped."""
    return listing.filter(F.col("is_file") & has_suffix(F.col("name")))


def sync_action(force: bool) -> Column:
    """Action for a source row left-joined to its target row."""
    if force:
        return F.lit("forced")
    return (
        F.when(F.col("last_modified").isNull(), "upload_new")
        .when(F.col("server_modified") <= F.col("last_modified"), "skip")
        .otherwise("upload_newer")
    )


def plan_sync(
    source: DataFrame,
    target: DataFrame,
    *,
    root: str,
    prefix: str,
    force: bool = False,
    strict_prefix: bool = True,
) -> DataFrame:
    """Every PDF of ``source`` with its target ``key`` and ``action``.

    ``target`` has ``key`` and ``last_modified``. Its keys are unique in a
    store; the newest wins should a listing repeat one.
    """
    files = pdf_files(source).withColumn("key", target_key(F.col("path_display"), root, prefix, strict_prefix))
    newest = target.groupBy("key").agg(F.max("last_modified").alias("last_modified"))
    return files.join(newest, "key", "left").withColumn("action", sync_action(force))


def is_upload(action: Column) -> Column:
    return action != "skip"


def _outcome(plan: DataFrame, failed_keys: DataFrame | None) -> DataFrame:
    if failed_keys is None:
        return plan.withColumn("__failed", F.lit(False))
    failures = failed_keys.select("key").distinct().withColumn("__hit", F.lit(True))
    return plan.join(failures, "key", "left").withColumn("__failed", F.col("__hit").isNotNull())


def uploaded_keys(plan: DataFrame, failed_keys: DataFrame | None = None) -> DataFrame:
    """``path_display, key`` of every upload of the plan that did not fail."""
    uploaded = is_upload(F.col("action")) & ~F.col("__failed")
    return _outcome(plan, failed_keys).filter(uploaded).select("path_display", "key")


def sync_summary(
    source: DataFrame, plan: DataFrame, failed_keys: DataFrame | None = None, *, limit: int = 100
) -> DataFrame:
    """One row: files scanned, PDFs uploaded, skipped and failed, and the first ``limit`` uploaded keys by path.

    ``failed_keys`` (``key``) names transfers that went wrong. ``uploaded_keys``
    has the whole list.
    """
    outcome = _outcome(plan, failed_keys)
    uploaded = is_upload(F.col("action")) & ~F.col("__failed")
    scanned = source.agg(F.count_if("is_file").alias("scanned"))
    first = (
        outcome.filter(uploaded)
        .orderBy("path_display")
        .limit(limit)
        .agg(F.sort_array(F.collect_list(F.struct("path_display", "key"))).alias("k"))
        .select(F.col("k.key").alias("k"))
    )
    return outcome.agg(
        F.count_if(uploaded).alias("uploaded"),
        F.count_if(~is_upload(F.col("action"))).alias("skipped"),
        F.count_if(is_upload(F.col("action")) & F.col("__failed")).alias("errors"),
    ).select(
        scanned.scalar().alias("scanned"), "uploaded", "skipped", "errors", first.scalar().alias("uploaded_keys")
    )
