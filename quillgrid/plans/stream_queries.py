"""Streaming twins of batch queries: the tables arrive as streams, results land in files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.plans import views as v
from quillgrid.plans.document_queries import PAGE_MAP_SQL
from quillgrid.plans.entity_queries import TASK_STATE_SQL
from quillgrid.plans.file_queries import PREFIX, ROOT, SYNC_PLAN_SQL
from quillgrid.session import scratch_path
from quillgrid.streaming import expiry, jobs


def _arriving(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table as a stream of its files.

    A file source wants a folder or a pattern; a pattern also fits a table that is one file.
    """
    schema = v.table(spark, folder, name).schema
    return jobs.stream_files(spark, f"{folder}/{name}.parque[t]", schema, files_per_trigger=100)


def stream_sync(spark: SparkSession, folder: str) -> DataFrame:
    """The sync plan from a stream that delivers every listing row twice."""
    out = scratch_path(spark, "stream-sync")
    listed = v.source_files(_arriving(spark, folder, "orders"))
    twice = listed.withColumn("__copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("__copy")
    query = jobs.sync_stream(
        twice, lambda: v.target_listing(spark, folder), f"{out}/plan", f"{out}/progress", root=ROOT, prefix=PREFIX
    )
    query.awaitTermination()
    return spark.read.parquet(f"{out}/plan").select("path_display", "key", "action", "last_modified")


def stream_task_state(spark: SparkSession, folder: str) -> DataFrame:
    out = scratch_path(spark, "stream-tasks")
    events = v.task_events(_arriving(spark, folder, "events"))
    jobs.task_state_stream(events, f"{out}/states", f"{out}/progress").awaitTermination()
    return jobs.read_task_states(spark, f"{out}/states")


KEEP_DAYS, DELAY_HOURS = 10, 1


def stream_task_expiry(spark: SparkSession, folder: str) -> DataFrame:
    """Task states in a store that forgets tasks after ten silent days; read through the compacted output."""
    # The state of a running query stays with the store it began with, so this only affects new ones.
    store = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", expiry.ROCKSDB)
    out = scratch_path(spark, "stream-expiry")
    try:
        events = v.task_events(_arriving(spark, folder, "events"))
        expiry.expiring_task_stream(events, f"{out}/states", f"{out}/progress", f"{KEEP_DAYS} days", f"{DELAY_HOURS} hours").awaitTermination()
    finally:
        if store is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", store)
    expiry.compact(spark, f"{out}/states")
    states = expiry.read_latest(spark, f"{out}/states")
    return states.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("created_at", "updated_at")})


STREAM_TASK_EXPIRY_SQL = TASK_STATE_SQL.replace("select task_id, created_at", f"""select
 updated_at + interval '{KEEP_DAYS}' day <= (select max(updated_at) from fx_task_events) - interval '{DELAY_HOURS}' hour expired,
 task_id, created_at""", 1)


def stream_tee(spark: SparkSession, folder: str) -> DataFrame:
    """One stream of pages feeding two branches, all pages and landscape pages, counted per document."""
    out = scratch_path(spark, "stream-tee")
    pages = v.pages_of(_arriving(spark, folder, "documents"))
    branches = {"all": lambda df: df, "landscape": lambda df: df.filter("width > height")}
    sinks = [jobs.folder_sink(f"{out}/{name}", keep) for name, keep in branches.items()]
    jobs.tee_stream(pages, sinks, f"{out}/progress").awaitTermination()
    read = [
        spark.read.schema(pages.schema).parquet(f"{out}/{name}").withColumn("branch", F.lit(name)) for name in branches
    ]
    return v.union_all(read).groupBy("branch", "doc_id").agg(F.count(F.lit(1)).alias("pages"))


STREAM_TEE_SQL = v.with_views("fx_pages", """
select 'all' branch, doc_id, count(*) pages from fx_pages group by doc_id
union all select 'landscape', doc_id, count(*) from fx_pages where width > height group by doc_id""")


def stream_pages(spark: SparkSession, folder: str) -> DataFrame:
    """A lazy stream of pages through column expressions, written as it arrives."""
    out = scratch_path(spark, "stream-pages")
    pages = v.pages_of(_arriving(spark, folder, "documents")).select(
        "doc_id",
        "page_number",
        (F.col("width") * F.col("height")).alias("area"),
        (F.col("width") > F.col("height")).alias("is_landscape"),
    )
    jobs.run_available(pages, jobs.folder_sink(f"{out}/pages"), f"{out}/progress").awaitTermination()
    return spark.read.schema(pages.schema).parquet(f"{out}/pages").select(*pages.columns)


QUERIES = {
    "stream_sync": stream_sync,
    "stream_task_state": stream_task_state,
    "stream_task_expiry": stream_task_expiry,
    "stream_tee": stream_tee,
    "stream_pages": stream_pages,
}
ORACLES = {
    "stream_sync": SYNC_PLAN_SQL,
    "stream_task_state": TASK_STATE_SQL,
    "stream_task_expiry": STREAM_TASK_EXPIRY_SQL,
    "stream_tee": STREAM_TEE_SQL,
    "stream_pages": PAGE_MAP_SQL,
}
