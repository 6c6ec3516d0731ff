import datetime as dt

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from quillgrid.operators.entities import task_states
from quillgrid.operators.sync import plan_sync
from quillgrid.streaming import jobs

T0 = dt.datetime(2024, 1, 1)
LISTING = "path_display string, name string, is_file boolean, rev string, server_modified timestamp_ntz"


def listing(spark, rows):
    return spark.createDataFrame([(f"/Docs/{n}", n, True, r, T0 + dt.timedelta(days=d)) for n, r, d in rows], LISTING)


def test_sync_stream_equals_batch_over_several_runs(spark, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    target = spark.createDataFrame([("in/a.pdf", T0), ("in/old.pdf", T0)], "key string, last_modified timestamp_ntz")
    first = listing(spark, [("a.pdf", "1", 0), ("b.pdf", "1", 900), ("b.pdf", "1", 900), ("n.txt", "1", 0)])
    late = listing(spark, [("old.pdf", "1", -2000), ("b.pdf", "2", 901), ("B.PDF", "1", 900)])

    def run():
        arriving = jobs.stream_files(spark, source, first.schema, files_per_trigger=1)
        jobs.sync_stream(arriving, lambda: target, out, progress, root="/Docs", prefix="in").awaitTermination(120)

    first.coalesce(1).write.parquet(source)
    run()
    late.coalesce(1).write.mode("append").parquet(source)
    run()
    got = sorted((r.key, r.rev, r.action) for r in spark.read.parquet(out).select("key", "rev", "action").collect())
    # B.PDF of revision 1 is the path and revision seen before; the old file is late but planned.
    unique = first.distinct().unionByName(late.filter("name <> 'B.PDF'"))
    want = sorted((r.key, r.rev, r.action) for r in plan_sync(unique, target, root="/Docs", prefix="in").collect())
    assert got == want and ("in/old.pdf", "1", "skip") in got


def test_task_stream_equals_batch(spark, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    rows = [(f"t{i % 5}", "kind", f"s{i}", T0 + dt.timedelta(minutes=(i * 37) % 50), i) for i in range(40)]
    events = spark.createDataFrame(rows, "task_id string, kind string, status string, updated_at timestamp_ntz, event_id bigint")
    for part in (events.filter("event_id < 20"), events.filter("event_id >= 20")):
        part.coalesce(1).write.mode("append").parquet(source)
        arriving = jobs.stream_files(spark, source, events.schema)
        jobs.task_state_stream(arriving, out, progress).awaitTermination(120)
    got = jobs.read_task_states(spark, out)
    want = task_states(events).select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_tee_branches_see_the_same_rows(spark, tmp_path):
    source, progress = str(tmp_path / "in"), str(tmp_path / "progress")
    spark.range(50).coalesce(1).write.parquet(source)
    seen = {"a": [], "b": []}
    sinks = [lambda df, _, n=n: seen[n].extend(r.id for r in df.collect()) for n in seen]
    jobs.tee_stream(jobs.stream_files(spark, source, spark.range(1).schema), sinks, progress).awaitTermination(120)
    assert sorted(seen["a"]) == sorted(seen["b"]) == list(range(50))


def test_a_failing_branch_fails_the_query(spark, tmp_path):
    source, progress = str(tmp_path / "in"), str(tmp_path / "progress")
    spark.range(5).coalesce(1).write.parquet(source)

    def broken(df, batch_id):
        raise RuntimeError("branch is down")

    query = jobs.tee_stream(jobs.stream_files(spark, source, spark.range(1).schema), [lambda df, _: None, broken], progress)
    with pytest.raises(StreamingQueryException):
        query.awaitTermination(120)


def test_folder_sink_replaces_a_replayed_batch(spark, tmp_path):
    sink = jobs.folder_sink(str(tmp_path / "out"), lambda df: df.filter(F.col("id") > 1))
    sink(spark.range(5), 0)
    sink(spark.range(5), 0)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_silent_tasks_leave_the_store(spark, tmp_path):
    from quillgrid.streaming import expiry

    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    schema = "task_id string, kind string, status string, updated_at timestamp_ntz, event_id bigint"
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, expiry.ROCKSDB)
    held = []
    try:
        for day in range(0, 8, 2):
            rows = [(f"t{day}-{i}", "k", "queued", T0 + dt.timedelta(days=day, minutes=i), 10 * i) for i in range(20)]
            rows += [(f"t{day}-{i}", None, "done", T0 + dt.timedelta(days=day, minutes=30), 10 * i + 1) for i in range(10)]
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
            arriving = jobs.stream_files(spark, source, spark.createDataFrame([], schema).schema)
            query = expiry.expiring_task_stream(arriving, out, progress, "1 day", "1 hour")
            query.awaitTermination(240)
            held.append(query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"])
            if day == 4:
                assert expiry.compact(spark, out) >= 0
    finally:
        spark.conf.unset(name)
    got = {r.task_id: (r.kind, r.status, r.expired) for r in expiry.read_latest(spark, out).collect()}
    want = {f"t{day}-{i}": ("k", "done" if i < 10 else "queued", day < 6) for day in range(0, 8, 2) for i in range(20)}
    assert got == want
    # The store holds the tasks of the last day only, however many there were before.
    assert max(held[1:]) <= held[0]
