import datetime as dt

from pyspark.sql import functions as F

from quillgrid.operators import checks as ck
from quillgrid.operators import entities as en

T0 = dt.datetime(2024, 1, 1)


def test_task_states(spark):
    rows = [
        ("a", "queued", T0, 1), ("a", "failed", T0 + dt.timedelta(1), 2), ("a", "succeeded", T0 + dt.timedelta(1), 3),
        ("b", "running", T0 + dt.timedelta(2), 9), ("b", "queued", T0 + dt.timedelta(1), 10),
    ]
    events = spark.createDataFrame(rows, "task_id string, status string, updated_at timestamp_ntz, event_id bigint")
    got = {r.task_id: (r.status, r.created_at, r.updated_at) for r in en.task_states(events).collect()}
    assert got == {"a": ("succeeded", T0, T0 + dt.timedelta(1)), "b": ("running", T0 + dt.timedelta(1), T0 + dt.timedelta(2))}


def test_fold_keeps_the_last_even_if_null(spark):
    df = spark.createDataFrame([("k", "old", 1), ("k", None, 2), ("j", "x", 1)], "k string, v string, o int")
    assert {r.k: r.v for r in en.fold_to_map(df, "k", "v", "o").collect()} == {"k": None, "j": "x"}


def test_conflicts(spark):
    users = spark.createDataFrame([(1, "a@x"), (2, "b@x")], "id bigint, email string")
    changes = spark.createDataFrame([(1, "a@x"), (1, "b@x"), (2, "c@x"), (2, None)], "id bigint, email string")
    assert [tuple(r) for r in en.email_conflicts(changes, users).collect()] == [(1, "b@x")]
    inserts = spark.createDataFrame([("a@x",), ("new@x",)], "email string")
    assert [r.email for r in en.email_conflicts(inserts, users).collect()] == ["a@x"]


def test_patches(spark):
    users = spark.createDataFrame(
        [(1, "a@x", "A", "h1", True, False), (2, "b@x", "B", "h2", True, False), (3, "c@x", None, "h3", True, False)],
        "id bigint, email string, full_name string, hashed_password string, is_active boolean, is_superuser boolean",
    )
    patches = spark.createDataFrame(
        [(1, None, "A2", False, True, 1, False), (2, "z@x", None, False, None, 9, True), (3, "a@x", "C", None, None, 3, False), (8, None, "X", None, None, 8, True)],
        "id bigint, email string, full_name string, is_active boolean, is_superuser boolean, actor_id bigint, actor_is_superuser boolean",
    )
    got = {r.id: tuple(r) for r in en.apply_patches(users, patches).collect()}
    assert got == {
        1: (1, "a@x", "A2", "h1", True, False),
        2: (2, "z@x", "B", "h2", False, False),
        3: (3, "c@x", None, "h3", True, False),
    }
    assert en.public(users).columns == ["id", "email", "full_name", "is_active", "is_superuser"]


def test_a_stranger_may_not_patch(spark):
    users = spark.createDataFrame([(1, "a@x")], "id bigint, email string")
    patch = spark.createDataFrame([(1, "n@x", 2, False)], "id bigint, email string, actor_id bigint, actor_is_superuser boolean")
    assert en.apply_patches(users, patch).first().email == "a@x"


def test_upsert_and_delete(spark):
    current = spark.createDataFrame([(1, "dropbox", "r1", "s"), (2, "dropbox", "r2", "s"), (1, "drive", "r3", "s")], "user_id bigint, provider string, refresh string, scope string")
    granted = spark.createDataFrame([(1, "dropbox", None), (3, "dropbox", "r9")], "user_id bigint, provider string, refresh string")
    got = sorted(map(str, map(tuple, en.upsert_tokens(current, granted).collect())))
    assert got == sorted(map(str, [(1, "dropbox", None, "s"), (2, "dropbox", "r2", "s"), (1, "drive", "r3", "s"), (3, "dropbox", "r9", None)]))
    keys = spark.createDataFrame([(1, "dropbox"), (7, "dropbox")], "user_id bigint, provider string")
    assert en.delete_tokens(current, keys).count() == 2


def test_lookup_is_deterministic(spark):
    df = spark.createDataFrame([(3, "x"), (1, "x"), (2, "y")], "id bigint, email string")
    assert en.find_first(df, F.col("email") == "x").first().id == 1
    assert en.find_first(df, F.col("email") == "q").count() == 0


def test_totals_in_decimals(spark):
    rows = spark.createDataFrame([(1, 0.1)] * 3 + [(2, 5.0)], "doc_id bigint, amount double")
    declared = spark.sql("select 1L doc_id, cast(0.30 as decimal(18,2)) declared_total union all select 2L, 5.01BD union all select 3L, 1BD")
    got = {r.doc_id: r.matches for r in ck.totals_check(rows, declared, "amount").collect()}
    assert got == {1: True, 2: False, 3: False}
    loose = {r.doc_id: r.matches for r in ck.totals_check(rows, declared, "amount", tolerance="0.01").collect()}
    assert loose == {1: True, 2: True, 3: False}


def test_group_summaries_do_not_depend_on_partitions(spark):
    df = spark.range(3000).selectExpr("case when id % 3 = 0 then 'hot' else cast(id % 7 as string) end k", "repeat('x', cast(id % 11 as int)) t")
    partial = lambda s: {"n": len(s), "c": int(s.str.len().sum())}
    merge = lambda p: {"n": int(p.n.sum()), "c": int(p.c.sum())}
    want = {r.k: (r.n, r.c) for r in df.groupBy("k").agg(F.count("*").alias("n"), F.sum(F.length("t")).alias("c")).collect()}
    for parts in (1, 9):
        got = ck.summarise_groups(df.repartition(parts), "k", "t", partial, merge, "n bigint, c bigint", fan_in=3)
        assert {r.k: (r.n, r.c) for r in got.collect()} == want


def test_uris_and_composition(spark):
    clusters = spark.createDataFrame([("/a/x.pdf", 1), ("/b/x.pdf", 2), ("/c/y.pdf", 3)], "file string, cluster int")
    objects = spark.createDataFrame([("/a/x.pdf", "s3://k/a/x.pdf"), ("/b/x.pdf", "s3://k/b/x.pdf")], "local_path string, uri string")
    got = {r.cluster: r.file for r in ck.resolve_uris(clusters, objects).collect()}
    assert got == {1: "s3://k/a/x.pdf", 2: "s3://k/b/x.pdf", 3: "/c/y.pdf"}
    kept = ck.apply_all(clusters, [lambda d: d.filter("cluster > 1"), lambda d: d.limit(1)])
    assert kept.count() == 1


def test_two_claims_of_one_email(spark):
    users = spark.createDataFrame([(1, "a@x"), (2, "b@x"), (3, "c@x")], "id bigint, email string")
    patches = spark.createDataFrame(
        [(1, "n@x", 1, False), (2, "n@x", 2, False), (3, "c@x", 3, False)],
        "id bigint, email string, actor_id bigint, actor_is_superuser boolean",
    )
    assert {r.id: r.email for r in en.apply_patches(users, patches).collect()} == {1: "n@x", 2: "b@x", 3: "c@x"}
    hot = en.email_conflicts(patches, users, hot_rows=1)
    assert [r.id for r in hot.collect()] == [2]


def test_insert_users(spark):
    users = spark.createDataFrame([(1, "a@x", "A")], "id bigint, email string, full_name string")
    asked = spark.createDataFrame([(7, "n@x"), (5, "n@x"), (6, "a@x"), (8, None)], "id bigint, email string")
    got = {tuple(r) for r in en.insert_users(users, asked).collect()}
    assert got == {(1, "a@x", "A"), (5, "n@x", None)}


def test_last_of_two_grants(spark):
    current = spark.createDataFrame([(1, "dropbox", "r1", 1)], "user_id bigint, provider string, refresh string, at int")
    granted = spark.createDataFrame([(1, "dropbox", "r3", 3), (1, "dropbox", "r2", 2)], "user_id bigint, provider string, refresh string, at int")
    assert [tuple(r) for r in en.upsert_tokens(current, granted, ["at"]).collect()] == [(1, "dropbox", "r3", 3)]


def test_sparse_task_updates(spark):
    rows = [
        ("a", "sync", "queued", None, T0, 1), ("a", None, "running", None, T0 + dt.timedelta(1), 2),
        ("a", None, None, "ok", T0 + dt.timedelta(2), 3), ("z", None, "running", None, T0, 4),
    ]
    events = spark.createDataFrame(rows, "task_id string, kind string, status string, result string, updated_at timestamp_ntz, event_id bigint")
    got = [(r.task_id, r.kind, r.status, r.result, r.event_id) for r in en.task_states(events, F.col("kind").isNotNull()).collect()]
    assert got == [("a", "sync", "running", "ok", 3)]
