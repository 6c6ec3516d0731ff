import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillgrid.functions import files as fn
from quillgrid.functions import metadata as m
from quillgrid.functions import tokens as tk


def one(spark, column, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column.alias("r")).first().r


def test_hashes(spark):
    want = "6ae8a75555209fd6c44157c0aed8016e763ff435a19cf186f76863140143ff72"
    assert one(spark, m.sha256_hex(F.col("v")), bytearray(b"test content"), "binary") == want
    assert one(spark, m.document_id(F.col("v")), "test content") == want


def test_missing_and_empty_paths_get_random_ids(spark):
    df = spark.createDataFrame([(None,), ("",), (None,)], "v string")
    ids = [r[0] for r in df.select(m.document_id(F.col("v"))).collect()]
    assert len(set(ids)) == 3 and all(len(i) == 64 for i in ids)


@pytest.mark.parametrize(
    "creator,title,tag",
    [
        (None, None, ""),
        ("", "A b", "title|Ab"),
        ("   ", "x", "creator||title|x"),
        ("a b\u001cc\td", None, "creator|abcd"),
    ],
)
def test_metadata_tag(spark, creator, title, tag):
    df = spark.createDataFrame([(creator, title)], "creator string, title string")
    assert df.select(m.metadata_tag(("creator", "title"))).first()[0] == tag


@pytest.mark.parametrize(
    "text,day",
    [
        ("D:20240115103000-05'00'", dt.date(2024, 1, 15)),
        ("20240115", dt.date(2024, 1, 15)),
        ("2024-01-15", None),
        ("D:", None),
        ("", None),
        (None, None),
        ("202411", None),
        ("D:20241340", None),
    ],
)
def test_pdf_date(spark, text, day):
    assert one(spark, m.pdf_date(F.col("v")), text) == day


def test_dates_map_drops_unreadable(spark):
    df = spark.createDataFrame([("D:20240115", "x"), (None, None)], "creation_date string, mod_date string")
    assert [r[0] for r in df.select(m.document_dates()).collect()] == [{"creationDate": dt.date(2024, 1, 15)}, {}]


@pytest.mark.parametrize(
    "path,root,prefix,strict,lenient",
    [
        ("/Docs/a.pdf", "/Docs", "in/", "in/a.pdf", "in/a.pdf"),
        ("/Docs/a.pdf", "/", "in", "in/Docs/a.pdf", "in/Docs/a.pdf"),
        ("/Docs/a.pdf", "/Docs", "", "/a.pdf", "/a.pdf"),
        ("/Docs/x/Docs/a.pdf", "/Docs", "in", "in/x/Docs/a.pdf", "in/x/a.pdf"),
        ("/Docsy/a.pdf", "/Docs", "in", "in/Docsy/a.pdf", "in/y/a.pdf"),
        ("//Docs//a.pdf", "/Docs", "in", "in/a.pdf", "in/a.pdf"),
        ("/d/a///b.pdf", "/d", "in", "in/a//b.pdf", "in/a//b.pf"),  # the lenient rule removes every "d"
        ("/docs/a.pdf", "/Docs", "in", "in/docs/a.pdf", "in/docs/a.pdf"),
    ],
)
def test_target_key(spark, path, root, prefix, strict, lenient):
    assert one(spark, fn.target_key(F.col("v"), root, prefix), path) == strict
    assert one(spark, fn.target_key(F.col("v"), root, prefix, strict_prefix=False), path) == lenient


@pytest.mark.parametrize(
    "size,text",
    [
        (None, "0 B"), (0, "0 B"), (1023, "1023 B"), (1024, "1.00 KB"), (1048575, "1024.00 KB"), (1048576, "1.00 MB"),
        (2457600, "2.34 MB"), (1152, "1.13 KB"), (1024**3 - 1, "1024.00 MB"), (1024**4, "1.00 TB"), (1024**5, "1024.00 TB"),
        (2**62, "4194304.00 TB"),
    ],
)
def test_human_size(spark, size, text):
    assert one(spark, fn.human_size(F.col("v")), size, "bigint") == text


def test_size_in_mb_and_time(spark):
    assert one(spark, fn.size_in_mb(F.col("v")), 1572864, "bigint") == "1.50 MB"
    assert one(spark, fn.display_time(F.col("v")), dt.datetime(2024, 3, 5, 7, 8), "timestamp_ntz") == "05 Mar 2024 07:08"
    assert one(spark, fn.display_time(F.col("v")), None, "timestamp_ntz") == "—"


@pytest.mark.parametrize("path,parent", [("/a/b/c.pdf", "/a/b"), ("/x.pdf", "/"), ("x.pdf", "/"), ("a/x.pdf", "a"), ("/a/", "/a")])
def test_parent_folder(spark, path, parent):
    assert one(spark, fn.parent_folder(F.col("v")), path) == parent


def test_breadcrumbs(spark):
    got = [tuple(c) for c in one(spark, fn.breadcrumbs(F.col("v")), "/a%20b+c//d/%zz")]
    assert got == [("Home", ""), ("a b+c", "a%20b+c"), ("d", "a%20b+c/d"), (None, "a%20b+c/d/%zz")]
    assert [tuple(c) for c in one(spark, fn.breadcrumbs(F.col("v")), "")] == [("Home", "")]


def test_shared_initials(spark):
    df = spark.createDataFrame([([("ann",), ("",), (None,), ("zoe",)],)], "s array<struct<name:string>>")
    assert df.select(fn.shared_initials(F.col("s"))).first()[0] == ["A", "?", "?"]


def test_vision_status(spark):
    df = spark.createDataFrame([(True, 3), (False, None), (None, 2)], "h boolean, n bigint")
    assert [r[0] for r in df.select(fn.vision_status(F.col("h"), F.col("n"))).collect()] == ["3 Tables Found", "Not Processed", None]


NOW = dt.datetime(2024, 1, 18)


@pytest.mark.parametrize(
    "expiry,expired,reauth,soon",
    [
        (None, False, False, False),
        (NOW, True, False, True),
        (NOW - dt.timedelta(seconds=1), True, True, True),
        (NOW + dt.timedelta(hours=24), False, False, False),
        (NOW + dt.timedelta(hours=23, minutes=59), False, False, True),
    ],
)
def test_token_moments(spark, expiry, expired, reauth, soon):
    as_of = F.lit(NOW).cast("timestamp_ntz")
    df = spark.createDataFrame([(expiry,)], "v timestamp_ntz")
    v = F.col("v")
    row = df.select(
        tk.is_expired(v, as_of), tk.needs_reauth(F.lit(None).cast("boolean"), v, as_of), tk.expires_soon(v, as_of),
        tk.integration_status(F.lit(True), F.lit(False), v, as_of), tk.integration_status(F.lit(False), F.lit(False), v, as_of),
        tk.expiry_from(F.lit(90), as_of), tk.expiry_from(F.lit(None), as_of),
    ).first()
    assert tuple(row) == (
        expired, reauth, soon, "needs_reauth" if reauth else "connected", "disconnected",
        dt.datetime(2024, 1, 18, 0, 1, 30), None,
    )


def test_flag_alone_needs_reauth(spark):
    as_of = F.lit(NOW).cast("timestamp_ntz")
    assert one(spark, tk.needs_reauth(F.lit(True), F.col("v"), as_of), None, "timestamp_ntz") is True
