import datetime as dt
import warnings

import pytest
from pyspark.sql import functions as F

from quillgrid.operators import listing as ls
from quillgrid.operators import sync as sy

T0 = dt.datetime(2024, 1, 1)
SOURCE = "path_display string, name string, is_file boolean, rev string, server_modified timestamp_ntz"


@pytest.fixture(scope="module")
def source(spark):
    rows = [
        ("/Docs/a.pdf", "a.pdf", True, "1", T0),
        ("/Docs/b.PDF", "b.PDF", True, "2", T0),
        ("/Docs/c.pdf", "c.pdf", True, "3", T0),
        ("/Docs/d.txt", "d.txt", True, "4", T0),
        ("/Docs/e.pdf", "e.pdf", False, None, None),
    ]
    return spark.createDataFrame(rows, SOURCE)


@pytest.fixture(scope="module")
def target(spark):
    rows = [("in/a.pdf", T0), ("in/b.PDF", T0 - dt.timedelta(seconds=1)), ("in/b.PDF", T0 - dt.timedelta(days=9)), ("in/x.pdf", T0)]
    return spark.createDataFrame(rows, "key string, last_modified timestamp_ntz")


def test_actions(source, target):
    plan = sy.plan_sync(source, target, root="/Docs", prefix="in")
    assert {r.key: r.action for r in plan.collect()} == {"in/a.pdf": "skip", "in/b.PDF": "upload_newer", "in/c.pdf": "upload_new"}
    forced = sy.plan_sync(source, target, root="/Docs", prefix="in", force=True)
    assert {r.action for r in forced.collect()} == {"forced"} and forced.count() == 3


def test_summary_adds_up(spark, source, target):
    plan = sy.plan_sync(source, target, root="/Docs", prefix="in")
    row = sy.sync_summary(source, plan).first()
    assert tuple(row) == (4, 2, 1, 0, ["in/b.PDF", "in/c.pdf"])
    failed = spark.createDataFrame([("in/c.pdf",), ("in/a.pdf",)], "key string")
    row = sy.sync_summary(source, plan, failed).first()
    assert tuple(row) == (4, 1, 1, 1, ["in/b.PDF"])
    not_pdf = 1
    assert row.uploaded + row.skipped + row.errors + not_pdf == row.scanned


def test_summary_reports_the_first_hundred(spark, target):
    rows = [(f"/Docs/{i:04}.pdf", f"{i:04}.pdf", True, "1", T0) for i in range(150)]
    source = spark.createDataFrame(rows, SOURCE)
    row = sy.sync_summary(source, sy.plan_sync(source, target, root="/Docs", prefix="in")).first()
    assert row.uploaded == 150 and row.uploaded_keys == [f"in/{i:04}.pdf" for i in range(100)]


FILES = "id bigint, name string, path string, file_type string, file_ext string, size bigint, modified_time timestamp_ntz, source string"


@pytest.fixture(scope="module")
def files(spark):
    names = ["b", "a", "A", "é", "B"]
    rows = [(i, n, f"/x/{n}", "file", "pdf", 10, T0 + dt.timedelta(days=i % 2), "local") for i, n in enumerate(names)]
    rows += [
        (10, "z", "/x/z", "folder", None, None, None, "local"),
        (11, "top.png", "/top.png", "file", "png", 5, T0, "dropbox"),
        (12, "odd", "/x/odd", "file", None, 1, T0, "dropbox"),
    ]
    return spark.createDataFrame(rows, FILES)


def ids(df):
    return [r.id for r in df.collect()]


def test_name_order(files):
    listed = ls.in_folder(files, "x").filter("name <> 'odd'")
    assert ids(listed.orderBy(*ls.name_order())) == [10, 1, 2, 0, 4, 3]
    assert ids(listed.orderBy(*ls.name_order(descending=True))) == [10, 3, 4, 0, 2, 1]
    assert ids(listed.orderBy(*ls.name_order(collation=None))) == [10, 2, 4, 1, 0, 3]


def test_equal_names_and_time_order(files):
    assert ids(files.filter("id < 5").orderBy(*ls.time_order())) == [0, 2, 4, 1, 3]
    assert ids(files.filter("id < 5").orderBy(*ls.time_order(descending=True))) == [1, 3, 0, 2, 4]


def test_folder_filter(files):
    assert ids(ls.in_folder(files, "")) == ids(ls.in_folder(files, "/")) == [11]
    assert len(ids(ls.in_folder(files, "/x"))) == 7


def test_type_filters(files):
    everything = len(ids(files))
    assert len(ids(ls.of_types_lenient(files, []))) == len(ids(ls.of_types_lenient(files, ["pdf", "png"]))) == everything
    assert sorted(ids(ls.of_types_lenient(files, ["png"], png_disables=False))) == [10, 11]
    assert sorted(ids(ls.of_types_lenient(files, ["docx"]))) == [10]
    assert ids(ls.of_types_strict(files, ["png"])) == [11] and len(ids(ls.of_types_strict(files, []))) == everything


def test_ignore_patterns(files):
    assert ids(ls.ignoring(files, "")) == ids(files)
    assert 11 not in ids(ls.ignoring(files, r"TOP\.png$"))
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        assert ids(ls.ignoring(files, "[")) == ids(files)
    assert any("invalid pattern" in str(w.message) for w in caught)


def test_search_source_and_browse(files):
    assert ids(ls.named_like(files, "TOP")) == [11] and len(ids(ls.named_like(files, ""))) == 8
    assert sorted(ids(ls.from_source(files, "dropbox"))) == [11, 12] and len(ids(ls.from_source(files))) == 8
    assert sorted(ids(ls.browse(files, "x", source="local", extensions=["pdf"], ignore="é"))) == [0, 1, 2, 4, 10]


def test_navigation_and_pager(files):
    rows = {r.id: r for r in ls.navigation(files.filter("id < 5"), ["source"], [F.col("id")]).collect()}
    assert (rows[0].position, rows[0].file_count, rows[0].previous_id, rows[0].next_id) == (1, 5, None, 1)
    assert (rows[4].previous_id, rows[4].next_id) == (3, None)
    paged = ls.pager(ls.navigation(files.filter("id < 2"), ["source"], [F.col("id")]), total="file_count").orderBy("index").collect()
    assert [(r["index"], r.previous_index, r.next_index) for r in paged] == [(0, 0, 1), (1, 0, 1)]


def test_totals_and_facets(files):
    assert tuple(ls.library_totals(files).first()) == (8, 56)
    got = {(r.facet, r.value): r.n for r in ls.facet_counts(files, ["source", "file_ext"]).collect()}
    assert got == {("source", "local"): 6, ("source", "dropbox"): 2, ("file_ext", "pdf"): 5, ("file_ext", "png"): 1, ("file_ext", None): 2}


def test_first_rule_wins(files):
    rules = [(r"^/x/", "x"), (r"(?i)PNG$", "image"), (r"top", "top")]
    got = {r.id: r.l for r in files.select("id", ls.auto_label(F.col("path"), rules).alias("l")).collect()}
    assert got[0] == "x" and got[11] == "image"
    assert files.select(ls.auto_label(F.col("path"), [], "none").alias("l")).first().l == "none"


def test_pdf_paths(spark):
    df = spark.createDataFrame([("b.pdf",), ("a.PDF",), ("c.txt",)], "path string")
    assert [r.path for r in ls.pdf_paths(df).collect()] == ["a.PDF", "b.pdf"]
    assert [r.path for r in ls.pdf_paths(df, case_sensitive=True).collect()] == ["b.pdf"]
