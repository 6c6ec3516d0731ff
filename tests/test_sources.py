import hashlib

import pandas as pd
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from quillgrid.sources import files as src
from quillgrid.sources import tables
from quillgrid.session import checkpoint_folder, scratch_path


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("docs")
    (root / "sub").mkdir()
    for name, data in {"b.pdf": b"test content", "Y.PDF": b"two", "n.txt": b"no", "sub/a.pdf": b"three"}.items():
        (root / name).write_bytes(data)
    return root


def test_scan(spark, folder):
    def names(**options):
        return [r.name for r in src.scan_files(spark, str(folder), **options).orderBy("path").collect()]

    assert names() == ["Y.PDF", "b.pdf", "a.pdf"]
    assert names(recursive=False) == ["Y.PDF", "b.pdf"]
    assert names(case_sensitive=True) == ["b.pdf", "a.pdf"]
    first = src.scan_files(spark, str(folder)).orderBy("path").first()
    assert first.path == str(folder / "Y.PDF") and first.length == 3


def test_scan_does_not_read_contents(spark, folder):
    plan = src.scan_files(spark, str(folder))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_load_from_path(spark, folder):
    got = {r.source_path: r for r in src.load_documents(spark, str(folder)).collect()}
    row = got[str(folder / "b.pdf")]
    assert row.content_hash == hashlib.sha256(b"test content").hexdigest()
    assert row.id == hashlib.sha256(str(folder / "b.pdf").encode()).hexdigest() and row.source_type == "local"


def test_load_from_bytes(spark, folder):
    data = spark.createDataFrame([(bytearray(b"test content"),)], "content binary")
    row = src.load_documents(spark, data=data).first()
    assert row.source_path is None and row.source_type == "bytes"
    assert row.content_hash == hashlib.sha256(b"test content").hexdigest()
    assert src.load_documents(spark, str(folder / "b.pdf"), data).first().source_type == "local"


def test_load_errors(spark):
    with pytest.raises(ValueError):
        src.load_documents(spark)
    with pytest.raises(AnalysisException):
        src.load_documents(spark, "/no/such/path").count()


def test_page_hooks(spark):
    docs = spark.createDataFrame([(1, bytearray(b"ab")), (2, bytearray(b"")), (3, bytearray(b"c"))], "doc_id bigint, content binary")

    def parse(content):
        return [{"page_number": i, "width": float(c)} for i, c in enumerate(content)]

    pages = src.explode_pages(docs, parse, "page_number int, width double")
    assert sorted(map(tuple, pages.collect())) == [(1, 0, 97.0), (1, 1, 98.0), (3, 0, 99.0)]

    def double(batch: pd.DataFrame) -> pd.DataFrame:
        return batch.assign(width=batch.width * 2)

    twice = src.map_pages(pages, double, "doc_id bigint, page_number int, width double", partitions=2)
    assert sorted(r.width for r in twice.collect()) == [194.0, 196.0, 198.0]


def test_embed_hook(spark):
    def make():
        import numpy as np

        return lambda texts: np.array([[len(t), 1.0] for t in texts], dtype="float32")

    df = spark.createDataFrame([("abc",), ("",)], "t string")
    assert [r.embedding for r in src.embed(df, make, input_col="t", batch_size=1).collect()] == [[3.0, 1.0], [0.0, 1.0]]
    assert src.embed(df.limit(0), make, input_col="t").count() == 0


@pytest.mark.parametrize("batch_size", [1, 2, 64])
def test_embed_keeps_rows_without_input_from_the_model(spark, batch_size):
    def make():
        import numpy as np

        return lambda texts: np.array([[t.count("a") + 0.0, len(t)] for t in texts], dtype="float32")

    df = spark.createDataFrame([(1, "abca"), (2, None), (3, ""), (4, None), (5, "b")], "id int, t string").coalesce(1)
    got = {r.id: r.embedding for r in src.embed(df, make, input_col="t", batch_size=batch_size).collect()}
    assert got == {1: [2.0, 4.0], 2: None, 3: [0.0, 0.0], 4: None, 5: [0.0, 1.0]}
    none = src.embed(df.filter("t is null"), make, input_col="t", batch_size=batch_size).collect()
    assert [(r.id, r.embedding) for r in none] == [(2, None), (4, None)]


def test_objects(spark, tmp_path):
    plan = spark.sql(
        "select 'p1' path_display, 'k1' key, 'upload_new' action, 'r1' rev, timestamp_ntz '2024-01-02 03:04:05' client_modified"
        " union all select 'p2', 'k2', 'skip', 'r2', null union all select 'p3', 'k3', 'upload_newer', 'r3', null"
    )
    contents = spark.createDataFrame([(p, bytearray(p.encode())) for p in ("p1", "p2", "p3")], "path_display string, content binary")
    objects = src.objects_to_upload(plan, contents)
    src.write_objects(objects, str(tmp_path / "out"))
    got = {r.key: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert set(got) == {"k1", "k3"} and bytes(got["k1"].content) == b"p1" and got["k1"].content_type == "application/pdf"
    assert got["k1"].metadata == {"dropbox_rev": "r1", "dropbox_client_modified": "2024-01-02T03:04:05"}
    assert got["k3"].metadata == {"dropbox_rev": "r3"}

    def make_put(target=str(tmp_path)):
        def put(row):
            with open(f"{target}/{row.key}", "wb") as f:
                f.write(row.content)

        return put

    src.put_objects(objects, make_put)
    assert (tmp_path / "k3").read_bytes() == b"p3" and not (tmp_path / "k2").exists()


def test_fetch_counts_errors(spark, monkeypatch):
    monkeypatch.setattr(src, "_BYTES_OUT", 3)
    plan = spark.range(6).selectExpr(
        "concat('p', id) path_display", "concat('k', id) key", "case when id = 5 then 'skip' else 'upload_new' end action",
        "'r' rev", "timestamp_ntz '2024-01-02 03:04:05' client_modified",
    )

    def make_fetch():
        def fetch(path):
            if path == "p2":
                raise OSError("gone")
            return path.encode()

        return fetch

    got = {r.key: r for r in src.fetch_objects(plan, make_fetch).collect()}
    assert set(got) == {"k0", "k1", "k2", "k3", "k4"}
    assert got["k2"].content is None and got["k2"].error == "OSError: gone"
    assert bytes(got["k3"].content) == b"p3" and got["k3"].error is None and got["k3"].metadata["dropbox_rev"] == "r"


@pytest.mark.parametrize("fmt", ["json", "parquet"])
def test_cluster_report(spark, tmp_path, fmt):
    clusters = spark.createDataFrame([("a.pdf", 0, 1.0, 2.0), ("b.pdf", -1, 0.0, 0.5)], "file string, cluster bigint, x double, y double")
    src.write_cluster_report(clusters, str(tmp_path / fmt), fmt)
    back = spark.read.format(fmt).load(str(tmp_path / fmt)).select(*clusters.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, clusters.collect()))


def test_jdbc_options():
    options = tables.read_options("jdbc:x", "users", partition_column="id", lower=0, upper=100, partitions=8, user="u")
    assert options["numPartitions"] == "8" and options["partitionColumn"] == "id" and options["user"] == "u"
    assert "partitionColumn" not in tables.read_options("jdbc:x", "users")
    with pytest.raises(ValueError):
        tables.read_options("jdbc:x", "users", partition_column="id")


def test_checkpoint_folder_is_stable(spark):
    assert checkpoint_folder(spark) == checkpoint_folder(spark)
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    assert spark.range(3).select(F.sum("id")).first()[0] == 3
