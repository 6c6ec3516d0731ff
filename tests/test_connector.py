import json
import os

import sys

import pytest
from pyspark import cloudpickle

from quillgrid.sources.connector import RootPart, register_connector
from quillgrid.streaming import jobs

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import a test module


class LinePager:
    """Roots are folders; each file is a page of lines, and the cursor counts pages."""

    def __init__(self, folder):
        self.folder = folder

    def roots(self):
        return sorted(os.listdir(self.folder))

    def _files(self, root):
        return sorted(os.listdir(f"{self.folder}/{root}"))

    def page(self, root, cursor):
        files, at = self._files(root), int(cursor or 0)
        if at >= len(files):
            return [], str(at), False
        with open(f"{self.folder}/{root}/{files[at]}") as f:
            rows = [(r["path"], r["size"]) for r in map(json.loads, f)]
        with open(f"{self.folder}.log", "a") as log:
            log.write(f"{root}:{at}\n")
        return rows, str(at + 1), at + 1 < len(files)

    def latest(self, root):
        return str(len(self._files(root)))


def put(folder, root, page, rows):
    os.makedirs(f"{folder}/{root}", exist_ok=True)
    with open(f"{folder}/{root}/{page:04d}", "w") as f:
        f.writelines(json.dumps({"path": p, "size": s}) + "\n" for p, s in rows)


SCHEMA = "path string, size bigint"


def test_pages_are_read_by_root(spark, tmp_path):
    folder = str(tmp_path / "store")
    want = set()
    for root in ("a", "b", "c"):
        for page in range(3):
            rows = [(f"/{root}/{page}{i}", 10 * page + i) for i in range(4)]
            put(folder, root, page, rows)
            want |= {(root, *r) for r in rows}
    register_connector(spark, "paged", SCHEMA, lambda: LinePager(folder))
    df = spark.read.format("paged").load()
    assert {tuple(r) for r in df.collect()} == want and df.count() == 36
    os.remove(f"{folder}.log")
    only = df.filter("root = 'b' and size > 10")
    assert {tuple(r) for r in only.collect()} == {w for w in want if w[0] == "b" and w[2] > 10}
    with open(f"{folder}.log") as log:
        assert {line.split(":")[0] for line in log} == {"b"}
    assert df.filter("root in ('a', 'x')").count() == 12 and df.filter("root = 'a' and root = 'b'").count() == 0


def test_a_stream_resumes_at_its_cursors(spark, tmp_path):
    folder, out = str(tmp_path / "store"), str(tmp_path / "out")
    put(folder, "a", 0, [("/a/1", 1), ("/a/2", 2)])
    register_connector(spark, "changes", SCHEMA, lambda: LinePager(folder))

    def run():
        stream = spark.readStream.format("changes").load()
        jobs.run_available(stream, jobs.folder_sink(out), str(tmp_path / "progress")).awaitTermination()
        return {(r.path, r.size) for r in spark.read.parquet(out).collect()}, spark.read.parquet(out).count()

    assert run() == ({("/a/1", 1), ("/a/2", 2)}, 2)
    os.remove(f"{folder}.log")
    put(folder, "a", 1, [("/a/3", 3)])
    put(folder, "b", 0, [("/b/1", 4)])
    assert run() == ({("/a/1", 1), ("/a/2", 2), ("/a/3", 3), ("/b/1", 4)}, 4)
    with open(f"{folder}.log") as log:
        assert set(log.read().split()) == {"a:1", "b:0"}


class FolderStore:
    def __init__(self, folder):
        self.folder = folder

    def stage(self, batch, row):
        if row.path == "fail":
            raise RuntimeError("refused")
        os.makedirs(f"{self.folder}/staged", exist_ok=True)
        name = f"{batch}-{row.path}"
        with open(f"{self.folder}/staged/{name}", "w") as f:
            f.write(str(row.size))
        return name

    def publish(self, batch, names):
        os.makedirs(f"{self.folder}/live", exist_ok=True)
        for n in names:
            os.replace(f"{self.folder}/staged/{n}", f"{self.folder}/live/{n.removeprefix(batch + '-')}")

    def discard(self, batch, names):
        for n in names:
            os.remove(f"{self.folder}/staged/{n}")


def test_a_write_publishes_all_or_nothing(spark, tmp_path):
    folder = str(tmp_path / "store")
    register_connector(spark, "puts", SCHEMA, make_store=lambda: FolderStore(folder))
    rows = spark.createDataFrame([("r", f"f{i}", i) for i in range(20)], f"root string, {SCHEMA}").repartition(4)
    rows.write.format("puts").mode("append").save()
    assert sorted(os.listdir(f"{folder}/live")) == sorted(f"f{i}" for i in range(20))
    bad = spark.createDataFrame([("r", f"g{i}", i) for i in range(8)] + [("r", "fail", 0)], f"root string, {SCHEMA}").repartition(3)
    with pytest.raises(Exception, match="refused"):
        bad.write.format("puts").mode("append").save()
    assert not any(f.startswith("g") for f in os.listdir(f"{folder}/live"))


def test_parts_between_cursors(spark, tmp_path):
    from quillgrid.sources.connector import _pages

    folder = str(tmp_path / "store")
    for page in range(4):
        put(folder, "a", page, [(f"/{page}", page)])
    pager = LinePager(folder)
    assert [r[1] for r in _pages(pager, RootPart("a", "1", "3"))] == ["/1", "/2"]
    assert list(_pages(pager, RootPart("a", "2", "2"))) == [] and len(list(_pages(pager, RootPart("a")))) == 4


class CutPager(LinePager):
    """Cuts a root after every second page."""

    def cuts(self, root):
        return [str(i) for i in range(2, len(self._files(root)), 2)]


def test_a_root_is_cut_into_parts(spark, tmp_path):
    folder = str(tmp_path / "store")
    for page in range(7):
        put(folder, "a", page, [(f"/a{page}", page)])
    put(folder, "b", 0, [("/b0", 0)])
    register_connector(spark, "cut", SCHEMA, lambda: CutPager(folder))
    df = spark.read.format("cut").load()
    assert df.rdd.getNumPartitions() == 5
    assert sorted(r.path for r in df.collect()) == [*(f"/a{i}" for i in range(7)), "/b0"]
    assert sorted(open(f"{folder}.log").read().split()) == [*(f"a:{i}" for i in range(7)), "b:0"]  # each page once


def test_a_stored_page_begins_at_its_byte(tmp_path):
    from quillgrid.plans.file_queries import StoredPager
    from quillgrid.sources.connector import _pages

    folder = tmp_path / "store" / "root=a"
    folder.mkdir(parents=True)
    lines = [json.dumps({"path_display": f"/é{i}", "size": i}, ensure_ascii=False) + "\n" for i in range(9)]
    for name, part in (("0.json", lines[:5]), ("1.json", []), ("2.json", lines[5:])):
        (folder / name).write_text("".join(part))
    pager = StoredPager(str(tmp_path / "store"), 2)
    rows, cursor, more = pager.page("a", None)
    assert len(rows) == 2 and more and cursor == f"0:{len(''.join(lines[:2]).encode())}"
    assert [r[-1] for r in _pages(pager, RootPart("a"))] == list(range(9))
    cuts = [None, *pager.cuts("a"), None]
    parts = [[r[-1] for r in _pages(pager, RootPart("a", *ends))] for ends in zip(cuts, cuts[1:])]
    assert parts == [[0, 1, 2, 3, 4], [], [5, 6, 7, 8]]
