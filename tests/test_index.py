import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgrid.operators import index


def frame(spark, data, first=0):
    rows = [(first + i, [float(x) for x in v], i % 3) for i, v in enumerate(data)]
    return spark.createDataFrame(rows, "id bigint, embedding array<double>, kind int").repartition(3)


def brute(data, queries, k, allowed=None):
    unit = data / np.linalg.norm(data, axis=1)[:, None]
    out = []
    for q in queries:
        scores = unit @ (data[q] / np.linalg.norm(data[q]))
        order = sorted((i for i in range(len(data)) if allowed is None or i in allowed), key=lambda i: (-round(scores[i], 12), i))
        out.append(order[:k])
    return out


def clustered(n, dimensions=24, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, dimensions))
    return centres[np.arange(n) % 20] + 0.3 * rng.normal(size=(n, dimensions))


def recall_of(found, want, queries):
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append(r.id)
    return sum(len(set(got.get(q, ())) & set(w)) for q, w in zip(queries, want)) / sum(map(len, want))


def test_recall_and_pruned_folders(spark, tmp_path):
    data, path = clustered(1500), str(tmp_path / "index")
    df = frame(spark, data)
    model = index.fit(df, cells=20, stretches=8)
    index.add(df.filter("id < 900"), path, model)
    index.add(df.filter("id >= 900"), path, model)  # appended later
    assert spark.read.parquet(path).count() == 1500
    queries = list(range(0, 1500, 50))
    asked = df.filter("id % 50 = 0")
    found = index.search(spark, path, model, asked, k=10, probes=3)
    assert recall_of(found, brute(data, queries, 10), queries) >= 0.9
    first = found.filter("rank = 1").collect()
    assert all(r.id == r.query_id and r.score == pytest.approx(1) for r in first) and len(first) == len(queries)
    one = index.search(spark, path, model, asked.limit(1), k=5, probes=2)
    plan = one._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"PartitionFilters: \[[^\]]*?cell#\d+ IN \(\d+,\d+\)", plan)
    assert len(scans) == plan.count("FileScan parquet [id")


def test_filter_acts_before_ranking(spark, tmp_path):
    data, path = clustered(600, 12, 2), str(tmp_path / "index")
    df = frame(spark, data)
    model = index.fit(df, cells=6, stretches=5)  # dimensions are padded
    index.add(df, path, model)
    queries = list(range(0, 600, 60))
    found = index.search(spark, path, model, df.filter("id % 60 = 0"), k=8, probes=6, reranked=300, where=F.col("kind") == 1)
    allowed = set(range(1, 600, 3))
    got = {}
    for r in found.orderBy("rank").collect():
        assert r.kind == 1
        got.setdefault(r.query_id, []).append(r.id)
    assert [got[q] for q in queries] == brute(data, queries, 8, allowed)


@pytest.mark.parametrize("rows, asked", [(40, 3), (100_000, 512)])
def test_large_cells_are_dealt(spark, tmp_path, monkeypatch, rows, asked):
    monkeypatch.setattr(index, "_ROWS", rows)
    monkeypatch.setattr(index, "_QUERIES", asked)
    monkeypatch.setattr(index, "_BATCH", 16)
    data, path = clustered(300, 8, 3), str(tmp_path / "index")
    df = frame(spark, data)
    model = index.fit(df, cells=2, stretches=4)
    index.add(df, path, model)
    queries = list(range(0, 300, 20))
    found = index.search(spark, path, model, df.filter("id % 20 = 0"), k=4, probes=2, reranked=300)
    got = {}
    for r in found.orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert [got[q] for q in queries] == brute(data, queries, 4)


def test_probes_for_a_recall(spark, tmp_path):
    rng = np.random.default_rng(4)
    data, path = rng.normal(size=(800, 32)), str(tmp_path / "index")  # nothing clusters: many cells are needed
    df = frame(spark, data)
    model = index.fit(df, cells=16, stretches=16)
    index.add(df, path, model)
    probes = index.probes_for(spark, path, model, recall=0.97)
    assert 3 < probes <= 16
    queries = list(range(0, 800, 20))
    found = index.search(spark, path, model, df.filter("id % 20 = 0"), k=10, probes=probes)
    assert recall_of(found, brute(data, queries, 10), queries) >= 0.9


def test_rows_without_direction_and_bounds(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 1.0])], "id int, embedding array<double>")
    path = str(tmp_path / "index")
    model = index.fit(df, cells=2, stretches=2)
    index.add(df, path, model)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 4]
    found = [(r.query_id, r["rank"], r.id) for r in index.search(spark, path, model, df, k=5, probes=2).collect()]
    assert sorted(found) == [(1, 1, 1), (1, 2, 4), (4, 1, 4), (4, 2, 1)]
    with pytest.raises(ValueError, match="no vector"):
        index.fit(df.filter("id = 3"))
    with pytest.raises(ValueError, match="cells"):
        index.fit(df, cells=0)
