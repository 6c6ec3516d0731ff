import math
import random

import pytest
from pyspark.sql import functions as F

from quillgrid.operators import cluster as cl
from quillgrid.operators import metric
from quillgrid.operators.components import connected_components
from quillgrid.plans import vector_queries


def brute_clusters(points, eps, k, min_size):
    ids = sorted(points)
    near = {i: [j for j in ids if sum((a - b) ** 2 for a, b in zip(points[i], points[j])) <= eps * eps] for i in ids}
    core = {i for i in ids if len(near[i]) >= k}
    label = {i: -1 for i in ids}
    seen = set()
    for i in ids:
        if i not in core or i in seen:
            continue
        stack, members = [i], []
        seen.add(i)
        while stack:
            x = stack.pop()
            members.append(x)
            for j in near[x]:
                if j in core and j not in seen:
                    seen.add(j)
                    stack.append(j)
        if len(members) >= min_size:
            for m in members:
                label[m] = min(members)
    return label


def run(spark, points, eps, min_size, min_samples=None, hot_rows=1_000_000):
    rows = [(i, [float(c) for c in p]) for i, p in points.items()]
    df = spark.createDataFrame(rows, "id bigint, coords array<double>")
    out = cl.density_clusters(df, eps, min_size, min_samples, hot_rows=hot_rows)
    return {r.id: r.cluster for r in out.collect()}


@pytest.mark.parametrize("dimensions,hot_rows", [(2, 1_000_000), (2, 20), (3, 1_000_000), (5, 30)])
def test_against_brute_force(spark, dimensions, hot_rows):
    rng = random.Random(dimensions * 7 + hot_rows)
    points = {}
    for i in range(220):
        c = rng.choice([0.0, 1.0, 2.5])
        points[i] = [c + rng.gauss(0, 0.15) for _ in range(dimensions)]
    eps = 0.12 * math.sqrt(dimensions)
    assert run(spark, points, eps, 4, hot_rows=hot_rows) == brute_clusters(points, eps, 4, 4)


def test_copies_hold_a_third_of_all_rows(spark):
    rng = random.Random(3)
    points = {i: [0.5, 0.5] for i in range(100)}
    points |= {i: [rng.uniform(0, 3), rng.uniform(0, 3)] for i in range(100, 300)}
    assert run(spark, points, 0.15, 5, hot_rows=25) == brute_clusters(points, 0.15, 5, 5)


@pytest.mark.parametrize("shift", [0.9, 1.0, 1.02, 1.3])
def test_crowded_neighbours_are_split_into_sub_cells(spark, monkeypatch, shift):
    """Two dense strips about eps apart: their cells are settled by splitting, not pair by pair."""
    monkeypatch.setattr(cl, "_SMALL_UNIT", 4)
    rng = random.Random(11)
    points = {i: [rng.uniform(0, 0.05), rng.uniform(0, 1)] for i in range(150)}
    points |= {i: [shift + rng.uniform(0, 0.05), rng.uniform(0, 1)] for i in range(150, 300)}
    eps = 1.0
    assert run(spark, points, eps, 4) == brute_clusters(points, eps, 4, 4)


def test_min_size_and_min_samples(spark):
    points = {0: [0, 0], 1: [0.1, 0], 2: [0.2, 0], 3: [5, 5], 4: [5.1, 5], 5: [9, 9]}
    assert run(spark, points, 0.15, 3, min_samples=2) == brute_clusters(points, 0.15, 2, 3)
    assert run(spark, points, 0.15, 2, min_samples=1) == brute_clusters(points, 0.15, 1, 2)


def test_empty_input_and_few_rows(spark):
    empty = spark.createDataFrame([], "id bigint, coords array<double>")
    assert cl.density_clusters(empty, 1.0).count() == 0
    assert cl.layout_2d(empty).count() == 0
    assert run(spark, {1: [0, 0], 2: [0, 0]}, 1.0, 4) == {1: -1, 2: -1}


def test_rows_without_a_vector_are_noise(spark):
    rows = [(i, [0.0, 0.1 * i]) for i in range(5)] + [(7, None), (8, None)]
    df = spark.createDataFrame(rows, "id bigint, coords array<double>")
    got = {r.id: r.cluster for r in cl.density_clusters(df, 0.15, 3, hot_rows=1).collect()}
    assert got == brute_clusters(dict(rows[:5]), 0.15, 3, 3) | {7: -1, 8: -1}
    only = cl.density_clusters(df.filter("id > 6"), 0.15, 3).collect()
    assert [r.cluster for r in only] == [-1, -1]


def union_find(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("hot_rows", [1_000_000, 8])
def test_components(spark, hot_rows):
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(60)]
    star = [(500, 501 + i) for i in range(40)]
    loose = [(rng.randrange(1000, 1060), rng.randrange(1000, 1060)) for _ in range(45)]
    edges = [e for e in chain + star + loose if e[0] != e[1]]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r.node: r.component for r in connected_components(df, hot_rows).collect()}
    assert got == union_find(edges)


def test_components_without_edges(spark):
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_cluster_documents_joins_clusters_and_layout(spark):
    rng = random.Random(9)
    rows = [(i, f"/d/{i}.pdf", [float(i % 2) + rng.uniform(0, 0.01) for _ in range(4)]) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, file string, embedding array<float>")
    out = cl.cluster_documents(docs, 0.1, 4).collect()
    assert len(out) == 20
    assert {r.file: r.cluster for r in out} == {f"/d/{i}.pdf": i % 2 for i in range(20)}
    left = {round(r.x) for r in out if r.cluster == 0}
    right = {round(r.x) for r in out if r.cluster == 1}
    assert left != right
    again = {r.file: (r.x, r.y) for r in cl.cluster_documents(docs, 0.1, 4).collect()}
    assert all(abs(again[r.file][0] - r.x) < 1e-9 for r in out)


def test_document_without_embedding_is_noise(spark):
    docs = spark.createDataFrame([(1, "a", [0.0, 0.0]), (2, "b", None)], "doc_id bigint, file string, embedding array<float>")
    got = {r.file: (r.cluster, r.x is None) for r in cl.cluster_documents(docs, 1.0, 1).collect()}
    assert got == {"a": (1, False), "b": (-1, True)}


@pytest.mark.parametrize("dimensions", [2, 6])
def test_vectors_that_are_not_finite_are_noise_and_move_no_other(spark, dimensions):
    rng = random.Random(4)
    rows = [(i, f"d{i}", [float(i % 2) + rng.uniform(0, 0.01) for _ in range(dimensions)]) for i in range(20)]
    bad = [[v] + [0.0] * (dimensions - 1) for v in (math.nan, math.nan, math.nan, math.inf, -math.inf, math.inf, math.inf)]
    docs = [spark.createDataFrame(r, "doc_id bigint, file string, embedding array<float>") for r in (rows, rows + [(100 + i, f"bad{i}", b) for i, b in enumerate(bad)])]
    plain, mixed = ({r.file: r for r in cl.cluster_documents(df, 0.1, 3).collect()} for df in docs)
    assert len(mixed) == 27 and all(mixed[f].cluster == r.cluster and abs(mixed[f].x - r.x) < 1e-9 for f, r in plain.items())
    assert all(mixed[f"bad{i}"].cluster == -1 and math.isnan(mixed[f"bad{i}"].x) for i in range(7))


def test_documents_with_empty_or_no_text(spark, tmp_path):
    texts = [*(f"a stone and a line {'o' * (i % 2)}" for i in range(12)), "", "", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    shares = {r.doc_id: list(r)[1:] for r in vector_queries.embed_documents(spark, str(tmp_path)).collect()}
    assert len(shares) == 16 and shares[15] == [None] * 8
    assert all(math.isnan(x) for i in (12, 13, 14) for x in shares[i]) and abs(shares[0][0] - 3 / 19) < 1e-6
    got = {r.file: (r.cluster, r.placed) for r in vector_queries.cluster_documents(spark, str(tmp_path)).collect()}
    assert got == {**{f"doc/{i}": (i % 2, True) for i in range(12)}, **{f"doc/{i}": (-1, True) for i in (12, 13, 14)}, "doc/15": (-1, False)}


def test_vectors_of_unequal_length_are_refused(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0, 9.0])], "id bigint, coords array<double>")
    with pytest.raises(ValueError, match="2 to 3"):
        cl.density_clusters(df, 1.0, 1)


def test_score_is_cosine(spark):
    from quillgrid.operators.search import cosine, top_k

    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, [-1.0, 0.0])], "id int, embedding array<float>")
    scores = {r.id: r.s for r in df.select("id", cosine(F.col("embedding"), [2.0, 0.0]).alias("s")).collect()}
    assert scores[1] == pytest.approx(1) and scores[2] == pytest.approx(math.sqrt(0.5)) and scores[4] == pytest.approx(-1)
    assert scores[3] is None
    assert [r.id for r in top_k(df, [2.0, 0.0], 2).collect()] == [1, 2]


def test_neighbour_distances_equal_brute_force(spark):
    rng = random.Random(12)
    points = {i: [rng.gauss(0, 1) for _ in range(5)] for i in range(90)} | {100: [9.0] * 5, 101: [9.0] * 5, 102: [9.0] * 5}
    rows = [*points.items(), (200, None)]
    df = spark.createDataFrame(rows, "id bigint, coords array<double>").repartition(5)
    got = {r.id: r.distance for r in cl.neighbour_distances(df, 3, sampled=40).collect()}
    assert len(got) == 40 and 200 not in got
    for i, distance in got.items():
        assert distance == pytest.approx(sorted(math.dist(points[i], p) for p in points.values())[2])
    every = {r.id: r.distance for r in cl.neighbour_distances(df, 3).collect()}
    assert set(every) == set(points) and every[100] == 0.0


def test_few_and_unequal_vectors(spark):
    few = spark.createDataFrame([(1, [0.0, 1.0]), (2, [3.0, 5.0])], "id bigint, coords array<double>")
    assert {r.distance for r in cl.neighbour_distances(few, 3).collect()} == {None}
    assert {r.distance for r in cl.neighbour_distances(few, 2).collect()} == {5.0}
    assert cl.neighbour_distances(few.filter("id < 0"), 2).count() == 0
    uneven = few.unionByName(spark.createDataFrame([(3, [1.0, 2.0, 3.0])], few.schema))
    with pytest.raises(Exception, match="elements"):
        cl.neighbour_distances(uneven, 2).collect()


def test_eps_is_chosen_from_the_data(spark):
    rng = random.Random(5)
    points = {i: [(i % 3) * 10 + rng.gauss(0, 0.1), rng.gauss(0, 0.1)] for i in range(150)}
    df = spark.createDataFrame(list(points.items()), "id bigint, coords array<double>")
    eps = cl.suggested_eps(df, core_share=0.9)
    assert 0 < eps < 1
    clusters = {r.id: r.cluster for r in cl.density_clusters(df).collect()}
    assert all(c == -1 or c % 3 == i % 3 for i, c in clusters.items())
    assert sum(c >= 0 for c in clusters.values()) >= 60
    copies = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], "id bigint, coords array<double>")
    assert {r.cluster for r in cl.density_clusters(copies).collect()} == {0}


@pytest.mark.parametrize("dimensions, leaf", [(6, 10), (16, 25)])
def test_cuts_in_many_dimensions(spark, monkeypatch, dimensions, leaf):
    monkeypatch.setattr(metric.cells, "__defaults__", (leaf, 4))
    rng = random.Random(dimensions)
    centres = [[rng.uniform(0, 6) for _ in range(dimensions)] for _ in range(12)]
    points = {i: [c + rng.gauss(0, 0.2) for c in centres[i % 12]] for i in range(240)}
    points |= {i: [rng.uniform(0, 6) for _ in range(dimensions)] for i in range(240, 280)}
    points |= {i: points[i % 7] for i in range(280, 340)}
    eps = 0.3 * math.sqrt(dimensions)
    want = brute_clusters(points, eps, 4, 4)
    assert run(spark, points, eps, 4) == want and len(set(want.values())) > 3


def test_cells_hold_all_neighbours_of_their_points(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(i % 5, 0.5) for _ in range(8)], 1) for i in range(300)]
    df = spark.createDataFrame(rows, "pt bigint, coords array<double>, weight int")
    celled = metric.cells(df, 0.9, leaf=20).collect()
    inside = {}
    for r in celled:
        inside.setdefault(r.cell, set()).add(r.pt)
    assert sorted(r.pt for r in celled if r.own) == list(range(300)) and len(inside) > 10
    for r in celled:
        if r.own:
            near = {i for i, coords, _ in rows if math.dist(coords, r.coords) <= 0.9}
            assert near <= inside[r.cell]


def test_candidates_grow_with_the_rows(spark):
    """Four times the rows, spread over four times the area of a plane in 64 dimensions: so grow the pairs to compare."""

    def candidates(n):
        rng = random.Random(1)
        axes = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(2)]
        side = math.sqrt(n) / 10
        places = [(rng.uniform(0, side), rng.uniform(0, side)) for _ in range(n // 25)]
        centres = [[x * a + y * b for a, b in zip(*axes)] for x, y in places]
        rows = [(i, [c + rng.gauss(0, 0.05) for c in centres[i % len(centres)]], 1) for i in range(n)]
        df = spark.createDataFrame(rows, "pt bigint, coords array<double>, weight int").repartition(4)
        return metric.candidate_pairs(metric.cells(df, 0.7, leaf=64))

    small, large = candidates(1000), candidates(4000)
    assert large < 7 * small and large < 4000**2 / 12


def test_equal_points_need_no_cut(spark):
    df = spark.createDataFrame([(i, [1.0] * 6, 1) for i in range(50)], "pt bigint, coords array<double>, weight int")
    celled = metric.cells(df, 0.5, leaf=8)
    assert celled.select("cell").distinct().count() == 1 and celled.filter("own").count() == 50
    assert {r.near for r in metric.neighbour_counts(celled, 0.5).collect()} == {50}


def test_points_that_are_equally_far_are_not_copied(spark):
    """Cuts of such points make nearly all of them guests of every part, so the cell stays whole and is compared in chunks."""
    rng = random.Random(8)
    points = {i: [rng.gauss(0, 1) for _ in range(32)] for i in range(400)}
    df = spark.createDataFrame([(i, c, 1) for i, c in points.items()], "pt bigint, coords array<double>, weight int")
    eps = 6.0
    celled = metric.cells(df, eps, leaf=25, chunk=50)
    assert celled.count() == 400 and {r.chunks for r in celled.collect()} == {8}
    near = {i: sum(math.dist(c, d) <= eps for d in points.values()) for i, c in points.items()}
    assert {r.pt: r.near for r in metric.neighbour_counts(celled, eps).collect()} == near
    pairs = metric.links(celled, eps).collect()
    assert all(math.dist(points[r.a], points[r.b]) <= eps for r in pairs)
    root = list(range(400))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in pairs:
        root[find(r.a)] = find(r.b)
    for i, c in points.items():
        assert all(find(i) == find(j) for j, d in points.items() if math.dist(c, d) <= eps)
