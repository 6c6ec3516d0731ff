import random
import re
from collections import Counter
from itertools import combinations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillgrid.operators import grams as gr
from quillgrid.operators import patterns, tables


def graph(seed, n, m):
    rng = random.Random(seed)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    return edges + [(0, i) for i in range(1, n)] + edges[:5]  # a node with all others as neighbours, repeated edges


def neighbours(edges):
    out = {}
    for a, b in edges:
        if a != b:
            out.setdefault(a, set()).add(b)
            out.setdefault(b, set()).add(a)
    return out


def test_triangles(spark):
    edges = graph(1, 40, 120)
    near = neighbours(edges)
    want = {(a, b, c) for a, b, c in combinations(range(40), 3) if b in near[a] and c in near[a] and c in near[b]}
    rows = patterns.triangles(spark.createDataFrame([*edges, (None, 3)], "x bigint, y bigint")).collect()
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want


@pytest.mark.parametrize("hot_rows", [1_000_000, 10])
def test_four_cycles(spark, hot_rows):
    edges = graph(2, 30, 80)
    near = neighbours(edges)
    cycles = 0
    for a, c in combinations(range(30), 2):
        shared = len((near[a] & near[c]) - {a, c})
        cycles += shared * (shared - 1) // 2
    rows = patterns.four_cycles(spark.createDataFrame(edges, "x bigint, y bigint"), hot_rows).collect()
    assert sum(r.cycles for r in rows) == cycles // 2  # both pairs of opposite corners see a cycle
    for r in rows:
        assert r.a < r.b and r.cycles == r.between * (r.between - 1) // 2 and r.between <= len(near[r.a] & near[r.b])
    assert len({(r.a, r.b) for r in rows}) == len(rows)


def test_a_star_makes_few_paths(spark):
    """Of 2,000 neighbours of one node no two are joined: lists of higher neighbours hold one node each."""
    star = spark.createDataFrame([(0, i) for i in range(1, 2001)], "x bigint, y bigint")
    lists = patterns._ordered(star).groupBy("low").count()
    assert lists.agg({"count": "max"}).first()[0] == 1
    assert patterns.triangles(star).count() == 0 and patterns.four_cycles(star).count() == 0


def test_lists_are_joined_once(spark):
    """An edge's lower list comes with its own end; only the upper end's list is joined to it."""
    edges = spark.createDataFrame(graph(1, 20, 60), "x bigint, y bigint")
    plan = patterns.triangles(edges)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"(?m)^[ :+-]*Join ", plan)) == 1


def test_paths_of_four_cycles_are_dealt_out(spark, monkeypatch):
    real, parts = patterns.salted_join, []
    monkeypatch.setattr(patterns, "salted_join", lambda left, *a, **k: parts.append(left.rdd.getNumPartitions()) or real(left, *a, **k))
    edges = spark.createDataFrame([(a, 100 + b) for a in range(10) for b in range(10)], "x bigint, y bigint")
    monkeypatch.setattr(patterns, "TASK_PATHS", 100, raising=False)
    rows = patterns.four_cycles(edges).collect()
    assert parts == [10] and sum(r.cycles for r in rows) == 45 * 45  # 100 edges upwards, 10 paths from each


def blocks(spark, rows):
    return spark.createDataFrame(rows, "t int, x0 double, y0 double, x1 double, y1 double, text string")


def test_rows_columns_and_spans(spark):
    rows = [
        (1, 0.0, 0.0, 200.0, 8.0, "title over all"),
        *[(1, 70.0 * c, 10.0 * r, 70.0 * c + 50, 10.0 * r + 8, f"{r},{c}") for r in range(1, 5) for c in range(3)],
        (1, 0.0, 50.0, 50.0, 68.0, "tall"),
        *[(1, 70.0 * c, 10.0 * r, 70.0 * c + 50, 10.0 * r + 8, f"{r},{c}") for r in (5, 6) for c in (1, 2)],
        (2, 5.0, 5.0, 9.0, 9.0, "alone"),
        (3, 5.0, 5.0, 5.0, 5.0, "flat"),
    ]
    cells = tables.extract_cells(blocks(spark, rows), ["t"])
    got = {(r.t, r.text): (r.row_no, r.row_span, r.col_no, r.col_span) for r in cells.collect()}
    assert got[1, "title over all"] == (0, 1, 0, 3) and got[1, "tall"] == (5, 2, 0, 1)
    assert all(got[1, f"{r},{c}"] == (r, 1, c, 1) for r in range(1, 5) for c in range(3))
    assert got[1, "6,2"] == (6, 1, 2, 1)
    assert got[2, "alone"] == (0, 1, 0, 1) and got[3, "flat"] == (None, None, None, None)
    shapes = {r.t: (r.n_rows, r.n_cols, r.n_cells, r.n_spanning) for r in tables.table_shapes(cells, ["t"]).collect()}
    assert shapes[1] == (7, 3, 18, 2) and shapes[2] == (1, 1, 1, 0)
    assert tables.extract_cells(blocks(spark, []), ["t"]).count() == 0


def random_tables(seed, n=40):
    rng = random.Random(seed)
    odd = [None, float("nan"), float("inf"), -float("inf"), -0.0]
    rows = []
    for t in range(n):
        # Every fourth table has odd places, every fifth lies anywhere.
        for _ in range(rng.choice([1, 2, 5, 20, 90])):
            x, y = (rng.uniform(0, 99), rng.uniform(0, 99)) if t % 5 == 0 else (10.0 * rng.randint(0, 9), 10.0 * rng.randint(0, 9))
            at = [x, y, x + rng.choice([0.0, 0.1, 5.0, 10.0, 40.0]), y + rng.choice([0.0, 0.1, 5.0, 10.0, 40.0])]
            if t % 4 == 0 and rng.random() < 0.1:
                at[rng.randint(0, 3)] = rng.choice(odd)
            rows.append((None if t == 7 else t, *at, str(rng.randint(0, 99))))
    return rows


def cell_counts(cells):
    return Counter(tuple(str(value) for value in row) for row in cells.select("t", "text", "x0", "y0", "x1", "y1", *tables.CELL).collect())


@pytest.mark.parametrize("gap_share", [0.0, 0.34])
def test_swept_cells_equal_those_of_bands(spark, monkeypatch, gap_share):
    rows = blocks(spark, random_tables(5)).coalesce(1)
    want = cell_counts(tables._cells_of_bands(rows, ["t"], gap_share))
    assert cell_counts(tables.extract_cells(rows, ["t"], gap_share)) == want
    named = rows.selectExpr("concat('a', t) s", "case when t % 3 = 0 then double('nan') when t % 3 = 1 then if(x0 > 50, 0D, -0D) else t end d", "*")
    keyed = cell_counts(tables._cells_of_bands(named, ["s", "d"], gap_share))
    assert cell_counts(tables.extract_cells(named, ["s", "d"], gap_share)) == keyed
    monkeypatch.setattr(tables, "LARGE_TABLE", 10)  # some tables are swept, some take windows
    assert cell_counts(tables.extract_cells(rows, ["t"], gap_share)) == want


def test_batches_end_within_tables(spark, monkeypatch):
    rows = [row for row in random_tables(6) if row[0] is not None]
    want = cell_counts(tables._cells_of_bands(blocks(spark, rows).coalesce(1), ["t"], 0.34))
    names = ["t", "x0", "y0", "x1", "y1", "text"]
    whole = pa.table({name: pa.array([row[i] for row in rows], from_pandas=False) for i, name in enumerate(names)})
    monkeypatch.setattr(tables, "BATCH_BLOCKS", 16)
    got = Counter()
    for batch in tables._placed_batches(iter(whole.to_batches(max_chunksize=7)), ["t"], 0.34):
        got.update(tuple(str(row[name]) for name in ["t", "text", "x0", "y0", "x1", "y1", *tables.CELL]) for row in batch.to_pylist())
    assert got == want
    assert list(tables._placed_batches(iter([]), ["t"], 0.34)) == []


def test_tables_take_one_shuffle_and_no_windows(spark):
    lines = spark.range(400).selectExpr("id div 4 t", "10D * (id % 4) y0", "10D * (id % 4) + 8 y1")
    apart = tables.together(lines, ["t"]).selectExpr("t", "y0", "y1", "explode(array(0D, 50D, 90D)) x0").withColumn("x1", F.expr("x0 + 20"))
    cells = tables.extract_cells(apart, ["t"])
    assert Counter((r.row_no, r.row_span, r.col_no, r.col_span) for r in cells.collect()) == {(y, 1, x, 1): 100 for y in range(4) for x in range(3)}
    ran = cells._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "MapInArrow" in ran and "Window" not in ran and "SortMergeJoin" not in ran
    assert ran.count("Exchange hashpartitioning(xxhash64(t") == 1


def test_large_tables(spark):
    rows = spark.createDataFrame([(i % 3 if i < 30 else i, "x") for i in range(60)] + [(0, "y")], "t int, text string")
    assert [tuple(r) for r in tables.large_tables(rows, ["t"], 10).collect()] == [(0,)]
    assert tables.large_tables(rows, ["t"], 11).count() == 0


@pytest.mark.parametrize(
    "pattern, literal",
    [
        (r"(?i)^/Urgent/.*\.pdf$", "/urgent/"), (r"a|bcd", None), (r"(ab)c+de?fgh", "abc"), (r"x(?:report)+y", "report"),
        (r"[abc]\d\w", None), (r"colou?r", "colo"), (r"über-Straße", "ber-stra"), (r"(unclosed", None), (r"^ab$", "ab"), (r"(opt)?abc", "abc"),
    ],
)
def test_required_literal(pattern, literal):
    found = gr.required_literal(pattern)
    assert found == literal or (literal and found and len(found) >= len(literal) and found in pattern.lower())


def test_rules_equal_brute_force(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(3, 6))) for _ in range(60)]
    texts = ["/".join(rng.choice(words) for _ in range(rng.randint(0, 5))) + rng.choice([".pdf", ".PNG", ""]) for _ in range(150)] + [None]
    rules = [(i, rng.randint(0, 40), rng.choice([w, f"(?i){w.upper()}", f"^{w}", f"{w}/.*f$", f"{w[:2]}."]), f"l{i}") for i, w in enumerate(words)]
    rules += [(100, 50, r"\.p.g$", "picture"), (101, 0, None, "never"), (102, 0, "nowhere", "absent")]
    want = Counter()
    for t in texts:
        hits = [(p, i, label) for i, p, pattern, label in rules if t is not None and pattern and re.search(pattern, t)]
        want[t, min(hits)[2] if hits else "none"] += 1
    df = spark.createDataFrame([(t,) for t in texts], "path string")
    got = gr.label_by_rules(df, "path", gr.frame_of(spark, rules), "none", hot_rows=20)
    assert Counter(tuple(r) for r in got.collect()) == want


def test_only_few_rules_are_tried_per_row(spark):
    rules = [(i, i, f"/folder{i:04d}/", "x") for i in range(3000)]
    df = spark.createDataFrame([(f"/folder{i:04d}/file.pdf",) for i in range(0, 3000, 3)], "text string")
    known = gr._with_literals(gr.frame_of(spark, rules))
    tried = gr.rule_candidates(df, known).count()
    assert tried <= 30 * 1000  # of 3,000,000 pairs
    with pytest.raises(ValueError, match="no string"):
        gr.label_by_rules(df, "text", gr.frame_of(spark, [(i, 0, "a.", "x") for i in range(gr.MOST_OPEN + 1)]))


def test_rules_made_of_the_same_grams_meet_their_own_texts_only(spark):
    numbers = [format(i, "010b") for i in range(512)]
    df = spark.createDataFrame([(f"/f{n}.pdf",) for n in numbers], "text string")
    known = gr._with_literals(gr.frame_of(spark, [(i, i, f"/f{n}\\.pdf$", "x") for i, n in enumerate(numbers)]))
    assert gr.rule_candidates(df, known).count() == 512  # of 262,144 pairs; each gram is in many texts
    long = gr.frame_of(spark, [(0, 0, "a" * 40 + "b", "b"), (1, 1, "a" * 40, "a")])  # longer than a key
    texts = spark.createDataFrame([("a" * 40 + "b",), ("a" * 45,), ("a" * 39,)], "text string")
    assert sorted(r.label for r in gr.label_by_rules(texts, "text", long, "none").collect()) == ["a", "b", "none"]


def test_search_looks_at_the_rows_that_hold_a_pattern_only(spark, tmp_path):
    names = [(i, "F" + format(i, "010b")) for i in range(512)]
    df = spark.createDataFrame([*names, (5, "F" + format(5, "010b"))], "id bigint, name string")  # a repeated row
    gr.write_grams(df, str(tmp_path / "grams"))
    patterns_ = spark.createDataFrame(names, "pattern_id bigint, pattern string")
    found = gr.search_grams(spark, str(tmp_path / "grams"), df, patterns_)
    assert sorted((r.pattern_id, r.id) for r in found.collect()) == sorted([(i, i) for i in range(512)] + [(5, 5)])
    ids = spark.read.parquet(str(tmp_path / "grams/ids"))
    keyed = gr._keyed(patterns_, "pattern")
    assert gr._met(ids, keyed, "id", "pattern_id", gr.HOT_ROWS).count() == 513  # of 262,656 pairs


def test_search_through_stored_grams(spark, tmp_path):
    rng = random.Random(5)
    names = ["".join(rng.choice("abAB") for _ in range(rng.randint(0, 12))) for _ in range(200)] + [None]
    df = spark.createDataFrame(list(enumerate(names)), "id bigint, name string")
    path = str(tmp_path / "grams")
    gr.write_grams(df, path)
    patterns_ = [(i, "".join(rng.choice("abAB") for _ in range(rng.randint(1, 6)))) for i in range(40)] + [(90, "zzz")]
    asked = spark.createDataFrame(patterns_, "pattern_id bigint, pattern string")
    got = {(r.pattern_id, r.id) for r in gr.search_grams(spark, path, df, asked, hot_rows=50).collect()}
    assert got == {(p, i) for p, s in patterns_ for i, n in enumerate(names) if n is not None and s.lower() in n.lower()}
