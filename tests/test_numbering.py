import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgrid.operators import numbering
from quillgrid.operators.numbering import slice_rows, with_position
from quillgrid.operators.skew import hot_keys, salted_join


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows in one group, a NULL group, and small ones; spread over many partitions."""
    rng = random.Random(2)
    rows = [("hot", i) for i in range(400)] + [(None, i) for i in range(50)] + [(f"k{i % 90}", i) for i in range(750)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, v bigint").repartition(7).persist()


@pytest.fixture
def many_partitions(spark, monkeypatch):
    """Segments for groups of any size, and many of them."""
    monkeypatch.setattr(numbering, "SHORT_GROUP", -1)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("descending", [False, True])
def test_positions_equal_a_window(spark, skewed, many_partitions, descending):
    order = [(F.col("v"), descending)]
    got = with_position(skewed, ["k"], order, total="n", neighbour="v")
    w = Window.partitionBy("k").orderBy(F.col("v").desc() if descending else F.col("v").asc())
    want = skewed.select(
        "k", "v", F.row_number().over(w).cast("bigint"), F.count("*").over(Window.partitionBy("k")), F.lag("v").over(w), F.lead("v").over(w)
    )
    assert sorted(map(str, got.collect())) == sorted(map(str, want.toDF(*got.columns).collect()))


def test_a_large_group_spans_segments(spark, skewed, many_partitions):
    spread = skewed.repartitionByRange("k", "v").filter("k = 'hot'").select(F.spark_partition_id()).distinct()
    assert spread.count() > 2


def test_rows_are_shuffled_once_and_not_checkpointed(spark, skewed, many_partitions):
    wide = skewed.withColumn("payload", F.concat("k", "v"))
    plan = with_position(wide, ["k"], [F.col("v")], total="n")._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange " in line and "Broadcast" not in line]
    assert sum("shufflepartitionidpassthrough" in line for line in exchanges) == 1
    # The rows are no checkpoint: only the cut points were computed before.
    assert "payload" in plan and all("payload" not in line for line in plan.splitlines() if "ExistingRDD" in line)


def test_mixed_directions_and_nulls(spark, many_partitions):
    rng = random.Random(5)
    rows = [(rng.choice([None, "a", "b"]), rng.choice([None, 1.5, -2.0, float("nan")]), rng.choice([None, "x", "é", "Z"]), i) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, d double, s string, id bigint").repartition(5)
    for down in ((True, False), (False, True), (True, True)):
        got = with_position(df, ["k"], [(F.col("d"), down[0]), (F.col("s"), down[1]), F.col("id")], neighbour="s")
        order = [F.desc(c) if x else F.asc(c) for c, x in zip("ds", down)]
        w = Window.partitionBy("k").orderBy(*order, "id")
        want = df.select("*", F.row_number().over(w).cast("bigint"), F.lag("s").over(w), F.lead("s").over(w))
        assert sorted(map(str, got.collect())) == sorted(map(str, want.toDF(*got.columns).collect()))


def test_empty_table(spark, many_partitions):
    empty = spark.createDataFrame([], "k string, v bigint")
    assert with_position(empty, ["k"], [F.col("v")], total="n", neighbour="v").collect() == []


def test_whole_table(spark, skewed, many_partitions):
    got = with_position(skewed.select("v").distinct(), [], [F.col("v")]).collect()
    assert all(r.position == r.v + 1 for r in got)


def test_short_slices_cut_before_the_shuffle(skewed):
    plan = slice_rows(skewed, ["k"], [F.col("v")], 5, 8)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 4  # parts of groups first, each before and after its shuffle


@pytest.mark.parametrize("keys", [["k"], []])
def test_short_groups_need_no_segments(skewed, monkeypatch, keys):
    order = [(F.col("v"), True), F.col("k")]
    short = with_position(skewed, keys, order, total="n", neighbour="v")
    assert "shufflepartitionidpassthrough" not in short._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(numbering, "SHORT_GROUP", -1)
    long = with_position(skewed, keys, order, total="n", neighbour="v")
    assert short.schema == long.schema
    # Rows that tie are alike, so all numbers are equal but theirs among themselves.
    assert sorted(r.position for r in short.collect()) == sorted(r.position for r in long.collect())
    assert sorted((str(r.k), r.v, r.n) for r in short.collect()) == sorted((str(r.k), r.v, r.n) for r in long.collect())


def test_slices(spark, skewed):
    def sizes(df):
        return {r.k: r["count"] for r in df.groupBy("k").count().collect()}

    order = [F.col("v")]
    assert sizes(slice_rows(skewed, ["k"], order, 5, 8))["hot"] == 3
    assert sizes(slice_rows(skewed, ["k"], order, 390))["hot"] == 10
    assert sizes(slice_rows(skewed, ["k"], order, -4, 2))[None] == 2
    assert slice_rows(skewed, ["k"], order, 3, 3).count() == 0
    assert sizes(slice_rows(skewed, ["k"], order, 300, 5000)) == sizes(slice_rows(skewed, ["k"], order, 300))
    assert slice_rows(skewed.filter("k = 'hot'"), [], order, 10, 5000).count() == 390
    assert [r.v for r in slice_rows(skewed.filter("k = 'hot'"), [], order, 2, 5).collect()] == [2, 3, 4]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_join(spark, skewed, how):
    left = skewed.filter("k is not null")
    right = spark.createDataFrame([("hot", "a"), ("hot", "b"), ("k1", "c"), ("zz", "d")], "k string, w string")
    got = salted_join(left, right, ["k"], spread=[F.col("v")], how=how, hot_rows=50)
    want = left.join(right, ["k"], how)
    assert sorted(map(str, got.select("k", "v", "w").collect())) == sorted(map(str, want.select("k", "v", "w").collect()))


@pytest.mark.parametrize("right_hot", [5, 40])
def test_both_sides_salted(spark, skewed, right_hot):
    left = skewed.filter("k is not null")
    right = spark.range(right_hot).selectExpr("'hot' k", "id w").unionByName(spark.range(3).selectExpr("'k1' k", "id w"))
    got = salted_join(left, right, ["k"], spread=[F.col("v")], spread_right=[F.col("w")], hot_rows=20)
    want = left.join(right, ["k"])
    assert sorted(map(str, got.select("k", "v", "w").collect())) == sorted(map(str, want.select("k", "v", "w").collect()))
    with pytest.raises(ValueError):
        salted_join(left, right, ["k"], spread=[F.col("v")], spread_right=[F.col("w")], how="left")


def test_hot_keys_are_few(spark, skewed):
    hot = hot_keys(skewed.filter("k is not null"), ["k"], 50)
    assert [tuple(r) for r in hot.collect()] == [("hot", 8)]
    assert hot_keys(skewed.filter("k <> 'hot'"), ["k"], 50) is None
