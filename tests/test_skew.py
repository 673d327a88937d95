"""Joins with hot keys give what the plain join gives."""

import pytest
from pyspark.sql import functions as F

from muster.operators import skew
from muster.operators.skew import hot_groups, is_broadcast, join_per_key, none_hot


@pytest.fixture(autouse=True)
def no_broadcast(spark):
    """Small tables go the way of large ones."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


@pytest.fixture(scope="module")
def sides(spark):
    key = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 50)
    left = spark.range(2000).select(key.alias("k"), F.lit("x").alias("j"), "id")
    right = spark.range(0, 40).where("id <> 5").select(F.col("id").alias("k"), F.lit("x").alias("j"), (F.col("id") * 10).alias("v"))
    return left.cache(), right.cache()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("hot_rows", [10, 100, 10_000])
def test_equals_plain_join(sides, how, hot_rows):
    left, right = sides
    got = join_per_key(left, right, ["k", "j"], how, hot_rows=hot_rows)
    want = left.join(right, ["k", "j"], how)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_wider_hot_list_is_fine(spark, sides):
    left, right = sides
    everything = spark.range(100).select(F.col("id").alias("k"), F.lit(70).alias("_rows"))
    got = join_per_key(left.drop("j"), right.drop("j"), ["k"], "left", hot=everything, hot_rows=10)
    assert got.count() == left.count()


def test_hot_list_is_bounded(sides):
    assert hot_groups(sides[0], ["k"], hot_rows=1, most=3).count() == 3


def test_the_sketch_names_the_hot_keys(spark, sides):
    """Every key with enough rows, by its hash; keys of a long tail do not come in its place."""
    rows = spark.range(200_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.lit("x").alias("j"))
    found = {r["_key"]: r["_rows"] for r in hot_groups(rows.repartition(40), ["k", "j"], hot_rows=1000).collect()}
    key = rows.where("k = 7").select(F.xxhash64("k", "j")).first()[0]
    assert set(found) == {key} and 66_000 < found[key] < 68_000
    assert none_hot(hot_groups(rows.where("k <> 7"), ["k"], hot_rows=1000))
    assert none_hot(hot_groups(rows.limit(0), ["k"], hot_rows=1))


def test_keys_of_other_types_meet(spark, sides):
    left, right = sides
    narrow = right.withColumn("k", F.col("k").cast("int"))
    got = join_per_key(left, narrow, ["k", "j"], hot_rows=10)
    assert sorted(map(str, got.select("id", "v").collect())) == sorted(map(str, left.join(narrow, ["k", "j"]).select("id", "v").collect()))


def test_rows_that_differ_in_a_map_only_are_dealt_out(spark):
    left = spark.range(500).select(F.lit(1).alias("k"), F.create_map(F.lit("a"), "id").alias("m"))
    right = spark.createDataFrame([(1, "x")], "k int, v string")
    plan = join_per_key(left, right, ["k"], hot_rows=50)
    assert plan.count() == 500
    from muster.operators.skew import _spread

    assert left.select(_spread(left, 10).alias("s")).distinct().count() == 10


def test_no_job_where_the_other_side_is_small(spark, sides):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 << 20))
    small = spark.range(5).select(F.col("id").alias("k"), F.lit("x").alias("j"), F.lit(2).alias("v"))
    large = spark.range(10**12).select(F.col("id").alias("k"), F.lit("x").alias("j"))
    assert is_broadcast(small) and not is_broadcast(large)
    spark.sparkContext.setJobGroup("planning", "joins")
    joined = join_per_key(large, small, ["k", "j"])
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("planning")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().toString()


def test_tasks_follow_the_size_of_a_table(spark, monkeypatch):
    """A window over a larger table takes more tasks, not larger ones; small tables and those with hot groups stay as they lie."""
    df = spark.range(20_000)
    none, some = skew.hot_groups(df, ["id"]), skew.hot_groups(spark.range(100).select((F.col("id") % 2).alias("id")), ["id"], 3)
    assert skew.dealt(df, ["id"], none) is df
    monkeypatch.setattr(skew, "TASK_BYTES", 1_000)
    assert skew.dealt(df, ["id"], none).rdd.getNumPartitions() == 160
    assert skew.dealt(df.limit(10), ["id"], none).rdd.getNumPartitions() <= 8
    assert skew.dealt(df, ["id"], some) is df
    monkeypatch.setattr(skew, "MANY_TASKS", 50)
    assert skew.dealt(df, ["id"], none).rdd.getNumPartitions() == 50
