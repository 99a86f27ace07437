"""The helpers that split hot keys give exactly what a plain window would."""

from __future__ import annotations

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from defectlake import scale

from .conftest import rows


def _skewed(spark, n=3000):
    rng = random.Random(7)
    data = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(20)}", i, rng.randrange(-9, 9)) for i in range(n)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "k STRING, o BIGINT, v BIGINT").repartition(7)


def test_ordered_fold_equals_window(spark):
    df = _skewed(spark)
    w = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumns({"s": F.sum("v").over(w), "n": F.count("v").over(w)})
    got = scale.ordered_fold(df, ["k"], [F.asc("o")], {"s": F.col("v"), "n": F.lit(1).cast("bigint")})
    assert rows(got, "k", "o", "s", "n") == rows(want, "k", "o", "s", "n")


def test_ordered_position_descending_and_null_keys(spark):
    df = _skewed(spark, 400).withColumn("k", F.when(F.col("k") != "k3", F.col("k")))
    w = Window.partitionBy("k").orderBy(F.desc("v"), F.asc("o"))
    want = df.withColumn("p", F.row_number().over(w).cast("bigint"))
    got = scale.ordered_position(df, ["k"], [F.desc("v"), F.asc("o")], "p")
    assert rows(got, "k", "o", "p") == rows(want, "k", "o", "p")


def test_top_n_equals_window(spark):
    df = _skewed(spark)
    w = Window.partitionBy("k").orderBy(F.desc("v"), F.asc("o"))
    want = df.withColumn("rank", F.row_number().over(w).cast("bigint")).where("rank <= 25")
    got = scale.top_n(df, ["k"], [F.desc("v"), F.asc("o")], 25, salt=["o"])
    assert rows(got, "k", "o", "rank") == rows(want, "k", "o", "rank")


def test_salted_lookup_keeps_every_row(spark):
    df = _skewed(spark)
    side = df.groupBy("k").agg(F.count("o").alias("c")).where("k != 'k1'")
    for how in ("left", "inner"):
        got = scale.salted_lookup(df, side, ["k"], salt=["o"], how=how)
        assert rows(got, "k", "o", "c") == rows(df.join(side, "k", how), "k", "o", "c")


def test_skewed_lookup_salts_only_heavy_keys(spark, monkeypatch):
    df = _skewed(spark)
    side = df.groupBy("k").agg(F.count("o").alias("c")).where("k != 'k1'")
    monkeypatch.setattr(scale, "HEAVY_ROWS", 1000)
    assert rows(scale.heavy_keys(df, ["k"])) == [("hot",)]
    for how in ("left", "inner"):
        want = rows(df.join(side, "k", how), "k", "o", "c")
        assert rows(scale.skewed_lookup(df, side, ["k"], ["o"], how), "k", "o", "c") == want
    monkeypatch.setattr(scale, "HEAVY_ROWS", 10**9)
    assert rows(scale.skewed_lookup(df, side, ["k"], ["o"], "left"), "k", "o", "c") == rows(
        df.join(side, "k", "left"), "k", "o", "c"
    )


def test_first_by_folds_before_the_shuffle(spark):
    df = _skewed(spark)
    got = scale.first_by(df, ["k"], F.struct(-F.col("v"), F.col("o")))
    w = Window.partitionBy("k").orderBy(F.desc("v"), F.asc("o"))
    want = df.withColumn("r", F.row_number().over(w)).where("r = 1")
    assert rows(got, "k", "o", "v") == rows(want, "k", "o", "v")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan


def test_shared_dir_follows_the_session(spark, tmp_path):
    assert scale.shared_dir(spark) == scale.shared_dir(spark)
    other = spark.newSession()
    assert scale.scratch_path(other, "x") != scale.scratch_path(other, "x")


def test_counted_rows_are_spread_over_more_tasks_than_cores(spark):
    few, many = (scale.spread(spark.range(10), n).rdd.getNumPartitions() for n in (10, 40 * scale.SPREAD_ROWS))
    assert few == spark.sparkContext.defaultParallelism and many == 40
