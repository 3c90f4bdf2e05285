"""Running values over ranges of rows equal those of windows, with one key over many tasks."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from vocalmill.operators import intervals, progress, scans
from vocalmill.operators.scans import Running


def rows(n, keys, seed=1):
    rng = random.Random(seed)
    return [(rng.choice(keys), k, rng.choice([None, rng.randint(-50, 50)]), rng.choice(["a", "b", "b", None])) for k in range(n)]


@pytest.mark.parametrize(("keys", "parts"), [(["x"], 7), (["x", None, "y"], 5), ([f"k{i}" for i in range(60)], 9), (["x"] * 9 + ["y", "z", None], 11)])
def test_running_values_equal_windows(spark, keys, parts):
    df = spark.createDataFrame(rows(700, keys), "k string, at bigint, v bigint, s string").withColumn("extra", F.lit("kept"))
    wanted = {
        "m": Running("max", "v"), "mb": Running("max", "v", True), "t": Running("sum", "v"), "tb": Running("sum", "v", True), "n": Running("count"), "nb": Running("count", None, True),
        "ls": Running("last", "s"), "lv": Running("last", "v"), "r": Running("runs", "s"),
    }
    w = Window.partitionBy("k").orderBy("at")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    changed = F.when((F.row_number().over(w) > 1) & F.lag("s").over(w).eqNullSafe(F.col("s")), 0).otherwise(1)
    want = df.withColumn("__new", changed).select(
        "*", F.max("v").over(upto).alias("m"), F.max("v").over(before).alias("mb"), F.sum(F.coalesce("v", F.lit(0))).over(upto).alias("t"), F.coalesce(F.sum(F.coalesce("v", F.lit(0))).over(before), F.lit(0)).alias("tb"),
        F.count("*").over(upto).alias("n"), F.count("*").over(before).alias("nb"), F.lag("s").over(w).alias("ls"), F.lag("v").over(w).alias("lv"), F.sum("__new").over(upto).alias("r"),
    ).drop("__new")
    got = scans.running(df, ["k"], ["at"], wanted, parts)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_group_max():
    rng = np.random.default_rng(2)
    values, group = rng.integers(-5, 5, 300), np.sort(rng.integers(0, 20, 300))
    want = np.concatenate([np.maximum.accumulate(values[group == g]) for g in np.unique(group)])
    assert (scans.group_max(values, group) == want).all()


def test_many_small_batches(spark):
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "3")
    try:
        test_running_values_equal_windows(spark, ["x", "x", "y", None], 4)
    finally:
        spark.conf.set(size, before)


def test_a_hot_key_is_dealt_evenly(spark):
    df = spark.range(40_000).selectExpr("if(id % 10 = 0, cast(id AS string), 'hot') AS k", "hash(id) AS at", "id % 100 AS progress")
    found = scans.monotone(df, ["k"], "at", parts=8)
    assert found.count() == 40_000
    sizes = Counter(r[0] for r in df.repartitionByRange(8, "k", "at").select(F.spark_partition_id()).collect())
    assert len(sizes) == 8 and max(sizes.values()) < 2 * sorted(sizes.values())[4]
    want = progress.monotone(df, ["k"], "at")
    assert found.exceptAll(want).count() == 0 == want.exceptAll(found).count()


@pytest.mark.parametrize("parts", [1, 6])
def test_merged_spans_and_ranges_equal_those_of_windows(spark, parts):
    rng = random.Random(9)
    spans = [(rng.choice(["hot"] * 6 + ["b", None]), a, a + rng.randint(0, 900)) for a in (rng.randint(0, 60_000) for _ in range(600))]
    spans += [("long", 0, 10**6), ("long", 5, 10), ("long", 10**6 + 499, 10**6 + 600), ("short", 0, 3), ("hot", 5, 5), ("hot", 5, 5)]
    df = spark.createDataFrame(spans, "k string, start_ms bigint, end_ms bigint")
    for collar, least in ((500, 0), (0, 100), (50, 400)):
        want = sorted(map(tuple, intervals.merge_spans(df, ["k"], collar, least).collect()), key=repr)
        assert sorted(map(tuple, scans.merge_spans(df, ["k"], collar, least, parts).collect()), key=repr) == want
    steps = spark.createDataFrame([(k, n, rng.randint(0, 9)) for k in ("a", "b") for n in range(50)] + [("zero", 0, 0), ("zero", 1, 0)], "k string, n bigint, weight bigint")
    assert sorted(map(tuple, scans.step_ranges(steps, ["k"], "n", parts=parts).collect())) == sorted(map(tuple, progress.ranges(steps, ["k"], "n").collect()))


def test_empty(spark):
    df = spark.createDataFrame([], "k string, start_ms bigint, end_ms bigint")
    assert scans.merge_spans(df, ["k"]).count() == 0 and scans.islands(df, ["k"], ["start_ms"], "end_ms").count() == 0
