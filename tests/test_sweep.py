"""Overlaps from merge-sort trees equal those of the join, also where all spans meet all items."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from vocalmill.operators import intervals, sweep


def plain(spans, a, b):
    met = [(min(b, e) - max(a, s), -i, k) for k, (s, e, i, _) in enumerate(spans) if min(b, e) - max(a, s) > 0]
    who = {spans[k][3] for _, _, k in met if spans[k][3] >= 0}
    return (max(met)[2], max(met)[0], len(who)) if met else (-1, 0, 0)


@pytest.mark.parametrize("seed", range(12))
def test_every_kind_of_overlap(seed):
    rng = random.Random(seed)
    width, n = rng.choice([10, 60, 1000]), rng.choice([0, 1, 2, 7, 60])
    spans = [(s, s + rng.randint(1, rng.choice([3, width])), i, rng.randint(-1, 4)) for i in rng.sample(range(n * 2), n) for s in [rng.randint(0, width)]]
    items = [(a, a + rng.choice([0, 1, 2, rng.randint(0, width)])) for a in (rng.randint(-2, width + 2) for _ in range(150))]
    s, e, i, w = (np.array(c, np.int64) for c in (zip(*spans, strict=True) if spans else ([], [], [], [])))
    a, b = (np.array(c, np.int64) for c in zip(*items, strict=True))
    found, most = sweep.best(s, e, i, a, b)
    number = sweep.speakers(s, e, w, a, b)
    assert list(zip(found.tolist(), most.tolist(), number.tolist(), strict=True)) == [plain(spans, x, y) for x, y in items]


def tables(spark, seed, n=300, length=4_000_000):
    rng = random.Random(seed)
    keys = ["r", "r", "r", "s", "t", None]
    spans = [(rng.choice(keys), k, s, s + rng.choice([0, 500, 20_000, 900_000, 3_000_000]), rng.choice(["A", "B", " A ", "", None, "C"])) for k in range(n) for s in [rng.randint(0, length)]]
    items = [(rng.choice([*keys, "none"]), k, s, s + rng.choice([0, 1, 400, 3_000, 700_000, 2_500_000]), "x") for k in range(n) for s in [rng.randint(0, length)]]
    return spark.createDataFrame(items, "interview_id string, idx int, start_ms bigint, end_ms bigint, extra string"), spark.createDataFrame(spans, "interview_id string, idx int, start_ms bigint, end_ms bigint, speaker string")


@pytest.mark.parametrize("cell", [1000, 600_000])
def test_best_overlaps_equal_the_join(spark, cell):
    items, spans = tables(spark, 3)
    items = items.where("end_ms > start_ms")  # the join leaves out empty items inside a span, even with ``outer``
    for outer in (False, True):
        want = intervals.best_overlap(items, spans, ["idx", "extra"], bin_ms=cell * 4, outer=outer)
        got = sweep.best_overlap(items, spans, ["idx", "extra"], cell_ms=cell, outer=outer)
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_chunks_keep_cells_whole(spark, monkeypatch):
    items, spans = tables(spark, 5, 120)
    want = sorted(map(tuple, sweep.best_overlap(items, spans, ["idx"], outer=True).collect()), key=repr)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "7")
    try:
        monkeypatch.setattr(sweep, "CHUNK", 10)
        assert sorted(map(tuple, sweep.best_overlap(items, spans, ["idx"], outer=True).collect()), key=repr) == want
    finally:
        spark.conf.set(size, before)


def test_points(spark):
    rng = random.Random(4)
    turns = spark.createDataFrame([("r", k, s, s + rng.choice([0, 100, 50_000, 2_000_000])) for k in range(80) for s in [rng.randint(0, 2_000_000)]], "interview_id string, turn bigint, start_ms bigint, end_ms bigint")
    points = spark.createDataFrame([(rng.choice("rq"), t, t % 7) for t in rng.sample(range(2_500_000), 200)], "interview_id string, at_ms bigint, note int")
    assert sorted(map(tuple, sweep.stab(points, turns).collect()), key=repr) == sorted(map(tuple, intervals.stab(points, turns).collect()), key=repr)


def test_a_dense_cell_takes_seconds(spark):
    n = 100_000
    spans = spark.range(n).selectExpr("'r' AS interview_id", "CAST(id AS int) AS idx", "id % 1000 AS start_ms", "590000 - id % 777 AS end_ms", "concat('S', id % 50) AS speaker")
    items = spark.range(n).selectExpr("'r' AS interview_id", "id AS idx", "1000 + id % 500000 AS start_ms", "1000 + id % 500000 + id % 90 AS end_ms")
    start = time.perf_counter()
    found = sweep.best_overlap(items, spans, ["idx"]).agg(F.count("*"), F.min("n_speakers"), F.max("n_speakers")).first()
    assert tuple(found) == (n - -(-n // 90), 50, 50) and time.perf_counter() - start < 60


def test_empty(spark):
    items, spans = tables(spark, 6, 20)
    assert sweep.best_overlap(items.limit(0), spans, ["idx"]).count() == 0
    assert sweep.best_overlap(items, spans.limit(0), ["idx"]).count() == 0 and sweep.best_overlap(items, spans.limit(0), ["idx"], outer=True).count() == 20


def test_memory_of_a_tree_is_in_proportion_to_its_points():
    tracemalloc = pytest.importorskip("tracemalloc")
    n = 1 << 17
    rng = np.random.default_rng(1)
    start, idx = rng.integers(0, 10**6, n), np.arange(n)
    tracemalloc.start()
    sweep.best(start, start + rng.integers(1, 10**5, n), idx, start, start + 50)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * 8 * n  # 18 levels of two numbers a point, of two trees, were more than this


def test_items_of_two_cells_need_no_cell_of_the_whole_recording(spark):
    spans = spark.range(2000).selectExpr("'r' AS interview_id", "id AS idx", "id * 600000 AS start_ms", "id * 600000 + 900000 AS end_ms", "'A' AS speaker")
    items = spans.selectExpr("interview_id", "idx", "start_ms", "end_ms")
    for look in (False, True):
        filed = sweep._filed(items, spans, ["interview_id"], "interview_id", sweep.CELL_MS, None, look)
        cells = filed.groupBy("__key", "__level", "__cell").agg(F.count_if(F.col("__what") == 1).alias("items"), F.count("*").alias("rows"))
        assert cells.where("items > 0").agg(F.max("rows")).first()[0] < 40
        assert (filed.where("__what = 0").groupBy("__level").count().count() == 1) == look


def test_spans_of_cells_without_items_are_not_held(spark, monkeypatch):
    items, spans = tables(spark, 8, 200)
    items = items.where("interview_id = 's'")
    want = sorted(map(tuple, sweep.best_overlap(items, spans, ["idx"], outer=True).collect()), key=repr)
    monkeypatch.setattr(sweep, "CHUNK", 5)
    for look in (False, True):
        assert sorted(map(tuple, sweep.best_overlap(items, spans, ["idx"], outer=True, look=look).collect()), key=repr) == want
