"""Ranked search against a plain evaluation of every document, and against its SQL."""

import math
import random
import re

import duckdb
import numpy as np
from pyspark.sql import functions as F

from vocalmill.llm import ranking as R

FOLDER = "/root/testdata/sf0.001"


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, top=50):
    split = [(i, terms_of(t)) for i, t in docs]
    split = [(i, t) for i, t in split if t]
    n_docs, total = len(split), sum(len(t) for _, t in split)
    df = {}
    for _, t in split:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms_of(t))
    out = []
    for item, terms in asked.items():
        found = []
        for i, t in split:
            m = 50 + 50 * len(t) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * t.count(x) // (1000 * t.count(x) + 20 * m)) for x in terms if x in t)
            if s > 0:
                found.append((-s, i is not None, i or 0))
        out += [(item, k + 1, i if known else None, -s) for k, (s, known, i) in enumerate(sorted(found)[:top])]
    return sorted(out, key=repr)


def cases(seed=3, n=300):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["Été", "the", "The", "of", "x-y", "Ünï"]
    weights = [1 / (k + 1) for k in range(len(words))]
    docs = [(rng.randint(0, 10**6), " ".join(rng.choices(words, weights, k=rng.randint(1, 80)))) for _ in range(n)]
    docs += [(7, "w3 w4 w5"), (7, "w3 w4 w5"), (5, "w3 w4 w5"), (None, "w3 w4 w5"), (None, "w59 w58"), (9, None), (10, ""), (11, "... --"), (12, "w1 " * 3000 + "w7"), (-4, "w3 w4 w5")]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for k in range(12)]
    items += [(50, None), (51, ""), (52, "!?"), (53, "nowhere at all"), (3, "w40 w41"), (None, "w9 w10"), (None, "w11"), (60, " ".join(words) + " " + " ".join(f"v{k}" for k in range(100))), (61, "of"), (62, "w3 W3 w4 w5")]
    return docs, items


def run(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("item", F.lit(0))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("clash"))
    found = R.ranked(d.repartition(5), b, **options)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, found.collect()), key=repr)


def test_equals_brute_force(spark, monkeypatch):
    docs, items = cases()
    want = brute(docs, items)
    assert run(spark, docs, items) == want
    monkeypatch.setattr(R, "SLICE_DOCS", 11)
    monkeypatch.setattr(R, "FIRST", 2)
    monkeypatch.setattr(R, "MERGED", 3)
    assert run(spark, docs, items, block_terms=60) == want  # several blocks, many slices, merged in two steps
    assert run(spark, docs, items, top=3) == brute(docs, items, 3)


def test_equals_sql(spark):
    docs, items = cases(8, 120)
    engine = duckdb.connect()
    engine.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    engine.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    engine.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    engine.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    assert sorted(map(tuple, engine.execute(R.ORACLE["op12_ranked_search"]).fetchall()), key=repr) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = cases()
    assert run(spark, [], items) == [] and run(spark, docs, []) == [] and run(spark, [(1, None)], items) == []


def test_groups_stop_early():
    rng = np.random.default_rng(5)
    n, k = 4000, 30
    chances = 1.0 / np.arange(1, k + 1) ** 2
    owners, terms = np.repeat(np.arange(n), 6), rng.choice(k, 6 * n, p=chances / chances.sum())
    weights = np.array([R.weight(n, len(set(owners[terms == t]))) for t in range(k)])
    row = R.slice_row(list(range(n)), [6] * n, terms.astype(np.int32), owners, n, 6 * n).to_pylist()[0]
    part, best = R.Slice(row, weights, n, 6 * n), R.Best(50)
    evaluated = part.search(list(range(k)), best)
    every = part.scores(list(range(k)), np.arange(n).astype(np.uint16))
    assert best.scores.tolist() == sorted(every.tolist(), reverse=True)[:50] and evaluated < n / 4


def test_long_documents_keep_their_counts():
    n = np.array([1, 10**7], np.int64)
    assert R.length_norms(n, 10**13, 3 * 10**13).tolist() == [50 + 50 * 10**13 // (3 * 10**13), 50 + 50 * 10**20 // (3 * 10**13)]
    row = R.slice_row([4], [300], np.zeros(300, np.int32), np.zeros(300, np.int64), 1, 300).to_pylist()[0]
    assert R.Slice(row, np.array([10]), 1, 300).shares.tolist() == [10 * (300 * 10**9 // (300_000 + 20 * 100))]


def test_query(spark):
    engine = duckdb.connect()
    for name in ("documents", "benchmark"):
        engine.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{FOLDER}/{name}.parquet')")
    want = sorted(map(tuple, engine.execute(R.ORACLE["op12_ranked_search"]).fetchall()), key=repr)
    assert want and sorted(map(tuple, R.op12_ranked_search(spark, FOLDER).collect()), key=repr) == want
