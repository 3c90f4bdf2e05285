"""The conversation trie against a plain dictionary of prefixes, in one shard and in many, with whole and cut splitters."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from vocalmill.llm import convtrie as T

FOLDER = "/root/testdata/sf0.001"


def brute(rows):
    def order(r):
        role, text = r[2] or "", r[3] or ""
        return (r[1] is not None, r[1] or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest())

    own = {}
    for r in sorted((r for r in rows if r[0] is not None), key=order):
        own.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    nodes = {}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        whole[c] = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(whole[c]) + 1):
            nodes.setdefault(whole[c][:d], []).append(c)
    children = {p: 0 for p in nodes}
    for p in nodes:
        if p:
            children[p[:-1]] += 1
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(members) - 1) * (len(p[-1][1].encode()) if p else 0)
    out = []
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(whole[c]) == len(p))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def cases(seed=1, n=120):
    rng = random.Random(seed)
    texts = ["yes", "no", "é", "", None, "well then", "x" * 3000]
    rows = []
    for c in [*range(n), *range(300, 330, 3), -7, -6, -3, 10**12, 10**12 + 1]:
        for k in range(rng.choice([1, 2, 3, 9, 12])):
            rows.append((c, rng.choice([k, k, k, None, 3]), rng.choice(["user", "assistant", None]), rng.choice(texts)))
    for c in range(1000, 1200):  # one group of copies
        rows += [(c, k, "user", f"same {k}") for k in range(10)]
    rows += [(2000, k, "user", f"long {k % 3}") for k in range(400)]  # one long conversation
    rows += [(2001, k, "user", f"long {k % 3}") for k in range(399)]
    rows += [rows[5], rows[5], (None, 1, "user", "lost"), (None, None, None, None)]
    rng.shuffle(rows)
    return rows


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("depth", F.lit("clash")).withColumn("c", F.lit(0))
    found = T.trie(df, **options)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, found.collect()), key=repr)


def small(rows):
    return [r for r in rows if r[0] is None or r[0] < 2000 or r[0] > 3000]


def test_equals_brute_force_in_many_shards(spark, monkeypatch):
    monkeypatch.setattr(T, "CHUNK_IDS", 7)
    monkeypatch.setattr(T, "CHUNK_TURNS", 3)
    rows = small(cases())
    want = brute(rows)
    assert run(spark, rows) == want
    assert run(spark, rows, parts=17) == want
    assert run(spark, rows, parts=9, sample=20, skeleton_turns=300) == want  # splitters are cut to one turn


def test_a_long_conversation_and_one_shard(spark):
    rows = [r for r in cases() if r[0] is not None and r[0] >= 1190]
    assert run(spark, rows, parts=1) == run(spark, rows, parts=6)
    found = run(spark, rows, parts=6)
    assert max(r[1] for r in found) == 400 and sum(r[3] for r in found if r[1] == 399) >= 1
    assert found == brute(rows)


def test_copies_are_split_over_shards_and_the_skeleton_is_small(spark):
    rows = [(c, k, "user", f"same {k}") for c in range(0, 5000, 5) for k in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    paths = T.rebuilt(df).cache()
    keys = T.splitters(paths, 8)
    assert len(keys) == 7 and len({p for p, _ in keys}) <= 5
    shards = [sum(k <= (bytes(r.path), r.c) for k in keys) for r in paths.collect()]
    assert max(map(shards.count, range(8))) < 3 * 1000 / 8


def test_empty_tables_and_ids(spark):
    assert run(spark, []) == [] and run(spark, [(None, 1, "user", "x")]) == []
    base = next(c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 1)
    empty = hashlib.sha256(str(base).encode()).hexdigest()
    assert run(spark, [(base, 1, "user", "taken over")]) == [(base, 0, None, 1, 0, 1, 0, empty)]  # the group's first is absent


def test_equals_sql(spark):
    rows = [r for r in small(cases(3, 60)) if r[0] is None or r[0] < 1100]
    engine = duckdb.connect()
    engine.execute("CREATE TABLE conversations (conv_id BIGINT, turn INT, role VARCHAR, text VARCHAR)")
    engine.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    cursor = engine.execute(T.ORACLE["op11_conversation_trie"])
    assert [c[0] for c in cursor.description][:2] == ["conv_id", "depth"]
    assert sorted(map(tuple, cursor.fetchall()), key=repr) == brute(rows) == run(spark, rows, parts=5)


@pytest.mark.parametrize("folder", [FOLDER])
def test_query(spark, folder):
    engine = duckdb.connect()
    engine.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{folder}/conversations.parquet')")
    want = sorted(map(tuple, engine.execute(T.ORACLE["op11_conversation_trie"]).fetchall()), key=repr)
    assert sorted(map(tuple, T.op11_conversation_trie(spark, folder).collect()), key=repr) == want
