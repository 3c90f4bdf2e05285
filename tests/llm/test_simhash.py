"""SimHash: fingerprints and components against brute force over all pairs."""

import random

import xxhash
from pyspark.sql import functions as F

from vocalmill.llm import simhash as S
from vocalmill.llm.components import components


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    pieces = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in pieces]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_components(prints):
    ids = list(range(len(prints)))
    parent = dict(zip(ids, ids))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids[:a]:
            if bin(prints[a] ^ prints[b]).count("1") <= 2:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return [root(i) for i in ids]


def texts():
    rng = random.Random(3)
    base = [" ".join(rng.choice(["Uno", "dos", "trés", "four", "FIVE", "six\t", "sept"]) for _ in range(rng.randint(0, 80))) for _ in range(25)]
    out = base + base[:8] + [b + " tail" for b in base[5:15]] + [None, "", "  \n", "one", "one two", "A B c"]
    for b in base[15:20]:
        words = b.split()
        out.append(" ".join(words[:-1] + ["dos"]) if words else b)
    return out


def test_equals_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("key", F.lit(1))
    got = {r.doc_id: r for r in S.near_duplicates(df).collect()}
    prints = [slow_fingerprint(t) for t in rows]
    want = slow_components(prints)
    assert [got[i].fingerprint for i in range(len(rows))] == [f"{p:016x}" for p in prints]
    assert [got[i].component_id for i in range(len(rows))] == want
    kept = S.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_full_buckets_lose_no_link(spark):
    rng = random.Random(7)
    prints = set()
    for _ in range(12):
        seed = rng.getrandbits(64)
        prints |= {seed, *(seed ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(12)), *(seed ^ (7 << rng.randrange(60)) for _ in range(4))}
    prints = sorted(prints)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    want = slow_components(prints)
    for bucket in (2, 5, 64):
        roots = {r.node: r.root for r in components(S.links(df, bucket)).collect()}
        groups = {}
        for p, w in zip(prints, want):
            signed = p - (1 << 64) if p >> 63 else p
            groups.setdefault(w, set()).add(roots.get(signed, signed))
        assert all(len(g) == 1 for g in groups.values())
        assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components_of_a_long_chain(spark):
    n = 60
    order = list(range(n))
    random.Random(1).shuffle(order)
    links = spark.createDataFrame([*zip(order, order[1:]), (5, 5), (None, 3), (100, 101)], "a long, b long")
    roots = {r.node: r.root for r in components(links).collect()}
    assert roots == {**{i: 0 for i in range(n)}, 100: 100, 101: 100}


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(4, "a b c d"), (4, "a b c d"), (2, "other words here"), (None, "a b c d"), (None, "alone in the world it seems")], "doc_id long, text string")
    rows = S.near_duplicates(df).collect()
    assert len(rows) == 5 and sorted(str(r.component_id) for r in rows) == ["2", "4", "4", "4", "None"]
    assert sorted(str(r.doc_id) for r in S.keep_one(df).collect()) == ["2", "4", "None"]
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeated_ids_with_different_texts_lose_none(spark):
    rng = random.Random(9)
    words = ["uno", "dos", "four", "six", "sept", "ocho", "neun", "ten"]
    a, b, c = (" ".join(rng.choice(words) for _ in range(60)) for _ in range(3))
    # 7 names a's and c's components; its other text b belongs to the component that 2 names
    rows = [(7, a, "x"), (7, b, "x"), (7, c, "x"), (7, c, "x"), (9, a, "x"), (2, b, "x"), (None, c, "x"), (None, "alone", "x")]
    assert len({slow_fingerprint(t) for t in (a, b, c)}) == 3
    for _ in range(3):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
        got = S.keep_one(df)
        assert got.columns == df.columns
        assert sorted(((r.doc_id or 0), r.text) for r in got.collect()) == sorted([(0, "alone"), (2, b), (7, a), (7, c)])
