"""Wu-Manber search against a plain scan of all windows."""

import random
import re

from pyspark.sql import functions as F

from vocalmill.llm import decontamination as D


def brute(docs, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def words(t):
        return word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    out = {}
    for i, (doc, text) in enumerate(docs):
        w = words(text)
        hit, found = set(), set()
        for item, t in items:
            v = words(t)
            n = min(13, len(v))
            for a in range(len(v) - n + 1 if n else 0):
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == v[a : a + n]:
                        hit |= set(range(b, b + n))
                        if item is not None:
                            found.add(str(item))
        out[i] = (doc, len(w), len(hit), len(found), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def cases():
    rng = random.Random(5)
    vocabulary = ["Éa", "the", "of", "x1", "été", "Zed", "and", "q"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate([30, 13, 14, 5, 40])]
    items += [(10, "solo"), (11, ""), (12, None), (None, "nameless words here"), (4, "of of of of of of of of of of of of of")]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for i in range(30)]
    docs += [(50, "start, " + items[0][1].upper() + "! end"), (51, items[1][1] + " \n " + items[4][1]), (52, None), (53, ""), (54, "SOLO"), (50, "again solo"), (None, "nameless; words? here"), (55, "of " * 200), (56, "--- ...")]
    return docs, items


def run(spark, docs, items, **options):
    d = spark.createDataFrame([(k, i, t) for k, (i, t) in enumerate(docs)], "k long, doc_id long, text string").withColumn("n_words", F.lit("clash")).withColumn("hits", F.lit(0))
    b = spark.createDataFrame(items, "item_id long, text string")
    return {r.k__k: (r.doc_id, r.n_words, r.n_hit, r.n_items, list(r["items"]), r.contaminated) for r in D.contamination(d, b, keep=("k",), **options).collect()}


def test_equals_brute_force(spark):
    docs, items = cases()
    assert run(spark, docs, items) == brute(docs, items)


def test_blocks_of_a_large_benchmark_add_up(spark):
    docs, items = cases()
    assert run(spark, docs, items, block_bytes=60) == brute(docs, items)


def test_empty_tables_and_columns_stay(spark):
    docs, items = cases()
    assert all(r[2] == 0 for r in run(spark, docs, []).values())
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit("mine"))
    kept = D.decontaminate(d, spark.createDataFrame(items, "item_id long, text string"))
    clean = [i for i, r in brute(docs, items).items() if not r[5]]
    assert kept.columns == d.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "", r["items"]) for r in kept.collect()) == sorted((docs[i][0] is None, docs[i][0] or 0, docs[i][1] or "", "mine") for i in clean)
    assert run(spark, [], items) == {}


def test_one_stage_whatever_the_number_of_blocks(spark, capsys):
    docs, items = cases()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    D.contamination(d, b, block_bytes=60).explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1


def test_pieces_have_all_windows_once():
    rng = random.Random(2)
    for n in (0, 1, 5, 12, 13, 14, 40, 99, 100, 101, 113, 350):
        words = [b"%d" % rng.randrange(50) for _ in range(n)]
        whole = [tuple(words[i : i + min(13, n)]) for i in range(n - min(13, n) + 1)] if n else []
        cut = [tuple(p[i : i + min(13, n)]) for p in D.pieces_of(words, 13, 100) for i in range(len(p) - min(13, n) + 1)]
        assert cut == whole


def test_very_long_text_and_item(spark):
    rng = random.Random(9)
    item = " ".join(f"w{rng.randrange(10**6)}" for _ in range(5_000))
    text = "filler words of a story " * 30_000 + item
    r = D.contamination(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")).first()
    assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (155_000, 5_000, 1, False)
