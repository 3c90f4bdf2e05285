"""Order MinHash: selection against a plain version, edited texts, order of documents, edge cases."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from vocalmill.llm import _hashing as H
from vocalmill.llm import orderminhash as O


def slow_signature(text):
    hashes = [int(x) for x in O.kmers(text)]
    if not hashes:
        return [0] * O.SKETCHES
    seen, base = {}, []
    for h in hashes:
        n = seen.get(h, 0)
        seen[h] = n + 1
        base.append(int(H.mix(np.array([(h + n * 0xC2B2AE3D27D4EB4F) % 2**64], np.uint64))[0]) >> 32)
    out = []
    for odd in O._ODD:
        order = sorted(range(len(base)), key=lambda i: (base[i] * int(odd) % 2**32, i))[:2]
        low, high = min(order), max(order)
        tail = int(H.mix(np.array([hashes[high]], np.uint64))[0]) if len(hashes) > 1 else 0
        out.append(int(H.mix(np.array([(hashes[low] * 3 + tail) % 2**64], np.uint64))[0]) >> 48)
    return out


def test_signature_equals_plain_version():
    rng = random.Random(2)
    for n in (0, 1, 4, 5, 6, 7, 40, 400):
        text = "".join(rng.choice("abé ") for _ in range(n))
        assert O.signature(text).tolist() == slow_signature(text)


def test_contract(spark):
    rng = random.Random(4)
    docs = [(i * 3 % 101, "".join(rng.choice("abcdé 漢") for _ in range(rng.randint(0, 90)))) for i in range(40)]
    docs += [(200, None), (201, ""), (202, "same text here, all of it"), (203, "same text here, all of it"), (204, "x" * 3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("range", F.lit("clash")).withColumn("n_chars", F.lit(0)).repartition(5)
    got = {r.doc_id: r for r in O.fingerprints(df).collect()}
    ordered = sorted((i, t or "") for i, t in docs)
    assert len(got) == len(docs)
    for k, (i, text) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        new = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        r, a, b, c = got[i], O.signature(text), O.signature(new), O.signature(following)
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert r.fingerprint == a.tobytes().hex() and r.edited_fingerprint == b.tobytes().hex()
        assert r.near_edited == O.likeness(a, b) and r.near_next == O.likeness(a, c)
    assert got[202].fingerprint == got[203].fingerprint and got[202].near_next == 1.0


def test_order_matters_and_edits_cost_little():
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(200)]
    text = " ".join(words)
    a = O.signature(text)
    assert O.likeness(a, O.signature(text.replace(words[50], "edited"))) > 0.7
    assert O.likeness(a, O.signature(" ".join(words[::-1]))) < 0.6
    assert O.likeness(a, O.signature(" ".join(reversed(text)))) < 0.2


def test_one_row_repeated_rows_and_empty_table(spark):
    one = O.fingerprints(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and one.near_next == 1.0
    rows = O.fingerprints(spark.createDataFrame([(1, "abcd"), (1, "abcd"), (None, "zz"), (2, "qqqq")], "doc_id long, text string")).collect()
    assert len(rows) == 4
    assert O.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
