"""Byte-level BPE: equal to tiktoken, exact round trip, edge cases."""

import hashlib

import numpy as np
import tiktoken
from pyspark.sql import functions as F

from vocalmill.llm import bpe

TEXTS = [
    "Hello world, it's   fine.\n\n  next\tline ",
    "éàü ñandú 漢字 🙂🙂 \u0085 x",
    "",
    None,
    "aaaa" * 50,
    "x" * 5000 + " " + "12345 67 " * 300,
    "Hello world, it's   fine.\n\n  next\tline ",
    "<|endoftext|> 's't 're \r\n !!'s",
]


def reference():
    return tiktoken.Encoding("own", pat_str=bpe.default_pattern(), mergeable_ranks=bpe.read_ranks(bpe.default_ranks()), special_tokens={})


def frame(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").withColumn("n_tokens", F.lit("clash")).withColumn("ids", F.lit(1))


def test_equals_tiktoken_and_round_trips(spark):
    known = reference()
    rows = {r.doc_id: r for r in bpe.encode(frame(spark), outputs=("ids", "ids_sha256", "decoded_sha256")).collect()}
    assert len(rows) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        ids = known.encode_ordinary(text or "")
        assert rows[i].ids == ids and rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_decode_and_offsets(spark):
    encoded = bpe.encode(frame(spark))
    texts = {r.doc_id: r.text for r in bpe.decode(encoded).collect()}
    assert [texts[i] for i in range(len(TEXTS))] == [t or "" for t in TEXTS]
    for r in encoded.collect():
        text = TEXTS[r.doc_id] or ""
        spans = list(zip(r.offsets[::2], r.offsets[1::2]))
        assert len(spans) == r.n_tokens
        assert all(0 <= a < b <= len(text) for a, b in spans)
        assert {i for a, b in spans for i in range(a, b)} == set(range(len(text)))


def test_split_characters_and_empty(spark):
    ids = bpe.encode(spark.createDataFrame([(1, "🙂")], "doc_id long, text string"), outputs=("ids",)).first().ids
    halves = spark.createDataFrame([(1, ids[:1]), (2, None)], "doc_id long, ids array<int>")
    rows = {r.doc_id: r for r in bpe.decode(halves).collect()}
    assert rows[2].text == "" and (len(ids) == 1 or "�" in rows[1].text)
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_texts_that_libraries_cut_differently(spark):
    odd = ["\U00018f68랜 a", "x ͸ y", "plain", "a\u0558b \u0558\u0558 1\U00011de0 2", "\U00011de0\U00011de1 \U0003fc40z!"]
    known = reference()
    frame = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    rows = {r.doc_id: r for r in bpe.encode(frame, outputs=("ids", "offsets")).collect()}
    plain = {r.doc_id: list(r.ids) for r in bpe.encode(frame, outputs=("ids",)).collect()}
    for i, text in enumerate(odd):
        assert list(rows[i].ids) == plain[i] == known.encode_ordinary(text)
        assert {k for a, b in zip(rows[i].offsets[::2], rows[i].offsets[1::2]) for k in range(a, b)} == set(range(len(text)))


def test_every_oddly_classed_character_alone_and_between():
    """All characters that the cutting library classes otherwise, and random mixtures with them."""
    import random

    random.seed(5)
    matches, _ = bpe.codec(bpe.default_ranks(), bpe.default_pattern())
    known = reference()
    odd = [chr(c) for c in bpe.alignment()]
    assert odd
    texts = ["".join(random.choices(random.sample(odd, 3) + list("ab 1é!\n"), k=12)) for _ in range(3000)]
    for part in range(0, len(texts), 500):
        some = texts[part : part + 500]
        ids, _, _ = matches.encode(some)
        assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [known.encode_ordinary(t) for t in some]


def test_very_long_text_and_split_tokens(spark):
    text = "Wörter und Zahlen 123 " * 20_000 + "漢字🙂" * 1000
    r = bpe.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), outputs=("ids", "offsets", "n_split", "decoded_sha256")).first()
    assert list(r.ids) == reference().encode_ordinary(text)
    assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    spans = list(zip(r.offsets[::2], r.offsets[1::2]))
    table = bpe.codec(bpe.default_ranks(), bpe.default_pattern())[1]
    whole = 0
    for i in r.ids:
        try:
            table[i].decode("utf-8")
            whole += 1
        except UnicodeDecodeError:
            pass
    assert 0 < len(r.ids) - whole <= r.n_split <= len(r.ids)
    assert {k for a, b in spans for k in range(a, b)} == set(range(len(text)))
