"""Trained operators against plain Python: what they count, infer and score, document by document."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from vocalmill.llm import langid as G
from vocalmill.llm import quality as Q
from vocalmill.llm import toxicity as X


def texts(seed, n, words):
    rng = random.Random(seed)
    return [" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) + rng.choice(["", ".", "!", " | ", "\n"]) for _ in range(n)]


# language mixtures


def gram_keys(text):
    """For each word the buckets of the four bytes that end at each of its bytes."""
    data = text.lower().encode()
    letter = [97 <= b <= 122 or b >= 128 for b in data]
    clean = [b if keep else 32 for b, keep in zip(data, letter)]
    words, here = [], None
    for i, keep in enumerate(letter):
        if not keep:
            here = None
            continue
        if here is None:
            here = []
            words.append(here)
        window = 0
        for back in range(4):
            window |= (clean[i - back] if i - back >= 0 else 32) << 8 * back
        here.append((window * 2654435761 & 0xFFFFFFFF) >> 32 - G.BUCKET_BITS)
    return words


def slow_model(docs):
    counts = {}
    for i, text, lang in docs:
        if text is None or lang is None or zlib.crc32(str(i).encode()) % 4 == 2:
            continue
        counts.setdefault(lang, Counter()).update(g for w in gram_keys(text) for g in w)
    names = sorted(counts)
    total = {k: sum(counts[k].values()) for k in names}
    return names, lambda k, g: math.log((1 - G.FLOOR) * counts[k][g] / max(total[k], 1) + G.FLOOR / (1 << G.BUCKET_BITS))


def slow_predict(text, names, logp):
    words = gram_keys(text or "")
    if not words or not any(c.isalpha() for c in text):
        return "und", 0.0
    loglik = [[sum(logp(k, g) for g in w) for k in names] for w in words]
    p = [[math.exp(x - max(row)) for x in row] for row in loglik]

    def em(share, rounds):
        total = 0.0
        for _ in range(rounds):
            joint = [[a * s for a, s in zip(row, share)] for row in p]
            mass = [max(sum(row), 1e-30) for row in joint]
            total = sum(map(math.log, mass))
            share = [sum(row[k] / m for row, m in zip(joint, mass)) / len(p) for k in range(len(names))]
        return share, total

    share, total = em([1 / len(names)] * len(names), G.EM_ROUNDS)
    fee = G.PENALTY * 0.5 * math.log(max(len(p), 2))
    while sum(s > 0 for s in share) > 1:
        least = min((k for k in range(len(names)) if share[k] > 0), key=lambda k: (share[k], -k))
        less = [0.0 if k == least else s for k, s in enumerate(share)]
        fitted, value = em([s / sum(less) for s in less], G.REFIT_ROUNDS)
        if value + fee <= total:
            break
        share, total = fitted, value
    best = max(range(len(names)), key=lambda k: share[k])
    return names[best], min(1.0, share[best])


def test_language_mixtures_equal_plain_python(spark):
    words = {"aa": ["casa", "perro", "niño", "mañana"], "bb": ["house", "dog", "child", "tomorrow"], "cc": ["maison", "chien", "été", "demain"]}
    docs = [(i, t, lang) for n, lang in enumerate(words) for i, t in enumerate(texts(n, 25, words[lang]), 100 * n)]
    mixed = texts(9, 20, words["aa"] + words["bb"])
    docs += [(900 + k, t, None) for k, t in enumerate([*mixed, None, "", "12 34", "слово", "casa dog", "Ǆ"])]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = G.train(df)
    names, logp = slow_model(docs)
    assert model[0] == names
    got = {r.doc_id: (r.lang_pred, r.score) for r in G.identify(df, model, mixture=False).collect()}
    for i, text, _ in docs:
        lang, score = slow_predict(text, names, logp)
        assert got[i][0] == lang and abs(got[i][1] - score) < 1e-3, (text, got[i], lang, score)


# toxicity chain


def test_chain_scores_equal_plain_python(spark):
    calm = [f"word{i}" for i in range(40)]
    docs = list(enumerate(texts(3, 200, [*calm, "knavery", "Scoundrels"])))
    labels = [(i, int("." not in t), int("knavery" in t or "Scoundrels" in t)) for i, t in docs]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    chain = X.train(d, lab)
    assert any(len(link.hashes) for link in chain)
    hash_of = {}

    def hashes(text):
        out = set()
        for w in re.findall(rb"[0-9a-z\x80-\xff]+", text.lower().encode()):
            if w not in hash_of:
                hash_of[w] = set(X.features(pa.array([w.decode()]))[0].tolist())
                assert len(hash_of[w]) == 1 + sum(len(w) > k for k in X.PREFIXES)
            out |= hash_of[w]
        return out

    for r in X.score(d, chain).collect():
        found, p = hashes(r.k__text), []
        for link in chain:
            z = link.bias + sum(a * b for a, b in zip(link.chained, p)) + sum(w for h, w in zip(link.hashes.tolist(), link.weights) if h in found)
            p.append(1 / (1 + math.exp(-z)))
        assert [abs(r[f"p_{link.name}"] - x) < 1e-9 for link, x in zip(chain, p)] == [True] * len(chain)
        assert r.rejected == any(x >= X.THRESHOLD for link, x in zip(chain, p) if link.name in X.REJECTING)


def test_training_rows_are_bounded_before_they_are_collected(spark):
    docs = [(7, f"text number {i} with its own words") for i in range(300)] + [(i, "plain text here") for i in range(100, 120)]
    labels = [(7, 1, 1)] * 3 + [(i, 1, 0) for i in range(100, 120)]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    seen = []
    real = X.fit_chain
    try:
        X.fit_chain = lambda rows, hashes, values, names, folds: seen.append(len(values)) or real(rows, hashes, values, names, folds)
        X.train(d, lab, train_rows=10)
        X.train(d, lab)
    finally:
        X.fit_chain = real
    assert seen[0] <= 10 and seen[1] == 21


# weak-label quality


def slow_statistics(text):
    data = text.encode()
    words = [(m.group(), m.end()) for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", data)]
    low = [(w.decode().lower(), e) for w, e in words]
    n, size = max(len(words), 1), max(len(data), 1)
    letters = max(sum(65 <= b <= 90 or 97 <= b <= 122 for b in data), 1)
    symbols = set(b"#$%&*|~^<>{}\\=_@+[]")
    runs, longest = 0, 0
    for k, (w, _) in enumerate(low):
        runs = runs + 1 if k and low[k - 1][0] == w else 1
        longest = max(longest, runs)
    top = max(Counter(w for w, _ in low).values(), default=0) if len(low) >= 10 else 0
    same = sum(low[k][0] == low[k - 1][0] for k in range(1, len(low)))
    stops = sum(b in b".!?" for b in data)
    return [
        sum(b in symbols for b in data) / size, sum(65 <= b <= 90 for b in data) / letters, top / n, data.count(b"|") / n, same / n, data.count(b"!") / n, 1 - min(stops * 40 / n, 1),
        abs(sum(len(w) for w, _ in words) / n - 6), 1 / n, sum(e < len(data) and data[e] in symbols for _, e in low) / n, float(longest),
    ]


def quality_texts():
    words = ["ma", "re", "silna", "venri", "dole", "ETE", "a#b", "x|", "longerword"]
    return [*texts(5, 150, words), "", " ", "one", "same same same same " * 5, "### ||| !!!", "Été ñandú. " * 12]


def test_statistics_equal_plain_python():
    rows = [t for t in quality_texts() if t == t.lower()]  # the statistics compare words as written
    values, words = Q.statistics(pa.array(rows))
    for text, got, n in zip(rows, values, words):
        assert n == len(re.findall(rb"[0-9A-Za-z\x80-\xff]+", text.encode()))
        assert np.allclose(got, slow_statistics(text), atol=1e-12), text


def test_estimates_and_scores_equal_plain_python(spark):
    rows = list(enumerate(quality_texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = Q.train(df)
    given, words = Q.votes(pa.array([t for _, t in rows]))
    given = given[words > 0]
    # expectation-maximisation over documents, not over counts of patterns
    p = np.where((given == 0).any(axis=1), 0.1, 0.95)
    for _ in range(Q.EM_ROUNDS):
        prior = min(max(p.mean(), 0.01), 0.99)
        odds = np.full(len(p), math.log(prior / (1 - prior)))
        for k in range(given.shape[1]):
            for v in range(3):
                bad = ((1 - p)[given[:, k] == v].sum() + 0.5) / ((1 - p).sum() + 1.5)
                good = (p[given[:, k] == v].sum() + 0.5) / (p.sum() + 1.5)
                odds[given[:, k] == v] += math.log(good / bad)
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    want = dict(zip(np.flatnonzero(words > 0).tolist(), p))
    for r in Q.score(df, model).collect():
        text = rows[r.doc_id][1]
        if words[r.doc_id] == 0:
            assert (r.score, r.posterior, r.keep) == (0.0, 0.0, False)
            continue
        data = text.encode()
        counts = Counter((sum((data[i - b] if i >= b else 0) << 8 * b for b in range(3)) * 2654435761 & 0xFFFFFFFF) >> 32 - Q.BUCKET_BITS for i in range(len(data)))
        z = model.weights[-1] + sum(math.sqrt(c / len(data)) * model.weights[b] for b, c in counts.items())
        assert abs(r.posterior - want[r.doc_id]) < 1e-6
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-4
        assert r.keep == (r.score >= Q.THRESHOLD)
