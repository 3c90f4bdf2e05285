"""Quality by weak labels: heuristics vote, their accuracies are estimated without any labels, a linear model generalises.

Each heuristic looks at a text's make-up and votes good (1), bad (0) or not at all.  Votes of a document form a
pattern; patterns are counted over all documents, and expectation-maximisation on the counts estimates for each
heuristic how often it is right about good and about bad documents (and how often it is silent), and for each pattern the probability that its
documents are good.  That probability is the soft label from which a logistic scorer over hashed byte trigrams
learns, on a bounded sample; the scorer then scores every whole text.

The driver sees at most 3**11 pattern counts and ``TRAIN_ROWS`` sparse rows of at most ``ROW_BUCKETS`` buckets (the
fullest ones), 98 MB in all.  Nothing else is shuffled.

Defined cases: a null, empty or wordless text scores 0 and isn't kept; if no document has words there is no model
and all score 0; a very long text is judged and scored whole; a statistic that equals a heuristic's upper bound is no
vote for bad, one that equals its lower bound is a vote for good; a score equal to the threshold is kept; repeated rows
count each and get repeated results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C
from . import _hashing as H

#: The bound of the rows that the scorer is fitted on: those with the least hash of id and text.
TRAIN_ROWS = 4_000
#: Buckets of a training row that are sent to the driver; a text of 4,098 bytes or fewer has no more.
ROW_BUCKETS = 4_096
BUCKET_BITS = 14
THRESHOLD = 0.35
#: For each heuristic: the statistic, the bound beyond which it votes bad, and the bound up to which it votes good.
HEURISTICS = (
    ("symbol_share", 0.06, 0.02),
    ("upper_share", 0.5, 0.2),
    ("top_word_share", 0.25, 0.15),
    ("pipe_share", 0.1, 0.0),
    ("repeat_share", 0.1, 0.02),
    ("exclaim_share", 0.2, 0.02),
    ("unpunctuated", 0.98, 0.9),
    ("odd_word_length", 6.0, 3.0),
    ("shortness", 0.34, 0.1),
    ("noisy_word_share", 0.2, 0.05),
    ("longest_run", 6.0, 2.0),
)
EM_ROUNDS = 60


def statistics(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The heuristics' statistics of each text (columns in order), and the number of its words."""
    data, offsets = C.flat_bytes(column)
    n = len(offsets) - 1
    bounds = offsets

    def count(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return (sums[bounds[1:]] - sums[bounds[:-1]]).astype(float)

    size = np.maximum(np.diff(offsets), 1).astype(float)
    upper = (data >= 65) & (data <= 90)
    letters = np.maximum(count(upper | ((data >= 97) & (data <= 122))), 1)
    symbols = np.isin(data, np.frombuffer(b"#$%&*|~^<>{}\\=_@+[]", np.uint8))
    starts, ends, rows = H.word_spans(data, offsets)
    words = np.bincount(rows, minlength=n).astype(float)
    least = np.maximum(words, 1)
    hashes = H.span_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    symbol_after = np.append(symbols, False)[ends]
    symbol_after[ends == offsets[rows + 1]] = False
    at = np.arange(len(hashes))
    run = at - np.maximum.accumulate(np.where(same, 0, at)) + 1 if len(at) else at
    longest = np.zeros(n)
    np.maximum.at(longest, rows, run)
    top = np.zeros(n)
    order = np.lexsort((hashes, rows))
    if len(order):
        fresh = np.concatenate(([True], (hashes[order][1:] != hashes[order][:-1]) | (rows[order][1:] != rows[order][:-1])))
        first = np.flatnonzero(fresh)
        np.maximum.at(top, rows[order][first], np.diff(np.append(first, len(order))))
        top[words < 10] = 0
    length = np.bincount(rows, weights=ends - starts, minlength=n) / least
    ends_of_sentences = count(np.isin(data, np.frombuffer(b".!?", np.uint8)))
    values = np.column_stack([
        count(symbols) / size,
        count(upper) / letters,
        top / least,
        count(data == 124) / least,
        np.bincount(rows, weights=same, minlength=n) / least,
        count(data == 33) / least,
        1 - np.minimum(ends_of_sentences * 40 / least, 1),
        np.abs(length - 6),
        1 / np.maximum(words, 1),
        np.bincount(rows, weights=symbol_after, minlength=n) / least,
        longest,
    ])
    return values, words


def votes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Votes of each text (columns are heuristics; 2 for none), and the number of its words."""
    values, words = statistics(column)
    out = np.full(values.shape, 2)
    for k, (_, bad, good) in enumerate(HEURISTICS):
        out[values[:, k] <= good, k] = 1
        out[values[:, k] > bad, k] = 0
    return out, words


def patterns(given: np.ndarray) -> np.ndarray:
    """Votes as one number in base 3."""
    return given @ (3 ** np.arange(given.shape[1]))


def estimate(found: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """The chance of each vote by heuristic and class, the posterior of each pattern, and the prior of good.

    ``found`` are distinct patterns with their ``counts``.  A heuristic's accuracy about bad documents is
    ``chance[k, 0, 0]``, about good ones ``chance[k, 1, 1]``; not voting is an outcome too, since most heuristics
    see one kind of fault only.  The start fixes which class is good: a document that nobody calls bad.
    """
    given = found[:, None] // 3 ** np.arange(len(HEURISTICS)) % 3
    p = np.where((given == 0).any(axis=1), 0.1, 0.95)
    chance = np.full((len(HEURISTICS), 2, 3), 1 / 3)
    prior = 0.5
    for _ in range(EM_ROUNDS):
        weights = np.column_stack([counts * (1 - p), counts * p])
        prior = float(np.clip(weights[:, 1].sum() / max(counts.sum(), 1), 0.01, 0.99))
        for k in range(len(HEURISTICS)):
            for v in range(3):
                chance[k, :, v] = (weights[given[:, k] == v].sum(axis=0) + 0.5) / (weights.sum(axis=0) + 1.5)
        odds = np.full(len(found), np.log(prior / (1 - prior)))
        for k in range(len(HEURISTICS)):
            odds += np.log(chance[k, 1, given[:, k]] / chance[k, 0, given[:, k]])
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return chance, p, prior


def trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of the three bytes that end at each byte, and the offsets of the texts."""
    data, offsets = C.flat_bytes(column)
    window = data.astype(np.uint32)
    window[1:] |= data[:-1].astype(np.uint32) << np.uint32(8)
    window[2:] |= data[:-2].astype(np.uint32) << np.uint32(16)
    for k in (0, 1):  # a text's first bytes see nothing of the text before
        at = offsets[:-1] + k
        at = at[at < len(data)]
        window[at] &= np.uint32((1 << 8 * (k + 1)) - 1)
    return (window * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS), offsets


def histogram(buckets: np.ndarray) -> np.ndarray:
    """Roots of the shares of the buckets in one text; its length is 1."""
    found = np.bincount(buckets, minlength=1 << BUCKET_BITS)
    return np.sqrt(found / max(len(buckets), 1)).astype(np.float32)


def fit_linear(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.3, ridge: float = 1e-5) -> np.ndarray:
    """Weights and, last, the bias of a logistic regression on soft labels (sparse rows in order), by Adam."""
    n, width = len(y), 1 << BUCKET_BITS
    w, first, second = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, rounds + 1):
        z = np.bincount(rows, weights=values * w[columns], minlength=n) + w[-1]
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.append(np.bincount(columns, weights=values * error[rows], minlength=width) / n, error.mean()) + ridge * w
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        w -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return w


@dataclass
class Model:
    """Posterior of each pattern that occurred, the accuracies behind it, and the scorer's weights."""

    posterior: dict[int, float]
    chance: np.ndarray
    prior: float
    weights: np.ndarray | None


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> Model:
    """Count patterns over all documents, estimate accuracies, fit the scorer on a bounded sample."""
    source = C.id_and_text(docs, id_col, text_col).select(F.xxhash64("__id", "__text").alias("h"), "__text")

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in C.text_slices(batches):
            given, words = votes(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.where(words > 0, patterns(given), -1))], names=["h", "pattern"])

    voted = C.materialize(source.mapInArrow(vote, "h bigint, pattern bigint").where("pattern >= 0"), "votes")
    counted = voted.groupBy("pattern").count().collect()  # at most 3**11 rows
    if not counted:
        return Model({}, np.full((len(HEURISTICS), 2, 3), 1 / 3), 0.5, None)
    found, counts = np.array([r[0] for r in counted]), np.array([r[1] for r in counted], float)
    chance, p, prior = estimate(found, counts)
    posterior = {int(k): float(v) for k, v in zip(found, p, strict=True)}
    chosen = voted.select("h", "pattern").distinct().orderBy("h", "pattern").limit(train_rows)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in C.text_slices(batches):
            buckets, offsets = trigrams(part.column(1))
            at, raw = [], []
            for a, b in zip(offsets, offsets[1:], strict=False):
                values = histogram(buckets[a:b])
                used = np.flatnonzero(values)
                if len(used) > ROW_BUCKETS:
                    used = np.sort(used[np.argsort(-values[used], kind="stable")[:ROW_BUCKETS]])
                at.append(used.astype(np.uint16).tobytes())
                raw.append(values[used].tobytes())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(at, pa.binary()), pa.array(raw, pa.binary())], names=["h", "pattern", "at", "value"])

    sample = source.join(F.broadcast(chosen), "h").dropDuplicates(["h"])  # two numbers for each of train_rows rows
    got = sample.select("h", "__text", "pattern").mapInArrow(sparse, "h bigint, pattern bigint, at binary, value binary").toArrow()
    got = got.take(np.argsort(got.column("h").to_numpy(), kind="stable"))
    at = [np.frombuffer(x, np.uint16) for x in got.column("at").to_pylist()]
    values = [np.frombuffer(x, np.float32) for x in got.column("value").to_pylist()]
    rows = np.repeat(np.arange(len(at)), [len(x) for x in at])
    labels = np.array([posterior[x] for x in got.column("pattern").to_pylist()])
    return Model(posterior, chance, prior, fit_linear(rows, np.concatenate(at), np.concatenate(values), labels))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: the id, ``votes`` array<int> (null: none), ``posterior``, ``score`` and ``keep``."""
    source = C.id_and_text(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part in C.text_slices(batches):
            given, words = votes(part.column(1))
            p = [own.posterior.get(int(x), own.prior) if n else 0.0 for x, n in zip(patterns(given), words, strict=True)]
            scores = np.zeros(part.num_rows)
            if own.weights is not None:
                buckets, offsets = trigrams(part.column(1))
                weights = own.weights[:-1].astype(np.float32)
                z = np.array([histogram(buckets[a:b]) @ weights for a, b in zip(offsets, offsets[1:], strict=False)]) + own.weights[-1]
                scores = np.where(words > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)
            cast = pa.array([[None if v == 2 else int(v) for v in row] for row in given], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column(0), cast, pa.array(p), pa.array(scores), pa.array(scores >= threshold)], names=["__id", "votes", "posterior", "score", "keep"])

    schema = f"__id {source.schema[0].dataType.simpleString()}, votes array<int>, posterior double, score double, keep boolean"
    return source.mapInArrow(run, schema).withColumnRenamed("__id", id_col)


def op4_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, train(docs)).select("doc_id", "posterior", "score", "keep")


QUERIES = {"op4_weak_label_quality": op4_weak_label_quality}
ORACLE: dict[str, str] = {}
