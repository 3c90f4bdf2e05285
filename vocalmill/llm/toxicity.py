"""Toxicity by a classifier chain: categories are predicted one after another, each seeing the earlier ones.

A category is a condition on the label table.  Its linear model reads which hashed words and word beginnings occur
in a text (only those that clearly tell the classes apart in training) and the probabilities of the earlier categories.  In
training those probabilities are out of fold: each comes from a model that has not seen the row.  In prediction
they come from the models fitted on all training rows.

The fit reads at most ``TRAIN_ROWS`` labelled ids, those with the least hash, one row for each; a row travels as at
most ``ROW_FEATURES`` hashes (the least ones), so the driver gets 128 MB at the very most.  Scoring is one pass over
whole texts with nothing shuffled.

Defined cases: a null, empty or wordless text has no features and gets the base rate; label rows without a value
that a category asks for are left out; labels of unknown documents are left out; without any labelled row of both
classes a category is predicted by its rate (0 without rows); of several texts or labels under one id the one with the
least hashes is trained on; a very long text is scored whole; a probability equal to the threshold rejects; repeated
rows get repeated results; an empty table gives an empty result; other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C
from . import _hashing as H

#: Category and its condition on the labels, in chain order.
CATEGORIES = (("unfit", "quality = 0"), ("toxic", "toxic = 1"), ("severe", "toxic = 1 AND quality = 0"))
#: A document is rejected if one of these is at least as likely as ``THRESHOLD``.
REJECTING = ("toxic", "severe")
THRESHOLD = 0.5
#: The bound of the labelled rows that the chain is fitted on.
TRAIN_ROWS = 8_000
#: Features of a training row that are sent to the driver; texts of some 600 words or fewer have no more.
ROW_FEATURES = 4_096
FOLDS = 5
#: Beginnings of so many bytes are features of longer words, besides whole words.
PREFIXES = (5, 6, 7, 8, 9)
#: A feature needs so many rows, this chi-square, and this share of the best feature's; the best so many are used.
MIN_ROWS, CHI_SQUARE, CHI_SHARE, FEATURES = 5, 40.0, 0.03, 512
RIDGE = 0.1


@dataclass
class Link:
    """The linear model of one category: sorted word hashes, their weights, weights of earlier categories, bias."""

    name: str
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    chained: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -20.0


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = 30) -> np.ndarray:
    """Weights and, last, the bias of an L2-regularised logistic regression, by Newton's method."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = _sigmoid(z @ w)
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the words and word beginnings of a text column, and the row of each."""
    data, offsets = C.flat_bytes(H.lowered(column))
    starts, ends, rows = H.word_spans(data, offsets)
    hashes, places = [H.span_hashes(data, starts, ends)], [rows]
    for k in PREFIXES:
        longer = ends - starts > k
        hashes.append(H.mix(H.span_hashes(data, starts[longer], starts[longer] + k) + np.uint64(k)))
        places.append(rows[longer])
    return (np.concatenate(hashes) >> np.uint64(32)).astype(np.uint32), np.concatenate(places)


def select_words(rows: np.ndarray, hashes: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sorted hashes of the features that tell the classes apart; (rows, hashes) are distinct occurrences."""
    n, pos = len(y), float(y.sum())
    if not len(hashes) or pos in (0.0, float(n)):
        return np.zeros(0, np.uint32)
    values, df = np.unique(hashes, return_counts=True)
    mine, both_counts = np.unique(hashes[y[rows] > 0], return_counts=True)
    both = np.zeros(len(values))
    both[np.searchsorted(values, mine)] = both_counts
    expected = df * pos / n
    chi = (both - expected) ** 2 * n / np.maximum(expected * (n - df) * (1 - pos / n), 1e-12)
    chosen = np.flatnonzero((chi >= max(CHI_SQUARE, CHI_SHARE * chi.max())) & (df >= MIN_ROWS))
    return np.sort(values[chosen[np.argsort(-chi[chosen], kind="stable")][:FEATURES]])


def presence(rows: np.ndarray, hashes: np.ndarray, n: int, chosen: np.ndarray) -> np.ndarray:
    """A 0/1 matrix of which chosen words occur in which row."""
    out = np.zeros((n, len(chosen)))
    if len(chosen) and len(hashes):
        at = np.minimum(np.searchsorted(chosen, hashes), len(chosen) - 1)
        hit = chosen[at] == hashes
        out[rows[hit], at[hit]] = 1.0
    return out


def _fit_one(name: str, rows: np.ndarray, hashes: np.ndarray, y: np.ndarray, earlier: np.ndarray) -> Link:
    n, pos = len(y), y.sum()
    if not n or pos in (0, n):
        return Link(name, chained=np.zeros(earlier.shape[1]), bias=float(np.clip(np.log((pos + 1e-9) / (n - pos + 1e-9)), -20, 20)) if n else -20.0)
    chosen = select_words(rows, hashes, y)
    w = fit_logistic(np.hstack([presence(rows, hashes, n, chosen), earlier]), y)
    return Link(name, chosen, w[: len(chosen)], w[len(chosen) : -1], float(w[-1]))


def _apply(link: Link, rows: np.ndarray, hashes: np.ndarray, n: int, earlier: np.ndarray) -> np.ndarray:
    z = np.full(n, link.bias)
    if len(link.chained):
        z += earlier[:, : len(link.chained)] @ link.chained
    if len(link.hashes):
        z += presence(rows, hashes, n, link.hashes) @ link.weights
    return _sigmoid(z)


def fit_chain(rows: np.ndarray, hashes: np.ndarray, labels: np.ndarray, names: list[str], folds: np.ndarray) -> list[Link]:
    """Links in order.  ``labels`` has a column for each category; ``folds`` the fold of each row."""
    n = len(labels)
    chain: list[Link] = []
    unseen = np.zeros((n, 0))
    for k, name in enumerate(names):
        y = labels[:, k].astype(float)
        chain.append(_fit_one(name, rows, hashes, y, unseen))
        held = np.zeros(n)
        for fold in np.unique(folds):
            out, seen = folds == fold, folds != fold
            renumber = np.cumsum(seen) - 1
            mine = seen[rows]
            link = _fit_one(name, renumber[rows[mine]], hashes[mine], y[seen], unseen[seen])
            theirs = out[rows]
            held[out] = _apply(link, (np.cumsum(out) - 1)[rows[theirs]], hashes[theirs], int(out.sum()), unseen[out])
        unseen = np.column_stack([unseen, held])
    return chain


def predict(chain: list[Link], rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """A column of probabilities for each category."""
    out = np.zeros((n, 0))
    for link in chain:
        out = np.column_stack([out, _apply(link, rows, hashes, n, out)])
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", categories=CATEGORIES, train_rows: int = TRAIN_ROWS) -> list[Link]:
    """Fit the chain on a bounded sample of labelled documents."""
    wanted = [F.expr(condition).cast("int").alias(f"y{k}") for k, (_, condition) in enumerate(categories)]
    known = labels.select(F.col(id_col).alias("__key"), *wanted).dropna()
    sample = known.orderBy(F.xxhash64("__key"), "__key", *(f"y{k}" for k in range(len(categories)))).limit(train_rows)
    sample = sample.groupBy("__key").agg(*(F.min(f"y{k}").alias(f"y{k}") for k in range(len(categories))))
    texts = C.id_and_text(docs, id_col, text_col).join(F.broadcast(sample), F.col("__id") == F.col("__key"))  # at most train_rows rows of a few numbers
    names = [f"y{k}" for k in range(len(categories))]
    columns = texts.select(F.xxhash64("__key").alias("h"), "__text", *names)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in C.text_slices(batches):
            found, rows = features(part.column(1))
            order = np.argsort(rows, kind="stable")
            bounds, found = np.searchsorted(rows[order], np.arange(part.num_rows + 1)), found[order]
            raw = [np.unique(found[a:b])[:ROW_FEATURES].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(raw, pa.binary()), *part.columns[2:]], names=["h", "words", *names])

    each_row = columns.mapInArrow(hashed, "h bigint, words binary, " + ", ".join(f"{y} int" for y in names))
    one = each_row.groupBy("h").agg(F.min(F.struct("words", *names)).alias("r")).select("h", "r.*")  # one row an id, before anything is collected
    got = one.toArrow().sort_by("h")
    each = [np.frombuffer(x, np.uint32) for x in got.column("words").to_pylist()]
    rows = np.repeat(np.arange(len(each)), [len(x) for x in each])
    hashes = np.concatenate(each) if each else np.zeros(0, np.uint32)
    seen, df = np.unique(hashes, return_counts=True)
    often = df[np.searchsorted(seen, hashes)] >= MIN_ROWS if len(hashes) else np.zeros(0, bool)
    rows, hashes = rows[often], hashes[often]
    values = np.column_stack([got.column(y).to_numpy() for y in names]) if each else np.zeros((0, len(names)))
    folds = (got.column("h").to_numpy().view(np.uint64) >> np.uint64(7)) % np.uint64(FOLDS)
    return fit_chain(rows, hashes, values, [name for name, _ in categories], folds)


def score(docs: DataFrame, chain: list[Link], text_col: str = "text", rejecting: tuple[str, ...] = REJECTING, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` as ``k__<name>``, a probability ``p_<category>`` each, and ``rejected``."""
    at = docs.columns.index(text_col)
    source = docs.select(*(F.col(c).alias(f"k__{c}") for c in docs.columns))
    schema = source
    for link in chain:
        schema = schema.withColumn(f"p_{link.name}", F.lit(0.0))
    schema = schema.withColumn("rejected", F.lit(False)).schema
    decisive = [k for k, link in enumerate(chain) if link.name in rejecting]
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in C.text_slices(batches, at):
            hashes, rows = features(part.column(at))
            p = predict(shared.value, rows, hashes, part.num_rows)
            bad = (p[:, decisive] >= threshold).any(axis=1)
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(np.ascontiguousarray(p[:, k])) for k in range(p.shape[1])), pa.array(bad)], names=schema.names)

    return source.mapInArrow(run, schema)


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that are not rejected, with all their columns."""
    scored = score(docs, train(docs, labels, id_col, text_col), text_col)
    return scored.where(~F.col("rejected")).select(*(F.col(f"k__{c}").alias(c) for c in docs.columns))


def op6_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, C.table(spark, sf_dir, "labels")))
    return scored.select(F.col("k__doc_id").alias("doc_id"), *(f"p_{name}" for name, _ in CATEGORIES), "rejected")


QUERIES = {"op6_toxicity_chain": op6_toxicity_chain}
ORACLE: dict[str, str] = {}
