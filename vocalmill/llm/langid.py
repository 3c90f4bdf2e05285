"""Language identification as inference of a mixture: which languages, in which proportions, wrote a document's words.

Each language's model is a table of hashed four-byte sequences of lower-cased letters and word gaps, counted over
all training documents.  A word's likelihood under a language is the product over its positions.  Expectation
maximisation estimates the proportions of a document's languages from its words; then languages leave one by one,
the least first, as long as the likelihood penalised by the number of languages improves.  The prediction is the
language of the largest share, the score that share.

Training documents are those whose crc32 of the id as text is not 2 modulo 4, with a text and a language.  Counts
are summed in blocks by language, so no task or message grows with the corpus.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, as is every text if no language was
learned; a very long text is read whole; of languages with equal shares the one that sorts last leaves first, and the
one that sorts first is predicted; a null id is never held out and never trained on; repeated rows count each; an
empty table gives an empty result; only id, text and language are read.  The model takes 256 KB a language, on the
driver and on each executor; more than ``MAX_LANGUAGES`` distinct values of the language column are an error, as that
is no column of languages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C
from . import _hashing as H

BUCKET_BITS = 16
BLOCK = 4096
#: Share of a model's mass that is spread evenly, so that unseen sequences cost the same in every language.
FLOOR = 0.02
EM_ROUNDS, REFIT_ROUNDS = 10, 4
#: What a language must add to the log-likelihood, in units of half the logarithm of the number of words.
PENALTY = 3.0
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
#: Distinct languages that may be learned.
MAX_LANGUAGES = 512

_LETTER = np.array([97 <= b <= 122 or b >= 128 for b in range(256)])
_CLEAN = np.where(_LETTER, np.arange(256), 32).astype(np.uint8)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket at each byte of lower-cased texts, and the starts and rows of the words; a word's gap belongs to it."""
    starts, _, rows = H.word_spans(data, offsets, _LETTER)
    clean = _CLEAN[data].astype(np.uint32)
    window = clean.copy()
    for back in (1, 2, 3):
        window[back:] |= clean[:-back] << np.uint32(8 * back)
    first = offsets[:-1][offsets[:-1] < len(data)]
    for k in range(3):  # a text's first bytes see nothing of the text before
        at = first + k
        at = at[at < len(data)]
        window[at] = (window[at] & np.uint32((1 << 8 * (k + 1)) - 1)) | np.uint32(0x20202020 << 8 * (k + 1) & 0xFFFFFFFF)
    return (window * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS), starts, rows


def _held_out(column):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order, and their log-probabilities by bucket."""
    used = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id"))
    used = used.where("id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").where(~_held_out("id")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for part in C.text_slices(batches):
            data, offsets = C.flat_bytes(H.lowered(part.column(1)))
            buckets, _, _ = grams(data, offsets)
            names = np.array(part.column(0).to_pylist(), dtype=object)
            of_byte = np.repeat(np.arange(len(names)), np.diff(offsets))
            letters = _LETTER[data]
            for name in dict.fromkeys(names):
                mine = (names == name)[of_byte] & letters
                found = np.bincount(buckets[mine], minlength=1 << BUCKET_BITS)
                totals[name] = totals[name] + found if name in totals else found
        for name, values in totals.items():
            yield _blocks(name, values)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for key, raw in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), batch.column(2), strict=True):
                values = np.frombuffer(raw.as_buffer(), np.int64)
                sums[key] = sums[key] + values if key in sums else values
        for (name, k), values in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k], pa.int32()), pa.array([values.tobytes()], pa.binary())], names=["lang", "block", "counts"])

    if used.select("lang").distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"column {lang_col} has more than {MAX_LANGUAGES} values")
    schema = "lang string, block int, counts binary"
    rows = used.mapInArrow(count, schema).repartition(F.col("lang"), F.col("block")).mapInArrow(add, schema).collect()
    names = sorted({r.lang for r in rows})
    counts = np.zeros((len(names), 1 << BUCKET_BITS))
    for r in rows:
        counts[names.index(r.lang), r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(bytes(r.counts), np.int64)
    share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    return names, np.log((1 - FLOOR) * share + FLOOR / (1 << BUCKET_BITS)).astype(np.float32)


def _blocks(name: str, values: np.ndarray) -> pa.RecordBatch:
    pieces = [p.astype(np.int64).tobytes() for p in values.reshape(-1, BLOCK)]
    return pa.RecordBatch.from_arrays([pa.array([name] * len(pieces)), pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.binary())], names=["lang", "block", "counts"])


def _em(p: np.ndarray, starts: np.ndarray, counts: np.ndarray, rows: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after some rounds, and the log-likelihood of each document at the round before the last."""
    total = None
    for _ in range(rounds):
        joint = p * share[rows]
        mass = np.maximum(joint.sum(axis=1), 1e-30)
        total = np.add.reduceat(np.log(mass), starts)
        share = np.add.reduceat(joint / mass[:, None], starts, axis=0) / counts[:, None]
    return share, total


def mixtures(loglik: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents that have words (their row numbers), and the proportions of their selected languages.

    ``loglik`` has a row for each word and a column for each language; ``rows``, ascending, the document of each.
    """
    docs, starts, counts = np.unique(rows, return_index=True, return_counts=True)
    if not len(docs):
        return docs, np.zeros((0, loglik.shape[1]))
    where = np.repeat(np.arange(len(docs)), counts)
    p = np.exp((loglik - loglik.max(axis=1, keepdims=True)).astype(np.float64))
    n = loglik.shape[1]
    share, total = _em(p, starts, counts, where, np.full((len(docs), n), 1.0 / n), EM_ROUNDS)
    fee = PENALTY * 0.5 * np.log(np.maximum(counts, 2))
    open_ = np.ones(len(docs), bool)
    while True:
        open_ &= (share > 0).sum(axis=1) > 1
        if not open_.any():
            return docs, share
        pick = np.flatnonzero(open_)
        mine = open_[where]
        sub_counts = counts[pick]
        sub_starts = np.concatenate(([0], np.cumsum(sub_counts)[:-1]))
        sub_rows = np.repeat(np.arange(len(pick)), sub_counts)
        less = share[pick]
        least = less.shape[1] - 1 - np.where(less > 0, less, np.inf)[:, ::-1].argmin(axis=1)  # of equal ones the last
        less[np.arange(len(pick)), least] = 0.0
        less /= less.sum(axis=1, keepdims=True)
        fitted, value = _em(p[mine], sub_starts, sub_counts, sub_rows, less, REFIT_ROUNDS)
        better = value + fee[pick] > total[pick]
        share[pick[better]], total[pick[better]] = fitted[better], value[better]
        open_[pick[~better]] = False


def predict(column: pa.Array, names: list[str], table: np.ndarray) -> tuple[list[str], np.ndarray, list[dict[str, float]]]:
    """Language, score and mixture of each text of a column; ``table`` has a row for each bucket."""
    data, offsets = C.flat_bytes(H.lowered(column))
    n = len(offsets) - 1
    langs, scores, mixed = [UNKNOWN] * n, np.zeros(n), [{} for _ in range(n)]
    buckets, starts, rows = grams(data, offsets)
    if not names or not len(starts):
        return langs, scores, mixed
    values = table[buckets]
    values[~_LETTER[data]] = 0
    loglik = np.add.reduceat(values, starts, axis=0)
    docs, share = mixtures(loglik, rows)
    ascii_letters = np.add.reduceat(np.concatenate((_LETTER[data] & (data < 128), [False])).astype(np.int64), offsets[:-1])
    texts = C.text_array(column)
    for doc, parts in zip(docs, share, strict=True):
        if not ascii_letters[doc] and not any(map(str.isalpha, texts[int(doc)].as_py())):
            continue
        best = int(parts.argmax())
        langs[doc], scores[doc] = names[best], min(1.0, float(parts[best]))
        mixed[doc] = {names[k]: float(parts[k]) for k in np.flatnonzero(parts > 0)}
    return langs, scores, mixed


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text", mixture: bool = True) -> DataFrame:
    """(id, ``lang_pred``, ``score``, ``mixture`` map of language to share) for every row."""
    source = C.id_and_text(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast((model[0], np.ascontiguousarray(model[1].T)))
    names = ["__id", "lang_pred", "score", *(["mixture"] if mixture else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, table = shared.value
        for part in C.text_slices(batches):
            langs, scores, mixed = predict(part.column(1), languages, table)
            columns = [part.column(0), pa.array(langs, pa.string()), pa.array(scores)]
            if mixture:
                columns.append(pa.array([list(m.items()) for m in mixed], pa.map_(pa.string(), pa.float64())))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"__id {source.schema[0].dataType.simpleString()}, lang_pred string, score double" + ", mixture map<string,double>" * mixture
    return source.mapInArrow(run, schema).withColumnRenamed("__id", id_col)


def op10_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    found = identify(docs, train(docs), mixture=False)
    return found.select("doc_id", _held_out("doc_id").alias("held_out"), "lang_pred", "score")


QUERIES = {"op10_language_mixture": op10_language_mixture}
ORACLE: dict[str, str] = {}
