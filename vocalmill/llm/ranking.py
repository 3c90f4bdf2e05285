"""Ranked lexical search by presence-mask grouping: the best documents for each benchmark item, exact.

Terms are runs of ASCII letters, digits and non-ASCII characters after A-Z became a-z.  A first pass reads every document
once and writes slices: postings (document of the slice, occurrences) for the terms that items ask for, with the numbers of
documents and terms for the statistics.  Their sums give the number of documents with a term, and so the weights.

A second pass searches the slices.  In a slice each term has a bitmap of its documents and a greatest contribution to a
score.  For an item, the terms whose greatest contributions together stay below the item's 50th score so far can't bring a
document in alone; the union of the other terms' bitmaps gives the candidates.  The bitmaps of all the item's terms,
turned over, give each candidate its mask of matched terms; equal masks form a group, whose greatest possible score is the
sum of its terms' contributions.  Groups are evaluated by descending greatest score until that falls below the 50th score
found: the rest can't enter.  A task hands on one list an item, and lists are merged, in two steps where slices are many.

Items are taken in blocks of about ``BLOCK_TERMS`` terms, each with passes of its own, so that what is broadcast is bounded; an
item's terms must fit into one block, however large.  All numbers are 64-bit integers but for the logarithm in a weight.

Defined cases: null, empty and termless documents have no terms and are not counted; an item without terms has no results;
rows that share an item id (null too) are one item with the terms of all; every row of the documents is a document of its
own, so repeated rows take several ranks; of equal scores the lesser doc_id comes first, null before all; fewer documents
with a positive score than asked for give fewer rows; a very long text is read whole, as is a long item; empty tables give
an empty result; other columns are not read.  Document ids are whole numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C
from .decontamination import words_of

TOP = 50
#: Terms of items in a block.
BLOCK_TERMS = 200_000
#: Documents with matches, and bytes of text, in a slice.
SLICE_DOCS, SLICE_TEXT = 8192, 16 << 20
#: Candidates that are evaluated first, twice as many in each step after it; and rows of a list merged in one step.
FIRST, MERGED = 128, 1000
_SLICE = "ids binary, known binary, n binary, terms array<int>, counts array<int>, docs binary, tfs binary, total bigint, length bigint"


def item_terms(bench: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, term) without repeats; the item as it is."""
    C.prepare(bench.sparkSession)
    source = bench.select(F.col(item_col).alias("item"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in C.text_slices(batches):
            rows, terms = [], []
            for row, text in enumerate(part.column(1).to_pylist()):
                found = sorted(set(words_of(text)))
                rows += [row] * len(found)
                terms += [t.decode("utf-8", "surrogatepass") for t in found]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array(terms, pa.string())], names=["item", "term"])

    return source.mapInArrow(run, f"item {source.schema[0].dataType.simpleString()}, term string").distinct()


def slice_row(ids: list, lengths: list[int], terms: np.ndarray, owners: np.ndarray, total: int, length: int) -> pa.RecordBatch:
    """A slice as one row, from the query terms found (term and document for each occurrence)."""
    used, docs = np.unique(owners, return_inverse=True)
    pairs, tfs = np.unique(terms.astype(np.int64) * max(len(used), 1) + docs, return_counts=True)
    term, doc = np.divmod(pairs, max(len(used), 1))
    names, counts = np.unique(term, return_counts=True)
    mine = [ids[k] for k in used]
    values = [
        np.array([0 if i is None else i for i in mine], np.int64).tobytes(),
        np.array([i is not None for i in mine], np.uint8).tobytes(),
        np.array([lengths[k] for k in used], np.int64).tobytes(),
        names.astype(np.int32).tolist(),
        counts.astype(np.int32).tolist(),
        doc.astype(np.uint16 if len(used) <= 1 << 16 else np.uint32).tobytes(),
        tfs.astype(np.uint8 if not len(tfs) or tfs.max() < 256 else np.int64).tobytes(),
        total,
        length,
    ]
    types = [pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=[f.split()[0] for f in _SLICE.split(", ")])


def index(docs: DataFrame, vocabulary: list[str], id_col: str, text_col: str) -> DataFrame:
    """The slices of all documents, with postings of the vocabulary's terms."""
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    C.prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t.encode("utf-8", "surrogatepass"): k for k, t in enumerate(shared.value)}.get
        ids: list = []
        lengths: list[int] = []
        found: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        size = matched = total = length = 0
        for part in C.text_slices(batches):
            size += part.nbytes
            for id_, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                words = words_of(text)
                if not words:
                    continue
                total += 1
                length += len(words)
                here = np.array([k for w in words if (k := number(w)) is not None], np.int32)
                if len(here):
                    matched += 1
                    found.append(here)
                    owners.append(np.full(len(here), len(ids), np.int64))
                    ids.append(id_)
                    lengths.append(len(words))
            if matched >= SLICE_DOCS or size >= SLICE_TEXT:
                yield slice_row(ids, lengths, _joined(found, np.int32), _joined(owners, np.int64), total, length)
                ids, lengths, found, owners = [], [], [], []
                size = matched = total = length = 0
        if total:
            yield slice_row(ids, lengths, _joined(found, np.int32), _joined(owners, np.int64), total, length)

    return source.mapInArrow(run, _SLICE)


def _joined(arrays: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.zeros(0, kind)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_norms(n: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """100 - 50 + (50 n N) div L, exact where the product outgrows 64 bits."""
    if not len(n):
        return np.zeros(0, np.int64)
    if 50 * int(n.max()) * n_docs < 1 << 63:
        return 50 + 50 * n * n_docs // total
    return np.array([50 + 50 * int(x) * n_docs // total for x in n], np.int64)


class Best:
    """The best (score, known, id) of an item so far."""

    def __init__(self, top: int):
        self.top = top
        self.scores = np.zeros(0, np.int64)
        self.known = np.zeros(0, np.uint8)
        self.ids = np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """The score below which nothing can enter."""
        return max(int(self.scores[-1]), 1) if len(self.scores) == self.top else 1

    def add(self, scores: np.ndarray, known: np.ndarray, ids: np.ndarray) -> None:
        fit = scores >= self.least
        scores, known, ids = (np.concatenate((a, b[fit])) for a, b in zip((self.scores, self.known, self.ids), (scores, known, ids), strict=True))
        order = np.lexsort((ids, known, -scores))[: self.top]
        self.scores, self.known, self.ids = scores[order], known[order], ids[order]


class Slice:
    """Postings, contributions and bitmaps of a slice."""

    def __init__(self, row: dict, weights: np.ndarray, n_docs: int, total: int):
        self.ids, self.known = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], np.uint8)
        norms = length_norms(np.frombuffer(row["n"], np.int64), n_docs, total)
        terms, counts = np.array(row["terms"], np.int64), np.array(row["counts"], np.int64)
        self.size, many = len(self.ids), int(counts.sum())
        self.docs = np.frombuffer(row["docs"], np.uint16 if self.size <= 1 << 16 else np.uint32)
        tfs = np.frombuffer(row["tfs"], np.uint8 if len(row["tfs"]) == many else np.int64).astype(np.int64)
        self.shares = np.repeat(weights[terms], counts) * (1_000_000_000 * tfs // (1000 * tfs + 20 * norms[self.docs]))
        ends = np.cumsum(counts)
        self.spans = {int(t): (int(e - c), int(e)) for t, e, c in zip(terms, ends, counts, strict=True)}
        most = np.maximum.reduceat(self.shares, ends - counts) if many else np.zeros(0, np.int64)
        self.most = dict(zip(terms.tolist(), most.tolist(), strict=True))
        self.bitmaps: dict[int, np.ndarray] = {}

    def bitmap(self, term: int) -> np.ndarray:
        if term not in self.bitmaps:
            bits = np.zeros(self.size, bool)
            a, b = self.spans[term]
            bits[self.docs[a:b]] = True
            self.bitmaps[term] = np.packbits(bits)
        return self.bitmaps[term]

    def masks(self, terms: list[int], docs: np.ndarray) -> np.ndarray:
        """A row of bytes for each document: bit j, from the top, tells whether it has term j."""
        words = []
        for k in range(0, len(terms), 64):
            bits = np.unpackbits(np.stack([self.bitmap(t) for t in terms[k : k + 64]]), axis=1, count=self.size)[:, docs]
            words.append(np.packbits(bits, axis=0).T)
        return np.ascontiguousarray(np.concatenate(words, axis=1))

    def scores(self, terms: list[int], docs: np.ndarray) -> np.ndarray:
        out = np.zeros(len(docs), np.int64)
        for t in terms:
            a, b = self.spans[t]
            own = self.docs[a:b]
            at = np.minimum(np.searchsorted(own, docs), b - a - 1)
            out += np.where(own[at] == docs, self.shares[a:b][at], 0)
        return out

    def search(self, terms: list[int], best: Best) -> int:
        """Bring the item's best up to date; the number of documents that were evaluated."""
        terms = sorted((t for t in terms if self.most.get(t, 0) > 0), key=lambda t: (self.most[t], t))
        if not terms:
            return 0
        most = np.array([self.most[t] for t in terms], np.int64)
        first = int(np.searchsorted(np.cumsum(most), best.least))  # the terms before can't bring in a document
        if first == len(terms):
            return 0
        union = np.bitwise_or.reduce(np.stack([self.bitmap(t) for t in terms[first:]]))
        docs = np.flatnonzero(np.unpackbits(union, count=self.size)).astype(self.docs.dtype)
        masks = self.masks(terms, docs)
        width = masks.shape[1]
        if width <= 8:
            padded = np.zeros((len(docs), 8), np.uint8)
            padded[:, :width] = masks
            _, at, group = np.unique(padded.view(np.uint64).ravel(), return_index=True, return_inverse=True)
        else:
            _, at, group = np.unique(masks.view(f"V{width}").ravel(), return_index=True, return_inverse=True)
        bounds = np.unpackbits(masks[at], axis=1, count=len(terms)).astype(np.int64) @ most
        of_doc = bounds[group]
        order = np.argsort(-of_doc, kind="stable")
        start, size, evaluated = 0, FIRST, 0
        while start < len(order) and of_doc[order[start]] >= best.least:
            here = order[start : start + size]
            here = here[of_doc[here] >= best.least]
            chosen = docs[here]
            best.add(self.scores(terms, chosen), self.known[chosen], self.ids[chosen])
            start, size, evaluated = start + size, 2 * size, evaluated + len(here)
        return evaluated


_LISTS = "item int, part int, scores array<bigint>, known array<int>, ids array<bigint>"


def _lists(found: dict[int, Best], part: int) -> pa.RecordBatch:
    items = sorted(k for k, b in found.items() if len(b.scores))
    numbers = lambda kind, get: pa.array([get(found[k]).tolist() for k in items], pa.list_(kind))
    return pa.RecordBatch.from_arrays(
        [pa.array(items, pa.int32()), pa.array([part] * len(items), pa.int32()), numbers(pa.int64(), lambda b: b.scores), numbers(pa.int32(), lambda b: b.known), numbers(pa.int64(), lambda b: b.ids)],
        names=["item", "part", "scores", "known", "ids"],
    )


def _merged(lists: DataFrame, keys: tuple[str, ...], top: int) -> DataFrame:
    """One list for each distinct key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, best = None, None
        for batch in batches:
            for item, part, scores, known, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = (item, part if "part" in keys else 0)
                if key != here:
                    if best is not None:
                        yield _lists({here[0]: best}, here[1])
                    here, best = key, Best(top)
                best.add(np.array(scores, np.int64), np.array(known, np.uint8), np.array(ids, np.int64))
        if best is not None:
            yield _lists({here[0]: best}, here[1])

    return lists.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, _LISTS)


def ranked(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of each item."""
    spark = docs.sparkSession
    asked = C.materialize(item_terms(bench, item_col, item_text_col), "items")
    item_type = asked.schema["item"].dataType
    blocks = 2 * (asked.count() // block_terms) or 1
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int"))
    parts = [_block(docs, asked.where(F.col("block") == k), id_col, text_col, top) for k in range(blocks)]
    parts = [p for p in parts if p is not None]
    names = f"item_id {item_type.simpleString()}, rank int, doc_id bigint, score bigint"
    if not parts:
        return spark.createDataFrame([], names)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _block(docs: DataFrame, asked: DataFrame, id_col: str, text_col: str, top: int) -> DataFrame | None:
    spark = docs.sparkSession
    rows = asked.groupBy("item").agg(F.collect_list("term").alias("terms")).collect()  # about BLOCK_TERMS terms
    if not rows:
        return None
    vocabulary = sorted({t for r in rows for t in r.terms})
    number = {t: k for k, t in enumerate(vocabulary)}
    items = [(r.item, [number[t] for t in r.terms]) for r in rows]
    slices = C.materialize(index(docs, vocabulary, id_col, text_col), "slices")
    sums = slices.agg(F.sum("total"), F.sum("length"), F.count("*")).first()
    if not sums[0]:
        return None
    n_docs, total = int(sums[0]), int(sums[1])
    weights = np.zeros(len(vocabulary), np.int64)
    dfs = slices.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.counts").alias("df"))
    for r in dfs.collect():  # at most a row a term of the block
        weights[r.term] = weight(n_docs, r.df)
    shared = spark.sparkContext.broadcast(([t for _, t in items], weights))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = shared.value
        best = {k: Best(top) for k in range(len(items))}
        for batch in batches:
            for k in range(batch.num_rows):
                part = Slice(batch.slice(k, 1).to_pylist()[0], weights, n_docs, total)
                for item, terms in enumerate(items):
                    part.search(terms, best[item])
        yield _lists(best, TaskContext.get().partitionId())

    lists = slices.mapInArrow(search, _LISTS)
    if sums[2] > MERGED:
        groups = math.isqrt(sums[2])
        lists = _merged(lists.withColumn("part", F.pmod("part", F.lit(groups)).cast("int")), ("item", "part"), top)
    best = C.materialize(_merged(lists, ("item",), top), "ranked")
    names = [i for i, _ in items]
    kind = asked.schema["item"].dataType
    named = spark.createDataFrame([(k, i) for k, i in enumerate(names)], f"item int, item_id {kind.simpleString()}")
    hits = best.join(F.broadcast(named), "item").select("item_id", F.posexplode(F.arrays_zip("scores", "known", "ids")).alias("at", "x"))  # a row an item of the block
    return hits.select("item_id", (F.col("at") + 1).alias("rank"), F.when(F.col("x.known") == 1, F.col("x.ids")).alias("doc_id"), F.col("x.scores").alias("score"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))


_TERMS_SQL = r"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), [])"
ORACLE = {
    "op12_ranked_search": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS_SQL} AS t FROM documents),
s AS (SELECT count(*) AS N, CAST(sum(len(t)) AS BIGINT) AS L FROM d WHERE len(t) > 0),
q AS (SELECT DISTINCT item_id, unnest({_TERMS_SQL}) AS term FROM benchmark),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(N) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY term),
norms AS (SELECT r, doc_id, 100 - 50 + ((50 * len(t) * N) // L) AS m FROM d, s WHERE len(t) > 0),
scores AS (
  SELECT item_id, r, any_value(doc_id) AS doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN norms USING (r) GROUP BY item_id, r)
SELECT item_id, CAST(n AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS n FROM scores WHERE score > 0) WHERE n <= {TOP}
"""
}
QUERIES = {"op12_ranked_search": op12_ranked_search}
