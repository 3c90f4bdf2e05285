"""Benchmark decontamination by Wu-Manber search for many word windows at once.

A text's words are runs of ASCII letters, digits and non-ASCII characters after A-Z became a-z.  A benchmark
item gives its windows of 13 consecutive words, or one shorter window if it has fewer.  Windows of equal length
share one searcher over the alphabet of words: a shift table of word blocks tells how far the search may jump,
a block with shift 0 selects a bucket of windows by suffix and first word, and a direct comparison confirms.

Items are cut into pieces of a bounded number of windows, and the pieces dealt into blocks of about
``BLOCK_BYTES``, each a broadcast of its own.  One stage reads the documents: a worker holds the searchers of at most
``KEPT_BLOCKS`` blocks; of a larger benchmark it builds the others anew for every ``BUFFER_BYTES`` of documents.
Nothing is shuffled, and hits of the blocks are added up in the row itself.

Defined cases: a null, empty or wordless text has no words and no hits; an item without words has no windows;
an item without id is searched (its hits count) but not listed; items that share an id count once; a very long text
or item is searched whole; repeated documents give repeated rows; an empty benchmark gives no hits, an empty table
no rows; overlapping occurrences, of one item or several, count each word once; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

WINDOW = 13
#: Bytes of benchmark words in a block; about seventy times as many are a worker's searchers of it.
BLOCK_BYTES = 1 << 20
#: Windows of an item in a piece.
PIECE_WINDOWS = 1_024
#: Blocks whose searchers a worker keeps, and the bytes of documents for which it builds those of other blocks.
KEPT_BLOCKS, BUFFER_BYTES = 4, 8 << 20
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD).split() if text else []


class Searcher:
    """Wu-Manber over words for windows of one length."""

    def __init__(self, length: int, block: int = 3):
        self.length, self.block = length, min(block, length)
        self.jump = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[bytes, list[tuple[list[bytes], int, object]]]] = {}

    def add(self, words: list[bytes], start: int, item: object) -> None:
        """The window of an item's words that begins at ``start``."""
        n, b = self.length, self.block
        for end in range(b, n + 1):
            key = tuple(words[start + end - b : start + end])
            if n - end < self.shift.get(key, self.jump):
                self.shift[key] = n - end
        bucket = self.buckets.setdefault(tuple(words[start + n - b : start + n]), {})
        bucket.setdefault(words[start], []).append((words, start, item))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set]]:
        """Start and items of each occurrence, from left to right."""
        n, b, shift, jump = self.length, self.block, self.shift.get, self.jump
        end, total = n, len(words)
        while end <= total:
            key = tuple(words[end - b : end])
            step = shift(key, jump)
            if step:
                end += step
                continue
            start = end - n
            if candidates := self.buckets[key].get(words[start]):
                here = words[start:end]
                found = {item for own, at, item in candidates if own[at : at + n] == here}
                if found:
                    yield start, found
            end += 1


def pieces_of(words: list[bytes], window: int, size: int = PIECE_WINDOWS) -> Iterator[list[bytes]]:
    """An item's words in pieces that have all its windows, each window in one piece."""
    n = min(window, len(words))
    for start in range(0, len(words) - n + 1, size):
        if words:
            yield words[start : start + size + n - 1]


def searchers(items: list[tuple[object, str | None]], window: int = WINDOW) -> list[Searcher]:
    """One searcher for each window length in the items (or pieces of items)."""
    by_length: dict[int, Searcher] = {}
    for item, text in items:
        words = words_of(text)
        if words:
            n = min(window, len(words))
            searcher = by_length.setdefault(n, Searcher(n))
            for i in range(len(words) - n + 1):
                searcher.add(words, i, item)
    return [by_length[n] for n in sorted(by_length)]


_cache: dict[str, list[Searcher]] = {}


def _built(key: str, shared, window: int, keep: bool) -> list[Searcher]:
    """The searchers of a block; with ``keep`` they stay in this worker until another benchmark comes."""
    if key in _cache:
        return _cache[key]
    if any(k.split()[0] != key.split()[0] for k in _cache):
        _cache.clear()
    found = searchers(shared.value, window)
    vars(shared).pop("_value", None)  # the block's rows are not needed any more
    if keep:
        _cache[key] = found
    return found


def _blocks(bench: DataFrame, item_col: str, text_col: str, limit: int, window: int) -> Iterator[list[tuple[str | None, str]]]:
    """The pieces (item as string, words) of the benchmark in blocks of about ``limit`` bytes, read one block at a time."""
    C.prepare(bench.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in C.text_slices(batches):
            items, out = [], []
            for item, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                for piece in pieces_of(words_of(text), window):
                    items.append(item)
                    out.append(b" ".join(piece).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(out, pa.string())], names=["item", "text"])

    rows = bench.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    pieces = rows.mapInArrow(cut, "item string, text string").distinct()
    total = pieces.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if total <= limit:
        yield [tuple(r) for r in pieces.collect()]  # at most ``limit`` bytes
        return
    n = 2 * -(-total // limit)
    written = C.materialize(pieces.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n))).repartitionByRange("block").sortWithinPartitions("block"), "benchmark")
    for k in range(n):
        yield [tuple(r) for r in written.where(F.col("block") == k).select("item", "text").collect()]  # pieces are small beside a block, so it has about half of ``limit``
    C.discard(written)


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, share: int = 20, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: the id, ``n_words``, ``n_hit``, ``n_items``, ``items`` array<string> sorted, ``contaminated``.

    ``hits`` array<bigint> has start and end of each hit run in words.  A document is contaminated if it has hit
    words and ``share * n_hit >= n_words``.  ``keep`` names columns of the documents to carry along, as ``k__<name>``.
    """
    spark = docs.sparkSession
    C.prepare(spark)
    carried = [c for c in keep if c != text_col]
    source = docs.select(F.col(id_col).alias("__0"), F.col(text_col).cast("string").alias("__1"), *(F.col(c).alias(f"k__{c}") for c in carried))
    text_goes_on = text_col in keep
    found_fields = "n_words bigint, n_hit bigint, hits array<bigint>, items array<string>"
    head = [f"__0 {source.schema[0].dataType.simpleString()}", *(["__1 string"] if text_goes_on else [])]
    schema = ", ".join([*head, found_fields, *(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[2:])])
    name = uuid.uuid4().hex
    shared = [spark.sparkContext.broadcast(block) for block in _blocks(bench, item_col, item_text_col, block_bytes, window)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few = len(shared) <= KEPT_BLOCKS
        for part in C.text_slices(batches, limit=C.SLICE_BYTES if few else BUFFER_BYTES):
            texts = [words_of(t) for t in C.text_array(part.column(1)).to_pylist()]
            spans: list[list[tuple[int, int]]] = [[] for _ in texts]
            names: list[set] = [set() for _ in texts]
            for k, block in enumerate(shared):
                for searcher in _built(f"{name} {k}", block, window, few or k < KEPT_BLOCKS):
                    for words, own, items in zip(texts, spans, names, strict=True):
                        for start, owners in searcher.search(words):
                            if own and own[-1][0] <= start <= own[-1][1]:
                                own[-1] = (own[-1][0], max(own[-1][1], start + searcher.length))
                            else:
                                own.append((start, start + searcher.length))
                            items |= owners
            spans = [merge(own) for own in spans]
            columns = [part.column(0), *([part.column(1)] if text_goes_on else []), pa.array(list(map(len, texts)), pa.int64()), pa.array([sum(b - a for a, b in own) for own in spans], pa.int64())]
            columns += [pa.array([[x for span in own for x in span] for own in spans], pa.list_(pa.int64())), pa.array([sorted(x for x in items if x is not None) for items in names], pa.list_(pa.string())), *part.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, names=["__0", *(["__1"] if text_goes_on else []), "n_words", "n_hit", "hits", "items", *part.schema.names[2:]])

    out = source.mapInArrow(run, schema)
    bad = (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words"))
    back = [F.col("__1" if c == text_col else f"k__{c}").alias(f"k__{c}") for c in keep]
    return out.select(F.col("__0").alias(id_col), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), "items", bad.alias("contaminated"), "hits", *back)


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open spans, in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def decontaminate(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns; the texts are not shuffled."""
    kept = contamination(docs, bench, keep=tuple(docs.columns), **options).where(~F.col("contaminated"))
    return kept.select(*(F.col(f"k__{c}").alias(c) for c in docs.columns))


def op1_wu_manber_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_WORDS_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = {
    "op1_wu_manber_decontamination": rf"""
WITH d AS (SELECT doc_id, coalesce({_WORDS_SQL}, []) AS w FROM documents),
b AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
found AS (SELECT g.doc_id, g.i, g.n, x.item_id FROM grams g JOIN windows x ON g.win = x.win AND g.n = x.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS list
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
}
QUERIES = {"op1_wu_manber_decontamination": op1_wu_manber_decontamination}
