"""Line dedup: a suffix array over the lines shows what is repeated, and later copies are deleted.

The text is the sequence of all non-blank lines of all documents, in order of id (then of text hash), with a gap
after each document.  Every line has a position in it and a 128-bit content hash as its id.  :mod:`suffixarray` orders
the suffixes by prefix doubling and gives, for each position, the longest run of lines from there that also begins at a
lesser position: the maximal repeats, seen from their later copies.

A repeated run counts from ``min_words`` words.  So only suffixes whose first ``least`` lines (the fewest with that many
words) may be repeated enter the prefixes; neighbours with shorter common prefixes part the array into intervals, and
in an interval every suffix but the one at the least position begins a later copy.  Lines of such runs are deleted.
Positions run within range partitions, so no task sees all lines.

Defined cases: a null text stays null, an empty one empty; a very long text is read whole, a row for each line; blank
lines match nothing and go with a deleted line before them; rows that share id and text are one document and get the
same result; of equal runs the one in the least id (null first), then in the least text hash, then further up stays;
the first copy of a line is never deleted; a document may end up empty; an empty table gives an empty result; other
columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C
from . import suffixarray

MIN_WORDS = 50
#: Bits of a position that count lines within a range partition.
LINE_BITS = 42
#: Bits of the filter that tells which documents may have lines to delete; 64 of them a row that is broadcast.
FILTER_BITS = 1 << 25


def least_lines(counts: np.ndarray, least: int) -> np.ndarray:
    """For each line the fewest lines from it on that have at least ``least`` words; 0 where the document has too few."""
    ends = np.cumsum(counts)
    stop = np.searchsorted(ends, ends - counts + least, side="left")
    return np.where(stop < len(ends), stop - np.arange(len(ends)) + 1, 0).astype(np.int32)


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each document that has non-blank lines: its key, and its lines' hashes and word counts."""
    source = C.id_and_text(docs, id_col, text_col)
    schema = f"__id {source.schema[0].dataType.simpleString()}, th bigint, lines binary, words array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in C.text_slices(batches):
            rows, keys, lines, words = [], [], [], []
            for row, text in enumerate(C.text_array(part.column(1)).to_pylist()):
                raw = text.encode("utf-8", "surrogatepass")
                counted = [(line, n) for line in raw.split(b"\n") if (n := len(line.split()))]
                if counted:
                    rows.append(row)
                    keys.append(xxhash.xxh64_intdigest(raw, 42))
                    lines.append(b"".join(xxhash.xxh3_128_digest(line) for line, _ in counted))
                    words.append([n for _, n in counted])
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(lines, pa.binary()), pa.array(words, pa.list_(pa.int32()))], names=["__id", "th", "lines", "words"])

    return source.mapInArrow(run, schema)


def _positions(hashed: DataFrame, least: int) -> DataFrame:
    """A row for each line: position, hash, place in the document, ``least`` lines, and the key of the document."""
    id_type = hashed.schema[0].dataType.simpleString()
    schema = f"pos bigint, h1 bigint, h2 bigint, line int, least int, __id {id_type}, th bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = TaskContext.get().partitionId() << LINE_BITS, None
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                pos, hashes, line, fewest, rows = [], [], [], [], []
                for row, (key, th, raw, words) in enumerate(zip(*(c.to_pylist() for c in part.columns), strict=True)):
                    if (key, th) == last:
                        continue
                    last = (key, th)
                    n = len(words)
                    pos.append(np.arange(at, at + n))
                    hashes.append(np.frombuffer(raw, np.int64).reshape(-1, 2))
                    line.append(np.arange(n, dtype=np.int32))
                    fewest.append(least_lines(np.array(words, np.int64), least))
                    rows.append(np.full(n, row))
                    at += n + 1
                if pos:
                    pair = np.concatenate(hashes)
                    take = pa.array(np.concatenate(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(pos)), pa.array(np.ascontiguousarray(pair[:, 0])), pa.array(np.ascontiguousarray(pair[:, 1])), pa.array(np.concatenate(line)), pa.array(np.concatenate(fewest)), part.column(0).take(take), part.column(1).take(take)], names=["pos", "h1", "h2", "line", "least", "__id", "th"])

    parts = C.shuffle_parts(hashed)
    return hashed.repartitionByRange(parts, "__id", "th").sortWithinPartitions("__id", "th").mapInArrow(run, schema)


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(__id, th, runs): for each document with later copies, runs (start, length) of non-blank lines to delete."""
    before = C.written()
    hashed = C.materialize(_hashed(docs, id_col, text_col), "lines")
    lines = C.materialize(_positions(hashed, min_words), "positions")
    ranks = suffixarray.suffix_ranks(lines, C.shuffle_parts(lines))
    # a suffix whose first ``least`` lines are repeated had a repeated block of at least half as many
    able = ranks.final.join(lines.where("least > 0").select("pos", "least"), "pos").where(F.col("least") < F.call_function("shiftleft", F.lit(2).cast("bigint"), F.col("level")))
    candidates = C.materialize(able.join(ranks.levels[0].select("pos", F.col("rank").alias("line")), "pos").select("rank", "pos", "least", "line"), "candidates")
    found = suffixarray.earlier_copies(suffixarray.common_prefixes(candidates, ranks), ranks)
    placed = found.join(lines.select("pos", "line", "__id", "th"), "pos")
    runs = C.materialize(placed.groupBy("__id", "th").agg(F.collect_list(F.struct("line", F.col("length").alias("m"))).alias("runs")), "runs")
    C.discard_others(docs.sparkSession, before, runs)
    return runs


def without_runs(text: str, runs: list[tuple[int, int]]) -> tuple[str, int]:
    """The text without the lines of the runs, and their number."""
    kept, i, dropped, cut = [], -1, 0, False
    runs = sorted(runs)
    at, end = 0, 0  # runs taken so far reach to ``end``
    for line in text.split("\n"):
        if line.encode("utf-8", "surrogatepass").split():
            i += 1
            while at < len(runs) and runs[at][0] <= i:
                end = max(end, sum(runs[at]))
                at += 1
            cut = i < end
            dropped += cut
        if not cut:
            kept.append(line)
    return "\n".join(kept), dropped


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, count_col: str | None = None) -> DataFrame:
    """All rows and columns of ``docs``, with later copies of line runs deleted from the text.

    ``count_col`` names a column to add, the number of deleted lines.  A filter of ``FILTER_BITS`` bits over the
    documents with runs lets the others pass by without a shuffle; those that it can't tell apart only cost one.
    """
    runs = repeated_runs(docs, id_col, text_col, min_words)
    here = docs.select(*(F.col(c).alias(f"c{k}") for k, c in enumerate(docs.columns)))
    key, text = f"c{docs.columns.index(id_col)}", f"c{docs.columns.index(text_col)}"
    right = runs.select(F.col("__id").alias("r_id"), F.col("th").alias("r_th"), "runs").hint("merge")
    bit = lambda th: F.pmod(th, F.lit(FILTER_BITS))
    words = runs.select(F.shiftright(bit(F.col("th")), 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit(F.col("th")).bitwiseAND(F.lit(63)).cast("int")).alias("b")).groupBy("word").agg(F.bit_or("b").alias("bits"))
    words = C.materialize(words, "filter")
    th = F.xxhash64(F.col(text).cast("string"))
    marked = here.withColumn("th", th).withColumn("word", F.shiftright(bit(F.col("th")), 6)).join(F.broadcast(words), "word", "left")  # at most FILTER_BITS / 64 rows of two numbers
    may = F.coalesce(F.getbit("bits", bit(F.col("th")).bitwiseAND(F.lit(63))) == 1, F.lit(False))
    passed = marked.where(~may)
    joined = marked.where(may).join(right, F.col(key).eqNullSafe(F.col("r_id")) & (F.col("th") == F.col("r_th")), "left")

    at = docs.columns.index(text_col)
    names = [*docs.columns, *([count_col] if count_col else [])]
    fields = [f"c{k}" for k in range(len(docs.columns))]
    source = joined.select(*fields, "runs")
    schema = source.drop("runs").withColumn("n_deleted", F.lit(0).cast("bigint")).schema

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in C.text_slices(batches, at):
            spans = part.column(len(fields)).to_pylist()
            hit = [i for i, s in enumerate(spans) if s]
            texts, counts = part.column(at), np.zeros(part.num_rows, np.int64)
            if hit:
                values = texts.to_pylist()
                for i in hit:
                    values[i], counts[i] = without_runs(values[i], [(s["line"], s["m"]) for s in spans[i]])
                texts = pa.array(values, part.schema.field(at).type)
            columns = [texts if k == at else part.column(k) for k in range(len(fields))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts)], names=[*fields, "n_deleted"])

    out = source.mapInArrow(apply, schema).unionByName(passed.select(*fields, F.lit(0).cast("bigint").alias("n_deleted")))
    return out.select(*(F.col(f).alias(n) for f, n in zip([*fields, "n_deleted"], names, strict=False)))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(C.table(spark, sf_dir, "documents").select("doc_id", "text"), count_col="n_deleted")


_TEXT = """
lines AS (
  SELECT doc_id, i, s[i] AS line, len(regexp_extract_all(s[i], '[^\\x20\\x09-\\x0D]+')) AS n
  FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM {docs}))),
full_lines AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM lines WHERE n > 0),
wins AS (
  SELECT a.doc_id, a.k AS s, min(b.k) AS e FROM full_lines a JOIN full_lines b ON a.doc_id = b.doc_id AND b.k >= a.k AND b.c - (a.c - a.n) >= {least} GROUP BY ALL
  UNION
  SELECT b.doc_id, max(a.k) AS s, b.k AS e FROM full_lines a JOIN full_lines b ON a.doc_id = b.doc_id AND b.k >= a.k AND b.c - (a.c - a.n) >= {least} GROUP BY b.doc_id, b.k),
content AS (
  SELECT w.doc_id, w.s, w.e, string_agg(f.line, chr(10) ORDER BY f.k) AS body FROM wins w JOIN full_lines f ON f.doc_id = w.doc_id AND f.k BETWEEN w.s AND w.e GROUP BY w.doc_id, w.s, w.e),
later AS (
  SELECT doc_id, s, e FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, s) AS nth FROM content) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS k FROM later),
marked AS (
  SELECT l.doc_id, l.i, l.line, l.n, g.k IS NOT NULL AS cut,
    last_value(CASE WHEN l.n > 0 THEN g.k IS NOT NULL END IGNORE NULLS) OVER (PARTITION BY l.doc_id ORDER BY l.i) AS goes
  FROM lines l LEFT JOIN full_lines f ON f.doc_id = l.doc_id AND f.i = l.i LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.k = f.k),
deduped AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT coalesce(goes, false)), '') AS text, CAST(count(*) FILTER (WHERE cut) AS BIGINT) AS n_deleted
  FROM marked GROUP BY doc_id)
"""


def sql_ctes(docs: str, least: int = MIN_WORDS) -> str:
    """Common table expressions that end in ``deduped`` (doc_id, text, n_deleted), for documents with unique ids."""
    return _TEXT.format(docs=docs, least=least)


QUERIES = {"op9_line_dedup": op9_line_dedup}
ORACLE = {"op9_line_dedup": f"WITH {sql_ctes('documents')} SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE x.text END AS text, coalesce(x.n_deleted, 0) AS n_deleted FROM documents d LEFT JOIN deduped x USING (doc_id)"}
