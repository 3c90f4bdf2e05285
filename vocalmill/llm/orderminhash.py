"""Order MinHash fingerprints: signatures that estimate closeness under edits, not only shared content.

A text's k-mers of characters are numbered by occurrence, so that repeats count.  For each of ``SKETCHES`` random
orders the two least (k-mer, occurrence) pairs are selected; their k-mers are put back in text order and hashed
as a tuple.  Moving text around changes tuples though the set of k-mers stays, as does an edit.  The likeness of
two signatures is the share of equal entries.

For each document an edited text is also fingerprinted: its last half replaced by the beginning of the next
document.  Next means by ascending id (then by text hash), and after the last comes the first.  Documents are
dealt once, by key ranges of which each task gets one; the first of each range also goes to the range before, so no
text is joined or sorted globally.  The driver sees two keys a range.

Defined cases: a null text is empty; an empty text has an all-zero signature; a text shorter than k is its own
only k-mer; a single k-mer makes a tuple of one; a very long text is fingerprinted whole, in tables of a bounded
number of cells; repeated rows follow one another; of equal ids the lesser text hash comes first; null ids come
first; of equal least k-mers the one earlier in the text is taken; a table of one row is followed by itself; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C
from . import _hashing as H

K = 5
SKETCHES = 64
#: Elements of a sketch table that are computed at once.
CELLS = 1 << 20
_ODD = H.mix(np.arange(1, SKETCHES + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)
_TOP = np.uint32(0xFFFFFFFF)


def kmers(text: str, k: int = K) -> np.ndarray:
    """A 64-bit hash of each k-mer of characters, in text order."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(codes) - k + 1
    if n < 1:
        codes, n, k = codes, min(len(codes), 1), len(codes)
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n]
    return H.mix(out + np.uint64(k))


def numbered(hashes: np.ndarray) -> np.ndarray:
    """32-bit hashes of (k-mer, occurrence): the occurrence is the number of equal k-mers before."""
    n = len(hashes)
    # sort hashes whose low bits give way to the position: equal k-mers end up together, in text order
    low = np.uint64((1 << n.bit_length()) - 1)
    line = np.sort((hashes & ~low) | np.arange(n, dtype=np.uint64))
    order = (line & low).astype(np.int64)
    new = np.empty(n, bool)
    new[:1] = True
    np.greater((line[1:] ^ line[:-1]), low, out=new[1:])
    at = np.arange(n)
    nth = np.empty(n, np.uint64)
    nth[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return (H.mix(hashes + nth * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(32)).astype(np.uint32)


def signature(text: str) -> np.ndarray:
    """``SKETCHES`` 16-bit hashes of ordered tuples."""
    hashes = kmers(text)
    n = len(hashes)
    if not n:
        return np.zeros(SKETCHES, np.uint16)
    base = numbered(hashes)
    first, second = np.empty(SKETCHES, np.int64), np.empty(SKETCHES, np.int64)
    step = max(1, CELLS // n)
    for start in range(0, SKETCHES, step):
        table = base[None, :] * _ODD[start : start + step, None]
        rows = np.arange(len(table))
        a = table.argmin(axis=1)
        table[rows, a] = _TOP
        first[start : start + step] = a
        second[start : start + step] = table.argmin(axis=1) if n > 1 else a
    low, high = np.minimum(first, second), np.maximum(first, second)
    tuples = H.mix(hashes[low] * np.uint64(3) + (H.mix(hashes[high]) if n > 1 else np.uint64(0)))
    return (tuples >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.count_nonzero(a == b)) / SKETCHES


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _key(id_, th: int) -> tuple:
    return (False, 0, th) if id_ is None else (True, id_, th)


def range_starts(keys: DataFrame, parts: int) -> list[tuple]:
    """The least key of each range of (``__id``, ``th``), in order; two numbers for each of at most ``parts`` ranges."""
    id_type = keys.schema[0].dataType.simpleString()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = False
        for batch in batches:
            if batch.num_rows and not done:
                done = True
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(0, 1), batch.column(1).slice(0, 1)], names=["__id", "th"])

    ranged = keys.repartitionByRange(parts, "__id", "th").sortWithinPartitions("__id", "th")
    return sorted({_key(r[0], r[1]) for r in ranged.mapInArrow(first, f"__id {id_type}, th bigint").collect()})


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's columns for each row."""
    source = C.id_and_text(docs, id_col, text_col).withColumn("th", F.xxhash64("__text"))
    parts = C.shuffle_parts(docs.select(id_col, text_col))
    starts = range_starts(C.materialize(source.select("__id", "th"), "keys"), parts)
    id_type = source.schema[0].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(starts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = shared.value
        for part in C.text_slices(batches):
            rows, ranges, ahead = [], [], []
            for row, (id_, th) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True)):
                key = _key(id_, th)
                at = max(bisect_right(firsts, key) - 1, 0)
                rows.append(row)
                ranges.append(at)
                ahead.append(0)
                if firsts[at] == key:
                    rows.append(row)
                    ranges.append((at - 1) % len(firsts))
                    ahead.append(1)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), pa.array(ahead, pa.int32()), *(c.take(take) for c in part.columns)], names=["range", "ahead", "__id", "__text", "th"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row whose next document has not come yet
        out: list[tuple] = []
        for part in C.text_slices(batches, 3):
            for at, ahead, id_, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), C.text_array(part.column(3)).to_pylist(), strict=True):
                if ahead and held is None:
                    continue
                mine = signature(text)
                if held is not None:
                    old_id, old, theirs = held
                    new = edited(old, text)
                    changed = signature(new)
                    out.append((old_id, len(old), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), theirs.tobytes().hex(), changed.tobytes().hex(), likeness(theirs, changed), likeness(theirs, mine)))
                held = None if ahead else (id_, text, mine)
            if out:
                yield _batch(out, part.schema.field(2).type)
                out = []

    dealt = source.mapInArrow(deal, f"range int, ahead int, __id {id_type}, __text string, th bigint")
    ordered = dealt.repartitionById(max(1, len(starts)), F.col("range")).sortWithinPartitions("ahead", "__id", "th")  # one range a task
    schema = f"__id {id_type}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.mapInArrow(run, schema).withColumnRenamed("__id", id_col)


def _batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    types = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["__id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(C.table(spark, sf_dir, "documents"))


QUERIES = {"op2_order_minhash": op2_order_minhash}
ORACLE: dict[str, str] = {}
