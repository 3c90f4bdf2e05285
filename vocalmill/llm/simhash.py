"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked where few bits differ.

Texts are lower-cased (A-Z), cut at ASCII white space, and every run of three words is hashed by XXH64 with
seed 42; a bit of the fingerprint is 1 if it is set in over half the hashes.  Links follow the pigeonhole
principle: of four 16-bit blocks, two fingerprints that differ in two bits agree in at least two, so each
distinct fingerprint is filed under the six pairs of its blocks, and those filed together are compared.

A pair of blocks that more than ``BUCKET`` fingerprints share is not compared pair by pair.  Its members are
filed under themselves and their 64 one-bit neighbours instead: two of them share such a neighbour exactly if
they differ in at most two bits, at most 65 fingerprints can share one, and all of those are linked.  So no
link is lost and no group's pairs are listed.  Components come from :mod:`components` over distinct fingerprints.

Defined cases: a null, empty or blank text has fingerprint zero, linked like any other; fewer than three words
are one shingle; repeated rows share a component; a null id gives a row but never names a component unless the
component has no other id; a very long text is fingerprinted whole, in slices of its hashes; of equal ids in a
component the least fingerprint stays; an empty table gives an empty result; other columns pass through, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C
from .components import components

SHINGLE, SEED, DISTANCE = 3, 42, 2
BLOCKS = 4
#: Fingerprints under one pair of blocks that are compared with one another; above it the exact way by neighbours is taken.
BUCKET = 64


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(C.ASCII_LOWER).split() if text else []


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    words = words_of(text)
    if not words:
        return 0
    if len(words) <= shingle:
        pieces = [b" ".join(words)]
    else:
        pieces = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), np.uint64)
    bits = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 65536):
        part = hashes[start : start + 65536]
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, ``fp`` bigint) for every row."""
    source = C.id_and_text(docs, id_col, text_col)
    schema = f"__id {source.schema[0].dataType.simpleString()}, fp bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in C.text_slices(batches):
            values = np.array([fingerprint(t, shingle) for t in C.text_array(part.column(1)).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(values.view(np.int64))], names=["__id", "fp"])

    return source.mapInArrow(run, schema).withColumnRenamed("__id", id_col)


def _block(k: int):
    return F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF))


def links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between the distinct values of the bigint column ``fp``; those left out follow from those given."""
    pairs = [F.struct(F.lit(t).alias("t"), F.shiftleft(_block(i), 16).bitwiseOR(_block(j)).alias("k")) for t, (i, j) in enumerate(combinations(range(BLOCKS), 2))]
    filed = distinct.select("fp", F.explode(F.array(*pairs)).alias("x")).select("fp", (F.shiftleft(F.col("x.t").cast("bigint"), 32).bitwiseOR(F.col("x.k"))).alias("key"))
    shared = C.materialize(filed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    met = C.materialize(filed.join(shared, "key"), "filed")
    close = F.flatten(F.transform("fps", lambda x: F.transform(F.filter("fps", lambda y: (y < x) & (F.bit_count(x.bitwiseXOR(y)) <= DISTANCE)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    few = met.where(F.col("n") <= bucket).groupBy("key").agg(F.collect_list("fp").alias("fps")).select(F.explode(close).alias("p")).select("p.a", "p.b")
    flips = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63)).cast("bigint")) for i in range(64)))
    many = met.where(F.col("n") > bucket).select("fp").distinct().select("fp", F.explode(flips).alias("near"))
    starred = many.groupBy("near").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1").select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).where("a != b")
    return few.union(starred)


def _owners(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of all rows, and for each distinct one (``fp``) its ``root`` fingerprint and ``component_id``."""
    prints = C.materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    values = C.materialize(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "values")
    roots = components(links(values.select("fp")))
    named = values.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = C.materialize(named, "named")
    linked = named.where("root != fp").select("root").distinct()
    of_root = named.join(linked, "root", "left_semi").groupBy("root").agg(F.min("least").alias("component"))
    return prints, C.materialize(named.join(of_root, "root", "left").select("fp", "root", F.coalesce("component", "least").alias("component_id")), "owners")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ``fingerprint`` (16 hex digits), ``component_id`` (least id of the component)."""
    prints, owner = _owners(docs, id_col, text_col)
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(owner.drop("root"), "fp").select(id_col, hexed.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all columns: the one whose id names it.

    Of several fingerprints under that id in the component the least stays.  A component that has no id at all is
    represented by any one of its rows.  Texts are shuffled once, by id; only those of an id that has several
    fingerprints are fingerprinted again, so that the id's other texts don't pass for the one kept.
    """
    prints, owner = _owners(docs, id_col, text_col)
    fields = [f"c{k}" for k in range(len(docs.columns))]
    here = docs.select(*(F.col(c).alias(f) for c, f in zip(docs.columns, fields, strict=True)))  # no name can clash from here on
    own, at = fields[docs.columns.index(id_col)], docs.columns.index(text_col)
    prints = prints.withColumnRenamed(id_col, "id")
    kept = prints.join(owner, "fp").where(F.col("id") == F.col("component_id")).groupBy("root").agg(F.min("id").alias("kept"), F.min("fp").alias("kept_fp"))
    kept = C.materialize(kept.drop("root"), "kept")
    several = prints.where("id IS NOT NULL").groupBy(F.col("id").alias("several")).agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a != b").select("several")
    several = C.materialize(several, "several")
    single = kept.join(several, F.col("kept") == F.col("several"), "left_anti")
    named = here.join(single, F.col(own) == F.col("kept"), "left_semi").dropDuplicates([own])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in C.text_slices(batches, at):
            values = np.array([fingerprint(t) for t in C.text_array(part.column(at)).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values.view(np.int64))], names=[*fields, "fp"])

    def printed(rows: DataFrame) -> DataFrame:
        return rows.mapInArrow(add, rows.withColumn("fp", F.lit(0).cast("bigint")).schema)

    alone = printed(here.where(F.col(own).isNull())).join(owner.where("component_id IS NULL"), "fp").dropDuplicates(["root"])
    out = named.unionByName(alone.select(*fields))
    if not several.isEmpty():
        again = printed(here.join(several, F.col(own) == F.col("several"), "left_semi"))
        again = again.join(kept, (F.col(own) == F.col("kept")) & (F.col("fp") == F.col("kept_fp")), "left_semi").dropDuplicates([own, "fp"])
        out = out.unionByName(again.select(*fields))
    return out.select(*(F.col(f).alias(c) for f, c in zip(fields, docs.columns, strict=True)))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.table(spark, sf_dir, "documents"))


QUERIES = {"op5_simhash_near_dedup": op5_simhash_near_dedup}
ORACLE: dict[str, str] = {}
