"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Toxic documents go, later copies of line runs are cut, one document of each near-duplicate group stays, documents
contaminated by the benchmark go, and what is left is encoded to token ids (and decoded again, for its digest).
All stages but the last return the columns of ``documents``; ``n_chars`` follows the text where lines were cut.

Defined cases: null and empty texts are one group of near-duplicates, of which one row stays; rows that share id and
text count as copies; of equal copies the first by id, then by text hash, keeps its lines; a very long text goes through
each stage whole; an empty table gives an empty result; other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalmill.llm import _common as C
from vocalmill.llm import bpe, decontamination, linededup, simhash, toxicity


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, C.table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    deleted = C.unused(docs, "deleted")
    cut = linededup.dedup(docs, count_col=deleted)
    if "n_chars" in docs.columns:
        size = F.length("text").cast(docs.schema["n_chars"].dataType)
        cut = cut.withColumn("n_chars", F.when(F.col(deleted) > 0, size).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, C.table(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("byte_bpe", bpe_stage),
]
#: No SQL: the toxicity chain, XXH64 fingerprints and byte-level BPE can't be written in it; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; the stages between are written to the shared folder."""
    docs = C.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = C.materialize(docs, name)
    return docs
