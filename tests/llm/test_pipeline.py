"""The pipeline on planted cases, stage by stage, and the registered queries on the smallest tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vocalmill.llm import registry, simhash
from vocalmill.llm.decontamination import words_of

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")


@needs_tables
def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "decontamination", "byte_bpe"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns
        after = {r.doc_id: r for r in out.collect()}
        assert after.keys() <= before.keys() <= ids
        if name == "line_dedup":
            assert after.keys() == before.keys() and all(r.n_chars == len(r.text) for r in after.values())
            assert all(len(after[i].text) <= len(before[i].text) for i in after)
        else:
            assert all(after[i] == before[i] for i in after)
        if name == "simhash_near_dedup":
            prints = [simhash.fingerprint(r.text) for r in after.values()]
            assert all((a ^ b).bit_count() > 2 for k, a in enumerate(prints) for b in prints[:k])
        docs = spark.createDataFrame(list(after.values()), docs.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert last.count() == docs.count()


def test_planted_cases(spark, tmp_path):
    item = " ".join(f"bench{i}" for i in range(30))
    passage = " ".join(f"pass{i}" for i in range(55))
    body = lambda k: "\n".join(" ".join(f"doc{k}w{i}x{j}" for i in range(12)) for j in range(6))
    docs = [(i, body(i), "en", "s", 0) for i in range(40)]
    docs += [(100, body(3), "en", "s", 0), (101, body(4) + "\n" + passage, "en", "s", 0), (102, body(50) + "\n" + passage, "en", "s", 0), (103, item, "en", "s", 0), (104, body(60) + " " + " ".join(item.split()[:20]), "en", "s", 0), (105, "You vile knave and rotter", "en", "s", 0), (106, None, None, None, None), (107, "", "en", "s", 0)]
    labels = [(i, 1, 0) for i in range(40)] + [(200 + i, 1, 1) for i in range(30)]
    docs += [(200 + i, f"talk{i} of{i} a vile knave and rotter here{i}", "en", "s", 0) for i in range(30)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = {r.doc_id for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect()}
    assert set(range(40)) | {101, 102} <= left
    assert not left & {103, 104, 105, *range(200, 230)}
    assert len(left & {100, 106, 107}) == 1  # emptied copies and empty texts are one group
    assert len(words_of(item)) == 30


@pytest.fixture(scope="module")
def odd_tables(tmp_path_factory, spark):
    """Few rows with every odd case: nulls, an empty and a very long text, repeated rows, names that clash."""
    folder = tmp_path_factory.mktemp("odd")
    long = " ".join(f"long{i % 977}x{i}" for i in range(30_000))
    rows = [(None, "a text without an id of its own", None), (1, None, "1"), (2, "", "x"), (3, long, "3"), (3, long, "3"), (4, "one plain line of text here", "4"), (4, "another text under that id", "4")]
    schema = "doc_id long, text string, n_chars string"
    extra = ("__deleted", "__kept", "kept", "fp", "root", "deleted", "c0", "rejected", "k__text", "runs", "__id", "th", "n_deleted", "items", "lang")
    docs = spark.createDataFrame(rows, schema)
    for k, name in enumerate(extra):
        docs = docs.withColumn(name, F.lit(k))
    docs.write.parquet(f"{folder}/full/documents.parquet")
    docs.limit(0).write.parquet(f"{folder}/empty/documents.parquet")
    for where in ("full", "empty"):
        spark.createDataFrame([(1, 1, 0), (None, 1, 1), (3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/{where}/labels.parquet")
        spark.createDataFrame([(1, None), (None, "")], "item_id long, text string").write.parquet(f"{folder}/{where}/benchmark.parquet")
    return folder, extra


def test_odd_tables_go_through_all_stages(spark, odd_tables):
    folder, extra = odd_tables
    docs = spark.read.parquet(f"file://{folder}/full/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, f"file://{folder}/full")
        assert out.columns == docs.columns and out.schema["n_chars"].dataType.simpleString() == "string", name
        docs = spark.createDataFrame(out.collect(), docs.schema)
    assert sorted((r.doc_id is None, r.doc_id or 0, len(r.text or "")) for r in docs.collect()) == sorted([(True, 0, 31), (False, 1, 0), (False, 3, docs.where("doc_id = 3").first().text.__len__()), (False, 4, 27), (False, 4, 26)])
    assert all(getattr(r, name) == k for r in docs.collect() for k, name in enumerate(extra) if not name.startswith("__"))
    assert corpus_pipeline.run(spark, f"file://{folder}/full").count() == 5


def test_empty_tables_go_through_all_stages(spark, odd_tables):
    assert corpus_pipeline.run(spark, f"file://{odd_tables[0]}/empty").count() == 0


@needs_tables
@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_equals_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{FOLDER}/{table}.parquet')")
    df = registry.QUERIES[name](spark, FOLDER)
    cursor = connection.execute(registry.ORACLE[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(map(tuple, cursor.fetchall()), key=repr)


@needs_tables
@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_one_row_for_each_row(spark, name):
    table = "pages" if name.startswith(("op7_", "op13_")) else "documents"
    assert registry.QUERIES[name](spark, FOLDER).count() == spark.read.parquet(f"{FOLDER}/{table}.parquet").count()


def test_written_tables_can_be_deleted(spark):
    from vocalmill.llm import _common as C

    df = spark.range(3).toDF("doc_id")
    kept, gone = C.materialize(df), C.materialize(df)
    C.discard(gone)
    assert kept.count() == 3 and kept._vocalmill_path in C._written and gone._vocalmill_path not in C._written
    C.discard_all(spark)
    assert not C._written
