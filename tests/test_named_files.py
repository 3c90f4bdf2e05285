"""Named files read: few tasks for many small files, tables in them, and filters that don't make texts again."""

import re

import pytest
from pyspark.sql import functions as F

from vocalmill.functions import text as X
from vocalmill.operators import turns
from vocalmill.sources import named, readers, writers


def test_many_small_files_take_few_tasks(spark, tmp_path):
    (tmp_path / "f").mkdir()
    for k in range(600):
        (tmp_path / f"f/{k}.srt").write_text(f"é {k}\n")
    for other in ("_hidden.srt", ".hidden.srt", "7.vtt"):
        (tmp_path / "f" / other).write_text("no")
    (tmp_path / "f/empty.srt").touch()
    (tmp_path / "f/deeper.srt").mkdir()
    found = readers.named_files(spark, f"file://{tmp_path}/f", ".srt", "k")
    assert found.rdd.getNumPartitions() == 1
    assert {r.k: r.content for r in found.collect()} == {"empty": "", **{str(k): f"é {k}\n" for k in range(600)}}
    (tmp_path / "none").mkdir()
    assert readers.named_files(spark, f"file://{tmp_path}/none", ".srt").collect() == []
    with pytest.raises(Exception, match="missing"):
        readers.named_files(spark, f"file://{tmp_path}/missing", ".srt").collect()


def test_shares_of_tasks_are_bounded(monkeypatch):
    monkeypatch.setattr(named, "PARTITION_FILES", 3)
    monkeypatch.setattr(named, "PARTITION_BYTES", 10)
    assert [p.names for p in named.dealt([(f"/f/{k}", size) for k, size in enumerate((1, 1, 1, 1, 9, 1, 50, 0, 0))])] == [["0", "1", "2"], ["3", "4"], ["5"], ["6"], ["7", "8"]]
    assert named.dealt([]) == []


def test_batches_are_bounded_and_whole(tmp_path, monkeypatch):
    monkeypatch.setattr(named, "BATCH_FILES", 2)
    monkeypatch.setattr(named, "BATCH_BYTES", 10)
    sizes = (4, 4, 4, 30, 0, 7, 7)
    for k, size in enumerate(sizes):
        (tmp_path / str(k)).write_bytes(b"x" * size)
    reader = named.NamedReader(f"file://{tmp_path}", "")
    got = [batch.column(1).to_pylist() for part in reader.partitions() for batch in reader.read(part)]
    assert [[len(x) for x in batch] for batch in got] == [[4, 4], [4], [30], [0, 7], [7]]


def test_tables_by_their_own_headers(spark, tmp_path):
    long = "x" * 200_000
    files = {
        "1.csv": '﻿id,note,more\r\na,"two\r\nlines, ""quoted""",1\r\n\r\nb,,2\r\n',
        "2.csv": f"note,id\n{long},c\nshort\ntoo,many,cells\n",
        "3.csv": "id,note\n",
        "4.csv": "",
        "5.csv": "more\n1\n",
        "6.tsv": "id\tnote\nno\tno\n",
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content.encode())
    rows = readers.named_tables(spark, f"file://{tmp_path}", ".csv", ["id", "note"]).collect()
    assert sorted(map(tuple, rows)) == sorted([("a", 'two\r\nlines, "quoted"'), ("b", ""), ("c", long), ("", "short"), ("many", "too"), ("", "")])
    assert list(map(tuple, readers.named_tables(spark, f"file://{tmp_path}", ".tsv", ["note"], "\t").collect())) == [("no",)]


def test_what_shows_is_what_joins_to_a_text(spark):
    texts = [None, "", " ", "\t\n", "\x1c\x1d\x1e\x1f", "  　\u0085 ", "​", "\x00", "a", " a ", "\n\U0001f600", "﻿", "-"]
    flags = [None, [], [" "], [None], ["", "duvida"], [" x "], ["\t"]]
    rows = spark.createDataFrame([(t, f) for t in texts for f in flags], "text string, flags array<string>").persist()
    joined = X.join_text(X.collapse(F.coalesce("text", F.lit(""))), X.flag_text(F.col("flags")))
    said = rows.select(X.shows(F.col("text"), F.col("flags")).alias("new"), (joined != "").alias("old")).collect()
    assert {r.new for r in said} == {True, False} and all(r.new == r.old for r in said)


def test_filters_do_not_make_the_text(spark, tmp_path):
    t = spark.createDataFrame([("r", 0, 0, 1000, "A", "Ana", " a  b ", ["duvida"], "")], "interview_id string, turn int, start_ms long, end_ms long, speaker string, human_label string, text string, flags array<string>, notes string")
    t.write.parquet(f"file://{tmp_path}/t")
    t = spark.read.parquet(f"file://{tmp_path}/t")
    for df in (writers.cues(t), turns.blocks(t)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert not [line for line in plan.split("\n") if re.match(r"\W*Filter", line) and "regexp_replace" in line]
    assert writers.cues(t).first().text == "Ana: a b [Dúvida]"
