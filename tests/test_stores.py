"""Named files with a commit, and logs that grow in place."""

import io
import os
import random

import pytest
from pyspark.sql import functions as F

from vocalmill.sources import growing, named, readers
from vocalmill.streaming import events as S


def there(folder):
    return sorted(f for f in os.listdir(folder) if not f.endswith(".crc"))


def test_a_file_a_row(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    rows = spark.range(30).selectExpr("id AS interview_id", "if(id = 4, NULL, concat('é ', id, '\n')) AS content").repartition(5)
    named.write(rows, out, ".srt")
    assert there(tmp_path / "out") == sorted(["_SUCCESS", *(f"{k}.srt" for k in range(30))])
    back = {r.interview_id: r.content for r in readers.named_files(spark, out, ".srt").collect()}
    assert back.pop("4", "") == "" and back == {str(k): f"é {k}\n" for k in range(30) if k != 4}
    named.write(rows.where("interview_id < 2").withColumn("content", F.lit("new")), out, ".srt")
    assert len(there(tmp_path / "out")) == 31 and (tmp_path / "out/1.srt").read_text() == "new"
    named.write(rows.where("interview_id < 3"), out, ".srt", mode="overwrite")
    assert there(tmp_path / "out") == ["0.srt", "1.srt", "2.srt", "_SUCCESS"]
    named.write(rows.limit(0), f"file://{tmp_path}/none", ".srt")
    assert there(tmp_path / "none") == ["_SUCCESS"]
    named.write(spark.createDataFrame([("a b+c%20é", b"\xff\x00")], "k string, content binary"), f"file://{tmp_path}/odd", ".docx", "k")
    assert (tmp_path / "odd/a b+c%20é.docx").read_bytes() == b"\xff\x00"
    assert readers.named_files(spark, f"file://{tmp_path}/odd", ".docx", "k").select("k").first().k == "a b+c%20é"


@pytest.mark.parametrize("bad", ["a/b", "..", "_x", None, "5"])
def test_a_job_that_fails_leaves_what_was_there(spark, tmp_path, bad):
    out = f"file://{tmp_path}/out"
    rows = spark.range(20).selectExpr("CAST(id AS string) AS k", "'old' AS content").repartition(4)
    named.write(rows.where("k < '12'"), out, "", "k")
    before = there(tmp_path / "out")
    wrong = rows.withColumn("content", F.lit("new")).withColumn("k", F.when(F.col("k") == "17", F.lit(bad)).otherwise(F.col("k")))
    with pytest.raises(Exception, match="."):
        named.write(wrong, out, "", "k")
    assert there(tmp_path / "out") == before and all((tmp_path / "out" / f).read_text() in ("old", "") for f in before)


def test_only_the_attempt_that_counts_is_committed(tmp_path):
    writer = named.NamedWriter(f"file://{tmp_path}/out", False)
    for attempt in (1, 2):
        folder = tmp_path / "out" / writer.staging / str(attempt)
        folder.mkdir(parents=True)
        (folder / "x.srt").write_text(f"attempt {attempt}")
    writer.commit([named.Staged(str(tmp_path / "out" / writer.staging / "2"), ["x.srt"]), None])
    assert there(tmp_path / "out") == ["_SUCCESS", "x.srt"] and (tmp_path / "out/x.srt").read_text() == "attempt 2"


def test_every_line_is_in_one_range():
    rng = random.Random(4)
    for _ in range(60):
        data = b"".join(bytes(rng.choice(b"ab\n") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 12)))
        upto = growing.line_end(io.BytesIO(data), 0, len(data))
        assert upto == data.rfind(b"\n") + 1
        want, at = [], 0
        for line in data[:upto].split(b"\n")[:-1]:
            want.append((at, line))
            at += len(line) + 1
        for piece in (1, 2, 3, 7, 100):
            cuts = [*range(0, upto, piece), upto]
            got = [x for a, b in zip(cuts, cuts[1:], strict=False) for x in growing.lines(io.BytesIO(data), growing.Range("", a, b, a == 0), len(data))]
            assert got == want


def test_blocks_smaller_than_lines(monkeypatch):
    monkeypatch.setattr(growing, "BLOCK", 4)
    data = b"a long line\nb\n\nanother long line\nrest"
    assert growing.line_end(io.BytesIO(data), 0, len(data)) == len(data) - 4
    assert growing.line_end(io.BytesIO(data), len(data) - 4, len(data)) == len(data) - 4
    assert growing.next_line(io.BytesIO(data), 2, len(data)) == 12 and growing.next_line(io.BytesIO(data), 33, len(data)) == len(data)
    assert [x for _, x in growing.lines(io.BytesIO(data), growing.Range("", 0, 33, True), len(data))] == [b"a long line", b"b", b"", b"another long line"]


def test_a_log_that_grows_is_read_once(spark, tmp_path):
    log = tmp_path / "logs" / "job.jsonl"
    log.parent.mkdir()
    log.write_bytes('{"n": 1, "t": "é"}\n{"n": 2}\r\n\n{"n": '.encode())
    (tmp_path / "logs" / "_hidden.jsonl").write_text('{"n": 99}\n')
    seen = []

    def read(**options):
        start = len(seen)
        stream = growing.stream(spark, f"file://{tmp_path}/logs", "n int, t string", ending=".jsonl", **options)
        S.run_available(stream, f"file://{tmp_path}/c", "append", lambda df, k: seen.extend((r.n, r.t) for r in df.orderBy("position").collect())).awaitTermination()
        return seen[start:]

    assert read(partitionBytes="7") == [(1, "é"), (2, None)]
    assert read() == []
    with log.open("a") as out:
        out.write('3}\nnot json\n{"n": 4, "t": "x"}\n')
    (log.parent / "other.jsonl").write_text('{"n": 50}\n')
    assert sorted(read(), key=str) == sorted([(3, None), (None, None), (4, "x"), (50, None)], key=str)
    log.write_text('{"n": 7}\n')  # begun anew
    assert read() == [(7, None)]


def test_batches_are_bounded(tmp_path):
    log = tmp_path / "a.log"
    log.write_bytes(b"".join(b"%03d\n" % k for k in range(5)))
    reader = growing.GrowingReader({"path": f"file://{log}", "maxBytesPerTrigger": "30", "partitionBytes": "8"})
    offset, got = reader.initialOffset(), []
    for k in range(40):
        if k == 1:
            with log.open("ab") as out:
                out.write(b"".join(b"%03d\n" % k for k in range(5, 100)) + b"x" * 50 + b"\n" + b"tail")
        end = reader.latestOffset()
        parts = reader.partitions(offset, end)
        assert end == offset or sum(p.end - p.start for p in parts) <= 51
        got += [v for p in parts for batch in reader.read(p) for v in batch.column(2).to_pylist()]
        reader.commit(end)
        offset = end
    assert got == [f"{k:03d}" for k in range(100)] + ["x" * 50]
