"""Chains of steps, hooks, and folds over very long recordings."""

import io
import random
import struct
import time
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from vocalmill import schemas
from vocalmill.operators import folds, render, review, trash, waveform
from vocalmill.sources import readers, writers
from vocalmill.streaming import events as S

from .test_operators import SEGMENT, plain_fold, turn


def long_recording(spark, n):
    """One recording whose turns change at every third segment."""
    rows = spark.range(n).selectExpr("'r' AS interview_id", "CAST(id AS int) AS idx", "id * 1000 AS start_ms", "id * 1000 + 900 AS end_ms", "CASE WHEN id div 3 % 2 = 0 THEN 'A' ELSE 'B' END AS speaker", "CAST(NULL AS string) AS human_label", "concat('Text ', id, '. ') AS text", "id % 100 = 0 AS needs_review")
    return rows


@pytest.mark.parametrize("step", ["turns", "ids", "paragraphs"])
def test_time_of_folds_is_in_proportion(spark, step):
    def run(n):
        rows = long_recording(spark, n)
        start = time.perf_counter()
        if step == "turns":
            assert folds.turn_fold(rows).count() == -(-n // 3)
        elif step == "ids":
            ids = rows.groupBy("interview_id").agg(F.collect_list(F.expr("CASE WHEN idx % 2 = 0 THEN concat('x', idx) ELSE '' END")).alias("ids"))
            assert ids.select(F.explode(folds.assign_turn_ids(F.col("ids")))).distinct().count() == n
        else:
            texts = rows.groupBy("interview_id").agg(F.collect_list("text").alias("texts"))
            assert folds.exploded(folds.paragraphs(texts), [], "paragraphs", "nth", "p").count() > n / 100
        return time.perf_counter() - start

    run(1_000)
    few, many = min(run(4_000) for _ in range(2)), run(40_000)
    assert many < 20 * max(few, 0.5)


def test_many_turns_equal_the_plain_fold(spark):
    rng = random.Random(2)
    at, rows = 0, []
    for i in range(4_000):
        start = at + rng.randint(-100, 2_200)
        rows.append((start, start + rng.randint(0, 3_000), rng.choice("AAB"), rng.choice(["x", "y z", ""])))
        at = rows[-1][1]
    df = spark.createDataFrame([("r", i, a, b, s, None, t, False) for i, (a, b, s, t) in enumerate(rows)], SEGMENT)
    got = [(r.start_ms, r.end_ms, r.speaker, r.text) for r in folds.turn_fold(df, gap_ms=1800, max_turn_ms=9000).orderBy("turn").collect()]
    assert got == plain_fold(rows, 1800, 9000) and len(got) > 2 * folds._CHUNK


def test_time_of_replay_is_in_proportion():
    def run(n):
        base = [turn(i + 1, i * 10, i * 10 + 9, "some words here") for i in range(n)]
        edits = [(("split", "set_text", "merge_next")[i % 3], f"turn_{i + 1:06d}", {"text": "new"}) for i in range(n)]
        start = time.perf_counter()
        done, refused = review.replay_list(base, edits)
        assert n / 2 < len(done) <= 2 * n and refused <= n / 3
        return time.perf_counter() - start

    few = min(run(5_000) for _ in range(3))
    assert run(50_000) < 30 * max(few, 0.02)


def test_undo_and_redo():
    a, b, c = (("set_text", "t", {"text": x}) for x in "abc")
    undo, redo = ("undo", "", {}), ("redo", "", {})
    assert review.in_effect([a, b, undo]) == [a]
    assert review.in_effect([a, b, undo, redo]) == [a, b]
    assert review.in_effect([a, undo, c, redo]) == [c]
    assert review.in_effect([undo, redo, a, undo, undo, redo]) == [a]
    assert review.in_effect([]) == []


def test_a_number_is_used_again_once_its_turn_is_gone():
    base = [turn(1, 0, 1000, "one two"), turn(7, 1000, 2000, "three four")]
    done, _ = review.replay_list(base, [("merge_next", "turn_000001", {}), ("split", "turn_000001", {})])
    assert [t["turn_id"] for t in done] == ["turn_000001", "turn_000002"]


def test_render_and_report_of_few_recordings(spark):
    manifest = spark.createDataFrame([("a", "true", "/m/a.wav", "h", "2.5"), ("b", "true", "/m/b.wav", "", ""), ("c", "false", "/m/c.wav", "", "1")], "interview_id string, selected string, source_path string, source_sha256 string, duration_sec string")
    raw = spark.createDataFrame([("a", '{"segments": [{"start": 0, "end": 1, "text": " hi ", "speaker": "S1", "needs_speaker_review": true}, {"start": 1, "end": 2, "text": "there", "speaker": "S2"}]}'), ("c", '{"segments": [{"start": 0, "end": 1, "text": "not chosen"}]}')], "interview_id string, document string")
    done = render.render(manifest, raw, labels=["One", "Two"], speaker_map=spark.createDataFrame([("a", 0, "S2", "Dora")], "interview_id string, idx int, speaker_label string, human_label string"), settings={"asr_model": "tiny"})
    assert [(t.interview_id, t.turn, t.human_label, t.text, list(t.flags)) for t in done.turns.orderBy("turn").collect()] == [("a", 0, "One", "hi", ["duvida"]), ("a", 1, "Dora", "there", [])]
    assert [tuple(r) for r in done.missing.collect()] == [("b", "render", "missing recogniser document")]
    assert '"asr_model":"tiny"' in done.canonical().first().content and set(done.files()) == {"md", "srt", "vtt"}
    listing = spark.createDataFrame([("/p/json/a.canonical.json",), ("/p/json/a.json",), ("/p/json/b.json",), ("/p/wav/b.wav",)], "path string")
    rows = {r.interview_id: r for r in render.report(done, manifest, listing).collect()}
    assert set(rows) == {"a", "b"} and list(rows["a"].asDict()) == schemas.QC_COLUMNS
    assert (rows["a"].canonical_exists, rows["a"].raw_json_exists, rows["a"].wav_exists, rows["a"].turn_count, rows["a"].source_duration_sec, rows["a"].raw_segment_count) == ("true", "true", "false", "2", "2.500", "2")
    assert (rows["b"].canonical_exists, rows["b"].wav_exists, rows["b"].last_timestamp_sec, rows["b"].notes, rows["b"].raw_word_count) == ("false", "true", "0", "missing canonical JSON", "")
    assert render.render(manifest, raw, ids=["b"]).turns.count() == 0


def test_trash_leaves_recordings_with_work_under_way(spark):
    tables = {
        "manifest": spark.createDataFrame([("a",), ("b",)], "interview_id string"),
        "metadata": spark.createDataFrame([("a",), ("b",)], "file_id string"),
        "speakers_map": spark.createDataFrame([("a", "S0")], "interview_id string, speaker_label string"),
        "jobs": spark.createDataFrame([("a", "Transcrito", 65), ("b", "Rodando", 10)], "file_id string, status string, progress int"),
    }
    files = spark.createDataFrame([("/p/a.json", 3), ("/p/a.json", 3), ("/p/b.json", 4)], "path string, size bigint")
    left, saved, moved = trash.move(tables, spark.createDataFrame([("a",), ("b",)], "id string"), files, "t", "/p/.trash/")
    assert [r.interview_id for r in left["manifest"].collect()] == ["b"] and saved["speakers_map"].count() == 1
    assert [tuple(r) for r in moved.collect()] == [("t", "/p/a.json", "/p/.trash/t/files/p/a.json", 3)]
    now = spark.createDataFrame([("/p/a.json", 9, 1)], "path string, size bigint, mtime bigint")
    assert [trash.bring_back(left, saved, moved, now, overwrite=x)[1].count() for x in (False, True)] == [0, 1]


def test_items_progress_and_cancellation():
    said, done = [], []

    def work(item):
        done.append(item)
        if item == "b":
            raise ValueError("no sound")

    assert S.run_items(["a", "b", "c", "d"], work, said.append, lambda: len(done) >= 3) == {"a": "ok", "b": "failed: no sound", "c": "ok", "d": "cancelled"}
    assert [x["progress"] for x in said] == [25, 50, 75] and done == ["a", "b", "c"]


def test_progress_hook_of_a_stream(spark, tmp_path):
    said = []
    hook = S.ProgressHook(spark, said.append, lambda: any(x["event"] == "progress" for x in said))
    spark.streams.addListener(hook)
    try:
        query = spark.readStream.format("rate").option("rowsPerSecond", 5).load().writeStream.format("noop").option("checkpointLocation", f"file://{tmp_path}/c").trigger(processingTime="200 milliseconds").start()
        assert query.awaitTermination(60)
    finally:
        spark.streams.removeListener(hook)
    assert {"started", "progress"} <= {x["event"] for x in said} and not query.isActive
    S.stop(query)


def test_variant_folders():
    assert writers.variant_folder("/a", "/v/", None) == "/a" and writers.variant_folder("/a", "/v/", "big model!") == "/v/big_model"
    with pytest.raises(ValueError):
        writers.variant_folder("/a", "/v", "...")


def test_one_csv_file(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([("b", "2"), ("a", "1")], "k string, v string").repartition(4)
    writers.write_csv_file(df, f"file://{tmp_path}/t", ["v", "k"], ["k"])
    parts = list((tmp_path / "t").glob("*.csv"))
    assert len(parts) == 1 and parts[0].read_bytes() == "﻿v,k\n1,a\n2,b\n".encode()
    assert [tuple(r) for r in readers.csv_table(spark, f"file://{tmp_path}/t", schemas.strings(["k", "v"])).collect()] == [("a", "1"), ("b", "2")]
    monkeypatch.setattr(writers, "ONE_FILE_ROWS", 1)
    with pytest.raises(ValueError):
        writers.write_csv_file(df, f"file://{tmp_path}/u", ["k"], ["k"])


@pytest.mark.parametrize(("width", "code"), [(1, "B"), (2, "h"), (4, "i")])
def test_samples_of_every_width(width, code):
    data = io.BytesIO()
    values = [0, 5, 100, 7] if width == 1 else [0, -5, 1000, 7]
    with wave.open(data, "wb") as file:
        file.setnchannels(1)
        file.setsampwidth(width)
        file.setframerate(8000)
        file.writeframes(struct.pack(f"<4{code}", *values))
    want = [v - 128 for v in values] if width == 1 else values
    assert waveform.read_samples(data.getvalue()) == (8000, want)
    chunks = list(waveform.sample_chunks(data.getvalue(), 3))
    assert [at for _, at, _ in chunks] == [0, 3] and np.concatenate([v for *_, v in chunks]).tolist() == want


def test_documents_with_python_docx_or_without(spark, tmp_path):
    t = folds.turn_fold(spark.createDataFrame([("r", 0, 0, 1000, "S", "Ana", "words", False)], SEGMENT))
    written = writers.export(t, f"file://{tmp_path}", ("docx",))
    try:
        import docx
    except ImportError:
        assert written == [] and not list(tmp_path.iterdir())
    else:
        assert written == ["docx"] and docx.Document(f"{tmp_path}/docx/r.docx").paragraphs[0].text == "r"
