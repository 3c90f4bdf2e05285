"""Streams of job events, run over what is there."""

import json
import time

from pyspark.sql import functions as F

from vocalmill.streaming import events as S


def write(folder, name, rows):
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def test_log_and_held_progress(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    schema = "file_id string, seq bigint, progress double, status string, updated_at timestamp"
    at = "2024-01-01T00:00:0{}Z"
    write(log, "a.json", [{"file_id": "x", "seq": 1, "progress": 5, "status": "Rodando", "updated_at": at.format(1)}, {"file_id": "x", "seq": 2, "progress": 3, "status": "Rodando", "updated_at": at.format(2)}, {"file_id": "y", "seq": 1, "status": "Na fila", "updated_at": at.format(1)}])
    seen = []
    save = lambda df, n: seen.extend(df.collect())
    stream = S.held_progress(S.read_log(spark, f"file://{log}", schema))
    S.run_available(stream, f"file://{tmp_path}/c1", "append", save).awaitTermination()
    write(log, "b.json", [{"file_id": "x", "seq": 3, "progress": 4, "status": "Rodando", "updated_at": at.format(3)}, {"file_id": "x", "seq": 4, "progress": 250, "status": "ok", "updated_at": at.format(4)}])
    S.run_available(stream, f"file://{tmp_path}/c1", "append", save).awaitTermination()
    assert sorted((r.file_id, r.seq, r.shown) for r in seen) == [("x", 1, 5), ("x", 2, 5), ("x", 3, 5), ("x", 4, 100), ("y", 1, 0)]
    query = S.run_available(S.latest_state(S.read_log(spark, f"file://{log}", schema)), f"file://{tmp_path}/c2", "complete", table="latest_jobs")
    query.awaitTermination()
    S.stop(query)
    assert {r.file_id: r.status for r in spark.table("latest_jobs").collect()} == {"x": "ok", "y": "Na fila"}


def test_recogniser_seam(spark):
    def model(frames):
        for frame in frames:
            yield frame.assign(document='{"segments": []}')[["interview_id", "variant", "document"]]

    audio = spark.createDataFrame([("r", "base")], "interview_id string, variant string")
    assert S.transcribe(audio, model).first().document == '{"segments": []}'


def test_windowed_failures_in_batch(spark):
    df = spark.createDataFrame([("asr", "failed", 1), ("asr", "failed", 1000), ("asr", "ok", 2), ("qc", "failed", 4000)], "stage string, status string, s bigint").withColumn("started_at", F.timestamp_seconds("s"))
    assert sorted((r.stage, r.failures) for r in S.windowed_failures(df).collect()) == [("asr", 2), ("qc", 1)]


def test_creeping_progress(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    write(log, "a.json", [{"file_id": "x", "progress": 5}, {"file_id": "x", "progress": 3}, {"file_id": "y", "progress": None}])
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        seen = []
        stream = S.creeping_progress(S.read_log(spark, f"file://{log}", "file_id string, progress double"), idle_ms=200)
        out = stream.writeStream.outputMode("update").option("checkpointLocation", f"file://{tmp_path}/c").trigger(processingTime="300 milliseconds").foreachBatch(lambda df, n: seen.extend(df.collect())).start()
        for _ in range(60):
            out.awaitTermination(1)
            if sum(r.key == "x" for r in seen) >= 3:
                break
        S.stop(out)
    finally:
        spark.conf.unset(key)
    shown = [r.shown for r in seen if r.key == "x"]
    assert shown[:3] == [5, 6, 7]


def test_a_job_is_cancelled_by_its_tag(spark):
    begun = time.time()

    def slow():
        def wait(frames):
            for frame in frames:
                time.sleep(40)
                yield frame

        spark.range(4, numPartitions=1).mapInPandas(wait, "id bigint").count()

    def broken():
        raise ValueError("no sound")

    done = S.run_tagged(spark, {"a": lambda: spark.range(10).count(), "slow": slow, "broken": broken, "never": slow, "b": lambda: spark.range(1000).selectExpr("sum(id)").collect()}, lambda item: item == "never" or (item == "slow" and time.time() > begun + 3))
    assert done == {"a": "ok", "slow": "cancelled", "broken": "failed: no sound", "never": "cancelled", "b": "ok"} and time.time() < begun + 30
    assert S.run_tagged(spark, {}) == {}
