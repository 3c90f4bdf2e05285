"""WAV files read in ranges, and levels from the pyramid of peaks."""

import io
import random
import struct
import time
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from vocalmill.operators import waveform as W


def wav(values, width=2, channels=1, rate=8000):
    data = io.BytesIO()
    with wave.open(data, "wb") as file:
        file.setnchannels(channels)
        file.setsampwidth(width)
        file.setframerate(rate)
        file.writeframes(np.repeat(np.asarray(values) + (128 if width == 1 else 0), channels).astype({1: np.uint8, 2: "<i2", 4: "<i4"}[width]).tobytes())
    return data.getvalue()


def listing(spark, folder):
    return spark.read.format("binaryFile").load(f"file://{folder}")


def test_ranges_equal_whole_files(spark, tmp_path):
    rng = random.Random(1)
    for width, channels, n in [(1, 1, 900), (2, 1, 10_007), (4, 2, 5_000), (2, 2, 1), (1, 2, 0), (2, 1, 70)]:
        top = {1: 127, 2: 32000, 4: 2_000_000_000}[width]
        (tmp_path / f"w{width}c{channels}n{n} é.wav").write_bytes(wav([rng.randint(-top, top) for _ in range(n)], width, channels))
    whole = (tmp_path / "w2c1n10007 é.wav").read_bytes()
    (tmp_path / "cut.wav").write_bytes(whole[:5001])
    (tmp_path / "noise.wav").write_bytes(b"RIFF\x00\x00\x00\x00WAVEjunk")
    (tmp_path / "short.wav").write_bytes(b"RI")
    files = listing(spark, tmp_path)
    for chunk in (1, 7, 64, 100_000):
        want = sorted(map(tuple, W.wav_peaks(files, chunk).collect()))
        for size in (100, 4096, 1 << 20):
            assert sorted(map(tuple, W.file_peaks(files.select("path", "length"), chunk, range_bytes=size).collect())) == want
    ruled = W.file_peaks(files.select("path", "length"), range_bytes=512).groupBy("file_id").count().collect()
    assert {r.file_id.rsplit("/", 1)[1]: r["count"] for r in ruled}["w2c1n10007 é.wav"] == 10_007


def test_a_long_file_is_dealt_over_tasks(spark, tmp_path):
    (tmp_path / "long.wav").write_bytes(wav(np.arange(200_000) % 30_000 - 15_000))
    found = W.file_peaks(listing(spark, tmp_path).select("path", "length"), 100, range_bytes=10_000)
    assert found.count() == 2000
    ranges = W.wav_headers(listing(spark, tmp_path).select("path", "length")).first()
    assert (ranges.frames, ranges.rate, ranges.at) == (200_000, 8000, 44)


def test_headers():
    def header(data):
        return W.wav_header(io.BytesIO(data), len(data))

    plain = wav([1, 2, 3])
    assert header(plain) == (8000, 1, 2, 44, 6)
    fmt, body = plain[12:36], plain[36:]
    odd = b"LIST" + struct.pack("<I", 3) + b"abc\0"
    assert header(plain[:12] + odd + fmt + odd + body) == (8000, 1, 2, 44 + 24, 6)
    assert header(plain[:40] + b"\xff\xff\xff\xff" + plain[44:]) == (8000, 1, 2, 44, 6)  # a size that was never filled in
    assert header(b"RF64" + plain[4:12] + b"ds64" + struct.pack("<IQQQI", 28, 0, 4, 2, 0) + fmt + b"data\xff\xff\xff\xff" + plain[44:]) == (8000, 1, 2, 80, 4)
    extended = struct.pack("<4sIHHIIHHHHI", b"fmt ", 40, 0xFFFE, 1, 8000, 16000, 2, 16, 22, 16, 4) + struct.pack("<H", 1) + b"\0" * 14
    assert header(plain[:12] + extended + body) == (8000, 1, 2, 68, 6)
    assert header(plain[:20] + struct.pack("<H", 3) + plain[22:]) is None  # floating-point samples
    assert header(b"") is None and header(b"RIFFxxxxWAVE") is None and header(plain[:30]) is None


def levels_of(spark, peaks, duration, asked, block):
    table = spark.createDataFrame([("f", k, float(p)) for k, p in enumerate(peaks)] + [("one", 0, 0.25)], "file_id string, peak_idx bigint, peak double")
    files = spark.createDataFrame([("f", float(duration)), ("one", 3.0), ("none", 2.0), ("zero", 0.0)], "file_id string, duration double")
    rows = spark.createDataFrame([("f", k, a, b) for k, (a, b) in enumerate(asked)] + [("one", 0, 0.5, 9.0), ("none", 0, 0.0, 1.0), ("zero", 0, 0.0, 1.0), ("unknown", 0, 0.0, 1.0)], "file_id string, id bigint, start double, end double")
    return {(r.file_id, r.id): r.level for r in W.levels(rows, table, files, block=block).collect()}


@pytest.mark.parametrize(("n", "block"), [(1, 4), (2, 4), (3, 4), (37, 4), (64, 4), (65, 1), (300, 8), (300, 64)])
def test_levels_equal_those_of_the_array(spark, n, block):
    rng = random.Random(n)
    peaks, duration = [rng.random() for _ in range(n)], 10.0
    asked = [(0.0, 10.0), (-1.0, -0.5), (3.0, 2.0), (9.99, 50.0), (0.0, 0.0)]
    asked += [(a, a + rng.choice([0.01, 0.2, 1, 5, 9])) for a in (rng.uniform(-1, 11) for _ in range(60))]
    array = spark.createDataFrame([(k, a, b, peaks) for k, (a, b) in enumerate(asked)], "id bigint, start double, end double, p array<double>")
    want = {("f", r.id): r.level for r in array.select("id", W.level(F.col("p"), F.lit(duration), F.col("start"), F.col("end")).alias("level")).collect()}
    got = levels_of(spark, peaks, duration, asked, block)
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()} | {("one", 0): 0.25, ("none", 0): 0.0, ("zero", 0): 0.0, ("unknown", 0): 0.0}


def test_many_look_ups_on_one_file(spark):
    peaks = spark.range(100_000).selectExpr("'f' AS file_id", "id AS peak_idx", "abs(sin(id)) AS peak")
    files = spark.createDataFrame([("f", 1000.0)], "file_id string, duration double")
    asked = spark.range(200_000).selectExpr("'f' AS file_id", "id", "CAST(id % 900 AS double) AS start", "CAST(id % 900 + id % 100 AS double) AS end")
    start = time.perf_counter()
    found = W.levels(asked, peaks, files)
    assert found.where("level BETWEEN 0 AND 1").count() == 200_000 and time.perf_counter() - start < 60
