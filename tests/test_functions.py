"""Column functions on literals."""

import pytest
from pyspark.sql import functions as F

from vocalmill.functions import media as M
from vocalmill.functions import text as X
from vocalmill.functions import timecode as TC


def values(spark, column, rows, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("v"))).collect()]


def test_white_space_and_sentences(spark):
    assert values(spark, X.collapse, [" a  b c\x1cd\n", "", None]) == ["a b c d", "", None]
    assert values(spark, X.sentences, ["Um. Dois!  Três", "sem fim", ""]) == [["Um.", "Dois!", "Três"], ["sem fim"], [""]]


def test_labels_and_flags(spark):
    assert values(spark, X.display_label, [" entrevistador ", "Ana  B"]) == ["Entrevistador", "Ana B"]
    assert values(spark, X.flag_text, [["duvida", " x ", ""], None], "array<string>") == ["[Dúvida] [x]", ""]
    df = spark.createDataFrame([(None, "SPEAKER_00", "oi", ["duvida"]), ("Ana", "x", " ", []), ("", None, "", ["inaudivel"])], "h string, s string, t string, f array<string>")
    assert [r[0] for r in df.select(X.subtitle_text(*map(F.col, "hstf"))).collect()] == ["SPEAKER_00: oi [Dúvida]", "", "Falante: [Inaudível]"]
    assert [r[0] for r in df.select(X.editorial_key(F.col("h"), F.col("s"))).collect()] == ["SPEAKER_00", "ANA", "SPEAKER_UNKNOWN"]


def test_joining_words_and_preview(spark):
    assert values(spark, X.join_words, [["Olá", ",", " mundo0", "!", "", "0"]], "array<string>") == ["Olá, mundo0! 0"]
    assert values(spark, lambda c: X.preview(c, 10), ["short", "a long text here"]) == ["short", "a long..."]


def test_hygiene(spark):
    assert values(spark, X.cue_safe, ["a --> b\r\nc"]) == ["a -> b c"]
    assert values(spark, X.cell_safe, ["a\tb\nc"]) == ["a b c"]
    assert values(spark, X.redact, ["key hf_abcdefgh12 end", "hf_short"]) == ["key hf_*** end", "hf_short"]
    assert values(spark, X.safe_name, ["../é a", "", "ok.1"]) == ["a", "item", "ok.1"]
    assert values(spark, X.is_safe_id, ["A1_2", "../x", ""]) == [True, False, False]
    assert values(spark, lambda c: X.title(c, 5), ["  ab\x07c ", "abcdefgh", None]) == [("abc", False), ("abcde", True), ("", False)]


def test_numbers_in_text(spark):
    assert values(spark, X.progress_percent, ["1% 45 %", "none", "250%"]) == [45, None, 100]
    assert values(spark, X.size_text, [12, 2048, 5 * 1024**2, 3 * 1024**3], "bigint") == ["12 B", "2.0 KB", "5.0 MB", "3.00 GB"]
    assert values(spark, X.duration_text, [75.0, 3725.0], "double") == ["1min 15s", "1h 02min"]


def test_times(spark):
    assert values(spark, TC.timecode, [65500, 67123, -5, 400 * 3600000], "bigint") == ["00:01:05.500", "00:01:07.123", "00:00:00.000", "400:00:00.000"]
    assert values(spark, lambda c: TC.timecode(c, ","), [65500], "bigint") == ["00:01:05,500"]
    assert values(spark, TC.to_ms, [1.0005, 1.0625, 0.0015], "double") == [1000, 1062, 2]
    assert values(spark, TC.truncated_clock, [59.99, None, 3661.0], "double") == ["00:00:59", "00:00:00", "01:01:01"]
    assert values(spark, TC.parse_timecode, ["1:02:03,5", "2:03", "7", "x", "1:2:3:4"]) == [3723.5, 123.0, 7.0, None, None]
    assert values(spark, TC.seconds_text, [1500, -20, 0], "bigint") == ["1.500", "-0.020", "0.000"]
    assert values(spark, TC.eta_text, [None, 30.0, 125.0, 7260.0], "double") == ["estimando...", "cerca de 30s", "cerca de 2min 05s", "cerca de 2h 01min"]


@pytest.mark.parametrize(("path", "id_", "kind", "ext"), [("/x/a01r_1234_v take.MP4", "A01R_1234", "V", ".mp4"), ("/x/Talk.final.mov", "Talk.final", "V", ".mov"), ("b22P_0001.wav", "B22P_0001", "AUDIO", ".wav"), ("noext", "noext", "AUDIO", "")])
def test_media_names(spark, path, id_, kind, ext):
    df = spark.createDataFrame([(path,)], "p string")
    assert tuple(df.select(M.media_id(F.col("p")), M.media_kind(F.col("p")), M.extension(F.col("p"))).first()) == (id_, kind, ext)


def test_probe_values(spark):
    assert values(spark, M.number_text, ["1.23456", "x", None]) == ["1.235", "", ""]
    assert values(spark, M.frame_rate_text, ["30000/1001", "0/0", "25/1", "bad"]) == ["29.970", "", "25.000", ""]
    assert M.config_hash({"b": 1, "a": "é"}) == M.config_hash({"a": "é", "b": 1}) and len(M.config_hash({})) == 16
    assert M.merged_config({"a": 1, "b": 2}, None, {"a": None, "b": 3}) == {"a": 1, "b": 3}
