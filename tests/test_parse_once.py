"""Documents are parsed once: no filter repeats the parsing of what it asks for."""

from pyspark.sql import functions as F

from vocalmill.operators import render
from vocalmill.sources import readers


def parses(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("from_json")


def test_segments_and_words_are_parsed_once(spark):
    documents = spark.createDataFrame([("r", '{"segments": [7, null, {"start": 2, "end": 1, "text": " a  b ", "words": [{"word": "a", "start": 1, "end": 1.5}, "x", {"word": " ", "start": 1, "end": 2}, {"word": "b", "start": 2, "end": 1}]}, {"start": "x", "end": 1, "text": "c"}, {"start": 0, "end": 1, "text": " "}]}'), ("none", None), ("broken", "{"), ("empty", "{}")], "interview_id string, document string").repartition(2)
    segments = readers.asr_segments(documents)
    assert parses(segments) == 2  # the document, then each segment
    assert [(r.interview_id, r.idx, r.start_ms, r.end_ms, r.text, len(r.words)) for r in segments.collect()] == [("r", 2, 1000, 2000, "a b", 4)]
    given = spark.createDataFrame(segments.collect(), segments.schema).repartition(2)
    assert parses(readers.asr_words(given)) == 1
    assert [tuple(r) for r in readers.asr_words(given).select("widx", "start_ms", "end_ms", "word").collect()] == [(0, 1000, 1500, "a")]
    assert readers.asr_words(given, usable_only=False).where(F.col("widx") == 3).select("start_ms", "end_ms").first() == (1000, 2000)


def test_what_is_missing_needs_no_turns(spark, monkeypatch):
    written = []
    monkeypatch.setattr(render.shared, "written", lambda df, name: written.append(name) or df)
    manifest = spark.createDataFrame([("a", "true"), ("b", "true")], "interview_id string, selected string")
    raw = spark.createDataFrame([("a", '{"segments": [{"start": 0, "end": 1, "text": "x"}]}')], "interview_id string, document string")
    done = render.render(manifest, raw)
    assert [r.interview_id for r in done.missing.collect()] == ["b"] and written == []
    assert done.turns.count() == 1 and written == ["segments", "turns"] and done.turns is done.turns
