"""Operators on small literals, and folds against plain Python on random rows."""

import random

import pytest
from pyspark.sql import functions as F

from vocalmill.operators import folds, intervals, jobs, library, models, progress, qc, review, trash, turns, waveform
from vocalmill.sources import readers, writers

SEGMENT = "interview_id string, idx int, start_ms bigint, end_ms bigint, speaker string, human_label string, text string, needs_review boolean"


def plain_fold(rows, gap, cap):
    out = []
    for start, end, speaker, text in rows:
        text = " ".join((text or "").split())
        if not text:
            continue
        end = end or start
        if out and out[-1][2] == speaker and start - out[-1][1] <= gap and end - out[-1][0] <= cap:
            out[-1] = (out[-1][0], end, speaker, out[-1][3] + " " + text)
        else:
            out.append((start, end, speaker, text))
    return out


def test_turn_fold_equals_plain_fold(spark):
    rng = random.Random(11)
    data, rows = {}, []
    for k in range(15):
        at, listed = 0, []
        for i in range(rng.randint(0, 30)):
            start = at + rng.randint(-300, 2500)
            end = start + rng.randint(0, 3000)
            item = (start, end, rng.choice("AAB"), rng.choice(["x", " y  z ", "", None]))
            listed.append(item)
            rows.append((f"r{k}", i, item[0], item[1], item[2], None, item[3], False))
            at = end
        data[f"r{k}"] = plain_fold(listed, 1800, 6000)
    rng.shuffle(rows)
    got = folds.turn_fold(spark.createDataFrame(rows, SEGMENT), gap_ms=1800, max_turn_ms=6000).orderBy("interview_id", "turn").collect()
    for key, want in data.items():
        assert [(r.start_ms, r.end_ms, r.speaker, r.text) for r in got if r.interview_id == key] == want


def test_review_mark_is_lost_in_a_merge(spark):
    rows = [("r", 0, 0, 1000, "A", None, "one", False), ("r", 1, 1000, 2000, "A", None, "two", True), ("r", 2, 9000, 9500, "A", None, "three", True)]
    df = spark.createDataFrame(rows, SEGMENT)
    assert [r["flags"] for r in folds.turn_fold(df).orderBy("turn").collect()] == [[], ["duvida"]]
    assert [r["flags"] for r in folds.turn_fold(df, keep_flags=True).orderBy("turn").collect()] == [["duvida"], ["duvida"]]


def plain_ids(ids):
    seen, out, n = set(), [], 1
    for raw in ids:
        own = (raw or "").strip()
        if not own or own in seen:
            while f"turn_{n:06d}" in seen:
                n += 1
            own = f"turn_{n:06d}"
        seen.add(own)
        out.append(own)
    return out


def test_turn_ids(spark):
    rng = random.Random(3)
    cases = [[rng.choice([None, "", " a ", "b", "turn_000001", "turn_000002", "turn_000004"]) for _ in range(rng.randint(0, 9))] for _ in range(40)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, ids array<string>")
    got = [r[0] for r in df.orderBy("i").select(folds.assign_turn_ids(F.col("ids"))).collect()]
    assert got == [plain_ids(c) for c in cases]


def test_spans_of_one_recording_in_many_bins(spark):
    rng = random.Random(8)
    spans = [("r", i, s := rng.randint(0, 5000), s + rng.randint(0, 900), rng.choice(["A", "B", ""])) for i in range(60)]
    items = [("r", i, s := rng.randint(0, 5000), s + rng.randint(1, 700)) for i in range(40)]
    a = spark.createDataFrame(items, "interview_id string, idx int, start_ms bigint, end_ms bigint")
    b = spark.createDataFrame(spans, "interview_id string, idx int, start_ms bigint, end_ms bigint, speaker string")
    got = {r.idx: r for r in intervals.best_overlap(a, b, ["idx"], bin_ms=100).collect()}
    for _, i, s, e in items:
        met = [(min(e, y) - max(s, x), -j, w) for _, j, x, y, w in spans if min(e, y) > max(s, x)]
        if not met:
            assert i not in got
            continue
        best = max(met, key=lambda m: m[:2])
        assert got[i].best_speaker == (best[2] or None) and got[i].overlap_ms == best[0]
        assert got[i].n_speakers == len({w for *_, w in met if w})


def test_span_merge_of_the_fixture(spark):
    rows = [(0, 1000, "A"), (1200, 2950, "A"), (2950, 3050, "A"), (3500, 4000, "B"), (4000, 4050, "B"), (4050, 5000, "B"), (5200, 6000, "A"), (5500, 5580, "B")]
    df = spark.createDataFrame([("r", *r) for r in rows], "interview_id string, start_ms bigint, end_ms bigint, speaker string")
    got = intervals.merge_spans(df, ["interview_id", "speaker"], 500, 300).orderBy("start_ms").collect()
    assert [(r.speaker, r.start_ms, r.end_ms, r.spans) for r in got] == [("A", 0, 2950, 2), ("B", 3500, 5000, 2), ("A", 5200, 6000, 1)]


def test_attribution_splits_and_falls_back(spark):
    seg = spark.createDataFrame([("r", 0, 0, 4000, "X", None, "a b c d", False), ("r", 1, 5000, 6000, "X", None, "alone", False), ("r", 2, 9000, 9900, "X", None, "far", False)], SEGMENT)
    words = spark.createDataFrame([("r", 0, i, i * 1000, (i + 1) * 1000, w) for i, w in enumerate(["a", ",", "c", "d"])], "interview_id string, idx int, widx int, start_ms bigint, end_ms bigint, word string")
    spans = spark.createDataFrame([("r", 0, 0, 2000, "A"), ("r", 1, 2000, 4000, "B"), ("r", 2, 5000, 5400, "A"), ("r", 3, 5300, 6000, "B")], "interview_id string, idx int, start_ms bigint, end_ms bigint, speaker string")
    got = turns.attribute(seg, words, spans).orderBy("idx", "sub").collect()
    assert [(r.idx, r.sub, r.speaker, r.text, r.split, r.needs_review) for r in got] == [(0, 0, "A", "a,", True, False), (0, 1, "B", "c d", True, False), (1, 0, "B", "alone", False, True), (2, 0, "X", "far", False, False)]


def test_paragraphs(spark):
    def run(*chunks):
        return folds.paragraphs(spark.createDataFrame([(list(chunks),)], "texts array<string>")).first()[0]

    sentence = "w" * 99 + "."
    assert run() == [] and run("", " ") == []
    assert run("One. Two.") == ["One. Two."]
    assert run(*[sentence] * 3) == [f"{sentence} {sentence} {sentence}"]
    assert run(f"{sentence} {sentence} {sentence}", "next") == [f"{sentence} {sentence} {sentence} next"]
    long = " ".join([sentence] * 20)
    assert [len(p) for p in run(long)] == [908, 908 + 202]
    assert run("a" * 1300, "b" * 300) == ["a" * 1300, "b" * 300]


def test_qc_of_edge_cases(spark):
    t = spark.createDataFrame([("r", 0, 0, 0, None, "", " "), ("r", 1, 500, 400, "A", "SPEAKER_1", "x"), ("r", 2, 100, 9000, "SPEAKER_UNKNOWN", "Ana", "y"), ("one", 0, 0, 5, "A", "Ana", "z")], "interview_id string, turn int, start_ms bigint, end_ms bigint, speaker string, human_label string, text string")
    rec = spark.createDataFrame([("r", 30000), ("one", None), ("gone", 10)], "interview_id string, duration_ms bigint")
    got = {r.interview_id: r for r in qc.metrics(t, rec).collect()}
    r = got["r"]
    assert (r.turn_count, r.speaker_count, r.empty_turns, r.missing_human_labels, r.unknown_speakers, r.timestamp_regressions, r.max_gap_ms) == (3, 2, 1, 2, 2, 1, 500)
    assert r.notes == "duration_delta_gt_10s; missing_human_labels; timestamp_regressions; unknown_speakers"
    assert got["one"].max_gap_ms is None and got["one"].coverage_ratio is None and got["gone"].notes == "missing_canonical"
    text = {r.interview_id: r for r in qc.text_view(qc.metrics(t, rec)).collect()}
    assert text["r"].coverage_ratio == "0.3000" and text["one"].max_gap_sec == "" and text["gone"].canonical_exists == "false"


def test_restore_is_idempotent(spark):
    tables = {
        "manifest": spark.createDataFrame([("a", "x"), ("b", "y")], "interview_id string, source_path string"),
        "speakers_map": spark.createDataFrame([("a", "S0"), ("a", "S1")], "interview_id string, speaker_label string"),
        "jobs": spark.createDataFrame([("a", "Transcrito", 65), ("b", "Pendente", 0)], "file_id string, status string, progress int"),
    }
    ids = spark.createDataFrame([("a",)], "id string")
    saved, left = trash.snapshot(tables, ids), trash.remove(tables, ids)
    once = trash.restore(left, saved)
    twice = trash.restore(once, saved)
    for name in tables:
        assert sorted(map(tuple, once[name].collect())) == sorted(map(tuple, twice[name].collect()))
    assert sorted(map(tuple, once["jobs"].collect())) == [("a", "Pendente", 0), ("b", "Pendente", 0)]
    assert once["speakers_map"].count() == 2
    entries = spark.createDataFrame([("t1", "trashed"), ("t2", "moving")], "trash_id string, status string")
    acts = spark.createDataFrame([("t1", "restore"), ("t2", "purge")], "trash_id string, action string")
    assert sorted(map(tuple, trash.advance(entries, acts).collect())) == [("t1", "restored"), ("t2", "moving")]


def turn(i, start, end, text, label="Ana", **more):
    return {"turn_id": f"turn_{i:06d}", "start_ms": start, "end_ms": end, "speaker": "S", "human_label": label, "text": text, "flags": [], "notes": "", "edited": False} | more


def test_edits():
    base = [turn(1, 0, 1000, "hello big world"), turn(2, 1000, 2000, "again", flags=["x"]), turn(3, 2000, 3000, "other", label="Rui")]
    done, refused = review.replay_list(base, [("split", "turn_000001", {}), ("merge_next", "turn_000004", {}), ("merge_next", "turn_000004", {}), ("set_times", "turn_000003", {"start_ms": "9", "end_ms": "1"}), ("toggle_flag", "turn_000003", {"flag": "f"}), ("move_boundary", "turn_000004", {"edge": "end", "at_ms": "2100"}), ("set_text", "nope", {})])
    assert refused == 3
    assert [(t["turn_id"], t["start_ms"], t["end_ms"], t["text"]) for t in done] == [("turn_000001", 0, 333, "hello"), ("turn_000004", 333, 2100, "big world again"), ("turn_000003", 2100, 3000, "other")]
    assert done[1]["flags"] == ["x"] and done[2]["flags"] == ["f"] and base[0]["text"] == "hello big world"
    assert review.replay_list(base, [("set_text", "turn_000001", {"text": "a"}), ("set_text", "turn_000001", {"text": "b"})], upto=1)[0][0]["text"] == "a"


@pytest.mark.parametrize(("text", "wanted", "at"), [("hello big world", None, 5), ("abc def", 2, 2), ("abcdef", None, 3), ("ab cdefgh", None, 2), ("abcdefg h", None, 7), ("a b", 99, 1)])
def test_split_point(text, wanted, at):
    assert review.split_point(text, wanted) == at


def test_orders_and_sets(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d"], ["c"])], "o array<string>, h array<string>")
    move = lambda item, step: df.select(library.move(F.col("o"), F.lit(item), step, F.col("h"))).first()[0]
    assert move("b", 1) == ["a", "d", "c", "b"] and move("a", -1) == ["a", "b", "c", "d"] and move("d", 1) == ["a", "b", "c", "d"] and move("zz", 1) == ["a", "b", "c", "d"]
    assert df.select(library.merge_order(F.col("o"), F.array(*map(F.lit, "dxa")))).first()[0] == ["a", "d", "x"]
    rows = spark.createDataFrame([("a", 0, False, True, False), ("b", 1, False, False, True)], "interview_id string, idx int, checked boolean, visual boolean, cursor boolean")
    assert [r.interview_id for r in library.target_ids(rows).collect()] == ["a"]
    assert [r.interview_id for r in library.target_ids(rows.withColumn("visual", F.lit(False))).collect()] == ["b"]


def test_jobs_and_models(spark):
    base = spark.createDataFrame([("a", "x")], "file_id string, title string")
    new = spark.createDataFrame([("a", None), ("b", "y")], "file_id string, title string")
    assert sorted(map(tuple, jobs.upsert(base, new, "file_id", ("title",)).collect())) == [("a", "x"), ("b", "y")]
    assert jobs.default_metadata()["speaker_labels"] == "Falante 1|Falante 2"
    registry = spark.createDataFrame([("m", "o/m", ["mm"], True, 10)], "name string, repo string, aliases array<string>, required boolean, expected_bytes bigint")
    asked = spark.createDataFrame([("mm",), ("/local",), ("remote/x",)], "model string")
    assert dict(map(tuple, models.resolve(asked, registry).collect())) == {"mm": "o/m", "/local": "/local", "remote/x": None}
    cache = models.cache_repos(spark.createDataFrame([("/h/models--o--m/blobs/1", 4)], "path string, size bigint"))
    status = models.model_status(registry, cache)
    assert status.first().state == "partial" and tuple(models.all_required_ready(status).first()) == (False, 1)
    assert progress.weights("large-v3", "cpu") == (1, 65, 33, 1, 0) and progress.weights("?", "cpu") == progress.FALLBACK


def test_waveform(spark, tmp_path):
    import io
    import struct
    import wave

    data = io.BytesIO()
    with wave.open(data, "wb") as file:
        file.setnchannels(2)
        file.setsampwidth(2)
        file.setframerate(10)
        file.writeframes(struct.pack("<8h", 1, 9, -4, 9, 2, 9, 3, 9))
    assert waveform.read_samples(data.getvalue()) == (10, [1, -4, 2, 3]) and waveform.read_samples(b"junk") == (0, [])
    files = spark.createDataFrame([("f", bytearray(data.getvalue())), ("bad", bytearray(b"x"))], "path string, content binary")
    got = waveform.peaks(waveform.decode_wav(files), chunk=2).orderBy("peak_idx").collect()
    assert [(r.file_id, r.peak) for r in got] == [("f", 1.0), ("f", 0.75)]
    level = lambda a, b: spark.createDataFrame([([0.0, 1.0, 0.5, 0.25],)], "p array<double>").select(waveform.level(F.col("p"), F.lit(4.0), F.lit(a), F.lit(b))).first()[0]
    assert level(0.5, 0.6) == 0.5 and level(0.0, 4.0) == 1.0 and level(9.0, 9.5) == 0.25


def test_lenient_recogniser_json(spark):
    document = '{"segments": ["x", null, 7, {"start": 5.0, "end": 2.0, "text": " swap "}, {"start": NaN, "end": 1, "text": "bad"}, {"start": 0, "end": Infinity, "text": "bad"}, {"start": 1, "end": 2, "text": " "}, {"start": 1, "end": 2, "text": "ok", "words": ["w", {"word": "a", "start": 1, "end": 1.5}, {"text": "b", "start": 1, "end": 2, "probability": 0.5}, {"word": " ", "start": 1, "end": 2}, {"word": "c", "start": "z", "end": 2}, {"word": "d", "start": 2, "end": 1}]}]}'
    docs = spark.createDataFrame([("r", document), ("none", "{}"), ("list", "[1]"), ("junk", "no json"), ("null", None)], "interview_id string, document string")
    segments = readers.asr_segments(docs)
    assert [(r.idx, r.start_ms, r.end_ms, r.text) for r in segments.orderBy("idx").collect()] == [(3, 2000, 5000, "swap"), (7, 1000, 2000, "ok")]
    words = readers.asr_words(segments).orderBy("widx").collect()
    assert [(w.word, w.start_ms, w.end_ms, w.score) for w in words] == [("a", 1000, 1500, None), ("b", 1000, 2000, 0.5)]
    assert [w.word for w in readers.asr_words(segments, usable_only=False).orderBy("widx").collect()] == ["a", "b", "d"]
    spans = readers.spans(spark.createDataFrame([("r", '{"segments": [5, {"start": 1, "end": 2, "speaker": "A"}, {"start": 3}]}')], "interview_id string, document string"))
    assert [(s.idx, s.start_ms, s.end_ms, s.speaker) for s in spans.orderBy("idx").collect()] == [(1, 1000, 2000, "A"), (2, 3000, 3000, "")]


def test_settings_round_trip(tmp_path):
    text = "a: 1 # note\nb: 'x y'\nlist:\n  - one\n  - 2.5\nempty:\nflag: true\ninline: [1, b]\n"
    assert readers.parse_settings(text) == {"a": 1, "b": "x y", "list": ["one", 2.5], "empty": None, "flag": True, "inline": [1, "b"]}
    value = {"a": 1, "t": "é: x", "l": ["p", 2], "n": None, "f": False}
    assert readers.parse_settings(writers.settings_lines(value)) == value
    path = tmp_path / "c.json"
    path.write_text('{"x": 2}')
    assert readers.settings(str(path), {"x": 1, "y": 3}) == {"x": 2, "y": 3}


def test_files(spark, tmp_path):
    t = folds.turn_fold(spark.createDataFrame([("r", 0, 0, 1000, "S", "Ana", "Olá, \"x\"", True), ("r", 1, 5000, 5000, "T", "", "a --> b", False)], SEGMENT))
    assert writers.export(t, f"file://{tmp_path}/out", ("json", "md", "docx", "srt", "vtt", "csv", "nvivo")) in (["json", "md", "srt", "vtt", "csv", "nvivo"], ["json", "md", "docx", "srt", "vtt", "csv", "nvivo"])
    srt = readers.named_files(spark, f"file://{tmp_path}/out/srt", ".srt").first().content
    assert srt == '1\n00:00:00,000 --> 00:00:01,000\nAna: Olá, "x" [Dúvida]\n\n2\n00:00:05,000 --> 00:00:05,250\nT: a --> b\n'
    from vocalmill import schemas

    rows = readers.csv_table(spark, f"file://{tmp_path}/out/csv", schemas.strings(["interview_id", "text", "notes", "more"])).orderBy("text").collect()
    assert [tuple(r) for r in rows] == [("r", 'Olá, "x"', "Revisar falante.", ""), ("r", "a --> b", "", "")]
    found = readers.listing(spark, f"file://{tmp_path}/out/md", "*.md")
    assert found.count() == 1 and found.first().size > 0
    writers.append_log(spark.createDataFrame([("r", "asr", "ok")], "interview_id string, stage string, status string"), f"file://{tmp_path}/log")
    writers.append_log(spark.createDataFrame([("r", "qc", "failed")], "interview_id string, stage string, status string"), f"file://{tmp_path}/log")
    assert readers.job_log(spark, f"file://{tmp_path}/log").count() == 2
    raw = writers.raw_files(spark.createDataFrame([("r", 0, 500, 2000, "S", None, " o\tl\n--> á", False)], SEGMENT))
    assert raw["tsv"].first().content == "start\tend\ttext\n500\t2000\to l --> á\n" and raw["srt"].first().content == "1\n00:00:00,500 --> 00:00:02,000\no\tl -> á\n"


def test_finding_documents(spark):
    files = spark.createDataFrame([("/a/json/A1.json",), ("/a/A10.json",), ("/a/json/B.whisperx.json",), ("/a/take-C.json",)], "path string")
    ids = spark.createDataFrame([("A1",), ("B",), ("C",), ("take-C",)], "interview_id string")
    assert dict(map(tuple, readers.find_documents(files, ids).collect())) == {"A1": "/a/json/A1.json", "B": "/a/json/B.whisperx.json", "take-C": "/a/take-C.json"}


def test_labels_meet_without_regard_to_case(spark):
    from vocalmill.operators import library

    labels = spark.createDataFrame([("Straße", 0), ("İzmir", 1), ("Σίσυφος", 2), ("  ", 3)], "label string, idx int")
    turns = spark.createDataFrame([("STRASSE", 0), (" i̇zmir ", 1), ("ΣΊΣΥΦΟΣ", 2), ("Strasbourg", 3), ("strasbourg", 4), ("STRAẞE", 5)], "label string, idx int")
    assert [r.label for r in library.speaker_options(labels, turns).orderBy("prio", "idx").collect()] == ["Straße", "İzmir", "Σίσυφος", "Strasbourg"]
    rows = spark.createDataFrame([("A1", "Große Straße", "ready"), ("b2", None, "ready"), ("c3", "x", "pending")], "interview_id string, title string, state string")
    assert [[r.interview_id for r in library.filter_list(rows, s, q).collect()] for s, q in ((None, "STRASSE"), ("all", " a1 "), ("ready", ""), (None, "B2"), ("pending", "a1"))] == [["A1"], ["A1"], ["A1", "b2"], ["b2"], []]
