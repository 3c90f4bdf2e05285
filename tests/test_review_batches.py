"""Replays of many recordings in one call of Python, equal to the replay of each."""

import random

from pyspark.sql import functions as F

from vocalmill.operators import review


def test_many_recordings_at_once(spark):
    rng = random.Random(7)
    fields = ["turn_id", "start_ms", "end_ms", "speaker", "human_label", "text", "flags", "notes", "edited"]
    turns = {f"r{k}": [(f"turn_{n:06d}", n * 10, n * 10 + 9, "S1", "Ana", f"one two {n}", ["b", "a"][: n % 3], "", False) for n in range(rng.randint(1, 6))] for k in range(250)}
    edits = {key: [(a, f"turn_{rng.randint(0, 6):06d}", p) for a, p in rng.sample([("set_text", {"text": " x ", "unused": None}), ("merge_next", {}), ("split", {"char": "3"}), ("undo", None), ("redo", {}), ("set_times", {"start_ms": "5"}), ("move_boundary", {"edge": "end", "at_ms": "44"})], rng.randint(0, 5))] for key in [*turns, "unknown"]}
    t = spark.createDataFrame([(k, i, *x) for k, rows in turns.items() for i, x in enumerate(rows)], "interview_id string, pos int, turn_id string, start_ms bigint, end_ms bigint, speaker string, human_label string, text string, flags array<string>, notes string, edited boolean")
    e = spark.createDataFrame([(k, i, *x) for k, rows in edits.items() for i, x in enumerate(rows)], "interview_id string, seq bigint, action string, turn_id string, payload map<string,string>").orderBy(F.rand(1))
    got = review.replay(t, e)
    assert "CoGroup" not in got._jdf.queryExecution().toString()  # a call of pandas for each recording
    want = []
    for key, rows in turns.items():
        done, refused = review.replay_list([dict(zip(fields, x, strict=True)) for x in rows], [(a, i, {k: v for k, v in (p or {}).items() if v is not None}) for a, i, p in edits[key]])
        want += [(key, n, *(x[c] for c in fields), refused) for n, x in enumerate(done)]
    assert sorted(map(tuple, got.select("interview_id", "pos", *fields, "refused").collect()), key=repr) == sorted(want, key=repr)
