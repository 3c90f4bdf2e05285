"""Line dedup against a quadratic search for repeated runs."""

import random

from pyspark.sql import functions as F

from vocalmill.llm import linededup as L
from vocalmill.llm import suffixarray as A


def brute(docs, least):
    """Deleted lines of (key, text) documents with distinct keys, in order of key: all runs that occur before."""
    seqs = [[(i, line) for i, line in enumerate((t or "").split("\n")) if line.encode().split()] for _, t in docs]
    gone = [set() for _ in docs]
    places = [(d, s) for d in range(len(docs)) for s in range(len(seqs[d]))]
    for d, s in places:
        for e, r in places:
            if (e, r) >= (d, s):
                break
            n = 0
            while s + n < len(seqs[d]) and r + n < len(seqs[e]) and seqs[d][s + n][1] == seqs[e][r + n][1]:
                n += 1
            if n and sum(len(line.split()) for _, line in seqs[d][s : s + n]) >= least:
                gone[d] |= {i for i, _ in seqs[d][s : s + n]}
    out = []
    for (_, text), cut in zip(docs, gone):
        if text is None:
            out.append((None, 0))
            continue
        kept, dropping = [], False
        for i, line in enumerate(text.split("\n")):
            if line.encode().split():
                dropping = i in cut
            if not dropping:
                kept.append(line)
        out.append(("\n".join(kept), len(cut)))
    return out


def documents(seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 6))) for _ in range(9)]
    docs = []
    for i in range(30):
        lines = [rng.choice(pool + ["", "  "]) if rng.random() < 0.7 else f"unique {i} {rng.random()}" for _ in range(rng.randint(0, 14))]
        docs.append((i, "\n".join(lines)))
    docs += [(40, docs[3][1]), (41, docs[3][1] + "\nend"), (42, None), (43, ""), (44, "a b c\n" * 12), (45, "x " * 300)]
    return docs


def test_equals_brute_force(spark):
    for seed, least in ((1, 6), (2, 12), (3, 3)):
        docs = documents(seed)
        df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("runs", F.lit("clash")).withColumn("pos", F.lit(1)).repartition(3)
        out = L.dedup(df, min_words=least, count_col="n_deleted")
        assert out.columns == [*df.columns, "n_deleted"]
        got = {r.doc_id: (r.text, r.n_deleted) for r in out.collect()}
        assert [got[i] for i, _ in docs] == brute(docs, least)


def test_repeated_rows_null_ids_and_empty_table(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    docs = [(7, passage), (7, passage), (8, "own\n" + passage + "\n\ntail"), (None, passage + "\nfirst"), (9, "short\nline"), (10, "short\nline")]
    rows = L.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    got = sorted((str(r.doc_id), r.text) for r in rows)
    assert got == sorted([("7", ""), ("7", ""), ("8", "own\ntail"), ("None", passage + "\nfirst"), ("9", "short\nline"), ("10", "short\nline")])
    assert L.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def sequence(seed, n_docs=12, letters=4, most=25):
    """Documents of line ids, as rows (pos, h1, h2) with gaps, some of them copies."""
    rng = random.Random(seed)
    docs = [[rng.randrange(letters) for _ in range(rng.randint(0, most))] for _ in range(n_docs)]
    docs += [docs[0], docs[1][2:], [0] * 20, docs[0] + [1]]
    rows, at = [], 5
    for d in docs:
        rows += [(at + i, h // 2, h % 2) for i, h in enumerate(d)]
        at += len(d) + 1
    return rows


def test_ranks_are_a_suffix_array(spark, monkeypatch):
    monkeypatch.setattr(A, "TASK_ROWS", 30)
    for seed, letters in ((1, 3),):
        rows = sequence(seed, letters=letters)
        line = {p: (a, b) for p, a, b in rows}

        def suffix(p, line=line):
            out = []
            while p in line:
                out.append(line[p])
                p += 1
            return out

        ranks = A.suffix_ranks(spark.createDataFrame(rows, "pos bigint, h1 bigint, h2 bigint").repartition(3), 5)
        got = {r.pos: (r.rank, r.level) for r in ranks.final.collect()}
        times = {}
        for p in line:
            times[line[p]] = times.get(line[p], 0) + 1
        assert got.keys() == {p for p in line if times[line[p]] > 1}
        assert len({r for r, _ in got.values()}) == len(got)
        order = sorted(got, key=lambda p: got[p][0])
        for p, q in zip(order, order[1:]):
            a, b = suffix(p), suffix(q)
            n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            # lines that occur once, and ends, follow no order of their own
            if n < min(len(a), len(b)) and times[a[n]] > 1 and times[b[n]] > 1:
                assert a[n] < b[n]
        for p in got:
            alike = max(next((i for i, (x, y) in enumerate(zip(suffix(p), suffix(q))) if x != y), min(len(suffix(p)), len(suffix(q)))) for q in got if q != p)
            assert 2 ** got[p][1] <= alike < 2 ** (got[p][1] + 1)


def test_longest_earlier_copies(spark, monkeypatch):
    monkeypatch.setattr(A, "TASK_ROWS", 30)  # many slices
    for seed, letters, parts in ((5, 2, 7),):
        rows = sequence(seed, letters=letters)
        line = {p: (a, b) for p, a, b in rows}

        def common(p, q, line=line):
            n = 0
            while p + n in line and q + n in line and line[p + n] == line[q + n]:
                n += 1
            return n

        ranks = A.suffix_ranks(spark.createDataFrame(rows, "pos bigint, h1 bigint, h2 bigint"), parts)
        first = ranks.levels[0].select("pos", F.col("rank").alias("line"))
        candidates = ranks.final.join(first, "pos").select("rank", "pos", F.lit(1).alias("least"), "line")
        prefixes = {r.pos: (r.rank, r.lcp) for r in A.common_prefixes(candidates, ranks).collect()}
        order = sorted(prefixes, key=lambda p: prefixes[p][0])
        assert [prefixes[p][1] for p in order] == [0, *(common(p, q) for p, q in zip(order[1:], order))]
        got = {r.pos: r.length for r in A.earlier_copies(A.common_prefixes(candidates, ranks), ranks).collect()}
        want = {p: n for p in order if (n := max((common(p, q) for q in order if q < p), default=0))}
        assert got == want


def test_runs_of_many_lines_and_a_very_long_text(spark):
    base = [f"line {i} of the long text has a few words" for i in range(3_000)]
    docs = [(1, "\n".join(base)), (2, "\n".join(base)), (3, "head\n" + "\n".join(base[1_000:2_500]) + "\ntail"), (4, "again " * 60 + "\n" + "same line\n" * 5_000), (5, "w " * 200_000)]
    got = {r.doc_id: (r.text, r.n_deleted) for r in L.dedup(spark.createDataFrame(docs, "doc_id long, text string"), count_col="n_deleted").collect()}
    assert got[1] == (docs[0][1], 0) and got[2] == ("", 3_000) and got[3] == ("head\ntail", 1_500) and got[5] == (docs[4][1], 0)
    assert got[4][1] == 4_999  # the second line begins a run that overlaps its own copy
