"""Trained operators: toxicity chain, language mixture, weak-label quality; and licence scans and HTML extraction."""

import itertools
import random
import textwrap
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vocalmill.llm import htmltext as W
from vocalmill.llm import langid as G
from vocalmill.llm import licenses as S
from vocalmill.llm import quality as Q
from vocalmill.llm import toxicity as X

ODD = [None, "", " \n", "1 2 3", "x" * 200_000]


def sentence(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def insults(spark):
    rng = random.Random(1)
    calm, bad = [f"word{i}" for i in range(300)], ["rotter", "knave", "scoundrel"]
    docs, labels = [], []
    for i in range(500):
        toxic = i % 5 == 0
        text = sentence(rng, calm, rng.randint(5, 60)).split()
        if toxic:
            text[rng.randrange(len(text))] = rng.choice(bad) + rng.choice(["", "ish", "!"])
        docs.append((i, " ".join(text).capitalize()))
        labels.append((i, int(i % 3 > 0), int(toxic)))
    docs += [(1000 + k, t) for k, t in enumerate(ODD)]
    labels += [(2000, 1, 1), (3, None, 1), (4, 1, None), (None, 1, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string").withColumn("rejected", F.lit("clash")).withColumn("p_toxic", F.lit(1)), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_chain(spark, insults):
    docs, labels = insults
    chain = X.train(docs.where("doc_id % 4 != 3 OR doc_id >= 500"), labels)
    assert [link.name for link in chain] == ["unfit", "toxic", "severe"] and [len(link.chained) for link in chain] == [0, 1, 2]
    rows = X.score(docs, chain).collect()
    held = [r for r in rows if r.k__doc_id < 500 and r.k__doc_id % 4 == 3]
    assert sum(r["rejected"] == (r.k__doc_id % 5 == 0) for r in held) >= 0.97 * len(held)
    assert not any(r["rejected"] for r in rows if r.k__doc_id >= 1000) and all(r.k__rejected == "clash" for r in rows)
    kept = X.without_toxic(docs, labels)
    assert kept.columns == docs.columns and 400 <= kept.count() <= 415


def test_toxicity_without_labels(spark, insults):
    docs, labels = insults
    chain = X.train(docs, labels.limit(0))
    assert X.score(docs, chain).where("rejected").count() == 0
    assert X.score(docs.limit(0), chain).count() == 0


def test_out_of_fold_probabilities_reach_later_links():
    rng = np.random.default_rng(0)
    rows, hashes, labels = [], [], []
    for i in range(400):
        a = rng.random() < 0.4
        rows += [i, i]
        hashes += [1 if a else 2, 100 + i]
        labels.append((a, a))
    chain = X.fit_chain(np.array(rows), np.array(hashes, np.uint32), np.array(labels), ["first", "second"], np.arange(400) % 5)
    assert chain[1].chained[0] > 1.0
    p = X.predict(chain, np.array([0, 1]), np.array([1, 2], np.uint32), 2)
    assert (p[0] > 0.9).all() and (p[1] < 0.1).all()


def corpus(seed=2, n=300):
    rng = random.Random(seed)
    words = {"xx": ["alfa", "gamma", "delta", "kappa"], "yy": ["été", "forêt", "où", "çà"], "zz": ["zwölf", "grün", "fuß", "übel"]}
    return [(i, sentence(rng, words[lang], rng.randint(3, 40)), lang) for i in range(n) for lang in [rng.choice(list(words))]], words


def test_language_mixture(spark):
    docs, words = corpus()
    rng = random.Random(5)
    docs += [(1000 + k, t, "xx") for k, t in enumerate([None, "", "12 ?!", "🙂 🙂", "x"])]
    docs += [(2000, sentence(rng, words["yy"], 60) + " " + sentence(rng, words["zz"], 30), None), (None, "alfa gamma", "xx")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = G.train(df)
    assert model[0] == ["xx", "yy", "zz"]
    rows = {r.doc_id: r for r in G.identify(df, model).collect()}
    held = [(i, lang) for i, _, lang in docs if i is not None and i < 1000 and zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 40 and sum(rows[i].lang_pred == lang for i, lang in held) >= 0.98 * len(held)
    assert [rows[1000 + k].lang_pred for k in range(4)] == ["und"] * 4 and rows[1000].score == 0.0
    assert set(rows[2000].mixture) == {"yy", "zz"} and rows[2000].lang_pred == "yy" and 0.55 < rows[2000].score < 0.8
    assert all(0 <= r.score <= 1 for r in rows.values())
    empty = df.limit(0)
    assert G.identify(df, G.train(empty)).where("lang_pred != 'und'").count() == 0 and G.identify(empty, model).count() == 0


def test_training_ignores_the_held_out_fold(spark):
    docs, _ = corpus(7, 80)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    changed = df.withColumn("text", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit("other words entirely")).otherwise(F.col("text")))
    assert (G.train(df)[1] == G.train(changed)[1]).all()


def test_mixture_of_one_document_is_a_likelihood_maximum():
    rng = np.random.default_rng(3)
    loglik = rng.normal(size=(50, 2)) * 2
    docs, share = G.mixtures(loglik, np.zeros(50, int))
    grid = np.linspace(0, 1, 201)
    best = max(grid, key=lambda a: np.log(np.exp(loglik) @ [a, 1 - a] + 1e-12).sum())
    assert docs.tolist() == [0] and (abs(share[0, 0] - best) < 0.05 or share[0].max() == 1.0)


def test_a_word_that_no_language_has_seen():
    docs, share = G.mixtures(np.vstack([np.full((1, 4), -9.0), np.full((2, 4), -9.0)]), np.array([3, 5, 5]))
    assert docs.tolist() == [3, 5] and share.tolist() == [[1.0, 0, 0, 0]] * 2
    table = np.full((1 << G.BUCKET_BITS, 4), -9.0, np.float32)
    langs, scores, mixed = G.predict(pa.array(["слово"]), ["aa", "bb", "cc", "dd"], table)
    assert (langs, scores.tolist(), mixed) == (["aa"], [1.0], [{"aa": 1.0}])


def test_quality(spark):
    rng = random.Random(4)
    words = [f"{a}{b}" for a, b in itertools.product(["ma", "re", "to", "sil", "ven"], ["na", "ri", "do", "le"])]
    docs = []
    for i in range(400):
        text = ". ".join(sentence(rng, words, rng.randint(4, 12)).capitalize() for _ in range(rng.randint(3, 9))) + "."
        if i % 10 == 0:
            text = "###".join(text.split()) + "###"
        elif i % 10 == 1:
            text = (text.split()[0] + " ") * 80
        elif i % 10 == 2:
            text = " | ".join(text.split())
        elif i % 10 == 3:
            text = text.upper().replace(" ", "!! ")
        docs.append((i, text))
    docs += [(1000 + k, t) for k, t in enumerate(ODD)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash"))
    model = Q.train(df)
    rows = {r.doc_id: r for r in Q.score(df, model).collect()}
    right = [rows[i].keep == (i % 10 > 3) for i in range(400)]
    assert sum(right) >= 0.97 * len(right)
    assert all(rows[i].keep for i in range(400) if i % 10 > 3)
    assert [rows[1000 + k].score for k in range(3)] == [0.0] * 3 and len(rows) == len(docs)
    nothing = Q.train(df.where("doc_id BETWEEN 1000 AND 1002"))
    assert nothing.weights is None and Q.score(df, nothing).where("keep").count() == 0
    assert Q.score(df.limit(0), model).count() == 0


def test_quality_accuracies_of_independent_labellers():
    rng = np.random.default_rng(6)
    n, k = 20000, len(Q.HEURISTICS)
    good = rng.random(n) < 0.8
    miss = np.linspace(0.3, 0.7, k)
    votes = np.where(good[:, None], np.where(rng.random((n, k)) < 0.01, 0, 1), np.where(rng.random((n, k)) < miss, 1, 0))
    found, counts = np.unique(Q.patterns(votes), return_counts=True)
    chance, p, prior = Q.estimate(found, counts.astype(float))
    assert abs(prior - good.mean()) < 0.02 and np.abs(chance[:, 0, 0] - (1 - miss)).max() < 0.05


def slow_scan(text, threshold=S.THRESHOLD):
    """All windows of content lines against all templates, without pruning; the most alike that don't overlap."""
    listed = [(key, g) for key, _, t in S.template_texts() if (g := S.bigrams(S.words_of(t)))]
    content = [(i, w) for i, line in enumerate((text or "").split("\n")) if (w := S.words_of(line)) and w[0] != b"copyright"]
    found = []
    for i in range(len(content)):
        words, grams = [], set()
        for j in range(i, len(content)):
            grams |= S.bigrams(words[-1:] + content[j][1])
            words += content[j][1]
            scored = [(-2 * len(grams & own) / (len(grams) + len(own)), key) for key, own in listed if grams]
            if scored and -min(scored)[0] >= threshold:
                found.append((min(scored)[0], j - i, i, min(scored)[1]))
    taken, out = set(), []
    for score, more, i, key in sorted(found):
        if taken.isdisjoint(range(i, i + more + 1)):
            taken |= set(range(i, i + more + 1))
            out.append((key, -score, content[i][0], content[i + more][0] - content[i][0] + 1))
    return sorted(out, key=lambda x: x[2])


def test_licences_equal_a_scan_without_pruning(spark):
    rng = random.Random(8)
    lines = [t.split("\n")[0] for _, _, t in S.template_texts()] + ["Some line of text.", "", "licensed"]
    rows = [line for _, kind, text in S.template_texts() if kind == "notice" for line in textwrap.wrap(text, 78)]
    docs = []
    for i in range(40):
        picked = [" ".join(w for w in rng.choice(lines).split() if rng.random() > 0.04) for _ in range(rng.randint(0, 4))]
        docs.append((i, "\n".join(x for p in picked for x in (p, "unrelated filler of the document"))))
        at = rng.randrange(len(rows) - 20)
        docs.append((40 + i, "\n".join(r for r in rows[at : at + 20] for _ in range(rng.choice([0, 1, 1, 1, 2])))))
    docs += [(100 + k, t) for k, t in enumerate(ODD)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("matches", F.lit(1))
    found = {r.doc_id: [tuple(m) for m in r.matches] for r in S.scan_licenses(df).collect()}
    for i, text in docs:
        assert found[i] == slow_scan(text)
    assert S.scan_licenses(df.limit(0)).count() == 0


def test_whole_licences():
    for key, kind, text in S.template_texts():
        if kind == "notice" and "\n" in text:
            found = S.scan(f"Copyright (c) 2020 Someone\n\n{text}\n")
            assert any(m[0] == key and m[1] == 1.0 and m[3] > 1 for m in found)
            inside = S.scan(f"An introduction that says other things.\n{text}\nAnd an ending about something else.")
            assert any(m[0] == key and m[1] > 0.95 and m[3] > 1 for m in inside)


@pytest.mark.parametrize("between", ["\n", "\n\n", "\n\nCopyright (c) 2020 Someone\n\n"])
def test_licences_that_follow_one_another(between):
    texts = {key: "\n".join(textwrap.wrap(text, 78)) for key, kind, text in S.template_texts() if kind == "notice"}
    for a, b in itertools.product(texts, repeat=2):
        found = S.scan(f"{texts[a]}{between}{texts[b]}")
        size = texts[a].count("\n") + 1
        # a line that begins with "copyright" is left out, so some score less than 1
        places = {(key, at, n) for key, score, at, n in found if score > 0.9}
        assert {(a, 0, size), (b, size - 1 + between.count("\n"), texts[b].count("\n") + 1)} <= places


@pytest.mark.parametrize("times", range(1, 9))
def test_a_repeated_licence_is_found_each_time(times):
    text = next(text for key, kind, text in S.template_texts() if key == "MIT" and kind == "notice")
    size = text.count("\n") + 1
    found = S.scan("\n".join([text] * times))
    assert found == [("MIT", 1.0, k * size, size) for k in range(times)]
    assert S.scan("\n".join([text] * times + [S.TEXTS["Apache-2.0"]]))[-1][0] == "Apache-2.0"


def test_a_very_long_text_and_templates_from_files(spark, tmp_path):
    filler = "\n".join(f"plain words number {i} of the story and of the rest" for i in range(20_000))
    assert [m[0] for m in S.scan(f"{filler}\n{S.TEXTS['ISC']}\n{filler}")] == ["ISC"]
    (tmp_path / "Own-1.0.txt").write_text("You may do with this what you like as long as you say where it is from.")
    own = S.read_templates(spark, f"file://{tmp_path}")
    assert S.scan("You may do with this what you like as long as you say where it is from", own) == [("Own-1.0", 1.0, 0, 1)]


def cut_value(side, terminal, edges):
    return sum(max(t, 0) for s, t in zip(side, terminal) if not s) + sum(max(-t, 0) for s, t in zip(side, terminal) if s) + sum(c for a, b, c in edges if side[a] != side[b])


def test_minimum_cut_equals_brute_force():
    rng = random.Random(12)
    for _ in range(150):
        n = rng.randint(1, 8)
        terminal = [rng.choice([0, rng.uniform(-4, 4)]) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 3)) for a in range(n) for b in range(a) if rng.random() < 0.5]
        best = min(cut_value(s, terminal, edges) for s in itertools.product([False, True], repeat=n))
        assert abs(cut_value(W.minimum_cut(terminal, edges), terminal, edges) - best) < 1e-6


LONG = "This is a paragraph of the article, with commas and several words. It has two sentences &amp; a reference."
SEEN = LONG.replace("&amp;", "&")


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<html><head><title>t</title></head><body><script>x<y</script></body>", ""),
        ("plain &lt;text&gt;", "plain <text>"),
        (f"<body><nav><a href=/>Home</a></nav><article><h1>Title</h1><p>{LONG}<p><b>Bo</b>ld  \n x<br>y<div class='ad'>Buy</div><ul><li>one<li>two</ul></article><footer>&copy; z</footer>", f"Title {SEEN} Bold x y one two"),
        (f"<div class=menu><a href=1>a</a></div><div id=content><h2>H</h2><p>{LONG}</p><p>{LONG}</p><form><p>{LONG}</p></form></div><div id='comments-list'><p>{LONG}</p></div>", f"H {SEEN} {SEEN}"),
        (f"<main><header><h1>T&#233;</h1></header><p>{LONG}</p><aside>{LONG}</aside><section class='commentList'><p>{LONG}</p></section><style>p{{}}</style></main>", f"Té {SEEN}"),
        (f"<article><p>{LONG}</p><p hidden>secret</p><p style='display: none'>x</p></article>", SEEN),
        ("<article><p>a < b and <3 <!-- c --> d</p></article", "a < b and <3 d"),
    ],
)
def test_pages(page, text):
    assert W.main_text(page, np.array(W.DEFAULT)) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<div class='content-sidebar-wrap'><article><p>{LONG}</p></article></div><div class=sidebar><p>{LONG}</p></div>", SEEN),
        (f"<div class='site no-sidebar'><div><p>{LONG}</p></div><div class=widget><p>{LONG}</p></div></div>", SEEN),
        (f"<div class='page-with-comments'><main><p>{LONG}</p></main></div>", SEEN),
        (f"<div class='layout-sidebar'><p>{LONG}</p><p>{LONG}</p></div>", f"{SEEN} {SEEN}"),
        (f"<article class='post category-popular tag-legal'><p>{LONG}</p></article>", SEEN),
        (f"<article><p>{LONG}</p><section class=comments><article class=comment-body><p>{LONG}</p></article></section></article>", SEEN),
        (f"<form><nav><a href=/>x</a></nav><main><p>{LONG}</p></main></form>", SEEN),
    ],
)
def test_class_words_of_wrappers(page, text):
    assert W.main_text(page, np.array(W.DEFAULT)) == text


@pytest.mark.parametrize(
    "page",
    [
        "<form id=aspnetForm><article><p>{0}</p></article></form>",
        "<form id=aspnetForm><div id=content><p>{0}</p></div></form>",
        "<div class='page has-sidebar'><article><p>{0}</p></article></div>",
        "<div class='with-header'><main><p>{0}</p></main></div>",
        "<div id='legal-news'><p>{0}</p></div>",
        "<div class='share-price-report'><p>{0}</p></div>",
        "<article class='post popular'><p>{0}</p></article>",
        "<main class='search-results'><p>{0}</p></main>",
        "<main><div role='form'><p>{0}</p></div></main>",
        "<article><p>{0}</p></article><h3>3 Comments</h3><ul><li><b>Ann</b><p>Nice post!</p></li><li><b>Bob</b><p>{0}</p></li></ul>",
        "<article><p>{0}</p><h3>Comments (2)</h3><div><b>Ann</b><p>I like it, and {0}</p></div></article>",
    ],
)
def test_articles_are_kept_and_comments_are_not(page):
    assert W.main_text(page.format(LONG), np.array(W.DEFAULT)) == SEEN


def test_an_article_keeps_its_title():
    assert W.main_text(f"<article><div class='entry-header'><h1>Title words</h1></div><p>{LONG}</p></article>", np.array(W.DEFAULT)) == f"Title words {SEEN}"


def test_whole_extraction_equals_brute_force_cuts(spark):
    """Random pages: the text is that of a least cut over all labellings, found by trying them all."""
    rng = random.Random(21)
    parts = ["<p>{0}</p>", "<div class=ad>Buy now</div>", "<ul><li><a href=/>Home</a></li></ul>", "<h2>Head</h2>", "<p>Short.</p>", "<div class='related'><p>{0}</p></div>", "<footer>&copy; x</footer>", "<div><p>{0}</p><p>Yes.</p></div>", "<aside><p>{0}</p></aside>"]
    rows, turned = [], 0
    for k in range(120):
        body = "".join(rng.choice(parts).format(LONG) for _ in range(rng.randint(1, 7)))
        rows.append((k, "u", rng.choice(["<article>{0}</article>", "{0}", "<div id=content>{0}</div>"]).format(body)))
    weights = np.array(W.DEFAULT)
    for r in W.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), weights).collect():
        blocks = W.blocks_of(rows[r.page_id][2])
        terminal, edges = W.terminals(blocks, weights), W.edges_of(blocks)
        # of equal cuts the one with the fewest content blocks
        best = min(itertools.product([False, True], repeat=len(blocks)), key=lambda s: (round(cut_value(s, terminal, edges), 9), sum(s)))
        assert r.text == " ".join(b.text for b, s in zip(blocks, best) if s)
        turned += sum((t > 0) != s for t, s in zip(terminal, best))
    assert turned > 20


def test_terminals_leave_the_choice_to_the_cut():
    page = f"<div><p>{LONG}</p><p class=popular>{LONG}</p><p>{LONG}</p></div><div class=popular><p>{LONG}</p></div>"
    blocks = W.blocks_of(page)
    strong = np.array([8.0, *np.zeros(len(W.FEATURES) - 1)])
    terminal = W.terminals(blocks, strong)
    assert max(map(abs, terminal)) < 50
    assert terminal[1] < 0 and W.minimum_cut(terminal, W.edges_of(blocks)) == [True, True, True, False]


def test_extraction_trains_and_runs(spark):
    good = f"<body><nav><ul><li><a href=/>Home</a></ul></nav><article><h1>T</h1><p>{LONG}</p></article><footer>&copy; x</footer>"
    rows = [(i, f"u{i}", good.replace("Home", f"Home{i}")) for i in range(30)] + [(100, "u", None), (101, None, f"<div><a href=1>x</a> <a href=2>y</a></div><p>{LONG}</p><p>{LONG}</p>"), (5, "u5", good)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    weights = W.train(df)
    assert weights[W.FEATURES.index("link_share")] < 0 < weights[W.FEATURES.index("log_length")] + weights[W.FEATURES.index("long")] + weights[W.FEATURES.index("is_paragraph")]
    got = W.extract(df, weights).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert {r.text for r in got if r.page_id < 100} == {f"T {SEEN}"}
    assert {r.page_id: r.text for r in got if r.page_id >= 100} == {100: "", 101: f"{SEEN} {SEEN}"}
    assert (W.train(df.limit(0)) == np.array(W.DEFAULT)).all()


@pytest.mark.parametrize("heading", ["Discussion", "Responses", "Replies", "Comments", "Reply"])
def test_a_section_under_such_a_heading_stays(heading):
    body = "<p>The measured values agree with those of the earlier study, as the second table shows in detail.</p><p>They differ where the sample was small, which was to be expected from the design.</p>"
    page = f"<html><body><nav><a href=/>Home</a></nav><article><h1>A study of rivers</h1><h2>Methods</h2>{body}<h2>{heading}</h2>{body}<h2>Conclusion</h2>{body}</article></body></html>"
    text = W.main_text(page, np.array(W.DEFAULT))
    assert heading in text and "Conclusion" in text and text.count("measured values") == 3
    if heading != "Comments":  # as the last section, too, but for the very word
        assert W.main_text(page.replace("<h2>Conclusion</h2>" + body, ""), np.array(W.DEFAULT)).count("measured values") == 2


@pytest.mark.parametrize("part", [
    "<h2>3 Comments</h2><p>Great read, thank you.</p><p>I never knew this about the river.</p>",
    "<h2>Discussion</h2><div><b>Ana</b><p>Great read, thank you.</p><a href=#>Reply</a></div><div><b>Rui</b><p>I never knew this about the river.</p><a href=#>Reply</a></div>",
    "<h2>Responses</h2><div>Ana, 3 hours ago</div><p>Great read, thank you. I never knew this about the river.</p>",
    "<h3>Leave a reply</h3><p>Great read, thank you.</p><p>I never knew this about the river.</p>",
    "<h2>Comments</h2><p>Great read, thank you.</p><p>I never knew this about the river.</p>",
    "<h2>Replies</h2><ul><li><div>Ana</div><div>Great read, thank you.</div></li><li><div>Rui</div><div>I never knew this about the river.</div></li></ul>",
])
def test_what_readers_wrote_goes(part):
    body = "<p>The measured values agree with those of the earlier study, as the second table shows in detail.</p>"
    text = W.main_text(f"<html><body><article><h1>A study of rivers</h1>{body}{part}</article></body></html>", np.array(W.DEFAULT))
    assert "measured values" in text and "Great read" not in text and "never knew" not in text
    text = W.main_text(f"<html><body><article><h1>A study of rivers</h1>{body}<section>{part}</section><h2>Conclusion</h2>{body}</article></body></html>", np.array(W.DEFAULT))
    assert text.count("measured values") == 2 and "Great read" not in text
