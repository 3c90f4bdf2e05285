"""URL filters: rules, hosts and segmentation against plain Python, and what the trained model catches."""

import itertools
import math
import re

import numpy as np
from pyspark.sql import functions as F

from vocalmill.llm import urlfilter as U

ODD = [None, "", "no scheme.org/es/", "http://", "https://example.org", "HTTPS://Example.ORG/es/x?q=1#y", "x://a.example.org/en/1234", "x://notexample.org/es/", "ftp://ÄB.fr.COM/fr/é://org/", "http://com/de/", "a://b://c/d", "http://u.example.com?x=/fr/", "http://h.com#/de/", "http://" + "ab" * 5000 + ".net/" + "x1/" * 5000, "http://org/de/", "http://sub.com/de/..", "\n://\n.org/\n", "http://-_-.123/45"]


def plain(url):
    """Host, path, rule and its verdict, straight from the definition."""
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits, default=(0, None, None))[1:])


def pages():
    clean = ["gardenhouse", "bookshop", "oldtown", "riverwalk", "newsdesk", "schoolbus"]
    bad = ["casino-win", "casinowin", "free-bets", "cheappills", "wincasino"]
    rows = [(i, f"https://{['', 'www.', 'm.'][i % 3]}{clean[i % 6]}.example.net/en/{i}.html") for i in range(200)]
    rows += [(1000 + i, f"http://{bad[i % 5]}.example.{['net', 'com', 'org'][i % 3]}/en/{i}") for i in range(30)]
    html = "<html><style>.casino{}</style><p>the garden house, book &amp; shop. Old town river walk; news desk school bus</p><p>free win cheap</p></html>"
    return [(i, url, html) for i, url in rows] + [(5000 + i, url, None) for i, url in enumerate(ODD)] + [(None, "http://oldtown.example.net/", ""), (7, rows[7][1], html)]


def test_rules_and_parts_equal_the_definition(spark):
    rows = U.judge(spark.createDataFrame(pages(), "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("verdict", F.lit(1))).collect()
    assert len(rows) == len(pages())
    want = sorted((repr((i, *plain(url)[:3])), plain(url)[3]) for i, url, _ in pages())
    got = sorted((repr((r.page_id, r.host, r.path, r.rule)), r.verdict) for r in rows)
    assert [k for k, _ in got] == [k for k, _ in want]
    assert all(g == w for (_, g), (_, w) in zip(got, want, strict=True) if w is not None)
    assert all(r.verdict in ("allow", "block") for r in rows)
    by_id = {r.page_id: r for r in rows}
    assert by_id[5000].verdict == by_id[5002].verdict == "allow" and by_id[5000].log_odds == 0
    for r in rows:
        if r.rule is None and r.page_id is not None and r.page_id < 5000:
            assert r.verdict == ("block" if r.page_id >= 1000 else "allow"), r
    assert by_id[1001].words.split()[:2] == ["casino", "win"] and by_id[1003].words.split()[:2] == ["cheap", "pills"]
    assert by_id[0].words.split()[:2] == ["garden", "house"]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert U.judge(empty).count() == 0
    rows = U.judge(spark.createDataFrame([(1, None, None)], "page_id long, url string, html string")).collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in rows] == [("", "", None, "allow")]


def test_viterbi_is_the_best_of_all_segmentations():
    counts = {"a": 50, "ab": 20, "abc": 9, "b": 30, "bc": 12, "c": 40, "cab": 3, "cc": 1}
    total = sum(counts.values())

    def score(words):
        return round(sum(math.log(counts[w] / total) if w in counts else math.log(10 * 10.0 ** -len(w) / total) for w in words), 6), -len(words)

    for run in [*("".join(x) for n in range(1, 6) for x in itertools.product("abcz", repeat=n)), "abcabcz", "zzabccb", "cabzcabc"]:
        n, every = len(run), []
        for cuts in range(1 << (n - 1)):
            ends = [k + 1 for k in range(n - 1) if cuts >> k & 1] + [n]
            every.append([run[a:b] for a, b in zip([0, *ends], ends, strict=False)])
        known = {(i, j - i): counts[run[i:j]] for i in range(n) for j in range(i + 1, n + 1) if run[i:j] in counts}
        assert score(U.viterbi(run, known, total)) == max(map(score, every))


def test_weights_are_naive_bayes():
    counts = np.array([[3.0, 0, 5, 0], [1.0, 10, 0, 0]])
    prior, table = U.weights(counts, 4, 6)
    assert prior == math.log(4.5 / 6.5) and table[3] == 0 and table[0] > 0 > table[1] and table[2] > table[0]
    pi = (8 + 1) / (19 + 2)
    assert math.isclose(table[1], math.log(pi / pi) - math.log((10 + 1 - pi) / (1 - pi)))


def test_a_hot_key_is_joined_apart(spark):
    many = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 'hot', cast(id as string)) AS k")
    one = many.select("k").distinct().selectExpr("k", "length(k) AS n")
    joined = U.skew_join(many, one, "k")
    assert joined.count() == 3000 and joined.where("n != length(k)").count() == 0
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().toString()
