"""URL filters: rules first, then naive Bayes over the words of host and path; host names are cut into words by Viterbi.

A URL's host is what stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, its path what follows up to
``?``, ``#`` or the end.  A rule is a host and the beginning of a path; it fits its host and all subdomains, and the
longest that fits decides.

Where none fits, the host is read as words.  Its runs of letters (cut at 63, the longest a host's label can be) are
segmented by a unigram model: the words with the greatest product of shares, where a word that was never seen has a share
that falls tenfold a letter; of equal segmentations the one with fewer words, then with the longer first words.  The shares
are counts over the visible text of all pages and their paths and hyphenated hosts, without the words that only repeat a
page's own host; seeds of five letters or more have a share of at least ``SEED_SHARE``.  A run of letters meets its counts by a join on its substrings, so no vocabulary is broadcast.

A multinomial naive Bayes model over the tokens of host and path then gives the log-odds of ``block``.  It is trained on
weak labels: a URL with one of ``SEEDS`` among its words is taken for unwanted, the others are not.  Every URL counts.
Tokens are hashed to ``1 << BUCKET_BITS`` buckets, so the model is a few megabytes at any size; a token's pseudo-count
is shared out by class sizes, so that a token never seen says nothing.

A host may stand in a third of all rows: hosts (and substrings) with more than a thousandth of the rows, at most a
thousand, are joined by broadcast, the others by shuffle.

Defined cases: a null URL or one without ``://`` has empty host and path, no words, and is allowed; an empty path fits no
rule, as rules' paths begin with ``/``; a null html has no words; null page ids and repeated rows give rows of their own; a
very long URL or page is read whole; log-odds of exactly 0 (or no tokens at all) allow; an empty table gives an empty
result; without any seed in the table nothing is blocked by the model; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

#: verdict, host, beginning of the path
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Words that mark a URL as unwanted when the model is trained: gambling, pharmacy, adult, tracking, spam and piracy.
SEEDS = (
    "ads adserver adult adware banner bet bets betting bingo blackjack casino cialis clickbait crack doubleclick escort gambling hentai jackpot keygen "
    "lottery malware payday phishing pills poker popunder popup porn roulette sex slots spam spyware torrent track tracker tramadol viagra warez xanax xxx"
).split()
LABEL, MAX_WORD, BUCKET_BITS = 63, 20, 18
#: The least share of a long seed in the unigram model, so that names made of one are cut where no text has it.
SEED_SHARE = 1e-5
#: A key with more than one row in so many is joined by broadcast; so there are at most as many such keys.
HOT_SHARE = 1000
#: Distinct words that a task counts before it passes the counts on.
COUNTED = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RUN = r"[^\x00-\x60\x7B-\x7F]+"
_TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_MARKUP = re.compile(r"<(script|style)\b.*?</\1\s*>|<[^>]*>|&[#\w]+;", re.S | re.I)
_WORDS = re.compile(_RUN)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL column, empty for null or where no ``://`` is."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + F.lit(3), F.length(text))).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none fits."""
    rule = verdict = None
    for says, name, begin in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(begin)
        rule = F.when(fits, F.lit(name + begin)) if rule is None else rule.when(fits, F.lit(name + begin))
        verdict = F.when(fits, F.lit(says)) if verdict is None else verdict.when(fits, F.lit(says))
    nothing = F.lit(None).cast("string")
    return (nothing if rule is None else rule), (nothing if verdict is None else verdict)


def skew_join(many: DataFrame, one: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``many`` joined with ``one`` (unique by ``key``): keys with more than a row in ``HOT_SHARE`` by broadcast, the rest by shuffle."""
    counts = many.groupBy(key).agg(F.count("*").alias("n"))
    total = many.count()
    hot = [r[0] for r in counts.where(F.col("n") * HOT_SHARE > total).select(key).collect()]  # fewer than HOT_SHARE keys
    if not hot:
        return many.join(one, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return many.where(is_hot).join(F.broadcast(one.where(is_hot)), key, how).unionByName(many.where(~is_hot).join(one.where(~is_hot), key, how))


def page_words(url_host: str, path: str, html: str) -> Iterator[str]:
    """The words of a page that count for the unigram model."""
    labels = set(url_host.split(".")[:-1])
    for word in _WORDS.findall(_MARKUP.sub(" ", html).lower()):
        if word not in labels:
            yield word
    yield from _WORDS.findall(path.lower())
    for label in url_host.split("."):
        parts = _WORDS.findall(label)
        if len(parts) > 1:
            yield from parts


def word_counts(urls: DataFrame) -> DataFrame:
    """(word, n) over the rows (host, path, html) of all pages; words too long for the segmentation are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for part in C.text_slices(batches, 2):
            for host, path, html in zip(*(C.text_array(c).to_pylist() for c in part.columns), strict=True):
                found.update(w for w in page_words(host, path, html) if len(w) <= MAX_WORD)
            if len(found) > COUNTED:
                yield pa.RecordBatch.from_pydict({"word": list(found), "n": list(found.values())})
                found.clear()
        if found:
            yield pa.RecordBatch.from_pydict({"word": list(found), "n": list(found.values())})

    counted = urls.select("host", "path", "html").mapInArrow(run, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def seeded(run: str, known: dict[tuple[int, int], int], total: int, seeds=SEEDS) -> dict[tuple[int, int], int]:
    """The counts of a run's substrings, where seeds of five letters or more have a share of at least ``SEED_SHARE``."""
    for word in seeds:
        at = run.find(word) if len(word) >= 5 else -1
        while at >= 0:
            known[at, len(word)] = max(known.get((at, len(word)), 0), math.ceil(total * SEED_SHARE))
            at = run.find(word, at + 1)
    return known


def viterbi(run: str, known: dict[tuple[int, int], int], total: int) -> list[str]:
    """The best segmentation of a run of letters; ``known`` has the counts of its substrings (start, length)."""
    base = math.log(max(total, 1))
    best: list[tuple[float, int, int]] = [(0.0, 0, 0)]  # log-share, minus the number of words, length of the last
    for end in range(1, len(run) + 1):
        options = []
        for size in range(1, min(end, LABEL) + 1):
            n = known.get((end - size, size))
            share = math.log(n) - base if n else math.log(10) * (1 - size) - base
            before = best[end - size]
            options.append((round(before[0] + share, 9), before[1] - 1, size))
        best.append(max(options, key=lambda o: (o[0], o[1], -o[2])))
    words, end = [], len(run)
    while end:
        size = best[end][2]
        words.append(run[end - size : end])
        end -= size
    return words[::-1]


def segmented(runs: DataFrame, counts: DataFrame, seeds=SEEDS) -> DataFrame:
    """(run, words) for distinct runs of letters, with the unigram counts (word, n)."""
    C.prepare(runs.sparkSession)
    total = counts.agg(F.sum("n")).first()[0] or 0
    starts = runs.select("run", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("start"))
    spans = starts.select("run", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(MAX_WORD), F.length("run") - F.col("start") + 1))).alias("size"))
    spans = spans.select("run", "start", "size", F.substring("run", F.col("start"), F.col("size")).alias("word"))
    met = skew_join(spans, counts, "word").groupBy("run").agg(F.collect_list(F.struct("start", "size", "n")).alias("known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            words = [viterbi(t, seeded(t, {(k["start"] - 1, k["size"]): k["n"] for k in known or ()}, total, seeds), total) for t, known in zip(texts, batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(words, pa.list_(pa.string()))], names=["run", "words"])

    return runs.join(met, "run", "left").select("run", "known").mapInArrow(run, "run string, words array<string>")


def _runs(host: Column) -> Column:
    """A host's runs of letters, none longer than ``LABEL``."""
    runs = F.regexp_extract_all(host, F.lit(f"({_RUN})"), F.lit(1))
    cut = lambda r: F.transform(F.sequence(F.lit(0), F.floor((F.length(r) - 1) / F.lit(LABEL)).cast("int")), lambda k: F.substring(r, k * LABEL + 1, F.lit(LABEL)))
    return F.flatten(F.transform(runs, cut))


def host_words(hosts: DataFrame, counts: DataFrame, seeds=SEEDS) -> DataFrame:
    """(host, words) for distinct hosts: the segmented words in order."""
    parts = hosts.select("host", F.posexplode(_runs(F.col("host"))).alias("nth", "run"))
    cut = C.materialize(segmented(parts.select("run").distinct(), counts, seeds), "runs")
    placed = skew_join(parts, cut, "run")
    return placed.groupBy("host").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("nth", "words"))), lambda x: x["words"])).alias("words"))


def train(rows: DataFrame) -> tuple[float, np.ndarray]:
    """Prior log-odds and the weight of each bucket, from rows (block boolean, tokens array<int>)."""
    size = 1 << BUCKET_BITS
    sums = rows.groupBy("block").agg(F.count("*").alias("n")).collect()
    rows_of = {bool(r.block): r.n for r in sums}
    table = rows.select("block", F.explode("tokens").alias("b")).groupBy("b").agg(F.count_if("block").alias("bad"), F.count_if(~F.col("block")).alias("good"))
    counts = np.zeros((2, size))
    for b in table.toArrow().to_batches():  # at most a row a bucket
        at = b.column(0).to_numpy()
        counts[0, at], counts[1, at] = b.column(1).to_numpy(), b.column(2).to_numpy()
    return weights(counts, rows_of.get(True, 0), rows_of.get(False, 0))


def weights(counts: np.ndarray, bad: int, good: int) -> tuple[float, np.ndarray]:
    """Naive Bayes from token counts by class; a pseudo-count of one a token is shared out by class sizes."""
    totals = counts.sum(axis=1)
    share = (totals + 1) / (totals.sum() + 2)
    return math.log((bad + 0.5) / (good + 0.5)), np.log((counts[0] + share[0]) / share[0]) - np.log((counts[1] + share[1]) / share[1])


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES, seeds=SEEDS) -> DataFrame:
    """Per row: the id, ``host``, ``path``, ``rule``, ``verdict``, ``words`` of the host and ``log_odds`` of block."""
    spark = pages.sparkSession
    C.prepare(spark)
    host, path = url_parts(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), F.col(html_col).cast("string").alias("html"))
    counts = C.materialize(word_counts(urls), "words")
    urls = urls.drop("html")
    words = C.materialize(host_words(urls.select("host").distinct(), counts, seeds), "hosts")
    joined = skew_join(urls, words, "host", "left")
    lower = F.regexp_extract_all(F.translate("path", _UPPER, _LOWER), F.lit(f"({_TOKEN})"), F.lit(1))
    digits = lambda t: F.when(t.rlike("^[0-9]+$"), F.concat(F.lit("#"), F.length(t))).otherwise(t)
    tokens = F.concat(F.coalesce("words", F.array().cast("array<string>")), F.transform(lower, digits))
    bucket = lambda t: F.pmod(F.xxhash64(t), F.lit(1 << BUCKET_BITS)).cast("int")
    rows = joined.withColumn("t", tokens).select("page_id", "host", "path", "words", F.arrays_overlap("t", F.array(*map(F.lit, seeds))).alias("block"), F.transform("t", bucket).alias("tokens"))
    rows = C.materialize(rows, "urls")
    prior, table = train(rows.select("block", "tokens"))
    shared = spark.sparkContext.broadcast(table.astype(np.float32))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value.astype(np.float64)
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            ends = np.cumsum(np.concatenate(([0], lists.value_lengths().to_numpy(zero_copy_only=False))))
            sums = np.concatenate(([0.0], np.cumsum(table[lists.flatten().to_numpy()])))
            odds = np.where(np.diff(ends) > 0, prior + sums[ends[1:]] - sums[ends[:-1]], 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(odds)], names=[*batch.schema.names[:-1], "log_odds"])

    source = rows.select("page_id", "host", "path", "words", "tokens")
    scored = source.mapInArrow(score, source.drop("tokens").withColumn("log_odds", F.lit(0.0)).schema)
    rule, says = rule_columns(F.col("host"), F.col("path"), rules)
    odds = F.round("log_odds", 6)  # the sums differ in the last digits with the rows of a batch
    verdict = F.coalesce(says, F.when(odds > 0, "block").otherwise("allow"))
    return scored.select(F.col("page_id").alias(id_col), "host", "path", rule.alias("rule"), verdict.alias("verdict"), F.coalesce(F.array_join("words", " "), F.lit("")).alias("words"), odds.alias("log_odds"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(C.table(spark, sf_dir, "pages"))


QUERIES = {"op13_url_filter": op13_url_filter}
ORACLE: dict[str, str] = {}
