"""URL filters: rules by host and path; for the rest host names are split into words by unigram Viterbi and multinomial naive Bayes, learnt from labelled URLs, scores the tokens."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, checkpoint, released, small, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: The number of words that the weight of one never seen is held against, whatever the input's own number, so that splits do not depend on the input's size.
UNSEEN = 10**9
WORDS = r"\p{L}+"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (lower case) and path; both are empty for null and where there is no ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, pattern, 1), UPPER, LOWER), F.regexp_extract(text, pattern, 2)


def by_rules(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits (ties: the smaller text), and its verdict; null without one."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]), reverse=True):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def split_words(name: str, counts: dict[str, int], total: int) -> list[str]:
    """The likeliest words that make up ``name``: a word's probability is its share of all words; one never seen has ten in ``UNSEEN``, a tenth of that for each of its letters. Of equal splits the one whose last word is longest."""
    longest = max(map(len, counts), default=0)
    log_total, unseen = math.log(max(total, 1)), math.log(10) - math.log(UNSEEN)
    # The best split up to each place; the best start of an unseen word that ends there, with its letters' cost taken off.
    best, back, start_of = [0.0], [0], 0
    open_ = [0.0]
    for end in range(1, len(name) + 1):
        score, start = open_[-1] + unseen - end * math.log(10), start_of
        for at in range(max(0, end - longest), end):
            n = counts.get(name[at:end], 0)
            if n and (known := best[at] + math.log(n) - log_total) > score + 1e-12:
                score, start = known, at
        best.append(score)
        back.append(start)
        own = score + end * math.log(10)
        start_of, value = (end, own) if own > open_[-1] + 1e-12 else (start_of, open_[-1])
        open_.append(value)
    words, end = [], len(name)
    while end:
        words.append(name[back[end] : end])
        end = back[end]
    return words[::-1]


def segment(names: DataFrame, texts: DataFrame) -> DataFrame:
    """(name, words) of the distinct ``names`` (name), by a unigram model counted over all of ``texts`` (text).

    A name asks only for its own substrings that are as long as some word, so the vocabulary is never gathered anywhere, and words may be of any length.
    """
    found = texts.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORDS), F.lit(0))).alias("word"))
    counts = checkpoint(found.groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    # One number for each length that occurs.
    told = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.sort_array(F.collect_set(F.char_length("word"))).alias("lengths")).first()
    total, lengths = told["total"], told["lengths"]
    sizes = F.filter(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>"), lambda n: n <= F.char_length("name"))
    spans = names.withColumn("size", F.explode(sizes)).withColumn("i", F.explode(F.sequence(F.lit(1), F.char_length("name") - F.col("size") + 1)))
    subs = spans.select("name", F.substring(F.col("name"), F.col("i"), F.col("size")).alias("word")).distinct()
    # A map holds the substrings of one name that are words.
    maps = subs.join(counts, "word").groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("counts"))

    @F.pandas_udf("array<string>")
    def words(name: pd.Series, counts: pd.Series) -> pd.Series:
        return pd.Series([split_words(n, dict(c) if c is not None else {}, total) for n, c in zip(name, counts, strict=True)])

    return names.join(maps, "name", "left").select("name", words("name", "counts").alias("words"))


def tokens_of(urls: DataFrame, texts: DataFrame) -> DataFrame:
    """(url, kind, word, tf): the words of the hosts, split, and of the paths of distinct ``urls`` (url)."""
    host, path = url_parts(F.col("url"))
    hosts = urls.select("url", F.explode(F.regexp_extract_all(host, F.lit(WORDS), F.lit(0))).alias("name"))
    split = checkpoint(segment(hosts.select("name").distinct(), texts))
    of_host = hosts.join(small(split, 100_000), "name").select("url", F.explode("words").alias("word"), F.lit("host").alias("kind"))
    of_path = urls.select("url", F.explode(F.regexp_extract_all(F.lower(path), F.lit(WORDS), F.lit(0))).alias("word"), F.lit("path").alias("kind"))
    return of_host.unionByName(of_path).groupBy("url", "kind", "word").agg(F.count(F.lit(1)).alias("tf"))


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, examples: DataFrame | None = None) -> DataFrame:
    """``pages`` (url, html and more) with ``host``, ``path``, ``rule``, ``score`` (log odds of block) and ``verdict``.

    The longest rule that fits a URL decides; without one, the classifier: block if ``score`` is above 0, else allow. Words of the host (its parts split by Viterbi with word counts of all html) and of the path are tokens of multinomial naive Bayes with add-one smoothing. It learns from ``examples`` (url, verdict: block or allow), those among the URLs of ``pages``; a URL with both verdicts counts for both. By default the examples are the distinct URLs of ``pages`` that a rule decides, so the rest is judged by its likeness to these. Words and URLs may be of any length. Null URLs and those without ``://`` have no tokens and get the odds of the classes alone; null html counts as empty; without any example all scores are 0. Rows that repeat are judged alike. An empty table gives no rows. Columns of ``pages`` with the names added are replaced; other names are free.
    """
    rows = carried(pages, ("host", "path", "rule", "score", "verdict"))
    rows = rows.withColumn("own", F.coalesce("in_url", F.lit("")))
    urls = checkpoint(rows.select(F.col("own").alias("url")).distinct())
    tokens = checkpoint(tokens_of(urls, rows.select(F.coalesce("in_html", F.lit("")).alias("text"))))
    if examples is None:
        labelled = urls.select("url", by_rules(*url_parts(F.col("url")), rules)[1].alias("verdict"))
    else:
        labelled = urls.join(examples.select("url", "verdict").distinct(), "url")
    labelled = labelled.filter(F.col("verdict").isin("block", "allow"))
    n = {r["verdict"]: r["n"] for r in labelled.groupBy("verdict").agg(F.count(F.lit(1)).alias("n")).collect()}
    of_class = tokens.join(labelled, "url").groupBy("kind", "word").agg(*(F.sum(F.when(F.col("verdict") == v, F.col("tf")).otherwise(0)).alias(v) for v in ("block", "allow")))
    counted = checkpoint(of_class)
    sums = counted.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("block"), F.lit(0)).alias("b"), F.coalesce(F.sum("allow"), F.lit(0)).alias("a")).first()
    odds = F.log((F.col("block") + 1) / F.lit(float(sums["b"] + sums["v"]))) - F.log((F.col("allow") + 1) / F.lit(float(sums["a"] + sums["v"])))
    prior = math.log((n.get("block", 0) + 1) / (n.get("allow", 0) + 1))
    # Words that no example has say nothing.
    weights = small(counted, 100_000).select("kind", "word", odds.alias("w"))
    scores = tokens.join(weights, ["kind", "word"]).groupBy("url").agg(F.sum(F.col("tf") * F.col("w")).alias("sum"))
    # One row a URL: where there are few, the pages stay where they are.
    out = rows.join(small(checkpoint(scores), 100_000), F.col("own") == F.col("url"), "left").withColumn("odds", F.coalesce("sum", F.lit(0.0)) + F.lit(prior))
    host, path = url_parts(F.col("own"))
    rule, verdict = by_rules(host, path, rules)
    by_score = F.when(F.col("odds") > 0, "block").otherwise("allow")
    return released(out, host=host, path=path, rule=rule, score=F.col("odds"), verdict=F.coalesce(verdict, by_score))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a page: page_id, host, path, rule, verdict, score; cases as in ``judge_urls``."""
    judged = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))
