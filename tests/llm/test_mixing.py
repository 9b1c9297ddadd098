"""Mixing against a plain version of its targets, and of what a mix may take."""

import random
import re

import pytest
from pyspark.sql import functions as F

from inkstone.llm import mixing

from ..conftest import SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def water(sizes, weights, most):
    """Shares by weight, sources at their bound taken out one after another."""
    target, open_, left = {}, set(sizes), float(sum(sizes.values()))
    while open_:
        heavy = sum(weights[s] for s in open_)
        first = min(open_, key=lambda s: (most * sizes[s] / weights[s], str(s)))
        if left * weights[first] / heavy <= most * sizes[first]:
            return target | {s: left * weights[s] / heavy for s in open_}
        target[first] = most * sizes[first]
        left -= target[first]
        open_.remove(first)
    return target


def by_place(sources, weights=mixing.WEIGHTS):
    names = sorted((s for s in sources if s is not None)) + [None] * (None in sources)
    return {s: weights[i % len(weights)] for i, s in enumerate(names)}


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {(f"s{i}" if i else None): rng.choice([0, 1, 7, rng.randint(1, 10**6)]) for i in range(rng.randint(1, 40))}
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), mixing.WEIGHTS, 3.0).collect()}
    assert got == {s: pytest.approx(t) for s, t in water(sizes, by_place(sizes), 3.0).items()} and sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_sources_without_words_leave_their_weight(spark):
    sizes = {None: 0, "a": 30_003, "b": 0, "c": 30_182}
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), mixing.WEIGHTS, 3.0).collect()}
    assert got == {s: pytest.approx(t) for s, t in water(sizes, by_place(sizes), 3.0).items()} and sum(got.values()) == pytest.approx(60_185)


def mixed(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    want = water(sizes, by_place(sizes), 3.0)
    assert sorted((r["doc_id"], r["text"], r["source"]) for r in got if r["doc_id"] is not None and r["text"] is not None and r["source"]) == sorted(r for r in rows if r[0] is not None and r[1] is not None and r[2])
    taken = {s: 0 for s in sizes}
    for r in got:
        n = len(WORD.findall(r["text"] or ""))
        assert (r["size"], r["source_size"]) == (n, sizes[r["source"]]) and r["target"] == pytest.approx(want[r["source"]]) and 0 <= r["copies"] <= 3
        taken[r["source"]] += n * r["copies"]
    return taken, want, got


@pytest.mark.parametrize("copies", [1, 2, 1000])
def test_repeated_rows_meet_their_target(spark, copies):
    rows = [(k, "ten words of one text that is there very often " * 1, "a") for k in range(1000 // copies) for _ in range(copies)] + [(10_000 + k, f"{k} other words, as many of them as the ones before", "b") for k in range(1000)]
    taken, want, got = mixed(spark, rows)
    longest = {s: max(r["size"] for r in got if r["source"] == s) for s in want}
    assert all(abs(taken[s] - want[s]) <= longest[s] for s in want)
    again = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7))
    assert sorted((r["doc_id"], r["copies"]) for r in again.collect()) == sorted((r["doc_id"], r["copies"]) for r in got)


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "", "a"), (None, "no id here", "c"), (3, "x " * 30_000, "a"), (3, "x " * 30_000, "a"), (4, "one", "b"), (4, "one", "b"), (5, "a b c", None)] + [(10 + i, f"w{i} " * (i % 9), "d") for i in range(200)]
    taken, want, got = mixed(spark, rows)
    assert len(got) == len(rows) and all(taken[s] <= want[s] + 1 for s in want)


def test_a_few_documents_of_each_length_as_well_as_can_be(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "source")
    taken, want, got = mixed(spark, [tuple(r) for r in docs.collect()])
    for source, target in want.items():
        sizes = [r["size"] for r in got if r["source"] == source]
        base = min(3, int(target // sum(sizes)))
        budget = min(sum(sizes), round(target - base * sum(sizes))) if base < 3 else 0
        sums = {0}
        for n in sizes:
            sums |= {x + n for x in sums if x + n <= budget}
        assert taken[source] == base * sum(sizes) + max(sums), source
    assert mixing.mix(docs.limit(0)).collect() == []


def test_no_task_holds_all_sources(spark):
    rows = spark.range(6_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words "), F.col("id")).alias("text"), F.concat(F.lit("host"), F.col("id") % 1_500).alias("source"))
    got = mixing.mix(rows).groupBy("source").agg(F.first("target").alias("t"), F.first("source_size").alias("n")).agg(F.sum("t"), F.sum("n"), F.count("*")).first()
    assert got[0] == pytest.approx(got[1]) and got[2] == 1_500
