"""Fill-in-middle against a plain version, and its round trip."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkstone.llm import fill_middle

UNIT = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")


def brute(doc_id, text, rate=50, suffix_first=80, seed=42):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < suffix_first:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


ODD = [None, "", " ", "\n\t a", "one", "a b c ", "\x02 \x01\x02\x02 x\x01 \x010\x011 \x02", "\x01", "tail \x0b\x0c\r\n", "a <P> b", "<S>", "x<M", "<S <P <<M> <", "< < S> P> M>", "é ß 😀😀     z", "$0 $1 \\ \\1 $", "w " * 40_000, " " * 50_000, "x" * 200_000, "a\n" * 3_000 + "\x02" * 500]


def made(spark, rows, **options):
    df = fill_middle.fill_middle(spark.createDataFrame(rows, "doc_id long, text string"), **options)
    return df.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", fill_middle.restored(F.col("output"), F.col("form")).alias("back"), F.coalesce("text", F.lit("")).alias("text")).collect()


@pytest.mark.parametrize("options, forms", [({}, "plain psm spm"), ({"rate": 100}, "plain psm spm"), ({"rate": 100, "suffix_first": 0, "seed": 7}, "plain psm"), ({"rate": 0}, "plain")])
def test_against_brute_force(spark, options, forms):
    rows = [(k * 100 + i, text) for k in range(7) for i, text in enumerate(ODD)] + [(None, "no id at all"), (5, "one"), (5, "one")]
    got = made(spark, rows, **options)
    assert sorted(map(str, ((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got))) == sorted(map(str, ((i, *brute(i, t, **options)) for i, t in rows)))
    assert all(r["back"] == r["text"] for r in got)
    assert {r["form"] for r in got} == set(forms.split())


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(st.sampled_from("<PSM> \n\x01\x02a0é😀"), max_size=30), min_size=1, max_size=30))
def test_round_trip(spark, texts):
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r for r in made(spark, rows, rate=90)}
    assert all(got[i]["back"] == t and tuple(got[i])[1:6] == brute(i, t, rate=90) for i, t in rows)


def test_plan_is_one_projection(spark):
    plan = fill_middle.op12_fill_middle(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_names_of_columns_are_free(spark):
    names = ["output", "form", "n", "digest", "units", "first", "last", "parts", "in_text"]
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string").withColumns({x: F.lit(f"v-{x}") for x in names})
    row = fill_middle.fill_middle(df, rate=100).first()
    assert (row["n"], row["output"]) == (3, brute(1, "a b c", rate=100)[-1]) and all(row[x] == f"v-{x}" for x in names[3:])
    assert fill_middle.fill_middle(df.limit(0)).collect() == []
