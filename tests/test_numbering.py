"""Numbering of tables that are larger than a sample and wider than their key, with exchanges worked out anew at each use."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from inkstone.operators import sampling
from inkstone.sources import samples

N = 200_000
LARGE = "/root/testdata/sf0.1"


@pytest.fixture
def wide(spark):
    """Rows in four partitions with keys in no order, ties in ``tied`` and a payload; every exchange is worked out anew."""
    before = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    yield spark.range(0, N, numPartitions=4).select((F.col("id") * 7919 % N).alias("id"), (F.col("id") % 3).cast("string").alias("source"), (F.col("id") % 1000).alias("tied"), F.repeat(F.lit("x"), 40).alias("label"), F.sha2(F.col("id").cast("string"), 256).alias("image"))
    spark.conf.set("spark.sql.exchange.reuse", before)


def dense(df, name, n=N):
    assert df.agg(F.min(name), F.max(name), F.countDistinct(name), F.count(name)).first() == (1, n, n, n)


def test_dense_index(wide):
    got = sampling.dense_index(wide, "id")
    assert set(got.columns) == {*wide.columns, "idx"} and got.filter(F.col("idx") != F.col("id") + 1).count() == 0
    dense(sampling.dense_index(wide, "tied"), "idx")
    dense(sampling.dense_index(wide, "image", ranges=7), "idx")
    by_source = sampling.dense_index(wide, "id", by=("source",)).groupBy("source").agg(F.max("idx").alias("m"), F.countDistinct("idx").alias("d"), F.count("idx").alias("n"))
    assert all(r["m"] == r["d"] == r["n"] for r in by_source.collect())


def test_running_total(wide):
    got = sampling.running_total(wide, "id", F.col("id"), "upto")
    assert got.filter(F.col("upto") != F.col("id") * (F.col("id") + 1) / 2).count() == 0


def test_ranges_hold_like_numbers(wide):
    sizes = [r["count"] for r in wide.groupBy(sampling.range_of(wide, "id", 16)).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * N / 16


def test_many_ranges_are_looked_up(wide):
    odd = wide.withColumn("x", F.when(F.col("id") % 5 == 0, F.lit(float("nan"))).when(F.col("id") % 7 == 0, None).otherwise(F.sin(F.col("id"))))
    for key in ("id", "image", "x", "tied"):
        dense(sampling.dense_index(odd, key, ranges=1000), "idx")
    got = sampling.dense_index(wide, "id", ranges=1000)
    assert got.filter(F.col("idx") != F.col("id") + 1).count() == 0 and "ArrowEvalPython" in got._jdf.queryExecution().executedPlan().toString()
    ordered = sampling.dense_index(odd.select("x"), "x", ranges=1000).withColumn("kind", F.when(F.col("x").isNull(), 0).when(F.isnan("x"), 2).otherwise(1))
    spans = ordered.groupBy("kind").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi")).orderBy("kind").collect()
    assert spans[0]["hi"] + 1 == spans[1]["lo"] and spans[1]["hi"] + 1 == spans[2]["lo"]
    # Few keys have few bounds, whatever the ranges.
    assert "Arrow" not in sampling.dense_index(wide.filter("id < 20"), "id", ranges=1000)._jdf.queryExecution().executedPlan().toString()


def test_batches(wide):
    sizes = sampling.mini_batches(wide, "id", 32).groupBy("batch_id").count().groupBy("count").agg(F.count(F.lit(1)).alias("n")).collect()
    assert [tuple(r) for r in sizes] == [(32, N // 32)]
    sizes = sampling.balanced_batches(wide, "source", "id", 30, {"0": 0.5, "1": 0.3, "2": 0.2}, batches=100).groupBy("batch_id", "source").count().groupBy("source", "count").agg(F.count(F.lit(1)).alias("n")).orderBy("source").collect()
    assert [tuple(r) for r in sizes] == [("0", 15, 100), ("1", 9, 100), ("2", 6, 100)]


def test_prefixes_and_orders(wide):
    kept = sampling.prefix_fraction(wide, "source", "id", 0.5).groupBy("source").count().orderBy("source").collect()
    sizes = {r["source"]: r["count"] for r in wide.groupBy("source").count().collect()}
    assert {r["source"]: r["count"] for r in kept} == {s: n // 2 for s, n in sizes.items()}
    one, two = (sampling.shuffled(wide, epoch, "id") for epoch in (1, 2))
    dense(one, "place")
    assert 0 < one.join(two.select("id", F.col("place").alias("other")), "id").filter(F.col("place") == F.col("other")).count() < 100


def test_lookup_and_ingest(spark, wide):
    at = spark.createDataFrame([(1,), (5_000,), (66_666,)], "position long")
    stored = wide.withColumnRenamed("id", "idx")
    got = samples.lookup(stored, at, F.col("idx") % 3 == 0).orderBy("position").collect()
    assert [(r["position"], r["idx"]) for r in got] == [(p, 3 * (p - 1)) for p in (1, 5_000, 66_666)]
    lines = wide.select(F.col("id").alias("line"), F.concat(F.col("id"), F.lit(".png\t"), "label").alias("value"))
    files = wide.filter("id % 2 = 0").select(F.concat(F.lit("/b/"), F.col("id"), F.lit(".png")).alias("path"), F.col("image").cast("binary").alias("content"))
    kept, rejects = samples.ingest(lines, files, "/b")
    dense(kept, "idx", N // 2)
    assert kept.filter(F.col("idx") != F.col("line") / 2 + 1).count() == 0 and rejects.count() == N // 2


@pytest.mark.parametrize("name", ["epoch_shuffle", "ingest_samples", "dense_index", "flat_offsets", "mini_batches", "prefix_fraction", "batch_quota", "batch_restart"])
def test_numbering_queries_at_the_larger_scale(spark, name):
    con = duckdb.connect()
    for t in ("documents", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{LARGE}/{t}.parquet'")
    want = con.execute(driver.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(tuple(r[c] for c in columns) for r in driver.queries()[name](spark, LARGE).collect()) == sorted(want.fetchall())


@pytest.mark.parametrize("name", ["attn_prune", "strip_oov", "flat_encode", "normalized_edit_distance", "threshold_report"])
def test_label_queries_shuffle_lines_at_most_once(spark, name):
    plan = driver.queries()[name](spark, LARGE)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == (1 if name in ("normalized_edit_distance", "threshold_report") else 0)
    # The lines are scored once, and filtered after that.
    assert plan.count("MapInArrow") == (1 if name in ("normalized_edit_distance", "threshold_report") else 0) and "spark_partition_id" not in plan.lower()
