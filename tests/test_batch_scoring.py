"""Batch scoring against the same head in numpy."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from inkstone.operators import batch_scoring, evaluation

WEIGHTS, BIAS = np.arange(12).reshape(4, 3) / 7 - 0.6, np.array([0.1, 0.0, -0.2])


def keeps(seed, p, key, t, drop):
    return int(hashlib.md5(f"{seed}-{p}-{key}-{t}".encode()).hexdigest()[:13], 16) / 2**52 >= drop


def test_scores(spark):
    rng = np.random.default_rng(0)
    x = {i: rng.standard_normal((6, 4)) for i in range(40)}
    rows = [(i, v.ravel().tolist()) for i, v in x.items()] + [(100, None), (101, [1.0] * 23), (102, [None] + [1.0] * 23), (103, [])]
    df = spark.createDataFrame(rows, "sample_id long, features array<double>")
    for passes, drop in ((5, 0.2), (3, 0.5), (5, 0.0)):
        want = {(i, t): np.mean([(v[t] * (keeps(9, p, i, t, drop) if drop else 1)) @ WEIGHTS + BIAS for p in range(passes)], 0) for i, v in x.items() for t in range(6)}
        for parts, size in ((1, 1024), (16, 3)):
            got = batch_scoring.score_batches(df.repartition(parts), lambda: (WEIGHTS, BIAS), 6, 4, passes, drop, seed=9, batch_size=size).collect()
            assert len(got) == 240 and all(np.allclose(r["logit"], want[r["sample_id"], r["t"]]) for r in got)
    assert batch_scoring.score_batches(df.limit(0), lambda: (WEIGHTS, BIAS), 6, 4).collect() == []


def test_weights_are_loaded_by_workers_only(spark, tmp_path):
    np.savez(tmp_path / "head.npz", weights=WEIGHTS, bias=BIAS)
    path, calls = str(tmp_path / "head.npz"), []

    def load():
        calls.append(1)
        held = np.load(path)
        return held["weights"], held["bias"]

    df = spark.range(50).select(F.col("id").alias("sample_id"), F.array_repeat(F.lit(0.5), 8).alias("features"))
    got = batch_scoring.score_batches(df, load, 2, 4, drop=0.0).collect()
    assert len(got) == 100 and calls == [] and np.allclose(got[0]["logit"], np.full(4, 0.5) @ WEIGHTS + BIAS)


def test_from_features_to_text(spark):
    # Features are the classes themselves, so the best class of a kept step is its own.
    one_hot = [[9.0 if c == k else 0.0 for c in range(3)] for k in (1, 1, 0, 2, 2, 1)]
    df = spark.createDataFrame([(1, sum(one_hot, []))], "sample_id long, features array<double>")
    logits = batch_scoring.score_batches(df, lambda: (np.eye(3), np.zeros(3)), 6, 3, drop=0.0)
    row = evaluation.evaluate(logits, spark.createDataFrame([(1, "aba")], "sample_id long, label string"), "ab").first()
    assert (row["pred"], row["exact"]) == ("aba", True)
