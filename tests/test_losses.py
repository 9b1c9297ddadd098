"""Losses against sums over every alignment."""

import itertools
import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkstone.functions import losses


def collapsed(path):
    return [c for c, _ in itertools.groupby(path) if c]


def every_alignment(logits, ids):
    if not logits:
        return 0.0 if not ids else math.inf
    shares = [[math.exp(x) / sum(map(math.exp, row)) for x in row] for row in logits]
    total = sum(math.prod(s[c] for s, c in zip(shares, path, strict=True)) for path in itertools.product(range(len(logits[0])), repeat=len(logits)) if collapsed(path) == ids)
    return -math.log(total) if total else math.inf


SAMPLE = st.integers(2, 3).flatmap(lambda k: st.tuples(st.lists(st.lists(st.floats(-4, 4), min_size=k, max_size=k), max_size=5), st.lists(st.integers(1, k - 1), max_size=4)))


@settings(max_examples=80, deadline=None)
@given(st.lists(SAMPLE, min_size=1, max_size=5), st.sampled_from([losses.CELLS, 1]))
def test_ctc_is_the_sum_over_all_alignments(samples, cells):
    before, losses.CELLS = losses.CELLS, cells
    try:
        got = losses.ctc_losses(pa.array([x for x, _ in samples], pa.list_(pa.list_(pa.float64()))), pa.array([y for _, y in samples], pa.list_(pa.int32())))
    finally:
        losses.CELLS = before
    assert got.tolist() == [pytest.approx(every_alignment(x, y), abs=1e-9) for x, y in samples]


def test_ctc_column(spark):
    good = [[0.1, 0.2, 0.3], [1.0, 0.0, 0.0], [0.0, 2.0, -1.0]]
    rows = [(1, good, [1, 2]), (2, good, [1, 1, 1]), (3, None, [1]), (4, good, None), (5, [], []), (6, [], [1]), (7, [[0.0, 1.0], None], [1]), (8, [[0.0, 1.0], [0.0]], [1]), (9, good, [3]), (10, good, [0]), (11, good, [1, None]), (12, [[float("nan"), 1.0]], [1]), (13, good, []), (14, [[0.0, None]], [1]), (15, [[1e9, -1e9, 0.0]] * 4, [2])]
    df = spark.createDataFrame(rows, "id int, x array<array<float>>, y array<int>").repartition(2)
    got = {r["id"]: (r["zero"], r["open"]) for r in df.select("id", losses.ctc_loss(F.col("x"), F.col("y")).alias("zero"), losses.ctc_loss(F.col("x"), F.col("y"), zero_infinity=False).alias("open")).collect()}
    f32 = [[float(np.float32(v)) for v in row] for row in good]
    assert got[1] == (pytest.approx(every_alignment(f32, [1, 2])),) * 2 and got[13] == (pytest.approx(every_alignment(f32, [])),) * 2
    assert got[2] == (0.0, math.inf) and got[5] == (0.0, 0.0) and got[6] == (0.0, math.inf) and got[15][0] == pytest.approx(1e9)
    assert all(got[i] == (None, None) for i in (3, 4, 7, 8, 9, 10, 11, 12, 14))


def test_long_samples_beside_short_ones(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal((n, 5)).tolist(), rng.integers(1, 5, n // 3).tolist()) for i, n in enumerate((1, 2000, 3, 40, 7, 400))]
    df = spark.createDataFrame(rows, "id int, x array<array<double>>, y array<int>").coalesce(1)
    got = {r[0]: r[1] for r in df.select("id", losses.ctc_loss(F.col("x"), F.col("y"))).collect()}
    for i, x, y in rows:
        alone = losses.ctc_losses(pa.array([x]), pa.array([y], pa.list_(pa.int32())))[0]
        assert got[i] == pytest.approx(alone)
    assert got[1] > 100 and df.limit(0).select(losses.ctc_loss(F.col("x"), F.col("y"))).collect() == []


def test_cross_entropy_and_means(spark):
    x = [[0.0, 1.0, 2.0], [3.0, 0.0, 0.0], [1.0, 1.0, 1.0]]
    rows = [(1, x, [2, 0, 1]), (2, x, [0, 0, 0]), (3, x, [1]), (4, None, [1]), (5, [None, x[0]], [1, None])]
    got = {r["id"]: r["e"] for r in spark.createDataFrame(rows, "id int, x array<array<double>>, y array<int>").select("id", losses.cross_entropy(F.col("x"), F.col("y")).alias("e")).collect()}
    share = [[math.exp(v) / sum(map(math.exp, row)) for v in row] for row in x]
    assert tuple(got[1]) == (pytest.approx(-math.log(share[0][2]) - math.log(share[2][1])), 2)
    assert tuple(got[2]) == (0.0, 0) and tuple(got[3]) == (pytest.approx(-math.log(share[0][1])), 1) and tuple(got[5]) == (0.0, 0)
    assert got[4] is None or got[4]["total"] is None
    means = losses.mean_ctc_loss(spark.createDataFrame([(4.0, 2), (3.0, 0), (None, 1)], "loss double, size int")).first()
    assert tuple(means) == (2.5, 2)
