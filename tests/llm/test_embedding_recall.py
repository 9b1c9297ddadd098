"""Recall of links on vectors that fill the space, and on vectors near a subspace, whose neighbours differ along the directions that the codebooks split."""

import numpy as np
import pytest

from inkstone.llm import embedding_dedup as ed


def low_rank(n, rank, dim, seed=1):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((n, rank)) @ rng.standard_normal((rank, dim)) + 0.02 * rng.standard_normal((n, dim))


def frame(spark, x, label):
    rows = [(i, [float(np.float32(c)) for c in v], int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def links(x, label):
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    out = np.zeros(len(u), np.int64)
    for k in np.unique(label):
        at = np.flatnonzero(label == k)
        for part in np.array_split(at, len(at) // 2000 + 1):
            out[part] += (u[part] @ u[at].T >= 0.93).sum(1) - 1
    return out


@pytest.mark.parametrize("n, rank, dim", [(5_000, 3, 64), (5_000, 5, 64), (5_000, 8, 64), (5_000, 6, 256), (20_000, 6, 256)])
def test_recall_near_a_subspace(spark, n, rank, dim):
    x, label = low_rank(n, rank, dim), np.arange(n) % 2
    want = links(x, label)
    got = {r["vec_id"]: r["n_links"] for r in ed.near_duplicates(frame(spark, x, label)).collect()}
    print(n, rank, dim, int(want.sum()), sum(got.values()) / want.sum())
    assert all(got[i] <= want[i] for i in got) and sum(got.values()) >= 0.99 * want.sum()


def test_few_links_are_foreseen(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 64))
    x[1:60:2] = x[:59:2] + 0.35 * rng.standard_normal((30, 64))
    label = np.zeros(3000, int)
    want = links(x, label)
    got = {r["vec_id"]: r["n_links"] for r in ed.near_duplicates(frame(spark, x, label)).collect()}
    assert 20 < want.sum() < 200 and sum(got.values()) >= 0.95 * want.sum() and all(got[i] <= want[i] for i in got)


def test_measured_excess_is_that_of_each_link():
    rng = np.random.default_rng(2)
    x = ed.unit(rng.standard_normal((200, 6)))
    books = tuple(ed.codebook(h, 8) for h in ed.halves(x))
    first, second = (ed.squared(h, b) for h, b in zip(ed.halves(x), books, strict=True))
    u, v = first.argmin(1), second.argmin(1)
    assert np.allclose(ed.excesses(first, second, u, v), 0)
    a, b = rng.integers(0, 200, 50), rng.integers(0, 200, 50)
    need = ed.excesses(first[a], second[a], u[b], v[b])
    for k, (i, j) in enumerate(zip(a, b, strict=True)):
        # Cells by rising sum, one after another, as a traversal comes to them.
        order = sorted((first[i, p] + second[i, q], p, q) for p in range(8) for q in range(8))
        come = [(p, q) for d, p, q in order if d <= order[0][0] + need[k] + 1e-12]
        assert (u[j], v[j]) == come[-1] or np.isclose(first[i, u[j]] + second[i, v[j]], order[len(come) - 1][0])
        reach, _ = ed.traverse(first[i : i + 1], second[i : i + 1], need[k] + 1e-12)
        assert {(p, q) for p in range(8) for q in range(8) if second[i, q] <= reach[0, p]} == set(come)
