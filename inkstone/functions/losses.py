"""Losses of a recogniser's scores: connectionist temporal classification, and cross-entropy with an ignored class."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scoring import log_softmax

#: Numbers of a lattice, or of padded scores, that are held at a time; a sample of its own may have more.
CELLS = 1 << 22


def log_shares(x: np.ndarray) -> np.ndarray:
    """The logarithm of softmax along the last axis."""
    x = x - x.max(-1, keepdims=True)
    return x - np.log(np.exp(x).sum(-1, keepdims=True))


def lattice(shares: np.ndarray, steps: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Negative log likelihood of labels (``ids``, a row each, ``sizes`` of them count) under log shares (sample, step, class; ``steps`` of them count), class 0 being the blank: sums over all alignments, all samples a step at a time.

    A place of the lattice is a label's character or a blank before, between or behind them; a step stays, goes on by one, or by two where that leaves out a blank between two characters that differ.
    """
    n, wide = len(ids), 2 * ids.shape[1] + 1
    places = np.zeros((n, wide), np.int64)
    places[:, 1::2] = ids
    skips = np.zeros((n, wide), bool)
    skips[:, 3::2] = ids[:, 1:] != ids[:, :-1]
    own = np.arange(wide) <= 2 * sizes[:, None]
    now = np.where((np.arange(wide) == 0), 0.0, -np.inf) + np.zeros((n, 1))
    with np.errstate(invalid="ignore", divide="ignore"):
        for t in range(shares.shape[1]):
            after = now
            # Before the first step a path may begin with the blank or with the first character.
            moved = np.concatenate((np.full((n, 1), -np.inf), now[:, :-1]), 1)
            after = np.logaddexp(after, moved)
            if t:
                moved = np.concatenate((np.full((n, 2), -np.inf), now[:, :-2]), 1)
                after = np.logaddexp(after, np.where(skips, moved, -np.inf))
            after = np.where(own, after + np.take_along_axis(shares[:, t], places, 1), -np.inf)
            now = np.where((t < steps)[:, None], after, now)
        last = np.take_along_axis(now, 2 * sizes[:, None], 1)[:, 0]
        before = np.take_along_axis(now, np.maximum(2 * sizes[:, None] - 1, 0), 1)[:, 0]
        return -np.where(sizes > 0, np.logaddexp(last, before), last)


def ctc_losses(logits: pa.Array, ids: pa.Array) -> np.ndarray:
    """The loss of each row of nested scores and ids, nan where it has none: either is null, a step is null or has another number of classes, a score or an id is null, or an id is no class but the blank."""
    logits, ids = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (logits, ids))
    rows, out = len(logits), np.full(len(logits), np.nan)
    steps, sizes = (np.array([0 if x is None else x for x in pa.compute.list_value_length(c).to_pylist()], np.int64) for c in (logits, ids))
    flat = logits.flatten()
    classes = pa.compute.list_value_length(flat).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values, letters = flat.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), ids.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    step_at, letter_at = np.cumsum(steps) - steps, np.cumsum(sizes) - sizes
    value_at = np.concatenate(([0], np.cumsum(classes)))
    whole = ~(logits.is_null().to_numpy(zero_copy_only=False) | ids.is_null().to_numpy(zero_copy_only=False))
    kinds = np.zeros(rows, np.int64)
    for i in np.flatnonzero(whole):
        k, own, x = classes[step_at[i] : step_at[i] + steps[i]], letters[letter_at[i] : letter_at[i] + sizes[i]], values[value_at[step_at[i]] : value_at[step_at[i] + steps[i]]]
        kinds[i] = k[0] if len(k) else 1
        whole[i] = kinds[i] > 0 and (k == kinds[i]).all() and not np.isnan(x).any() and (not len(k) or ((own >= 1) & (own < kinds[i])).all())
    for k in np.unique(kinds[whole]):
        todo = np.flatnonzero(whole & (kinds == k))
        todo = todo[np.lexsort((sizes[todo], steps[todo]))]
        while len(todo):
            # Samples of like sizes go side by side.
            wide = np.maximum(np.maximum.accumulate(steps[todo]) * k, 2 * np.maximum.accumulate(sizes[todo]) + 1)
            upto = max(1, int(np.searchsorted(wide * np.arange(1, len(todo) + 1), CELLS)))
            part, todo = todo[:upto], todo[upto:]
            scores, chars = np.zeros((len(part), steps[part].max(), k)), np.zeros((len(part), sizes[part].max()), np.int64)
            for at, i in enumerate(part):
                lo = value_at[step_at[i]]
                scores[at, : steps[i]] = values[lo : lo + steps[i] * k].reshape(-1, k)
                chars[at, : sizes[i]] = np.minimum(letters[letter_at[i] : letter_at[i] + sizes[i]], k - 1)
            out[part] = lattice(log_shares(scores), steps[part], chars, sizes[part])
    return out


def ctc_loss(logits: Column, ids: Column, zero_infinity: bool = True) -> Column:
    """Connectionist temporal classification loss: minus the logarithm of the summed shares of all alignments of ``ids`` (classes from 1; 0 is the blank) with the steps of ``logits`` (an array of scores for each step; softmax makes them shares).

    A label that no alignment fits, being longer than the steps allow, has an infinite loss: 0 with ``zero_infinity``. Without steps the empty label has 0, any other an infinite loss. Null for what is no sample: a null argument, score, step or id, steps with other numbers of classes, ids outside the classes, and scores that are not numbers. Samples are worked out side by side in Arrow batches.
    """

    @F.arrow_udf("double")
    def losses(scores: pa.Array, labels: pa.Array) -> pa.Array:
        found = ctc_losses(scores, labels)
        return pa.array(np.where(np.isinf(found), 0.0, found) if zero_infinity else found, pa.float64(), mask=np.isnan(found))

    return losses(logits, ids)


def cross_entropy(logits: Column, targets: Column, ignore: int = 0) -> Column:
    """(total, n): the summed cross-entropy of the steps of ``logits`` whose class in ``targets`` is not ``ignore``, and how many they are. Steps beyond the shorter of the two do not count; null targets, steps and scores add nothing; null if either argument is."""

    def term(scores: Column, target: Column) -> Column:
        share = F.get(log_softmax(scores), target)
        return F.when((target != ignore) & share.isNotNull(), -share)

    terms = F.filter(F.zip_with(logits, targets, term), lambda x: x.isNotNull())
    return F.struct(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x).alias("total"), F.size(terms).cast("long").alias("n"))


def mean_ctc_loss(rows: DataFrame, loss: str = "loss", size: str = "size", *by: str) -> DataFrame:
    """(by, mean_loss, n): losses of ``rows`` divided by their labels' sizes (an empty one's by 1), and the mean of that. Null losses are no samples."""
    return rows.filter(F.col(loss).isNotNull()).groupBy(*by).agg(F.avg(F.col(loss) / F.greatest(F.col(size), F.lit(1))).alias("mean_loss"), F.count(F.lit(1)).alias("n"))
