"""Quality classifier: hashed word n-grams, logistic regression by follow the regularised leader, scores as sparse dot products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec
from .common import short_batches, table

#: Hash space of the features: the model is always 2**BITS weights and a bias, 1 MB.
BITS = 18
#: Labelled documents that a model is fitted on at most, those of the lowest hash of doc_id.
SAMPLE = 12_000
#: Stand for pairs of a word with itself, by distance.
REPEATS = {1: 0x5851F42D4C957F2D, 2: 0x14057B7EF767814F}
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 0.02, 0.5, 3


def features(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts: bucket of each word and word pair, the run's text it is of (ascending), and the number of items by text. Words are folded to lower case; runs of ASCII marks are words too, and a word repeated is a pair of its own kind."""
    for c in textvec.chunks(texts, lower=True, marks=True):
        doc, h = c.doc_of(), c.hashes
        parts = [(h, doc)]
        for gap in (1, 2):
            same = doc[gap:] == doc[:-gap]
            if gap == 1:
                parts.append((textvec.windows(h, 2)[same], doc[:-1][same]))
            # A word that comes again at once or after another one: the pair by its pattern, whatever the word.
            again = same & (h[gap:] == h[:-gap])
            parts.append((np.full(int(again.sum()), REPEATS[gap], np.uint64), doc[:-gap][again]))
        at = np.concatenate([d for _, d in parts])
        order = np.argsort(at, kind="stable")
        bucket = (np.concatenate([x for x, _ in parts]) >> np.uint64(64 - BITS)).astype(np.int32)[order]
        yield bucket, at[order], np.bincount(at, minlength=len(c.texts))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train(examples: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """Weights from (buckets, values, label) by FTRL-proximal updates, one example at a time; the bias, a bucket of its own with the value 1, comes last."""
    z, n, bias = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1), (np.array([1 << BITS], np.int32), np.ones(1, np.float32))

    def weights(at):
        return np.where(np.abs(z[at]) <= L1, 0.0, -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for at, x, y in examples:
            at, x = np.concatenate((at, bias[0])), np.concatenate((x, bias[1]))
            w = weights(at)
            g = (sigmoid(w @ x) - y) * x
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
            n[at] = grown
    return weights(slice(None)).astype(np.float32)


def scores(texts: list[bytes | None], weights: np.ndarray) -> np.ndarray:
    out = []
    for bucket, at, n in features(texts):
        total = np.bincount(at, weights=weights[bucket], minlength=len(n))
        out.append(sigmoid(total / np.sqrt(np.maximum(n, 1)) + weights[-1]))
    return np.concatenate(out) if out else np.zeros(0)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights fitted on at most ``sample`` labelled documents that are not held out. Null labels and ids are left out, a doc_id labelled twice has its lower label; without examples of both labels all weights but the bias may be 0."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    picked = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ats, xs = [], []
            for bucket, at, n in features(batch["text"].to_pylist()):
                for own in np.split(bucket, np.cumsum(n)[:-1]):
                    u, c = np.unique(own, return_counts=True)
                    ats.append(u.astype(np.int32).tobytes())
                    xs.append((c / np.sqrt(max(1, len(own)))).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["label"], pa.array(ats, pa.binary()), pa.array(xs, pa.binary())], ["doc_id", "label", "at", "x"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Batch by batch: only the examples themselves are held.
        examples = [(np.frombuffer(a, np.int32), np.frombuffer(x, np.float32), y) for batch in batches for a, x, y in zip(*(batch[n].to_pylist() for n in ("at", "x", "label")), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([train(examples).tobytes()], pa.binary())], ["weights"])

    # One task, of at most ``sample`` rows; ties and repeated rows are all examples.
    rows = picked.mapInArrow(sparse, "doc_id long, label int, at binary, x binary").withColumn("order", F.xxhash64("doc_id", F.lit(7)))
    with short_batches(docs.sparkSession):
        got = rows.repartition(1).sortWithinPartitions("order", "doc_id").mapInArrow(learn, "weights binary").first()
    return np.frombuffer(got["weights"], np.float32) if got else np.zeros((1 << BITS) + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``docs`` with ``score`` (0 to 1; higher: label 1 likelier), of the whole text and nothing else, and ``predicted`` (1 from 0.5 on). Null and empty texts get the bias's score. Columns of ``docs`` with these names are replaced."""
    model = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(scores(texts.tolist(), model.value))

    out = docs.drop("score", "predicted").withColumn("score", scored(F.col("text").cast("binary")))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: doc_id, held_out (false without a doc_id), score, predicted; cases as in ``fit`` and ``score``."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs.select("doc_id", "text"), fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
