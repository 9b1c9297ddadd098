"""Batch scoring: a linear head over step features, with seeded dropout of steps, in batches of arrays."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .augmentation import drawn


def kept_steps(key: Column, steps: int, passes: int, drop: float, seed: int) -> Column:
    """1 for each step that a pass keeps and 0 for one that it drops (a share of ``drop``), all steps of the first pass first: drawn from (seed, pass, key, step) alone."""
    return F.flatten(F.array(*(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda t: (drawn(seed, p, key, t.cast("string")) >= drop).cast("double")) for p in range(passes))))


def score_batches(features: DataFrame, load: Callable[[], tuple[np.ndarray, np.ndarray]], steps: int, inputs: int, passes: int = 5, drop: float = 0.2, seed: int = 0, batch_size: int = 1024) -> DataFrame:
    """(sample_id, t, logit) of ``features`` (sample_id, features: ``steps`` times ``inputs`` numbers).

    ``load`` gives the head's weights (input, class) and bias, and is called once by each Python worker. Every pass drops steps, whose features become 0, and scores what is left; logits are the mean of the passes. A sample whose features are null, of another length, or hold a null is no sample and has no rows. What is dropped depends on the sample alone, so batches and partitions change nothing. No rows shuffle.
    """
    passes = passes if drop > 0 else 1
    whole = (F.size("features") == steps * inputs) & ~F.exists("features", lambda x: x.isNull())
    rows = features.filter(whole).select("sample_id", F.transform("features", lambda x: x.cast("double")).alias("x"), kept_steps(F.col("sample_id"), steps, passes, drop, seed).alias("kept"))

    def make() -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        weights, bias = load()

        def predict(x: np.ndarray, kept: np.ndarray) -> np.ndarray:
            total = sum((x * kept[:, p, :, None]) @ weights + bias for p in range(passes))
            return (total / passes).reshape(len(x), -1)

        return predict

    scored = predict_batch_udf(make, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size, input_tensor_shapes=[[steps, inputs], [passes, steps]])
    flat = rows.select("sample_id", scored("x", "kept").alias("flat"))
    classes = (F.size("flat") / steps).cast("int")
    return flat.select("sample_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda t: F.slice("flat", t * classes + 1, classes))).alias("t", "logit"))
