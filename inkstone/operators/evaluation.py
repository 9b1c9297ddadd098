"""Evaluation of a recogniser's scores: decode, confidence, match and edit distance in one plan."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codecs, scoring


def scored(pairs: DataFrame, name: str = "ned") -> DataFrame:
    """``pairs`` (gt, pred and more) with their edit similarity in a column that filters read as they read a stored one: rows are dealt out singly, as long ones are dear, and scored there once, before any filter. Null texts give null, an empty one 0.

    Dealt by number, as small partitions of costly rows must not be merged.
    """
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = T.StructType([*pairs.schema, T.StructField(name, T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if a is None or b is None else 1 - scoring.distance(a, b) / max(len(a), len(b)) if a and b else 0.0 for a, b in zip(batch["gt"].to_pylist(), batch["pred"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, name])

    return pairs.repartition(n).mapInArrow(score, out)


def evaluate(logits: DataFrame, truth: DataFrame, alphabet: str, codec: str = "ctc") -> DataFrame:
    """(sample_id, gt, pred, confidence, exact, ned) of scores (sample_id, t, logit: one number for each class) and labels (sample_id, label).

    The best class of each step is decoded: with "ctc" class 0 is the blank; with "attention" 0 and 1 are the start and the end token, and the text ends at the end token (without one, its last character goes). ``confidence`` is the product of the steps' best shares, of an attention text's own steps; 0 of none. Samples without scores or without a label are left out. Only a step's best class and share leave the scan: a sample's steps meet as two short arrays.
    """
    best = logits.select("sample_id", "t", scoring.argmax(F.col("logit")).alias("id"), F.array_max(scoring.softmax(F.col("logit"))).alias("p"))
    steps = best.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("t", "id", "p"))).alias("s"))
    ids, p = F.col("s.id"), F.col("s.p")
    if codec == "ctc":
        pred, shares = codecs.ctc_decode(ids, alphabet), p
    else:
        # By place among the ids: tokens are longer than a character.
        end = F.array_position(ids, F.lit(1))
        kept = F.when(end > 0, end - 1).otherwise(F.greatest(F.size(ids) - 1, F.lit(0))).cast("int")
        pred, shares = codecs.attention_decode(F.slice(ids, F.lit(1), kept), alphabet), F.slice(p, F.lit(1), kept)
    both = steps.join(truth.select("sample_id", F.col("label").alias("gt")), "sample_id")
    return both.select("sample_id", "gt", pred.alias("pred"), scoring.cumulative_product(shares).alias("confidence")).withColumns({"exact": F.col("pred") == F.col("gt"), "ned": scoring.normalized_similarity(F.col("gt"), F.col("pred"))})


def summary(rows: DataFrame, *by: str) -> DataFrame:
    """Accuracy in percent and edit similarity weighted by label length (null for no characters at all)."""
    size: Column = F.char_length("gt")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), (100 * F.avg(F.col("exact").cast("int"))).alias("accuracy"), (F.sum(F.col("ned") * size) / F.nullif(F.sum(size), F.lit(0))).alias("norm_ed"))
