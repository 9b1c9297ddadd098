"""The corpus pipeline: each stage reads what the one before it wrote.

All stages take null and empty texts, texts of any length, rows that repeat, with or without a doc_id, empty tables and further columns, which they leave out; what each then does is said there. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm import line_dedup, mixing, ngram_join, packing, quality
from inkstone.llm.common import remove_at_exit, shared_folder, table

#: The columns of documents, which all stages but the last return.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled documents of the corpus, does not reject. Null and empty texts all get the bias's score, and so stay or go together; rows that repeat are judged alike; an empty table gives no rows."""
    weights = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.score(docs, weights).filter("predicted = 1").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them, that of the largest doc_id. Null texts become empty, no row goes, and n_chars follows the text."""
    return line_dedup.dedup_lines(docs).select(*COLUMNS)


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, with the smallest doc_id; of rows that repeat, or share that doc_id, one. Null and empty texts all stay."""
    return ngram_join.near_texts(docs).filter("kept").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document. Texts without words are taken as often as all of their source are at least; of rows that repeat as many are picked as are wanted."""
    mixed = mixing.mix(docs).filter("copies > 0")
    return mixed.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the token sequences; a null or empty text is its end id alone, rows that repeat are packed each."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", keep_one_of_near),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack),
]

#: Training a classifier, similarity joins and bin packing are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage before it returns is written to the shared folder of ``spark.checkpoint.dir`` and read again; the folder goes when the driver ends."""
    docs, own = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    remove_at_exit(spark, own)
    for n, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{own}/{n}")
        docs = spark.read.parquet(f"{own}/{n}")
    return STAGES[-1][1](spark, docs, sf_dir)
