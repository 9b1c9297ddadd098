"""Small helpers that the operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space and the five ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Let Hadoop delete a folder of intermediate results when the driver ends."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(place)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset a local session, whose executors are this machine, gets a temporary one; any other one gets an error, as its executors would not see this machine's folders."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="inkstone-")
            remove_at_exit(spark, folder)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder; this runs a job."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def short_batches(spark: SparkSession, rows: int = 512) -> Iterator[None]:
    """While jobs inside run, texts go to Python in batches of ``rows``, unless the session's are shorter: Spark's default of 10,000 long texts is much for a worker and for the JVM's buffers."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def carried(df: DataFrame, added: Iterable[str] = ()) -> DataFrame:
    """``df`` with ``in_`` before every column's name, so that none can clash with an operator's own (which never begin so); columns with the names ``added`` are left out."""
    added = set(added)
    return df.select(*(F.col(f"`{c}`").alias(f"in_{c}") for c in df.columns if c not in added))


def of_caller(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns if c.startswith("in_")]


def released(df: DataFrame, **columns: Column) -> DataFrame:
    """The caller's columns by their names, those named here replaced or added at the end."""
    own = [c.removeprefix("in_") for c in df.columns if c.startswith("in_")]
    kept = [columns.pop(c).alias(c) if c in columns else F.col(f"`in_{c}`").alias(c) for c in own]
    return df.select(*kept, *(c.alias(n) for n, c in columns.items()))


def text_key(text: Column) -> Column:
    """Tells rows apart that repeat a doc_id with another text, by way of SHA-256."""
    return F.xxhash64(F.sha2(F.coalesce(text, F.lit("")), 256))


def small(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast if a checkpointed side has been counted to be within ``rows``; else it stays a shuffled join."""
    return F.broadcast(df) if df.count() <= rows else df


def chunk_pairs(df: DataFrame, member: str) -> DataFrame:
    """Deal the rows of each group to all pairs of its ``chunks`` chunks, by a hash of ``member``, so that no task holds a whole group.

    Adds ``chunk`` (the row's own) and ``a`` <= ``b`` (the pair it was dealt to; one of them is ``chunk``); ``chunks`` goes.
    """
    dealt = df.withColumn("chunk", F.pmod(F.xxhash64(member), F.col("chunks")).cast("int"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return other.withColumns({"a": F.least("chunk", "other"), "b": F.greatest("chunk", "other")}).drop("other", "chunks")
