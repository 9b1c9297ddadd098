"""A sample store that is looked up by position: sorted files, and an index of how many samples lie in each and before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.sampling import running_total
from .samples import SAMPLES

#: Samples that are found by place before their images are read, up to which they are sent to all tasks.
FEW = 100_000


def write_store(samples: DataFrame, path: str, files: int = 16) -> None:
    """Samples (idx, label, image) as a store sorted by ``idx`` in about so many files, with the index of all of them."""
    samples.repartitionByRange(files, "idx").sortWithinPartitions("idx").write.mode("error").parquet(f"{path}/samples")
    write_index(samples.sparkSession, path)


def write_index(spark: SparkSession, path: str, name: str = "all", keep: str = "true") -> None:
    """Write the index ``name`` of the samples that the condition ``keep`` leaves: by file, how many there are, and up to and before it. Of the store only the columns that the condition names are read."""
    rows = spark.read.schema(SAMPLES).parquet(f"{path}/samples").filter(keep)
    by_file = rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min("idx").alias("first"), F.count(F.lit(1)).alias("n"))
    index = running_total(by_file, "first", F.col("n"), "upto").withColumns({"before": F.col("upto") - F.col("n"), "keep": F.lit(keep)})
    index.coalesce(1).write.mode("overwrite").parquet(f"{path}/index/{name}")


def stored(spark: SparkSession, path: str, positions: DataFrame, name: str = "all") -> DataFrame:
    """(position, idx, label, image) of a store at ``positions`` (position, from 1) among the samples of an index, in the order of ``idx``. Only the files that hold any of them are opened, of these the numbers first, and then the images that are wanted. Positions before 1, beyond the last, and null have no rows; one asked for twice has one."""
    index = spark.read.parquet(f"{path}/index/{name}")
    # A row a file of the store, as a listing has.
    found = positions.select("position").distinct().join(F.broadcast(index), (F.col("position") > F.col("before")) & (F.col("position") <= F.col("upto")))
    files = [(r["file"], r["keep"]) for r in found.select("file", "keep").distinct().collect()]
    if not files:
        return spark.createDataFrame([], f"position long, {SAMPLES}")
    wanted = found.select("position", F.col("file").alias("of"), (F.col("position") - F.col("before")).alias("at"))
    rows = spark.read.schema(SAMPLES).parquet(*(f for f, _ in files)).filter(files[0][1])
    numbers = rows.select("idx", F.col("_metadata.file_path").alias("file"))
    placed = numbers.withColumn("place", F.row_number().over(Window.partitionBy("file").orderBy("idx")))
    placed = placed.join(wanted, (F.col("file") == F.col("of")) & (F.col("place") == F.col("at"))).select("position", F.col("idx").alias("number"))
    placed = F.broadcast(placed) if wanted.count() <= FEW else placed
    return rows.join(placed, F.col("idx") == F.col("number")).select("position", "idx", "label", "image")
