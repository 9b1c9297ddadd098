"""Sources and sinks: ground-truth lists, image files, sample tables, vocabularies and reports."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.codecs import record_key
from ..operators.sampling import dense_index

SAMPLES = "idx long, label string, image binary"
REPORT = "Alphabet string, Accuracy double"


def split_fields(lines: DataFrame) -> DataFrame:
    """(image_path, label) of the lines (value) with exactly two tab-separated fields; an empty label stays."""
    parts = F.split(F.regexp_replace("value", "\n$", ""), "\t", -1)
    return lines.select("*", parts.alias("__p")).filter(F.size("__p") == 2).withColumns({"image_path": F.col("__p")[0], "label": F.col("__p")[1]}).drop("value", "__p")


def list_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of a list or a folder of lists: lines are numbered from 1 in the order of the lists' names and of their places there, whatever splits the lists are read in."""
    read = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("id"))
    # Ids rise along a split, and splits are known by where they begin.
    places = (F.lpad(F.col(c).cast("string"), 20, "0") for c in ("file_block_start", "id"))
    return dense_index(read.select("value", F.concat_ws("\t", "file_path", *places).alias("__at")), "__at", "line").select("line", "value")


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(line, image_path, label) of the good lines of a list or a folder of lists, numbered as by ``list_lines``."""
    return split_fields(list_lines(spark, path))


def ingest(lines: DataFrame, files: DataFrame, base: str, valid: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(samples, rejects) of a ground-truth list (line, value), the files (path, content) and, where they are to be checked, the paths of valid images (path).

    Samples (idx, line, image_path, label, image) are numbered from 1 in the order of their lines, without gaps. Rejects (line, value, reason) are lines without exactly two fields, without a file, or with a file that is no image.
    """
    split = F.split(F.regexp_replace("value", "\n$", ""), "\t", -1)
    two = lines.withColumn("__p", split)
    good = two.filter(F.size("__p") == 2).select("line", "value", F.col("__p")[0].alias("image_path"), F.col("__p")[1].alias("label"))
    rejects = two.filter(F.size("__p") != 2).select("line", "value", F.lit("not two fields").alias("reason"))
    # Lines are judged and numbered without the files' contents, which are joined last.
    named, names = good.withColumn("path", joined_path(base, F.col("image_path"))), files.select("path")
    rejects = rejects.unionByName(named.join(names, "path", "left_anti").select("line", "value", F.lit("no file").alias("reason")))
    found = named.join(names, "path", "left_semi")
    if valid is not None:
        rejects = rejects.unionByName(found.join(valid.select("path"), "path", "left_anti").select("line", "value", F.lit("no image").alias("reason")))
        found = found.join(valid.select("path"), "path", "left_semi")
    numbered = dense_index(found.select("line", "image_path", "label", "path"), "line")
    return numbered.join(files.select("path", F.col("content").alias("image")), "path").select("idx", "line", "image_path", "label", "image"), rejects


def lookup(samples: DataFrame, positions: DataFrame, keep: Column | None = None) -> DataFrame:
    """The samples at ``positions`` (position, from 1) among those that ``keep`` leaves, in the order of ``idx``: surviving places map to stored ones."""
    survivors = samples if keep is None else samples.filter(keep)
    return dense_index(survivors, "idx", "position").join(positions, "position")


def leaf_tables(spark: SparkSession, root: str, selected: tuple[str, ...] = ("/",)) -> DataFrame:
    """All sample tables below a folder as one, ``source`` being the folder of each below ``root``; those whose path holds any of ``selected`` (by default all)."""
    rows = spark.read.schema(SAMPLES).option("recursiveFileLookup", True).parquet(root)
    folder = F.regexp_replace(F.regexp_replace("_metadata.file_path", "^[a-z]+:(//)?", ""), "/[^/]*$", "")
    return select_sources(rows.withColumn("source", folder), "source", list(selected))


def substituted(samples: DataFrame, valid: Column, label: str = "[dummy_label]") -> DataFrame:
    """Samples whose image is not valid keep their place, with no image and a dummy label, and ``substituted`` says so."""
    bad = ~F.coalesce(valid, F.lit(False))
    return samples.withColumns({"substituted": bad, "label": F.when(bad, F.lit(label)).otherwise(F.col("label")), "image": F.when(~bad, F.col("image"))})


def collate(rows: DataFrame, batch: str, pixels: str = "pixels", width: int | None = None) -> DataFrame:
    """One row a batch: labels and rows of pixels, all as long as ``width`` or as the batch's longest, filled with their last one; null rows are left out."""
    kept = rows.filter(F.col(pixels).isNotNull())
    to = F.lit(width) if width else F.max(F.size(pixels)).over(Window.partitionBy(batch))
    padded = kept.withColumn("__w", to).withColumn("__p", F.slice(F.concat(pixels, F.array_repeat(F.element_at(pixels, -1), F.col("__w"))), F.lit(1), F.col("__w")))
    return padded.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct("idx", "label", F.col("__p").alias("pixels")))).alias("__s")).select(batch, F.col("__s.label").alias("labels"), F.col("__s.pixels").alias("pixels"))


def export_labels(samples: DataFrame, path: str) -> None:
    """``name`` and label lines, separated by a tab."""
    samples.select(record_key("image", F.col("idx")).alias("name"), "label").write.mode("error").csv(path, sep="\t", quote="", escape="")


def export_images(samples: DataFrame, path: str, ending: str = ".jpg") -> int:
    """Write each sample's image as a file of its own below ``path``, under the name that ``export_labels`` gives it, by the tasks that hold it; a null image has no file. Gives the number of files. A task that is run again writes the same files."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        store.create_dir(root)
        for batch in batches:
            done = 0
            for name, image in zip(batch["name"].to_pylist(), batch["image"].to_pylist(), strict=True):
                if image is not None:
                    with store.open_output_stream(f"{root}/{name}{ending}") as out:
                        out.write(image)
                    done += 1
            yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], ["n"])

    named = samples.select(record_key("image", F.col("idx")).alias("name"), "image")
    return named.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def joined_path(base: str, path: Column) -> Column:
    """``path`` under ``base``; an absolute one stays."""
    return F.when(path.startswith("/"), path).otherwise(F.concat_ws("/", F.lit(base.rstrip("/")), path))


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the files of a tree, with the scheme taken off the path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_replace("path", "^[a-z]+:(//)?", "").alias("path"), "content")


def valid_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height) of the files that decode to an image with an area."""
    images = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path)
    return images.filter("image.width > 0 and image.height > 0").select(F.regexp_replace("image.origin", "^[a-z]+:(//)?", "").alias("path"), "image.width", "image.height")


def with_images(truth: DataFrame, files: DataFrame, base: str) -> tuple[DataFrame, DataFrame]:
    """(rows with their image, rows whose file is missing); rows that share a file all get it."""
    full = truth.withColumn("path", joined_path(base, F.col("image_path")))
    return full.join(files, "path").withColumnRenamed("content", "image"), full.join(files.select("path"), "path", "left_anti")


def write_samples(samples: DataFrame, path: str) -> None:
    """Parquet in place of a key-value store: the commit is atomic and the count is in the files' footers."""
    samples.select("idx", "label", "image").write.mode("error").parquet(path)


def read_samples(spark: SparkSession, *paths: str) -> DataFrame:
    """One or more sample tables as one, with their path as ``source``."""
    parts = [spark.read.schema(SAMPLES).parquet(p).withColumn("source", F.lit(p)) for p in paths]
    return reduce(DataFrame.unionByName, parts)


def key_values(samples: DataFrame) -> DataFrame:
    """The key-value view: two records a sample and one with their number."""
    both = samples.select(F.inline(F.array(F.struct(record_key("image", F.col("idx")).alias("key"), F.col("image").alias("value")), F.struct(record_key("label", F.col("idx")).alias("key"), F.encode("label", "UTF-8").alias("value")))))
    return both.unionByName(samples.agg(F.lit("num-samples").alias("key"), F.encode(F.count(F.lit(1)).cast("string"), "UTF-8").alias("value")))


def from_key_values(records: DataFrame) -> DataFrame:
    """Samples (idx, label, image) back from key-value records: a label and an image meet by the number in their keys; one without the other has null there. Other keys, the count among them, are no samples."""
    parts = F.regexp_extract("key", r"^(image|label)-([0-9]{9,})$", 1), F.regexp_extract("key", r"^(image|label)-([0-9]{9,})$", 2)
    kept = records.select(parts[0].alias("kind"), parts[1].alias("number"), "value").filter("kind <> ''")
    by_number = kept.groupBy(F.col("number").try_cast("long").alias("idx"))
    return by_number.agg(F.decode(F.max(F.when(F.col("kind") == "label", F.col("value"))), "UTF-8").alias("label"), F.max(F.when(F.col("kind") == "image", F.col("value"))).alias("image"))


def option_list(text: Column) -> Column:
    """The names of an option that joins them by hyphens."""
    return F.split(text, "-")


def select_sources(df: DataFrame, column: str, wanted: list[str]) -> DataFrame:
    """Rows whose source holds any of ``wanted``."""
    return df.filter(reduce(lambda a, b: a | b, (F.col(column).contains(w) for w in wanted)))


def vocabulary_file(spark: SparkSession, path: str) -> DataFrame:
    """(ch, id) of a file with one character a line, ids from 1 by line; a space comes last. One file, so one task numbers it."""
    whole = spark.read.text(path, wholetext=True).select(F.split(F.regexp_replace("value", "\r?\n$", ""), "\r?\n").alias("lines"))
    return whole.select(F.posexplode(F.concat("lines", F.array(F.lit(" ")))).alias("pos", "ch")).select("ch", (F.col("pos") + 1).alias("id"))


def ranked(report: DataFrame, vocab: DataFrame | None = None) -> DataFrame:
    """The report's rows that have an accuracy, best first; equal ones in the order of ``vocab`` (ch, id), or by code point where there is none. Characters outside ``vocab`` come behind its own."""
    rows = report.filter("accuracy is not null")
    if vocab is None:
        return rows.orderBy(F.desc("accuracy"), "ch")
    ids = vocab.select(F.col("ch").alias("__c"), F.col("id").alias("__i"))
    return rows.join(ids, F.col("ch") == F.col("__c"), "left").orderBy(F.desc("accuracy"), F.col("__i").asc_nulls_last(), "ch").drop("__c", "__i")


def write_report(report: DataFrame, path: str, vocab: DataFrame | None = None) -> None:
    """The per-character report as one CSV with a header, in the order of ``ranked``."""
    rows = ranked(report, vocab).select(F.col("ch").alias("Alphabet"), F.col("accuracy").alias("Accuracy"))
    rows.coalesce(1).write.mode("overwrite").csv(path, header=True)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPORT).csv(path, header=True)


def write_rejects(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_log(spark: SparkSession, path: str, *entries: object, stamp: str | None = None) -> None:
    """Append a line to a run's log, the entries by their text, joined by spaces; with ``stamp`` a line with it comes first, as at the start of a run."""
    lines = [(stamp,)] if stamp else []
    spark.createDataFrame([*lines, (" ".join(map(str, entries)),)], "value string").coalesce(1).write.mode("append").text(path)


def checkpoint_step(name: Column) -> Column:
    """The number at the end of a checkpoint's name, null if there is none."""
    return F.element_at(F.split(F.element_at(F.split(name, "_"), -1), r"\."), 1).try_cast("int")
