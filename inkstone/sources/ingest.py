"""Ingest of image files by a list: headers are looked at first, valid lines are numbered while they are narrow, and only then are the files that are wanted read; in one go, or in parts as lists arrive.

Files are opened by the tasks that need them, through pyarrow's file systems (local and shared folders, HDFS, object stores): a folder is never listed and no other file of it is touched.
"""

from __future__ import annotations

import struct
import time
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from ..operators.sampling import dense_index
from .samples import joined_path

#: Bytes of a file's start and end that tell what image it is, and bytes of the files that go to the JVM at once.
HEAD, TAIL, AT_ONCE = 1 << 16, 1 << 10, 1 << 24
HEADER = T.StructType([T.StructField("format", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("reason", T.StringType())])


def jpeg_size(head: bytes, more) -> tuple[int, int] | None:
    """(width, height) of the first frame header; ``more`` gives bytes from a place on, where segments reach beyond the head."""
    at, base = 2, 0
    while True:
        if at + 9 > base + len(head):
            base, head = at, more(at)
            if len(head) < 9:
                return None
        part = head[at - base :]
        if part[0] != 0xFF:
            return None
        mark = part[1]
        if mark == 0xFF:
            at += 1
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", part[5:9])
            return width, height
        elif mark in (0xD9, 0xDA):
            return None
        elif 0xD0 <= mark <= 0xD8 or mark == 1:
            at += 2
        else:
            at += 2 + struct.unpack(">H", part[2:4])[0]


def image_header(head: bytes, tail: bytes, size: int, more=lambda at: b"") -> tuple[str | None, int | None, int | None, str | None]:
    """(format, width, height, reason): what the start and the end of a file of ``size`` bytes say of it, without decoding pixels. ``reason`` is null for a PNG, JPEG, GIF or BMP that has an area and does not end early."""
    kind, sides, ended = None, None, True
    if head.startswith(b"\x89PNG\r\n\x1a\n"):
        kind, ended = "png", b"IEND\xaeB`\x82" in tail
        sides = struct.unpack(">II", head[16:24]) if head[12:16] == b"IHDR" and len(head) >= 24 else None
    elif head[:6] in (b"GIF87a", b"GIF89a"):
        kind, ended = "gif", tail.rstrip(b"\0").endswith(b";")
        sides = struct.unpack("<HH", head[6:10]) if len(head) >= 10 else None
    elif head.startswith(b"BM") and len(head) >= 26:
        kind, ended = "bmp", size >= struct.unpack("<I", head[2:6])[0]
        sides = struct.unpack("<HH", head[18:22]) if struct.unpack("<I", head[14:18])[0] == 12 else tuple(map(abs, struct.unpack("<ii", head[18:26])))
    elif head.startswith(b"\xff\xd8"):
        kind, ended = "jpeg", b"\xff\xd9" in tail
        sides = jpeg_size(head, more)
    if kind is None:
        return None, None, None, "empty file" if size == 0 else "no image"
    if sides is None:
        return kind, None, None, "no size"
    width, height = sides
    return kind, width, height, "no area" if not width or not height else None if ended else "ends early"


def with_header(rows: DataFrame, content: str = "content", name: str = "header") -> DataFrame:
    """``rows`` with the ``image_header`` of a column of bytes (format, width, height, reason); null bytes are no file."""

    @F.arrow_udf(HEADER)
    def headers(data: pa.Array) -> pa.Array:
        found = [(None, None, None, "no file") if x is None else image_header(x[:HEAD], x[-TAIL:], len(x), lambda at, x=x: x[at : at + HEAD]) for x in data.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.string()))], HEADER.names)

    return rows.withColumn(name, headers(content))


def opened(path: str | None):
    """A file for random access, or None where there is none."""
    if not path:
        return None
    try:
        store, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        return store.open_input_file(at) if store.get_file_info(at).type == fs.FileType.File else None
    except (FileNotFoundError, IsADirectoryError):
        return None


def inspected(rows: DataFrame, path: str = "path", name: str = "header") -> DataFrame:
    """``rows`` with the ``image_header`` of the files at ``path``, of which only the start and the end are read; a file that is not there has the reason "no file"."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for at in batch[path].to_pylist():
                file = opened(at)
                if file is None:
                    found.append((None, None, None, "no file"))
                    continue
                with file:
                    size = file.size()
                    found.append(image_header(file.read_at(min(HEAD, size), 0), file.read_at(min(TAIL, size), max(0, size - TAIL)), size, lambda at, f=file, n=size: f.read_at(max(0, min(HEAD, n - at)), min(at, n))))
            column = pa.StructArray.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.string()))], HEADER.names)
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, name])

    return rows.mapInArrow(look, T.StructType([*rows.schema, T.StructField(name, HEADER)]))


def fetched(rows: DataFrame, path: str = "path", name: str = "image") -> DataFrame:
    """``rows`` with the bytes of the files at ``path``, null where there is none."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, held, data = 0, 0, []
            for i, p in enumerate(batch[path].to_pylist()):
                file = opened(p)
                data.append(None if file is None else file.read())
                held += len(data[-1] or b"")
                # Rows of large files go on in small batches.
                if held >= AT_ONCE or i == batch.num_rows - 1:
                    part = batch.slice(at, len(data))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(data, pa.binary())], [*batch.schema.names, name])
                    at, held, data = i + 1, 0, []

    return rows.mapInArrow(fetch, T.StructType([*rows.schema, T.StructField(name, T.BinaryType())]))


def judged(lines: DataFrame, base: str) -> DataFrame:
    """``lines`` (line, value) with ``image_path``, ``label``, ``path`` and ``reason``: "not two fields", "no file", or what ``image_header`` has against the file; null for a good line. No pixels are decoded."""
    parts = F.split(F.regexp_replace("value", "\n$", ""), "\t", -1)
    two = F.size(parts) == 2
    split = lines.select("line", "value", F.when(two, parts[0]).alias("image_path"), F.when(two, parts[1]).alias("label"))
    split = split.withColumn("path", joined_path(base, F.col("image_path")))
    return inspected(split).withColumn("reason", F.when(F.col("image_path").isNull(), "not two fields").otherwise(F.col("header.reason"))).drop("header")


def write_parts(lines: DataFrame, base: str, path: str, part: int, before: int) -> dict[str, float]:
    """Write one part of an ingest below ``path``: samples (idx, label, image) numbered from ``before`` + 1 in the order of ``line``, rejects (line, value, reason), and last the count that makes the part count. Gives the counts, which come out of the writes themselves, and the seconds it took."""
    began = time.perf_counter()
    spark = lines.sparkSession
    # What was found of the files is kept, narrow, so that numbers and rejects are of one look.
    look = f"{path}/looked/part={part}"
    judged(lines, base).write.mode("overwrite").parquet(look)
    rows = spark.read.schema("line long, value string, image_path string, label string, path string, reason string").parquet(look)
    numbered = dense_index(rows.filter("reason is null").select("line", "label", "path"), "line").withColumn("idx", F.col("idx") + before)
    kept, refused = Observation(), Observation()
    samples = fetched(numbered.select("idx", "label", "path")).drop("path").observe(kept, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("image")), F.lit(0)).alias("bytes"))
    samples.write.mode("overwrite").parquet(f"{path}/samples/part={part}")
    rows.filter("reason is not null").select("line", "value", "reason").observe(refused, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(f"{path}/rejects/part={part}")
    out = {"part": part, "before": before, "n": kept.get["n"], "bytes": kept.get["bytes"], "rejects": refused.get["n"], "seconds": time.perf_counter() - began}
    commit(spark, path, out)
    return out


COUNTS = "part long, before long, n long, bytes long, rejects long, seconds double"


def commit(spark: SparkSession, path: str, count: dict[str, float]) -> None:
    """Write a part's count, by which it counts."""
    spark.createDataFrame([count], COUNTS).coalesce(1).write.mode("overwrite").json(f"{path}/counts/part={count['part']}")


def counts(spark: SparkSession, path: str) -> DataFrame:
    """The counts of the parts that were written to the end."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/counts")
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    return spark.read.schema(COUNTS).option("recursiveFileLookup", True).json(f"{path}/counts") if there else spark.createDataFrame([], COUNTS)


def committed(spark: SparkSession, path: str, what: str = "samples") -> DataFrame:
    """Samples (or rejects) of the parts whose count is written; what a part left behind when it was stopped does not show."""
    schema = {"samples": "idx long, label string, image binary", "rejects": "line long, value string, reason string"}[what]
    parts = [r["part"] for r in counts(spark, path).select("part").collect()]
    read = spark.read.schema(f"{schema}, part long")
    rows = read.parquet(f"{path}/samples") if what == "samples" else read.json(f"{path}/rejects")
    return rows.filter(F.col("part").isin(parts)).drop("part")


def ingest_stream(spark: SparkSession, lists: str, base: str, path: str) -> DataStreamWriter:
    """A stream that ingests the lists arriving in the folder ``lists``, each batch as a part: numbers go on from the parts before, without gaps. A batch that is run again, after a stop at any point, writes the same part anew. Start it with ``start()``; its checkpoint lies in ``path``.

    Lines keep their order within a list, and lists that of their names within a batch.
    """

    def part(batch: DataFrame, number: int) -> None:
        before = counts(spark, path).filter(F.col("part") < number).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        # Ids rise along a block of a file.
        digits = [F.lpad(c.cast("string"), 20, "0") for c in (F.col("block"), F.monotonically_increasing_id())]
        placed = batch.withColumn("key", F.concat_ws(" ", "file", *digits))
        write_parts(dense_index(placed, "key", "line").select("line", "value"), base, path, number, before)

    lines = spark.readStream.text(lists).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return lines.writeStream.foreachBatch(part).option("checkpointLocation", f"{path}/stream")
