"""Line dedup: two Bloom filters find suspected repeats; only those shuffle for exact confirmation."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from .common import carried, checkpoint, released, short_batches, table, text_key

PROBES = 2
SPACE = b" \t\n\x0b\x0c\r"
LINE = pa.schema([("id", pa.int64()), ("tkey", pa.int64()), ("no", pa.int32()), ("key", pa.string())])


def line_keys(text: bytes, least: int) -> Iterator[tuple[int, bytes]]:
    """(place, key) of the lines whose key, the line without ASCII white space at both ends and with A-Z lower-cased, has ``least`` code points or more."""
    for no, line in enumerate(text.split(b"\n")):
        if len(line) >= least:
            key = line.strip(SPACE).lower()
            if len(key) >= least and (key.isascii() or len(key.decode()) >= least):
                yield no, key


def hash_of(key: bytes) -> int:
    return int.from_bytes(blake2b(key, digest_size=8).digest(), "little")


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with the lines that many documents share removed from all but the largest doc_id holding them.

    Keys of at least ``min_chars`` code points in at least ``min_docs`` documents (distinct doc_ids; rows that repeat a doc_id count once, rows without one count as one document, the smallest) lose all their lines elsewhere. Other lines stay, joined by a line feed. Null or empty text is one empty line. Adds ``n_lines`` and ``n_dropped`` and replaces ``text``, and ``n_chars`` where there is one. An empty table gives no rows. Columns of ``docs`` with the names added are replaced; other names are free.

    The filter of keys seen twice, built behind that of keys seen once, picks the suspects; only these shuffle, as text, to be counted exactly.
    """
    spark, rows = docs.sparkSession, carried(docs, ("n_lines", "n_dropped"))
    text = F.coalesce("in_text", F.lit(""))
    keyed = rows.withColumns({"id": F.coalesce("in_doc_id", F.lit(-(1 << 63))), "tkey": text_key(F.col("in_text"))})
    bits = bloom.bits_for(docs.count(), 256)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (np.array([hash_of(key) for x in batch["text"].to_pylist() for _, key in line_keys(x, min_chars)], np.uint64) for batch in batches)
        yield from bloom.gathered(found, bits, PROBES)

    with short_batches(spark):
        _, often = bloom.build(rows.select(text.cast("binary").alias("text")).mapInArrow(seen, bloom.BLOBS), bits)
        twice = spark.sparkContext.broadcast(often)

        def suspected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                of, no, keys = [], [], []
                for i, x in enumerate(batch["text"].to_pylist()):
                    for place, key in line_keys(x, min_chars):
                        of.append(i), no.append(place), keys.append(key)
                hit = np.flatnonzero(bloom.contains(twice.value, np.array([hash_of(k) for k in keys], np.uint64), PROBES))
                own = pa.array(np.array(of, np.int64)[hit])
                yield pa.RecordBatch.from_arrays([batch["id"].take(own), batch["tkey"].take(own), pa.array(np.array(no, np.int32)[hit]), pa.array([keys[i].decode() for i in hit], pa.string())], schema=LINE)

        suspects = checkpoint(keyed.select("id", "tkey", text.cast("binary").alias("text")).mapInArrow(suspected, "id long, tkey long, no int, key string"))
    # Documents of a key are counted by (key, id) first: a key that very many documents hold is never in one task.
    held = suspects.groupBy("key", "id").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count("one").alias("n"), F.max("id").alias("last"))
    repeated = checkpoint(held.filter(F.col("n") >= min_docs).select("key", "last"))
    dropped = suspects.join(repeated, "key").filter(F.col("id") != F.col("last"))
    drops = dropped.groupBy("id", "tkey").agg(F.collect_set("no").alias("drops"))
    joined = keyed.join(drops, ["id", "tkey"], "left")
    lines = F.split(text, "\n", -1)
    # array_except looks places up by hash; the lines are split once.
    left = F.transform(F.array(lines), lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.array_size(x) - 1), "drops"), lambda i: F.get(x, i)), "\n"))
    joined = joined.withColumns({"kept": F.when(F.col("drops").isNull(), text).otherwise(F.get(left, 0)), "n_dropped": F.coalesce(F.array_size("drops"), F.lit(0)).cast("long")})
    follows = {"n_chars": F.char_length("kept").cast("long")} if "n_chars" in docs.columns else {}
    return released(joined, text=F.col("kept"), n_lines=F.array_size(lines).cast("long"), n_dropped=F.col("n_dropped"), **follows)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of every document: doc_id, n_lines, n_dropped, kept_sha256; cases as in ``dedup_lines``."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


#: The same rows by SQL.
ORACLE = r"""
WITH line AS (
  SELECT doc_id, no, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS no FROM documents)
), repeated AS (
  SELECT key, max(doc_id) AS last FROM line WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT line.*, repeated.key IS NOT NULL AND doc_id <> last AS gone FROM line LEFT JOIN repeated ON line.key = repeated.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
