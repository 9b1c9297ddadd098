"""Substring dedup: fixed-block anchors are indexed, every rolling window probes them, hits are extended to maximal exact repeats."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bloom, textvec
from .common import carried, released, short_batches, table, text_key

PROBES = 3
#: Bytes of text whose candidate windows meet in one task to be confirmed; documents, and bytes on the average, that are rewritten in one task.
CONFIRM_BYTES, TOGETHER, REWRITE_BYTES = 1 << 24, 400, 1 << 24
FEW, MANY = 64, 1 << 20

#: A candidate window: the 128-bit digest of its words, its document's key, its first word's position (-1: nobody asks).
ENTRY = np.dtype([("h", "<u8"), ("h2", "<u8"), ("key", "<i8"), ("at", "<i4")])


def starts(chunk: textvec.Chunk, width: int) -> np.ndarray:
    """Which word positions of a chunk start a window of ``width`` words of one text."""
    n = len(chunk.hashes)
    last = np.repeat(chunk.first[1:], np.diff(chunk.first))
    return np.arange(n) + width <= last


def blocks(chunk: textvec.Chunk, block: int) -> np.ndarray:
    """Which word positions start a reference block: every ``block``-th word of a text, if a whole block follows."""
    at = np.arange(len(chunk.hashes)) - np.repeat(chunk.first[:-1], np.diff(chunk.first))
    return (at % block == 0) & starts(chunk, block)


def hashes(chunk: textvec.Chunk, width: int) -> np.ndarray:
    """A hash for each position; those where no window starts are of no meaning."""
    out = np.zeros(len(chunk.hashes), np.uint64)
    found = textvec.windows(chunk.hashes, width)
    out[: len(found)] = found
    return out


def digests(chunk: textvec.Chunk, at: np.ndarray, width: int) -> np.ndarray:
    """BLAKE2b of the words themselves, joined by one space, of the windows of ``width`` words from ``at`` on: two numbers each."""
    text = spaced(chunk, np.ones(len(chunk.hashes), bool))[0].tobytes()
    edge = np.concatenate(([0], np.cumsum(chunk.ends - chunk.starts + 1)))
    found = [blake2b(text[a:b], digest_size=16).digest() for a, b in zip(edge[at].tolist(), (edge[at + width] - 1).tolist(), strict=True)]
    return np.frombuffer(b"".join(found), "<u8").reshape(-1, 2)


def candidates(chunk: textvec.Chunk, window: int, block: int, once: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """Word positions that start a window holding a hit, a run of ``block`` words that some reference block may equal.

    Of two equal windows, each holds a reference block of the other one: by a shift it is a probe off the own grid, which hits the blocks seen once; without a shift it is an own block, which others must have made seen twice.
    """
    if len(chunk.hashes) < window:
        return np.zeros(0, np.int64)
    h, valid, own = hashes(chunk, block), starts(chunk, block), blocks(chunk, block)
    hit = np.zeros(len(h), bool)
    for mask, seen in ((valid & ~own, once), (own, twice)):
        at = np.flatnonzero(mask)
        hit[at] = bloom.contains(seen, h[at], PROBES)
    upto = np.concatenate(([0], np.cumsum(hit)))
    extended = np.zeros(len(h), bool)
    reach = window - block + 1
    extended[: len(h) - reach + 1] = upto[reach:] > upto[:-reach]
    return np.flatnonzero(extended & starts(chunk, window))


def pack(entries: np.ndarray) -> list[bytes]:
    """Columns one after another compress better than rows."""
    return [np.ascontiguousarray(entries[n]).tobytes() for n in ENTRY.names]


def unpack(t: pa.Table) -> np.ndarray:
    columns = [np.frombuffer(b"".join(t[n].to_pylist()), ENTRY[n]) for n in ENTRY.names]
    out = np.empty(len(columns[0]), ENTRY)
    for n, c in zip(ENTRY.names, columns, strict=True):
        out[n] = c
    return out


def spaced(chunk: textvec.Chunk, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the words that stay, each with a space behind it, and which bytes of the chunk these were."""
    flat = np.append(chunk.flat, np.uint8(32))
    mark = np.zeros(len(flat) + 1, np.int8)
    # A word that stays brings the byte after it, which becomes a space.
    mark[chunk.starts[kept]] += 1
    mark[chunk.ends[kept] + 1] -= 1
    flat[chunk.ends] = 32
    mask = np.cumsum(mark[:-1], dtype=np.int8) > 0
    return flat[mask], mask


def remove(chunk: textvec.Chunk, gone: np.ndarray) -> list[bytes]:
    """Each text's words that stay, joined by one space."""
    left, mask = spaced(chunk, ~gone)
    size, out = np.concatenate(([0], np.cumsum(mask))), left.tobytes()
    border = np.concatenate(([0], np.cumsum([len(t) + 1 for t in chunk.texts]))).clip(max=len(mask))
    return [out[size[a] : max(size[a], size[b] - 1)] for a, b in zip(border[:-1], border[1:], strict=True)]


def runs(chunk: textvec.Chunk, gone: np.ndarray) -> list[list[dict[str, int]]]:
    """Each text's maximal runs of words that go, by place in the text."""
    out: list[list[dict[str, int]]] = [[] for _ in chunk.texts]
    edge = np.concatenate(([False], gone, [False]))
    cuts = np.unique(np.concatenate((np.flatnonzero(edge[1:] != edge[:-1]), chunk.first)))
    doc = chunk.doc_of()
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if gone[a]:
            out[doc[a]].append({"start": a - int(chunk.first[doc[a]]), "length": b - a})
    return out


def dedup_passages(docs: DataFrame, window: int = 35) -> DataFrame:
    """``docs`` without the words that lie in a repeated passage; ``text`` is what is left, joined by single spaces.

    A window of ``window`` consecutive words of one text is repeated if its words also start anywhere else, in the same text or another one; all words of repeated windows go, first occurrences too. Windows are judged on the input. Adds ``n_words``, ``n_removed`` and ``repeats`` (start and length, in words, of each maximal run that went); ``n_chars``, where there is one, follows the text. Null text counts as empty. Rows that repeat, with their doc_id or without, are repeats of each other. A word may be of any length. An empty table gives no rows. Columns of ``docs`` with the names added are replaced; other names are free.

    Fixed blocks are anchors in filters of bounded size, which every rolling window of a block's length probes. A hit is extended to the windows around it; such a candidate is repeated if a second one has the digest of its words (BLAKE2b, 128 bits), and overlapping ones make up the maximal repeats.
    """
    block, spark = (window + 1) // 2, docs.sparkSession
    rows = carried(docs, ("n_words", "n_removed", "repeats"))
    text = F.col("in_text")
    total = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    bits, n_groups = bloom.bits_for(total["bytes"] // (5 * block)), max(total["n"] // TOGETHER, total["bytes"] // REWRITE_BYTES) + 1
    n_buckets = min(MANY, max(FEW, total["bytes"] // CONFIRM_BYTES))
    keyed = rows.withColumn("key", F.xxhash64("in_doc_id", text_key(text)))
    keyed = keyed.withColumn("group", (F.shiftrightunsigned("key", 1) % F.lit(n_groups)).cast("int"))

    def anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (hashes(c, block)[blocks(c, block)] for batch in batches for c in textvec.chunks(batch["text"].to_pylist()))
        yield from bloom.gathered(found, bits, PROBES)

    with short_batches(spark):
        once, twice = map(spark.sparkContext.broadcast, bloom.build(rows.select(text.cast("binary").alias("text")).mapInArrow(anchor, bloom.BLOBS), bits))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch["key"].to_numpy()
            for c in textvec.chunks(batch["text"].to_pylist()):
                at = candidates(c, window, block, once.value, twice.value)
                if not len(at):
                    continue
                doc = c.doc_of()[at]
                e = np.empty(len(at), ENTRY)
                e["h"], e["h2"] = digests(c, at, window).T
                e["key"], e["at"] = keys[c.at + doc], at - c.first[doc]
                # Repeats within the chunk need no one else; one of each only tells the others.
                e = e[np.lexsort((e["h2"], e["h"]))]
                new = np.concatenate(([True], (e["h"][1:] != e["h"][:-1]) | (e["h2"][1:] != e["h2"][:-1])))
                here = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] > 1
                told = e[new & here]
                told["at"] = -1
                asks = np.concatenate((e[~here], told))
                bucket = (asks["h"] % np.uint64(n_buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                asks, cuts = asks[order], np.flatnonzero(np.diff(bucket[order])) + 1
                parts = np.split(asks, cuts) if len(asks) else []
                names, known = [int(p["h"][0] % np.uint64(n_buckets)) for p in parts], [False] * len(parts)
                if here.any():
                    parts.append(e[here])
                    names.append(int(e["key"][0]) % n_buckets)
                    known.append(True)
                blobs = [pack(p) for p in parts]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(known), *(pa.array([b[i] for b in blobs], pa.binary()) for i in range(len(ENTRY.names)))], ["bucket", "known", *ENTRY.names])

    def confirm(t: pa.Table) -> pa.Table:
        known = unpack(t.filter(t["known"]))
        asked = unpack(t.filter(pa.compute.invert(t["known"])))
        asked = asked[np.lexsort((asked["h2"], asked["h"]))]
        same = (asked["h"][1:] == asked["h"][:-1]) & (asked["h2"][1:] == asked["h2"][:-1])
        repeated = np.concatenate((same, [False])) | np.concatenate(([False], same)) if len(asked) else np.zeros(0, bool)
        found = np.concatenate((known[["key", "at"]], asked[["key", "at"]][repeated & (asked["at"] >= 0)]))
        group = ((found["key"].view(np.uint64) >> np.uint64(1)) % np.uint64(n_groups)).astype(np.int32)
        order = np.lexsort((found["at"], found["key"], group))
        found, group = found[order], group[order]
        cuts = np.flatnonzero(np.diff(group)) + 1
        parts = np.split(found, cuts) if len(found) else []
        names = group[np.concatenate(([0], cuts))] if len(found) else group
        return pa.table([pa.array(names, pa.int32()), *(pa.array([np.ascontiguousarray(p[n]).tobytes() for p in parts], pa.binary()) for n in ("key", "at"))], names=["group", "key", "at"])

    asked = keyed.select("key", text.cast("binary").alias("text")).mapInArrow(probe, "bucket int, known boolean, h binary, h2 binary, key binary, at binary")
    found = asked.groupBy("bucket").applyInArrow(confirm, "group int, key binary, at binary")

    given = rows.columns

    def rewrite(texts: pa.Table, repeats: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(repeats["key"].to_pylist()), np.int64)
        at = np.frombuffer(b"".join(repeats["at"].to_pylist()), np.int32)
        order = np.argsort(keys, kind="stable")
        keys, at = keys[order], at[order]
        own = texts["key"].to_numpy()
        lo, hi = np.searchsorted(keys, own), np.searchsorted(keys, own, "right")
        kept, n_words, n_removed, gaps = [], [], [], []
        for c in textvec.chunks([x and x.encode() for x in texts["in_text"].to_pylist()]):
            edge = np.zeros(len(c.hashes) + 1, np.int32)
            for k in range(len(c.texts)):
                first = c.first[k] + at[lo[c.at + k] : hi[c.at + k]]
                np.add.at(edge, first, 1)
                np.add.at(edge, first + window, -1)
            gone = np.cumsum(edge[:-1]) > 0
            kept += [x.decode() for x in remove(c, gone)]
            n_words += np.diff(c.first).tolist()
            n_removed += np.diff(np.concatenate(([0], np.cumsum(gone)))[c.first]).tolist()
            gaps += runs(c, gone)
        span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        return pa.table([*(texts[n] for n in given), pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(gaps, span)], names=schema.names)

    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))
    schema = T.StructType([*rows.schema, T.StructField("kept", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("repeats", spans)])
    out = keyed.groupBy("group").cogroup(found.groupBy("group")).applyInArrow(rewrite, schema)
    follows = {"n_chars": F.char_length("kept").cast("long")} if "n_chars" in docs.columns else {}
    return released(out, text=F.col("kept"), n_words=F.col("n_words"), n_removed=F.col("n_removed"), repeats=F.col("repeats"), **follows)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of every document: doc_id, n_words, n_removed, kept_sha256; cases as in ``dedup_passages``."""
    kept = dedup_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


#: The same rows by SQL.
ORACLE = r"""
WITH word AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT row, i, array_to_string(w[i : i + 34], ' ') AS k FROM (SELECT row, w, unnest(range(1, len(w) - 33)) AS i FROM word WHERE len(w) >= 35)
), again AS (
  SELECT row, i FROM win WHERE k IN (SELECT k FROM win GROUP BY k HAVING count(*) > 1)
), gone AS (
  SELECT DISTINCT row, i + unnest(range(35)) AS i FROM again
), kept AS (
  SELECT word.row, list(w[p] ORDER BY p) FILTER (WHERE gone.i IS NULL) AS w, count(gone.i) AS n
  FROM (SELECT row, w, unnest(range(1, len(w) + 1)) AS p FROM word) word LEFT JOIN gone ON word.row = gone.row AND word.p = gone.i GROUP BY word.row
)
SELECT doc_id, len(word.w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(array_to_string(kept.w, ' '), '')) AS kept_sha256
FROM word LEFT JOIN kept USING (row)
"""
