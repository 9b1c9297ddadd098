"""Packing: minimum bin slack over the multiset of piece lengths, token ids cut only where nothing fits."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, short_batches, small, table, text_key
from .subset_sum import closest_fill

END = 2
#: Numbering within a length is dealt over so many hash groups, as one length may hold a third of all pieces.
SALTS = 64
#: Parts of texts that a worker's cache may hold; a full cache starts anew.
CACHED = 150_000
#: Bytes of a text that are cut into parts at a time.
PIECE = 1 << 20
SPACE = re.compile(rb"[\x20\x09-\x0D]")
LETTERS = re.compile(rb"([A-Za-z]+)([.,;:!?]*)").fullmatch


class WordTokenizer:
    """Token ids of whole texts as little-endian 32-bit bytes, by way of a cache of their parts.

    The tokenizer drops white space and no token of its reaches across it, so the ids of a text are those of its white-space-separated parts, one after another. Every part goes to the tokenizer itself, as it is; only ASCII white space cuts. New parts go there together, with a special token between them.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.between, self.between_id = min((t.content, i) for i, t in self.whole.get_added_tokens_decoder().items())
        self.known: dict[bytes, bytes] = {}

    def encode(self, parts: list[bytes]) -> list[bytes]:
        (found,) = self.whole.encode_batch_fast([self.between.join(p.decode() for p in parts)], add_special_tokens=False)
        ids = np.array(found.ids, "<u4")
        cuts = np.flatnonzero(ids == self.between_id).tolist()
        raw = ids.tobytes()
        return [raw[4 * a + 4 : 4 * b] for a, b in zip([-1, *cuts], [*cuts, len(ids)], strict=True)]

    def learn(self, parts: set[bytes]) -> None:
        """Ids of new parts. Small ASCII letters are one piece to the tokenizer, so they go to its model; the same letters in capitals or before closing marks are looked up by them. A part that may hold a special token goes alone."""
        known, model = self.known, self.whole.model.tokenize
        others, alone = [], []
        for part in parts:
            if found := LETTERS(part):
                letters, marks = found.groups()
                low = letters.lower()
                if low not in known:
                    known[low] = array("I", [t.id for t in model(low.decode())]).tobytes()
                if marks:
                    if marks not in known:
                        known[marks] = self.encode([marks])[0]
                    known[part] = known[low] + known[marks]
                elif part != low:
                    known[part] = known[low]
            else:
                (alone if b"<|" in part else others).append(part)
        known.update(zip(others, self.encode(others), strict=True) if others else ())
        known.update((p, array("I", self.whole.encode(p.decode(), add_special_tokens=False).ids).tobytes()) for p in alone)

    def ids(self, texts: list[str]) -> list[bytes]:
        out: list[list[bytes]] = [[] for _ in texts]
        for together in pieces(texts):
            if len(self.known) > CACHED:
                self.known = {}
            known = self.known
            found = [list(map(known.get, parts)) for _, parts in together]
            missing = [[k for k, x in enumerate(own) if x is None] for own in found]
            self.learn({parts[k] for (_, parts), lack in zip(together, missing, strict=True) for k in lack})
            for (i, parts), own, lack in zip(together, found, missing, strict=True):
                for k in lack:
                    own[k] = known[parts[k]]
                out[i].append(b"".join(own))
        return [b"".join(x) for x in out]


def pieces(texts: list[str]) -> Iterator[list[tuple[int, list[bytes]]]]:
    """The parts of the texts between ASCII white space, with the text's place; of about ``PIECE`` bytes at a time, so that memory does not grow with one very long text."""
    together, size = [], 0
    for i, text in enumerate(t.encode() for t in texts):
        at = 0
        while at < len(text):
            space = SPACE.search(text, at + PIECE)
            end = space.start() if space else len(text)
            together.append((i, text[at:end].split()))
            size += end - at
            at = end
            if size >= PIECE:
                yield together
                together, size = [], 0
    yield together


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One a worker process."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


@dataclass
class Plan:
    """Where the i-th piece of each length goes.

    ``slots``: (length, from i, to i, first sequence, pieces a sequence, offset of the first). ``poured``: (length, from i, to i, tokens poured before). The poured tokens follow one another from sequence ``first_poured`` on.
    """

    slots: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    poured: list[tuple[int, int, int, int]] = field(default_factory=list)
    sequences: int = 0
    pour: int = 0


def plan_windows(counts: dict[int, int], capacity: int) -> Plan:
    """Minimum bin slack by counts: the longest remaining length opens a window and a subset-sum bitset picks the multiset of others that fills it closest to capacity; backtracked counts say how often the same filling can be used before some length runs short.

    A length that no multiset completes any more is poured: its pieces will be cut at window borders. The work depends on the number of distinct lengths, at most ``capacity``, not on the number of pieces.
    """
    plan, left, at = Plan(), {n: c for n, c in counts.items() if c > 0}, dict.fromkeys(counts, 0)
    for longest in sorted(left, reverse=True):
        while left.get(longest):
            rest = ((n, left[n] - (n == longest)) for n in sorted(left, reverse=True) if n <= capacity - longest)
            best, chosen = closest_fill(rest, capacity - longest)
            if best + longest < capacity:
                plan.poured.append((longest, at[longest], at[longest] + left[longest], plan.pour))
                plan.pour += longest * left.pop(longest)
                break
            chosen[longest] = chosen.get(longest, 0) + 1
            times, offset = min(left[n] // k for n, k in chosen.items()), 0
            for n, k in sorted(chosen.items(), reverse=True):
                plan.slots.append((n, at[n], at[n] + k * times, plan.sequences, k, offset))
                at[n] += k * times
                left[n] -= k * times
                offset += n * k
                if not left[n]:
                    del left[n]
            plan.sequences += times
    return plan


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096) -> DataFrame:
    """Pieces of the token sequences that ``docs`` are packed into: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and an end id; null text counts as empty and gives the end id alone. Documents longer than ``capacity`` are cut at its multiples. The remainders are packed whole by ``plan_windows``; pieces of lengths that nothing completes are laid end to end and cut at window borders, and what is left at the end is cut into sequences whose lengths are powers of two, so no sequence needs padding. Rows that repeat are packed each; an empty table gives no rows; other columns are ignored.
    """
    docs = docs.select("doc_id", "text", text_key(F.col("text")).alias("tkey"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = tokenizer(tokenizer_path).ids
        for batch in batches:
            doc, key, start, length, crc, total = [], [], [], [], [], []
            texts = [t or "" for t in batch["text"].to_pylist()]
            for i, k, ids in zip(batch["doc_id"].to_pylist(), batch["tkey"].to_pylist(), ids_of(texts), strict=True):
                ids += END.to_bytes(4, "little")
                n = len(ids) // 4
                for s in range(0, n, capacity):
                    own = ids[4 * s : 4 * (s + capacity)]
                    doc.append(i), key.append(k), start.append(s), length.append(len(own) // 4), crc.append(zlib.crc32(own)), total.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(key, pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(total, pa.int64())], names)

    names = ["doc_id", "tkey", "start", "length", "ids_crc32", "doc_tokens"]
    with short_batches(docs.sparkSession):
        cut_up = checkpoint(docs.mapInArrow(cut, ", ".join(f"{n} long" for n in names)).withColumn("salt", F.pmod(F.xxhash64("doc_id", "tkey", "start"), F.lit(SALTS)).cast("int")))
    # At most capacity * SALTS rows, whatever the input: they are numbered and broadcast whole.
    by_salt = checkpoint(cut_up.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")))
    counts = {int(r["length"]): int(r["n"]) for r in by_salt.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = plan_windows(counts, capacity)
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "tkey", "start")) - 1
    numbered = cut_up.withColumn("i", within).join(F.broadcast(by_salt.select("length", "salt", "before")), ["length", "salt"]).withColumn("i", F.col("i") + F.col("before"))

    placed = [*names, "sequence_id", "offset"]
    spark = docs.sparkSession
    slots = spark.createDataFrame(plan.slots, "l long, lo long, hi long, first long, each long, at long")
    inside = (F.col("length") == F.col("l")) & (F.col("i") >= F.col("lo")) & (F.col("i") < F.col("hi"))
    nth = F.col("i") - F.col("lo")
    whole = numbered.join(F.broadcast(slots), inside).select(*names, (F.col("first") + F.floor(nth / F.col("each"))).alias("sequence_id"), (F.col("at") + (nth % F.col("each")) * F.col("length")).alias("offset"))

    # Borders in the poured tokens: multiples of capacity, and in the last window the binary digits of what is left.
    base, tail = plan.pour // capacity * capacity, plan.pour % capacity
    digits = [1 << b for b in range(capacity.bit_length() - 1, -1, -1) if tail >> b & 1]
    last = [base + sum(digits[:k]) for k in range(len(digits) + 1)]
    poured = spark.createDataFrame(plan.poured, "l long, lo long, hi long, before_pour long")
    laid = numbered.join(F.broadcast(poured), inside).withColumn("p", F.col("before_pour") + nth * F.col("length"))
    end = F.col("p") + F.col("length")
    borders = [F.lit(b) for b in last[1:-1]]
    cuts = F.array_sort(F.array_distinct(F.filter(F.array(F.col("p"), end, F.ceil(F.col("p") / capacity) * capacity, *borders), lambda c: (c >= F.col("p")) & (c <= end))))
    parts = laid.withColumn("cuts", cuts).withColumn("k", F.explode(F.sequence(F.lit(1), F.array_size("cuts") - 1)))
    lo, hi = F.element_at("cuts", F.col("k")), F.element_at("cuts", F.col("k") + 1)
    first_tail = plan.sequences + base // capacity
    sequence, offset = plan.sequences + F.floor(F.col("lo") / capacity), F.col("lo") % capacity
    for k, b in enumerate(last[:-1]):
        sequence = F.when(F.col("lo") >= b, F.lit(first_tail + k)).otherwise(sequence)
        offset = F.when(F.col("lo") >= b, F.col("lo") - b).otherwise(offset)
    parts = parts.select(*names, "p", lo.alias("lo"), hi.alias("hi"), F.array_size("cuts").alias("n_cuts")).withColumns({"sequence_id": sequence.cast("long"), "offset": offset.cast("long")})
    uncut = parts.filter(F.col("n_cuts") == 2).select(*placed)

    # Pieces that were cut need new checksums: only their documents are read and tokenized again.
    again = checkpoint(parts.filter(F.col("n_cuts") > 2).select("doc_id", "tkey", (F.col("start") + F.col("lo") - F.col("p")).alias("start"), (F.col("hi") - F.col("lo")).alias("length"), "doc_tokens", "sequence_id", "offset"))
    wanted = again.groupBy(F.col("doc_id").alias("d"), F.col("tkey").alias("t")).agg(F.collect_list(F.struct("start", "length", "doc_tokens", "sequence_id", "offset")).alias("parts"))
    texts = docs.join(small(wanted, 20_000), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tkey") == F.col("t"))).dropDuplicates(["doc_id", "tkey"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = tokenizer(tokenizer_path).ids
        for batch in batches:
            rows = []
            texts = [t or "" for t in batch["text"].to_pylist()]
            for i, k, ids, own in zip(batch["doc_id"].to_pylist(), batch["tkey"].to_pylist(), ids_of(texts), batch["parts"].to_pylist(), strict=True):
                ids += END.to_bytes(4, "little")
                rows += [(i, k, p["start"], p["length"], zlib.crc32(ids[4 * p["start"] : 4 * (p["start"] + p["length"])]), p["doc_tokens"], p["sequence_id"], p["offset"]) for p in own]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 8)], placed)

    recut = texts.select("doc_id", "tkey", "text", "parts").mapInArrow(check, ", ".join(f"{n} long" for n in placed))
    return whole.unionByName(uncut).unionByName(recut).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a piece of all documents, packed into sequences of 4096; cases as in ``pack``."""
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())
