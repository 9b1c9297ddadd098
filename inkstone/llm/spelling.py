"""Spelling variant grouping: words one edit apart meet by bands of their letter-parity masks, and follow their most frequent neighbours to a root."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, short_batches, small, table
from .textvec import mix

#: Letters of a word, after A-Z is lower-cased: a to z and the 64 code points from U+00C0.
LETTER, LETTERS = "[a-zÀ-ÿ]", 90
BANDS = 3
#: Words of equal length are edited in place, so their letters count by place too, modulo this.
TURNS = 6
#: Code points of a text that are searched at a time; distinct words that a task holds before it passes their counts on; words of a band's value that meet at once; postings of a group, on the average; pairs, or letters of pairs, that are compared at a time.
SEGMENT, HELD, CROWD, TOGETHER, PAIRS = 1 << 20, 1 << 18, 4_096, 1 << 17, 1 << 20
#: What a word is to those that it meets: of equal length, the shorter, the longer.
SAME, SHORT, LONG = 0, 1, 2


def runs(text: str, pattern: re.Pattern[str], other: re.Pattern[str] = re.compile(LETTER.replace("[", "[^"))) -> Iterator[list[str]]:
    """Matches in ``text``, a segment at a time; segments end between runs of letters."""
    at = 0
    while at < len(text):
        end = at + SEGMENT
        if end < len(text):
            found = other.search(text, end)
            end = found.start() if found else len(text)
        yield pattern.findall(text[at:end])
        at = end


def word_counts(docs: DataFrame, least: int = 7, spoil: int = 0) -> DataFrame:
    """(word, n) of the maximal runs of letters in the whole texts of ``docs`` (doc_id, text), A-Z lower-cased, that have ``least`` code points or more.

    With ``spoil`` a run whose hash (unsigned CRC-32 of ``doc_id:run`` in UTF-8) it divides first loses the code point at hash % length, as a test of what finds misspellings; a row without doc_id loses none. Null and empty texts have no words. Tasks count before they shuffle.
    """
    pattern = re.compile(f"{LETTER}{{{least},}}")

    def passed(held: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                start = zlib.crc32(f"{doc_id}:".encode())
                # Bytes lower-case A-Z only.
                for found in runs((text or b"").lower().decode(), pattern):
                    if not spoil or doc_id is None:
                        held.update(found)
                    else:
                        for run, n in Counter(found).items():
                            h = zlib.crc32(run.encode(), start)
                            if h % spoil == 0:
                                at = h % len(run)
                                run = run[:at] + run[at + 1 :]
                                if len(run) < least:
                                    continue
                            held[run] += n
                if len(held) >= HELD:
                    yield passed(held)
                    held = Counter()
        yield passed(held)

    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all words' letters: number, the word's row, and place in the word."""
    texts = words.to_pylist()
    size = np.array([len(x) for x in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64)
    codes = np.where(codes < 128, codes - 97, codes - 0xC0 + 26)
    return codes, np.repeat(np.arange(len(texts)), size), np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)


def bands(words: DataFrame) -> np.ndarray:
    """The band of each letter: letters by how evenly odd and even counts of them are spread over ``words``, dealt out in turns, so that all bands tell about as many words apart."""

    def odd(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(LETTERS, np.int64), 0
        for batch in batches:
            codes, row, _ = letters(batch["word"])
            times = np.zeros((batch.num_rows, LETTERS), np.uint8)
            np.add.at(times, (row, codes), 1)
            total, n = total + (times & 1).sum(0, dtype=np.int64), n + batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(LETTERS + 1), pa.int32()), pa.array(np.append(total, n))], ["letter", "n"])

    got = {r["letter"]: r["n"] for r in words.select("word").mapInArrow(odd, "letter int, n long").groupBy("letter").agg(F.sum("n").alias("n")).collect()}
    share = np.array([got.get(k, 0) for k in range(LETTERS)]) / max(1, got.get(LETTERS, 0))
    turn = np.argsort(np.abs(share - 0.5), kind="stable")
    of, there_and_back = np.empty(LETTERS, np.int64), [*range(BANDS), *reversed(range(BANDS))]
    of[turn] = [there_and_back[i % len(there_and_back)] for i in range(LETTERS)]
    return of


def parities(words: pa.Array, of: np.ndarray) -> np.ndarray:
    """The masks of ``words``, a column for each band: which of its letters come an odd number of times."""
    codes, row, _ = letters(words)
    bit, out = np.zeros(LETTERS, np.int64), np.zeros((len(words), BANDS), np.int64)
    for b in range(BANDS):
        bit[of == b] = 1 << np.arange((of == b).sum())
    np.bitwise_xor.at(out, (row, of[codes]), bit[codes])
    return out


def masked(words: DataFrame, of: np.ndarray) -> DataFrame:
    """``words`` (word, n) with the keys that words must share to be one edit apart: ``same`` by a band's mask and the length; ``short`` and ``long`` by the masks of the two bands beside a band, and the length of the shorter word."""
    rng = np.random.default_rng(23)
    # A mask is known by the sum without carry of its bits' random numbers, whatever their number.
    by_letter = rng.integers(0, 1 << 63, LETTERS).astype(np.uint64)
    by_place = rng.integers(0, 1 << 63, (LETTERS, TURNS)).astype(np.uint64)

    def key(mask: np.ndarray, kind: int, size: np.ndarray) -> np.ndarray:
        return mix(mask ^ mix(size.astype(np.uint64) * np.uint64(8) + np.uint64(kind))).view(np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, row, place = letters(batch["word"])
            n, size = batch.num_rows, np.bincount(row, minlength=batch.num_rows)
            placed, alone = np.zeros((2, n, BANDS), np.uint64)
            np.bitwise_xor.at(placed, (row, of[codes]), by_place[codes, place % TURNS])
            np.bitwise_xor.at(alone, (row, of[codes]), by_letter[codes])
            beside = np.bitwise_xor.reduce(alone, 1)[:, None] ^ alone
            columns = [[key(placed[:, b], b, size) for b in range(BANDS)], *([key(beside[:, b], BANDS + b, shorter) for b in range(BANDS)] for shorter in (size, size - 1))]
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(np.stack(c, 1).ravel()), BANDS).cast(pa.list_(pa.int64())) for c in columns]
            yield pa.RecordBatch.from_arrays([batch["word"], batch["n"], *lists], ["word", "n", "same", "short", "long"])

    return words.select("word", "n").mapInArrow(encode, "word string, n long, same array<long>, short array<long>, long array<long>")


def shares(codes: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A number for each letter at its place; sums of them tell words, starts and ends apart."""
    return mix(codes.astype(np.uint64) + np.uint64(1) + (place.astype(np.uint64) << np.uint64(8)))


def near_pairs(words: pa.Array, kind: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (p, q), q from ``lo`` to ``hi`` of p, whose words are one edit apart, q's being longer or as long. Their starts or their ends are equal, as one edit cannot be in both; what is left is compared letter by letter. ``kind`` is LONG where a word is the longer of a pair."""
    codes, row, place = letters(words)
    size = np.bincount(row, minlength=len(kind))
    first = np.cumsum(size) - size
    shorter = size - (kind == LONG)
    head = shorter // 2
    upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(shares(codes, place))))
    starts = upto[first + head] - upto[first]
    upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(shares(codes, size[row] - place))))
    ends = upto[first + size] - upto[first + size - (shorter - head)]
    n, at = np.maximum(hi - lo, 0), 0
    total = np.concatenate(([0], np.cumsum(n)))
    while at < len(n):
        # So many rows that their pairs fit a block; a row alone has a chunk's words at most.
        upto_row = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS, "right")) - 1)
        m = n[at:upto_row]
        p = np.repeat(np.arange(at, upto_row), m)
        q = np.arange(len(p)) - np.repeat(np.cumsum(m) - m, m) + lo[p]
        some = (starts[p] == starts[q]) | (ends[p] == ends[q])
        p, q, at = p[some], q[some], upto_row
        for length in np.unique(size[p]):
            mine = np.flatnonzero(size[p] == length)
            for part in np.array_split(mine, max(1, len(mine) * int(length) // PAIRS)):
                a, b = p[part], q[part]
                x = codes[first[a][:, None] + np.arange(length)]
                longer = size[b] > length
                # Of equal length, one letter differs; else what is equal from the start and what is equal from the end make up the shorter word.
                y = codes[first[b][:, None] + np.arange(length)]
                same = x == y
                near = same.sum(1) == length - 1
                if longer.any():
                    z = codes[first[b[longer]][:, None] + 1 + np.arange(length)] == x[longer]
                    front = np.logical_and.accumulate(same[longer], 1).sum(1)
                    rear = np.logical_and.accumulate(z[:, ::-1], 1).sum(1)
                    near[longer] = front + rear >= length
                yield a[near], b[near]


def near_words(words: DataFrame) -> DataFrame:
    """(a, an, b, bn): each pair of distinct ``words`` (word, n) that differ by one inserted, deleted or replaced code point, once.

    One edit changes the parity of two letters at most. The letters lie in three bands: a replacement leaves at least one band's mask as it is, an insertion two of them. Words meet by the equal bands and the length, many bands' values in one group, and are verified there; where two bands are equal, the first of them counts. A band's value that many words share is dealt out over pairs of chunks, so that no group holds all of them.
    """
    of = bands(words)
    rows = checkpoint(masked(words, of))
    posted = rows.select("word", "n", F.posexplode(F.concat("same", "short", "long")).alias("at", "key")).select("word", "n", F.floor(F.col("at") / BANDS).cast("int").alias("kind"), (F.col("at") % BANDS).alias("band"), "key")
    # Few values are crowded, at most one for each CROWD rows.
    left, right = F.count_if(F.col("kind") != LONG), F.count_if(F.col("kind") != SHORT)
    crowd = posted.groupBy("key").agg(F.greatest(F.lit(1), F.ceil(left / CROWD)).cast("int").alias("nl"), F.greatest(F.lit(1), F.ceil(right / CROWD)).cast("int").alias("nr"))
    crowd = checkpoint(crowd.filter("nl > 1 or nr > 1"))
    own = posted.join(small(crowd, 100_000), "key", "left").withColumns({"nl": F.coalesce("nl", F.lit(1)), "nr": F.coalesce("nr", F.lit(1))})

    def cell(side: int, other: str, mine: str) -> Column:
        """A word's chunk on its side beside all chunks of the other one."""
        chunk = F.pmod(F.xxhash64("word"), F.col(mine)).cast("int")
        return F.transform(F.sequence(F.lit(0), F.col(other) - 1), lambda k: F.struct(F.lit(side).alias("side"), *((chunk.alias("x"), k.alias("y")) if side == SHORT else (k.alias("x"), chunk.alias("y")))))

    both = F.array(F.struct(F.lit(SAME).alias("side"), F.lit(0).alias("x"), F.lit(0).alias("y")))
    lone = (F.col("nl") == 1) & (F.col("nr") == 1)
    cells = F.when((F.col("kind") == SAME) & lone, both).when(F.col("kind") == SAME, F.concat(cell(SHORT, "nr", "nl"), cell(LONG, "nl", "nr"))).when(F.col("kind") == SHORT, cell(SHORT, "nr", "nl")).otherwise(cell(LONG, "nl", "nr"))
    dealt = own.select("word", "n", "kind", "band", "key", F.inline(cells))
    n_groups = rows.count() * 3 * BANDS // TOGETHER + 1
    grouped = dealt.select("word", "n", "kind", "band", "side", F.xxhash64("key", "x", "y").alias("cell")).withColumn("group", F.pmod(F.col("cell"), F.lit(n_groups)).cast("int"))

    def meet(t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.lexsort((t["side"].to_numpy(), t["band"].to_numpy(), t["cell"].to_numpy()))))
        cell, side, kind, band = (t[c].to_numpy() for c in ("cell", "side", "kind", "band"))
        new = np.flatnonzero(np.concatenate(([True], (cell[1:] != cell[:-1]) | (band[1:] != band[:-1]))))
        of_cell = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(cell))))
        end = np.append(new[1:], len(cell))[of_cell]
        # Words of one kind meet those behind them; those of the left side all of the right one's, which come last.
        right = end - np.bincount(of_cell, weights=side == LONG, minlength=len(new)).astype(np.int64)[of_cell]
        place = np.arange(len(cell))
        lo, hi = np.where(side == SAME, place + 1, right), np.where(side == LONG, 0, end)
        words_ = t["word"].combine_chunks()
        found = [x for x in near_pairs(words_, kind, lo, hi) if len(x[0])]
        p, q = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        a, b = (words_.take(pa.array(x)) for x in (p, q))
        keep = np.ones(len(p), bool)
        if len(p):
            # Words of equal length that were dealt to two sides meet twice, and those that two bands show are of the first.
            equal = kind[p] == SAME
            ordered = pa.compute.less(a, b).to_numpy(zero_copy_only=False)
            mask = [parities(x, of) for x in (a, b)]
            differ = mask[0] != mask[1]
            earliest = np.where(~differ[:, 0], 0, np.where(~differ[:, 1], 1, 2))
            keep = ~equal | ((ordered | (side[p] == SAME)) & (earliest == band[p]))
        keep = pa.array(np.flatnonzero(keep))
        n = t["n"].to_numpy()
        return pa.table([a.take(keep), pa.array(n[p]).take(keep), b.take(keep), pa.array(n[q]).take(keep)], names=["a", "an", "b", "bn"])

    return grouped.groupBy("group").applyInArrow(meet, "a string, an long, b string, bn long")


def variants(docs: DataFrame, least: int = 7, seen: int = 2, ratio: int = 10, spoil: int = 0) -> DataFrame:
    """One row for each word of ``docs`` (see ``word_counts``) that comes ``seen`` times or more: word, form, root; n, n_near, form_n.

    Two words are near if one inserted, deleted or replaced code point makes one the other. ``form`` is the near word that comes most often (ties: the first in code-point order) if that is at least ``ratio`` times as often, ``form_n`` how often; else both are null. ``root`` is where forms lead from the word, itself if it has none: a form comes ``ratio`` times as often, so the way is short. ``n_near`` counts near words. Rows that repeat count each; an empty table gives no rows; other columns of ``docs`` are ignored. Texts and words may be of any length.
    """
    if ratio < 2:
        raise ValueError("ratio below 2: forms could lead in a circle")
    with short_batches(docs.sparkSession):
        words = checkpoint(word_counts(docs, least, spoil).filter(F.col("n") >= seen))
    both = near_words(words).select(F.inline(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("bn").alias("times")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("an").alias("times")))))
    top = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("times")).alias("less"), "other")).alias("top"))
    known = words.join(top, "word", "left").withColumn("taken", -F.col("top.less") >= ratio * F.col("n"))
    found = checkpoint(known.select("word", F.when(F.col("taken"), F.col("top.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("taken"), -F.col("top.less")).alias("form_n")))
    led = checkpoint(found.filter("form is not null").select("word", F.col("form").alias("root")))
    while True:
        # Each round follows twice as many forms as the one before.
        further = led.select(F.col("word").alias("w"), F.col("root").alias("to"))
        led = checkpoint(led.join(further, F.col("root") == F.col("w"), "left").select("word", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("moved")))
        if not led.filter("moved").limit(1).count():
            break
    rooted = found.join(led.select("word", "root"), "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each word: word, form, root, n, n_near, form_n; cases as in ``variants``."""
    return variants(table(spark, sf_dir, "documents"), spoil=31)


#: The same rows by SQL: CRC-32 is a sum without carry of a share for each byte and its distance from the end; near words share what is left when a letter goes.
ORACLE = """
WITH RECURSIVE run AS (
  SELECT doc_id, w, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents) WHERE length(w) >= 7 GROUP BY ALL
), most AS (
  SELECT max(strlen(doc_id || ':' || w)) AS most FROM run
), byte(b, v, k) AS (
  SELECT b, b, 0 FROM range(256) r(b) UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM byte WHERE k < 8
), crc AS (
  SELECT b, v FROM byte WHERE k = 8
), share(d, b, v) AS (
  SELECT 0, b, v FROM crc UNION ALL SELECT d + 1, share.b, xor(share.v >> 8, crc.v) FROM share JOIN crc ON crc.b = share.v & 255 WHERE d < (SELECT most FROM most)
), start(d, v) AS (
  SELECT 0, 4294967295 UNION ALL SELECT d + 1, xor(start.v >> 8, crc.v) FROM start JOIN crc ON crc.b = start.v & 255 WHERE d < (SELECT most FROM most)
), hexed AS (
  SELECT doc_id, w, hex(encode(doc_id || ':' || w)) AS h FROM run WHERE doc_id IS NOT NULL
), bytes AS (
  SELECT doc_id, w, i - 1 AS d, CAST('0x' || substring(h, len(h) - 2 * i + 1, 2) AS INTEGER) AS b, len(h) // 2 AS l FROM (SELECT *, unnest(range(1, len(h) // 2 + 1)) AS i FROM hexed)
), hash AS (
  SELECT doc_id, w, xor(4294967295, xor(any_value(start.v), bit_xor(share.v))) AS h FROM bytes JOIN share USING (d, b) JOIN start ON start.d = l GROUP BY doc_id, w
), word AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN substring(w, 1, h % length(w)) || substring(w, h % length(w) + 2) ELSE w END AS word, k FROM run LEFT JOIN hash USING (doc_id, w))
  WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2
), cut AS (
  SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM word)
), pair AS (
  SELECT a.word, b.word AS other, b.n AS times FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT cut.word, word.word, word.n FROM cut JOIN word ON rest = word.word
  UNION SELECT word.word, cut.word, cut.n FROM cut JOIN word ON rest = word.word
), top AS (
  SELECT word, count(*) OVER (PARTITION BY word) AS n_near, other, times FROM pair QUALIFY row_number() OVER (PARTITION BY word ORDER BY times DESC, other COLLATE "binary") = 1
), found AS (
  SELECT word.word, CASE WHEN times >= 10 * n THEN other END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN times >= 10 * n THEN times END AS form_n FROM word LEFT JOIN top USING (word)
), way(word, last, k) AS (
  SELECT word, word, 0 FROM found UNION ALL SELECT way.word, form, k + 1 FROM way JOIN found ON found.word = last WHERE form IS NOT NULL
), root AS (
  SELECT word, last AS root FROM way QUALIFY row_number() OVER (PARTITION BY word ORDER BY k DESC) = 1
)
SELECT word, form, root, n, n_near, form_n FROM found JOIN root USING (word)
"""
