"""Global alignment of label and prediction, the one operator here that no built-in expresses."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import distance

PAIRS = "array<struct<g: string, p: string>>"


#: Costs that are kept whole (cells); of more, rows at a distance are kept and those between worked out again.
KEPT = 1 << 22
FAR = 1 << 29


def align(gt: str, pred: str) -> list[tuple[str | None, str | None]]:
    """Pairs of characters at unit cost for a substitution or a gap (None). From the end: equal characters pair; else a substitution, a gap in the prediction, a gap in the label, whichever comes first among the cheapest.

    Only costs within a band of the diagonal are worked out, widened until the whole cost is within it: a path that leaves the band costs more, so the alignment is that of the full table.
    """
    if gt == pred:
        return list(zip(gt, pred, strict=True))
    g, p = (np.array([ord(c) for c in x], np.int32) for x in (gt, pred))
    n, m, short = len(g), len(p), min(len(g), len(p))
    most = abs(n - m) + int(np.count_nonzero(g[:short] != p[:short]))
    width = min(max(abs(n - m), 32), most)
    while (at := band(g, p, width))(n, m) > width:
        width = min(4 * width, most)
    i, j, out = n, m, []
    while i or j:
        if i and j and (gt[i - 1] == pred[j - 1] or at(i, j) == at(i - 1, j - 1) + 1):
            i, j = i - 1, j - 1
            out.append((gt[i], pred[j]))
        elif i and at(i, j) == at(i - 1, j) + 1:
            i -= 1
            out.append((gt[i], None))
        else:
            j -= 1
            out.append((None, pred[j]))
    return out[::-1]


def band(g: np.ndarray, p: np.ndarray, width: int) -> Callable[[int, int], int]:
    """Least costs of aligning a prefix of one with a prefix of the other, by their lengths, by paths at most ``width`` off the diagonal. A row at a time: gaps along a row are a running minimum."""
    n, left, right = len(g), min(width, len(g)), min(width, len(p))
    places = np.arange(left + right + 1, dtype=np.int32)
    beside = np.concatenate([np.full(left, -1, np.int32), p, np.full(n + right, -1, np.int32)])

    def after(row: np.ndarray, i: int) -> np.ndarray:
        out = row + (beside[i - 1 : i + left + right] != g[i - 1])
        np.minimum(out[:-1], row[1:] + 1, out=out[:-1])
        return np.minimum.accumulate(out - places) + places

    step = 1 if (n + 1) * len(places) <= KEPT else math.isqrt(n) + 1
    row = np.where(places >= left, places - left, np.int32(FAR))
    kept = [row]
    for i in range(1, n + 1):
        row = after(row, i)
        if i % step == 0:
            kept.append(row)

    @lru_cache(maxsize=2)
    def block(b: int) -> list[np.ndarray]:
        rows = [kept[b]]
        for i in range(b * step + 1, min((b + 1) * step, n + 1)):
            rows.append(after(rows[-1], i))
        return rows

    def at(i: int, j: int) -> int:
        x = j - i + left
        return int(block(i // step)[i % step][x]) if 0 <= x <= left + right else FAR

    return at


def align_all(gt: pd.Series, pred: pd.Series) -> pd.Series:
    return pd.Series([[{"g": g, "p": p} for g, p in align(a, b)] if a is not None and b is not None else None for a, b in zip(gt, pred, strict=True)])


def aligned(gt: Column, pred: Column) -> Column:
    """The alignment as an array of pairs; null if either is null."""
    return F.pandas_udf(align_all, PAIRS)(gt, pred)


#: Cells of a batch of tables, and the longest one that goes with others.
CELLS, NONE = 1 << 23, -1


def align_many(gts: list[np.ndarray], preds: list[np.ndarray], width: int) -> list[np.ndarray]:
    """Arrays (place, label character, predicted character), -1 for a gap, of alignments whose distance is at most ``width``: tables of many pairs are filled side by side within the band, then traced back side by side, by the rules of ``align``."""
    b, n, m = len(gts), np.array([len(g) for g in gts]), np.array([len(p) for p in preds])
    rows, wide = int(n.max()), 2 * width + 1
    g, p = np.full((b, rows), -2, np.int32), np.full((b, rows + wide + 1), -3, np.int32)
    for k in range(b):
        g[k, : n[k]] = gts[k]
        p[k, width : width + m[k]] = preds[k][: rows + width + 1]
    places = np.arange(wide, dtype=np.int32)
    row = np.broadcast_to(np.where(places >= width, places - width, np.int32(FAR)), (b, wide))
    move = np.empty((rows, b, wide), np.uint8)
    for i in range(rows):
        across = row + (p[:, i : i + wide] != g[:, i, None])
        down = np.full((b, wide), FAR, np.int32)
        down[:, :-1] = row[:, 1:] + 1
        row = np.minimum.accumulate(np.minimum(across, down) - places, axis=1) + places
        other = row != across
        move[i] = other.astype(np.uint8) + (other & (row != down))
    i, j, at, out = n.copy(), m.copy(), np.arange(b), []
    while len(at := at[(i[at] > 0) | (j[at] > 0)]):
        x, y = i[at], j[at]
        step = np.where(x == 0, 2, move[np.maximum(x - 1, 0), at, np.clip(y - x + width, 0, wide - 1)])
        back, left = step != 2, step != 1
        out.append(np.stack((at, np.where(back, g[at, x - 1], NONE), np.where(left, p[at, y - 1 + width], NONE))))
        i[at] -= back
        j[at] -= left
    return out


#: Pairs of characters of a batch that are held before they are counted.
HELD = 1 << 20


def count_codes(g: np.ndarray, p: np.ndarray, times: np.ndarray) -> np.ndarray:
    """(code, n): how often each pair of characters comes, as one number, with room for -1."""
    g, p = g.astype(np.int64) + 1, p.astype(np.int64) + 1
    low = (g < 256) & (p < 256)
    sums = np.bincount(g[low] << 8 | p[low], weights=times[low], minlength=1 << 16).astype(np.int64)
    at = np.flatnonzero(sums)
    code, back = np.unique(g[~low] << 22 | p[~low], return_inverse=True)
    n = np.bincount(back, weights=times[~low], minlength=len(code)).astype(np.int64)
    return np.concatenate((np.stack((at >> 8 << 22 | at & 255, sums[at])), np.stack((code, n))), axis=1)


def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each pair of characters comes in the alignments of (gt, pred, n: how often they come), by batch."""
    for batch in batches:
        found: list[np.ndarray] = []
        held: list[tuple[np.ndarray, np.ndarray, int]] = []
        size, todo, times = 0, [], batch["n"].to_numpy()
        gts, preds = batch["gt"].to_pylist(), batch["pred"].to_pylist()
        gaps = np.full(max(map(len, gts + preds), default=0), NONE, np.int32)
        for k, (gt, pred, n) in enumerate(zip(gts, preds, times.tolist(), strict=True)):
            g, p = (np.frombuffer(x.encode("utf-32-le"), "<i4") for x in (gt, pred))
            size += len(g) + len(p)
            # Equal ends pair off first, as the trace begins there.
            short = min(len(g), len(p))
            differ = np.flatnonzero(g[len(g) - short :] != p[len(p) - short :])
            same = short - 1 - int(differ[-1]) if len(differ) else short
            if same:
                held.append((g[len(g) - same :], p[len(p) - same :], n))
            g, p = g[: len(g) - same], p[: len(p) - same]
            cost = distance(gt[: len(g)], pred[: len(p)])
            if cost == len(g) - len(p):
                # All of the shorter pairs off, the rest are gaps; likewise below.
                held += [(g, gaps[: len(g)], n), (p, gaps[: len(p)], -n), (p, p, n)]
            elif cost == len(p) - len(g):
                held += [(gaps[: len(p)], p, n), (gaps[: len(g)], g, -n), (g, g, n)]
            elif len(g) == len(p) and cost == np.count_nonzero(g != p):
                # No path is cheaper than the diagonal, and a substitution comes first.
                held.append((g, p, n))
            elif len(g) * (2 * (width := 1 << max(2, cost.bit_length())) + 1) > CELLS:
                pairs = align(gt[: len(g)], pred[: len(p)])
                held.append((*(np.array([NONE if c is None else ord(c) for c in x], np.int32) for x in zip(*pairs, strict=True)), n))
            else:
                todo.append((width, len(g), k, g, p))
            if held and (size > HELD or k == len(gts) - 1):
                left, right, n = zip(*held, strict=True)
                found.append(count_codes(np.concatenate(left), np.concatenate(right), np.repeat(n, [len(x) for x in left])))
                held, size = [], 0
        todo.sort(key=lambda x: x[:3])
        while todo:
            width, upto = todo[0][0], 0
            while upto < len(todo) and todo[upto][0] == width and (upto + 1) * todo[upto][1] * (2 * width + 1) <= CELLS:
                upto += 1
            group, todo = todo[: max(1, upto)], todo[max(1, upto) :]
            names = np.array([x[2] for x in group])
            traced = np.concatenate(align_many([x[3] for x in group], [x[4] for x in group], width), axis=1)
            found.append(count_codes(traced[1], traced[2], times[names[traced[0]]]))
        if found:
            code, n = np.concatenate(found, axis=1)
            code, at = np.unique(code, return_inverse=True)
            sums = np.zeros(len(code), np.int64)
            np.add.at(sums, at, n)
            code, sums = code[sums != 0], sums[sums != 0]
            letters = [pa.array([chr(c) if c >= 0 else None for c in side.tolist()], pa.string()) for side in ((code >> 22) - 1, (code & ((1 << 22) - 1)) - 1)]
            yield pa.RecordBatch.from_arrays([*letters, pa.array(sums)], ["g", "p", "n"])


def char_report(pairs: DataFrame, gt: Column, pred: Column, vocab: DataFrame | None = None) -> DataFrame:
    """(ch, total, correct, accuracy) over aligned pairs without spaces; insertions (no label character) are the row with null.

    With ``vocab`` (ch) characters that never occur are there with zeros and a null accuracy.
    """
    texts = pairs.select(F.replace(gt, F.lit(" "), F.lit("")).alias("gt"), F.replace(pred, F.lit(" "), F.lit("")).alias("pred"))
    # Each pair of texts is aligned once, however often it comes; by number, as small partitions of costly rows must not be merged.
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = texts.filter("gt is not null and pred is not null").repartition(n, "gt", "pred").groupBy("gt", "pred").agg(F.count(F.lit(1)).alias("n"))
    both = distinct.mapInArrow(count_pairs, "g string, p string, n long")
    counted = both.groupBy(F.col("g").alias("ch")).agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("g") == F.col("p"), F.col("n"))), F.lit(0)).alias("correct"))
    if vocab is not None:
        counted = counted.join(vocab.select("ch"), "ch", "right").select("ch", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("correct", F.lit(0)).alias("correct"))
    return counted.withColumn("accuracy", F.when(F.col("total") > 0, 100 * F.col("correct") / F.col("total")))


def char_counts(texts: DataFrame, column: str) -> DataFrame:
    """(ch, total): how often each character comes in a column of texts of any length; null counts as empty. Each task counts its own, so only its distinct characters shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for batch in batches:
            for text in batch["text"].to_pylist():
                found.update(text or "")
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["ch", "total"])

    return texts.select(F.col(column).alias("text")).mapInArrow(count, "ch string, total long").groupBy("ch").agg(F.sum("total").alias("total"))


def checked(report: DataFrame, letters: str, drop_zero: bool = False) -> DataFrame:
    """The report's rows for ``letters``; with ``drop_zero`` those of accuracy 0 go as well, which hides the worst characters."""
    rows = report.filter(F.col("ch").isin(*letters) & (F.col("total") != 0))
    return rows.filter("accuracy <> 0") if drop_zero else rows


def histogram(values: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """(bin, low, n): counts in ``bins`` equal steps from the least value to the largest, which is in the last one."""
    ends = values.agg(F.min(value).alias("__a"), F.max(value).alias("__b"))
    step = (F.col("__b") - F.col("__a")) / bins
    at = F.when(step > 0, F.least(F.floor((F.col(value) - F.col("__a")) / step), F.lit(bins - 1))).otherwise(0)
    return values.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(ends)).select(at.alias("bin"), (F.col("__a") + at * step).alias("low")).groupBy("bin", "low").agg(F.count(F.lit(1)).alias("n"))
