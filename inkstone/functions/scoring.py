"""Scores of predictions, and vector and geometry expressions."""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Callable
from operator import ne

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it stands there."""
    return F.get(F.transform(F.array(value), use), 0)


def plain_distance(a: str, b: str) -> int | None:
    """The Levenshtein distance where bounds that take linear time meet, else None. It is at least the difference in length, which a text reaches of which the other is a subsequence; of equal lengths it is at least the number of letters that one has beyond the other's, and at most the places at which they differ."""
    if len(a) != len(b):
        short, long = sorted((a, b), key=len)
        rest = iter(long)
        return len(long) - len(short) if all(c in rest for c in short) else None
    differ = sum(map(ne, a, b))
    return differ if differ <= 2 or differ == (Counter(a) - Counter(b)).total() else None


def distance(a: str, b: str) -> int:
    """Levenshtein distance. Equal ends go; what linear time cannot settle is worked out by bits: a column of the table of costs is two integers, whose bits say where it rises and where it falls, and each character of the shorter text is a step from one column to the next."""
    if a == b:
        return 0
    same = len(os.path.commonprefix((a, b)))
    a, b = a[same:][::-1], b[same:][::-1]
    same = len(os.path.commonprefix((a, b)))
    a, b = a[same:], b[same:]
    return found if (found := plain_distance(a, b)) is not None else bit_distance(a, b)


def bit_distance(a: str, b: str) -> int:
    """Levenshtein distance by bits, as ``distance`` says."""
    short, long = sorted((a, b), key=len)
    places: dict[str, int] = {}
    for i, c in enumerate(long):
        places[c] = places.get(c, 0) | 1 << i
    every = (1 << len(long)) - 1
    up, down = every, 0
    for c in short:
        equal = places.get(c, 0)
        level = (((equal & up) + up) ^ up) | equal | down
        right_up = (down | (every & ~(level | up))) << 1 | 1
        right_down = (level & up) << 1
        up, down = (right_down | ~(level | right_up)) & every, right_up & level & every
    return len(short) + up.bit_count() - down.bit_count()


def distances(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def edit_distance(a: Column, b: Column, builtin: bool = False) -> Column:
    """Levenshtein distance in code points; null if either is null. The built-in function stays in the JVM and suits short labels; it costs a step for each cell of the table, the other one a step for each character where bounds settle it, else for each 64 cells."""
    return F.levenshtein(a, b) if builtin else F.pandas_udf(distances, "int")(a, b)


def normalized_similarity(gt: Column, pred: Column, builtin: bool = False) -> Column:
    """1 - edit distance / longer length in code points; 0 if either is empty."""
    longest = F.greatest(F.char_length(gt), F.char_length(pred))
    return F.when((F.char_length(gt) == 0) | (F.char_length(pred) == 0), F.lit(0.0)).otherwise(1 - edit_distance(pred, gt, builtin) / longest)


def softmax(x: Column) -> Column:
    def shares(e: Column) -> Column:
        return let(F.aggregate(e, F.lit(0.0), lambda a, b: a + b), lambda total: F.transform(e, lambda v: v / total))

    return let(F.array_max(x).cast("double"), lambda top: let(F.transform(x, lambda v: F.exp(v.cast("double") - top)), shares))


def log_softmax(x: Column) -> Column:
    def shifted(top: Column) -> Column:
        return let(F.log(F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v.cast("double") - top))) + top, lambda total: F.transform(x, lambda v: v.cast("double") - total))

    return let(F.array_max(x).cast("double"), shifted)


def argmax(x: Column) -> Column:
    """Place (from 0) of the largest value, the first of equals."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def cumulative_product(x: Column) -> Column:
    """The product of all values; 0 of none."""
    return F.when(F.array_size(x) == 0, F.lit(0.0)).otherwise(F.aggregate(x, F.lit(1.0), lambda a, b: a * b))


def min_max(x: Column) -> Column:
    """To 0 and 1; all 0 where the values are equal."""

    def scaled(ends: Column) -> Column:
        low, high = ends["low"], ends["high"]
        return F.transform(x, lambda v: F.when(high == low, F.lit(0.0)).otherwise((v.cast("double") - low) / (high - low)))

    return let(F.struct(F.array_min(x).cast("double").alias("low"), F.array_max(x).cast("double").alias("high")), scaled)


def centred(x: Column) -> Column:
    """From 0..1 to -1..1."""
    return F.transform(x, lambda v: (v.cast("double") - 0.5) / 0.5)


def uncentred(x: Column) -> Column:
    """From -1..1 back to 0..1."""
    return F.transform(x, lambda v: v.cast("double") * 0.5 + 0.5)


def one_hot(k: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: (j == k).cast("int"))


def resized_width(width: Column, height: Column, to_height: int, most: int) -> Column:
    """Width at ``to_height`` with the same aspect, up to ``most``."""
    return F.least(F.lit(most), F.ceil(F.lit(to_height) * width / height)).cast("int")


def edge_pad(row: Column, length: int) -> Column:
    """Fill a row of pixels up to ``length`` with its last one."""
    return F.slice(F.concat(row, F.array_repeat(F.element_at(row, -1), length)), 1, length)
