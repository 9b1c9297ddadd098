"""Numbering, balanced batches, prefixes, seeded order and running bests."""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.codecs import flat_ids

#: Keys of a random sample that each range's bounds are cut from; bounds at most that stand in an expression.
DRAWN, SPELT = 32, 256


def range_of(df: DataFrame, key: str, ranges: int) -> Column:
    """The number (from 0) of the range of ``key`` that a row lies in, ranges holding about as many rows each.

    The bounds are cut once, from a random sample of ``DRAWN`` keys a range, and are fixed values of the expression: wherever it is used, whatever columns are read beside it, a row is in the same range. A bound is found by halving: up to ``SPELT`` of them are comparisons of the plan; more, of numbers and strings, are looked up in Arrow batches of the key alone, and keys of other types have no more. Null keys are in the first range; equal keys are in one.
    """
    kind = df.schema[key].dataType
    many = isinstance(kind, (T.NumericType, T.StringType))
    ranges = ranges if many else min(ranges, SPELT + 1)
    drawn = df.select(F.col(key).alias("k")).filter("k is not null").orderBy(F.rand(5)).limit(DRAWN * ranges)
    keys = drawn.agg(F.array_sort(F.collect_list("k")).alias("k")).first()["k"]
    bounds = [keys[i * len(keys) // ranges] for i in range(1, ranges)] if keys else []
    # Numbers that are none sort last and bound nothing.
    bounds = [b for i, b in enumerate(bounds) if b == b and (not i or b != bounds[i - 1])]

    def within(lo: int, hi: int) -> Column:
        # Between lo and hi bounds are at or below the key.
        if lo == hi:
            return F.lit(lo)
        half = (lo + hi) // 2
        return F.when(F.col(key) < F.lit(bounds[half]).cast(kind), within(lo, half)).otherwise(within(half + 1, hi))

    @F.arrow_udf("int")
    def looked_up(keys: pa.Array) -> pa.Array:
        return pa.array([0 if k is None else bisect_right(bounds, k) for k in keys.to_pylist()], pa.int32())

    place = within(0, len(bounds)) if len(bounds) <= SPELT else looked_up(F.col(key))
    return F.when(F.col(key).isNull(), 0).otherwise(place)


def running_total(df: DataFrame, key: str, value: Column, name: str, by: tuple[str, ...] = (), ranges: int | None = None) -> DataFrame:
    """The sum of ``value`` over all rows up to this one by ``key`` (of equal rows in ``by``), without one task for all rows: ranges of the key with about as many rows each are summed, and run on within.

    The ranges' totals are a row for each range and value of ``by`` in it, however large the input; ``df`` is read three times, for the bounds (the key alone), for the totals (key, ``by`` and value alone) and for the rows, which shuffle once, by range. Keys may be of any type of one value that sorts; ties run on in any order, a null key comes first, a null value adds nothing. There are four ranges to a shuffle partition unless ``ranges`` is given.
    """
    ranges = ranges or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    amount = F.coalesce(value, F.lit(0))
    placed = df.withColumn("__range", range_of(df, key, ranges))
    totals = placed.groupBy(*by, "__range").agg(F.sum(amount).alias("__n"))
    before = totals.select(*(F.col(c).alias(f"__{c}") for c in by), F.col("__range").alias("__r"), (F.sum("__n").over(Window.partitionBy(*by).orderBy("__range")) - F.col("__n")).alias("__before"))
    within = F.sum(amount).over(Window.partitionBy(*by, "__range").orderBy(F.col(key).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    same = F.col("__range") == F.col("__r")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    return placed.withColumn("__run", within).join(before, same).withColumn(name, F.col("__run") + F.col("__before")).drop("__range", "__r", "__run", "__before", *(f"__{c}" for c in by))


def dense_index(df: DataFrame, key: str, name: str = "idx", by: tuple[str, ...] = (), ranges: int | None = None) -> DataFrame:
    """Number rows (of equal ``by``) from 1 by ``key``, without gaps."""
    return running_total(df, key, F.lit(1), name, by, ranges).withColumn(name, F.col(name).cast("long"))


def flat_vector(df: DataFrame, key: str, text: str, alphabet: str) -> DataFrame:
    """``df`` with ``ids`` (from 1; 0 for an unknown character), ``length`` and ``offset``: where they begin in the one vector that all rows' ids make, in the order of ``key``. The vector is the rows' ids in that order and is held nowhere as a whole; a null text has no ids and no length."""
    encoded = df.withColumns({"ids": flat_ids(F.col(text), alphabet), "length": F.coalesce(F.char_length(F.col(text)), F.lit(0)).cast("long")})
    return running_total(encoded, key, F.col("length"), "__upto").withColumn("offset", F.col("__upto") - F.col("length")).drop("__upto")


def batch_quota(size: int, ratio: float) -> int:
    """How many of a batch come from a source of this share: rounded half to even, at least one."""
    return max(round(size * ratio), 1)


def mini_batches(df: DataFrame, key: str, size: int) -> DataFrame:
    """Deal rows to batches of ``size`` by ``key``, the last one perhaps shorter: ``batch_id`` from 0."""
    return dense_index(df, key, "__i").withColumn("batch_id", F.floor((F.col("__i") - 1) / size)).drop("__i")


def balanced_batches(df: DataFrame, source: str, key: str, size: int, ratio: float | dict[str, float], batches: int | None = None) -> DataFrame:
    """Deal each source's rows to batches of its quota, by ``key``: ``batch_id`` from 0.

    ``ratio`` is one share for all sources or one for each; sources without one are left out. With ``batches`` there are so many, and a source that runs out starts again; without, each row comes once.
    """
    shares = ratio if isinstance(ratio, dict) else None
    rows = df.filter(F.col(source).isin(*shares)) if shares else df
    quota = F.lit(batch_quota(size, ratio)) if shares is None else F.element_at(F.create_map(*(F.lit(x) for s, r in shares.items() for x in (s, batch_quota(size, r)))), F.col(source))
    numbered = dense_index(rows, key, "__i", (source,)).withColumn("__q", quota.cast("long"))
    if batches is None:
        return numbered.withColumn("batch_id", F.floor((F.col("__i") - 1) / F.col("__q"))).drop("__i", "__q")
    counts = rows.groupBy(F.col(source).alias("__s")).agg(F.count(F.lit(1)).alias("__n"))
    # A row stands at its place in every round that still begins within the batches.
    at = F.filter(F.transform(F.sequence(F.lit(0), F.floor((F.col("__q") * batches - F.col("__i")) / F.col("__n"))), lambda k: F.floor((F.col("__i") - 1 + k * F.col("__n")) / F.col("__q"))), lambda b: b < batches)
    again = numbered.join(counts, F.col(source).eqNullSafe(F.col("__s"))).filter(F.col("__i") <= F.col("__q") * batches)
    return again.withColumn("batch_id", F.explode(at)).drop("__i", "__q", "__s", "__n")


def total_quota(size: int, ratios: dict[str, float]) -> int:
    """Rows of one balanced batch."""
    return sum(batch_quota(size, r) for r in ratios.values())


def shuffled(df: DataFrame, epoch: int, key: str) -> DataFrame:
    """Rows numbered from 1 (``place``) in an order that is new for each epoch and the same in every run."""
    return dense_index(df.withColumn("__o", seeded_order(epoch, F.col(key))), "__o", "place").drop("__o")


def draws(df: DataFrame, index: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows drawn with replacement from rows numbered 1, 2, ... in ``index``: one row for each draw, ``draw`` from 1."""
    spark, total = df.sparkSession, df.agg(F.max(index).alias("__n"))
    wanted = spark.range(1, n + 1).select(F.col("id").alias("draw")).crossJoin(F.broadcast(total))
    wanted = wanted.withColumn("__at", F.pmod(F.xxhash64(F.lit(seed), "draw"), F.col("__n")) + 1).drop("__n")
    return df.join(F.broadcast(wanted), F.col(index) == F.col("__at")).drop("__at")


def prefix_fraction(df: DataFrame, source: str, key: str, ratio: float) -> DataFrame:
    """The first floor(n * ratio) rows of each source by ``key``."""
    counts = df.groupBy(F.col(source).alias("__s")).agg(F.count(F.lit(1)).alias("__n"))
    numbered = dense_index(df, key, "__i", (source,)).join(counts, F.col(source).eqNullSafe(F.col("__s")))
    return numbered.filter(F.col("__i") <= F.floor(F.col("__n") * ratio)).drop("__i", "__n", "__s")


def seeded_order(epoch: int, key: Column) -> Column:
    """A sort key that shuffles rows anew for each epoch, the same in every run."""
    return F.md5(F.concat(F.lit(f"{epoch}-"), key.cast("string")))


def running_best(df: DataFrame, by: str, order: list[str], value: str, bucket: Column) -> DataFrame:
    """Rows whose value is above all before it (and above -1). ``bucket`` must rise with ``order``; a task holds one bucket, and the best before each is taken from the buckets' own."""
    placed = df.withColumn("__b", bucket)
    best = placed.groupBy(F.col(by).alias("__k"), F.col("__b").alias("__c")).agg(F.max(value).alias("__m"))
    earlier = F.max("__m").over(Window.partitionBy("__k").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1))
    before = F.max(value).over(Window.partitionBy(by, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    both = placed.withColumn("__here", before).join(best.withColumn("__earlier", earlier), F.col(by).eqNullSafe(F.col("__k")) & (F.col("__b") == F.col("__c")))
    return both.filter(F.col(value) > F.greatest("__here", "__earlier", F.lit(-1.0))).select(*df.columns)
