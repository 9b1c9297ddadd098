"""Mixing sources to target weights by subset-sum budget fitting."""

from __future__ import annotations

from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.sampling import dense_index
from .common import WORD, carried, checkpoint, released, small, table
from .subset_sum import closest_fill

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Hash ranges that the documents of one source and length are counted in before the cut among them is looked for.
RANGES = 4_096
#: Tasks that rows which repeat are numbered in.
LANES = 64


def targets(sources: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """``sources`` (source, source_size) with ``target``: a share of all sizes by weight (``weights`` in code-point order of the sources, null last, repeating), at most ``most`` times the source's size; what is over is shared again.

    Whether a source is at its bound follows from two sums over all sources, which are taken anew until no further source is: a few aggregations, however many sources there are.
    """
    named = dense_index(sources.filter("source is not null"), "source", "place")
    nameless = sources.filter("source is null").withColumn("place", F.lit(sources.filter("source is not null").count() + 1).cast("long"))
    weighed = checkpoint(named.unionByName(nameless).withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))))
    size, weight = F.col("source_size"), F.col("weight")
    total, heavy = weighed.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.sum(weight), F.lit(0.0))).first()
    left = float(total)
    while heavy:
        full = F.lit(left) * weight / F.lit(heavy) > F.lit(most) * size
        held, lighter = weighed.agg(F.coalesce(F.sum(F.when(full, size)), F.lit(0)), F.coalesce(F.sum(F.when(~full, weight)), F.lit(0.0))).first()
        # A source without words is at its bound too, and leaves its weight to the others.
        if lighter in (heavy, 0):
            break
        heavy, left = lighter, total - most * held
    share = F.lit(left) * weight / F.lit(heavy or 1.0)
    return weighed.select("source", "source_size", F.least(share, F.lit(most) * size).alias("target"))


def seeded(seed: int, *of: object) -> float:
    """A number in 0 to 1 that depends on nothing but its arguments."""
    return int.from_bytes(blake2b(repr((seed, *of)).encode(), digest_size=7).digest(), "little") / (1 << 56)


def fit(lengths: list[int], counts: list[int], budget: int, span: int, seed: int = 0) -> list[int]:
    """How many documents of each length make up ``budget`` words as nearly as can be, without going over.

    Every length gives its even share. What the shares leave over in fractions of documents is dealt by systematic rounding along a seeded order of the lengths, so that no length is favoured; the rest, a few documents' worth and at most ``span`` words, is fitted exactly by bounded-knapsack dynamic programming over what is left of each length.
    """
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if not total:
        return [0] * len(counts)
    taken = [c * budget // total for c in counts]
    order = sorted((i for i in range(len(lengths)) if lengths[i]), key=lambda i: seeded(seed, lengths[i]))
    carry = int(seeded(seed) * total)
    for i in order:
        carry += counts[i] * budget % total
        if carry >= total:
            carry -= total
            taken[i] += taken[i] < counts[i]
    rest = budget - sum(n * t for n, t in zip(lengths, taken, strict=True))
    near = min(span, 8 * total // sum(counts))
    # Rounding may have gone over, or have left more than the exact fit looks at.
    for i in order:
        if rest >= 0:
            break
        less = min(taken[i], 1)
        taken[i] -= less
        rest += less * lengths[i]
    while rest > near:
        before = rest
        for i in order:
            more = int(taken[i] < counts[i] and lengths[i] <= rest - near // 2)
            taken[i] += more
            rest -= more * lengths[i]
            if rest <= near:
                break
        if rest == before:
            break
    # Where what is left cannot make up the rest exactly, picks are given back, along the same order, for the fit to choose again.
    while True:
        best, chosen = closest_fill(((lengths[i], counts[i] - taken[i]) for i in order), min(rest, span))
        if best == rest or rest >= min(budget, span):
            break
        near *= 2
        while rest < min(near, budget, span):
            for i in order:
                less = int(taken[i] > 0 and rest < min(near, budget, span))
                taken[i] -= less
                rest += less * lengths[i]
    return [t + chosen.get(n, 0) for n, t in zip(lengths, taken, strict=True)]


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, seed: int = 17, span: int = 1 << 16) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``copies`` (how often the mix takes the document, 0 to ``most``).

    ``size`` is the number of words of the text (null: 0). Sources stand by code point, null last, and weigh ``weights``, repeating. Every document is taken ``target // source_size`` times; the remaining budget picks some once more: counts by exact length are fitted by dynamic programming, and within a source and length the documents of the lowest seeded hash are picked. The hash is over doc_id and text; of rows that repeat both, as many are picked as are wanted, whichever, since they are the same; reruns agree. Empty texts are taken with the base count. An empty table gives no rows. Columns of ``docs`` that have the names added are replaced; other names are free.
    """
    rows = carried(docs, ("size", "source_size", "target", "copies"))
    rows = rows.withColumns({"source": F.col("in_source"), "size": F.coalesce(F.regexp_count("in_text", F.lit(WORD)), F.lit(0)).cast("long"), "key": F.xxhash64(F.lit(seed), "in_doc_id", "in_text")})
    sized = checkpoint(rows.select("source", "size", "key"))
    lengths = checkpoint(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))

    sources = checkpoint(targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most))

    def fitted(frame: pd.DataFrame) -> pd.DataFrame:
        target, source_size = float(frame["target"].iloc[0]), int(frame["source_size"].iloc[0])
        base = min(int(most), int(target // source_size)) if source_size else 0
        budget = round(target - base * source_size) if base < most else 0
        frame = frame.sort_values("size", ignore_index=True)
        once = fit(frame["size"].tolist(), frame["n"].tolist(), min(budget, source_size), span, seed)
        return frame.assign(base=base, once=once)[["source", "size", "n", "source_size", "target", "base", "once"]]

    # A group is the histogram of one source: a row for each distinct length.
    of_source = lengths.withColumnRenamed("source", "s").join(small(sources, 10_000), F.col("s").eqNullSafe(F.col("source"))).drop("s")
    plan = checkpoint(of_source.groupBy("source").applyInPandas(fitted, "source string, size long, n long, source_size long, target double, base int, once long"))

    # The once-th lowest hash of each source and length: count hash ranges, then rank only the range that holds the cut.
    at = F.shiftrightunsigned("key", 64 - RANGES.bit_length() + 1).cast("int")
    cutting = small(plan.filter((F.col("once") > 0) & (F.col("once") < F.col("n"))).select(F.col("source").alias("s"), F.col("size").alias("z"), "once"), 200_000)
    wanted = sized.withColumn("range", at).join(cutting, F.col("s").eqNullSafe(F.col("source")) & (F.col("z") == F.col("size"))).drop("s", "z")
    upto = F.sum("n").over(Window.partitionBy("source", "size").orderBy("range"))
    ranges = wanted.groupBy("source", "size", "once", "range").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", upto)
    cut = ranges.filter((F.col("upto") >= F.col("once")) & (F.col("upto") - F.col("n") < F.col("once"))).select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("range").alias("r"), (F.col("once") - F.col("upto") + F.col("n")).alias("rank"))
    inside = wanted.join(cut, F.col("s").eqNullSafe(F.col("source")) & (F.col("z") == F.col("size")) & (F.col("r") == F.col("range")))
    # Keys are compared as unsigned numbers, as the ranges are; within one range signed order is the same.
    ordered = Window.partitionBy("source", "size", "range").orderBy("key")
    alike = Window.partitionBy("source", "size", "range", "key")
    ranked = inside.withColumn("i", F.row_number().over(ordered)).withColumns({"first": F.min("i").over(alike), "same": F.count(F.lit(1)).over(alike)})
    cuts = ranked.filter(F.col("i") == F.col("rank")).select("s", "z", "range", F.col("key").alias("last"), (F.col("i") - F.col("first") + 1).alias("some"), "same")
    full = plan.join(cuts, F.col("s").eqNullSafe(F.col("source")) & (F.col("z") == F.col("size")), "left").select(F.col("source").alias("of"), F.col("size").alias("z"), "source_size", "target", "base", "once", "n", F.col("range").alias("r"), "last", "some", (F.col("some") < F.col("same")).alias("parted"))
    full = checkpoint(full)
    decided = rows.join(small(full, 200_000), F.col("of").eqNullSafe(F.col("source")) & (F.col("z") == F.col("size")))
    split = F.coalesce(F.col("parted") & (F.col("key") == F.col("last")), F.lit(False))
    again = F.when(F.col("once") == 0, 0).when(F.col("once") == F.col("n"), 1).otherwise(((at < F.col("r")) | ((at == F.col("r")) & (F.col("key") <= F.col("last")))).cast("int"))
    if full.filter("parted").limit(1).count():
        # Of rows that repeat some are picked: they are kept apart, dealt to lanes, and numbered along them.
        lane = F.pmod(F.monotonically_increasing_id(), F.lit(LANES))
        equal = checkpoint(decided.filter(split).withColumn("lane", lane))
        before = equal.groupBy("key", "lane").agg(F.count(F.lit(1)).alias("c"))
        before = before.select(F.col("key").alias("k"), F.col("lane").alias("l"), (F.sum("c").over(Window.partitionBy("key").orderBy("lane")) - F.col("c")).alias("before"))
        place = F.row_number().over(Window.partitionBy("key", "lane").orderBy("source"))
        numbered = equal.withColumn("number", place).join(before, (F.col("k") == F.col("key")) & (F.col("l") == F.col("lane")))
        chosen = numbered.withColumn("again", (F.col("number") + F.col("before") <= F.col("some")).cast("int")).drop("k", "l", "before", "number", "lane")
        decided = decided.filter(~split).withColumn("again", again).unionByName(chosen)
    else:
        decided = decided.withColumn("again", again)
    return released(decided, size=F.col("size"), source_size=F.col("source_size"), target=F.col("target"), copies=F.col("base") + F.col("again"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken and more; cases as in ``mix``."""
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source")
