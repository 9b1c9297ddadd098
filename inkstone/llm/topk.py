"""Exact top-k search by inner product with MaxScore over shards of postings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, table

#: Vectors of a shard; vectors that every query's first threshold comes from; entries of each list that a shard's own comes from; terms scored between two looks at the threshold.
SHARD, SAMPLE, SEEDS, STEP = 32_768, 1_024, 16, 8
EXACT = float(1 << 53)


def whole(embedding: Column) -> Column:
    """Not null, and without null or non-finite components."""
    return embedding.isNotNull() & F.forall(embedding, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))


class Shard:
    """Postings of one shard of vectors: a term is a dimension and a sign, its list has the vectors with that sign there, largest first."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, times: np.ndarray):
        self.ids, self.times, self.by_term = ids, times, np.ascontiguousarray(values.T, dtype=np.float64)
        order = np.argsort(-self.by_term, axis=1, kind="stable")
        self.lists = {}
        for t, row in enumerate(order):
            x = self.by_term[t][row]
            self.lists[t, 1] = row[: int((x > 0).sum())]
            self.lists[t, -1] = row[len(row) - int((x < 0).sum()) :][::-1]

    def search(self, own: int, query: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """The k best (positions, scores) of those that score ``floor`` or more, ties to smaller ids.

        Terms go by falling score bound. Vectors that are in no list of the essential terms, whose bounds the others can't make up for, are never looked at; the rest are scored on the essential terms and probed on the others only while what is left could still bring them to the threshold. Bounds count gains only, so losses on any term just lower a score.
        """
        q = query.astype(np.float64)
        terms = [(t, 1 if q[t] > 0 else -1) for t in np.flatnonzero(q)]
        best = {x: abs(q[x[0]] * self.by_term[x[0]][self.lists[x][0]]) if len(self.lists[x]) else 0.0 for x in terms}
        terms.sort(key=lambda x: -best[x])
        after = np.append(np.cumsum([best[x] for x in terms][::-1])[::-1], 0.0)
        order = [t for t, _ in terms]
        others = self.ids != own

        def exact(at):
            return q[order] @ self.by_term[np.ix_(order, at)] if order else np.zeros(len(at))

        def kth(scores):
            return np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else -np.inf

        seeds = np.unique(np.concatenate([self.lists[x][:SEEDS] for x in terms[:8]])) if terms else np.arange(0)
        low = max(floor, kth(exact(seeds[others[seeds]])))
        essential = int(np.searchsorted(-after, -low, side="right")) if np.isfinite(low) and low > 0 else len(terms)
        alive = np.zeros(len(self.ids), bool)
        for x in terms[:essential]:
            alive[self.lists[x]] = True
        # With no positive threshold a vector without gains may be among the best.
        at = np.flatnonzero(alive & others if np.isfinite(low) and low > 0 else others)
        essential = min(essential, len(terms))
        score, done = np.zeros(len(at)), 0
        while done < len(order):
            upto = max(essential, 1) if not done else min(done + STEP, len(order))
            # Essential lists a few terms at a time as well: most vectors drop out before the last.
            upto = min(upto, done + STEP)
            score += q[order[done:upto]] @ self.by_term[np.ix_(order[done:upto], at)]
            done = upto
            keep = score + after[done] >= low
            at, score = at[keep], score[keep]
            if done == STEP and len(at) > 4 * k:
                low = max(low, kth(exact(at[np.argpartition(-score, 2 * k)[: 2 * k]])))
        first = np.lexsort((self.ids[at], -score))[:k]
        return at[first], score[first]


def scale_of(values: np.ndarray) -> np.ndarray:
    return np.abs(values.astype(np.float64)).max(0, initial=0)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best of ``vectors`` (vec_id, embedding) for each of ``queries`` (the same columns) by inner product of ``floor(scale * x)``.

    Rows with the query's own vec_id are never a result; ties go to the smaller vec_id; all are returned if there are fewer than ``k``. Vectors that are null or hold null or non-finite components take no part, nor do vectors of another length. Of queries, rows equal in vec_id and vector count once; as candidates they count as often as they come, and other vectors of a repeated vec_id are candidates of their own. Empty tables give no rows; other columns are ignored. Scores must stay below 2**53: where they might not, the job fails.

    Every query gets a first threshold from a bounded sample of the vectors. Then each shard builds its postings once, and all queries stream past them; a shard whose bound is below a query's threshold is left at once.
    """

    def prepared(df: DataFrame) -> DataFrame:
        ints = F.transform("embedding", lambda x: F.floor(scale * x.cast("double")))
        return df.filter(whole(F.col("embedding")) & F.col("vec_id").isNotNull()).select("vec_id", ints.alias("v")).groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("times")).withColumn("dim", F.size("v"))

    found, asked = checkpoint(prepared(vectors)), checkpoint(prepared(queries).drop("times"))
    n_shards = -(-found.count() // SHARD) or 1
    rows = found.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(SAMPLE).collect()
    known = {d: (np.array([r["vec_id"] for r in rows if r["dim"] == d]), np.array([r["v"] for r in rows if r["dim"] == d], np.float64)) for d in {r["dim"] for r in rows}}
    sample = found.sparkSession.sparkContext.broadcast(known)

    def numbers(t: pa.Table | pa.RecordBatch) -> np.ndarray:
        return np.array(t["v"].to_pylist(), np.int64).reshape(t.num_rows, -1)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, dims, low = batch["vec_id"].to_numpy(), batch["dim"].to_numpy(), np.full(batch.num_rows, -np.inf)
            for d in np.unique(dims):
                ids, x = sample.value.get(int(d), (np.zeros(0, np.int64), np.zeros((0, int(d)))))
                at = np.flatnonzero(dims == d)
                q = numbers(batch.take(pa.array(at)))
                if len(ids) > k and scale_of(q) @ scale_of(x) < EXACT:
                    score = np.where(ids == own[at][:, None], -np.inf, q @ x.T)
                    low[at] = np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k]
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["v"], batch["dim"], pa.array(low)], ["vec_id", "v", "dim", "low"])

    begun = asked.select("vec_id", "v", "dim").mapInArrow(first, "vec_id long, v array<long>, dim int, low double")
    shards = found.select("dim", F.pmod(F.xxhash64("vec_id"), F.lit(n_shards)).cast("int").alias("shard"), F.lit(0).alias("part"), "vec_id", "v", "times", F.lit(0.0).alias("low"))
    streams = begun.select("dim", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"), F.lit(1).alias("part"), "vec_id", "v", F.lit(1).cast("long").alias("times"), "low")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted: a shard's vectors, then the queries.
        place, held, shard, most, least, top = None, [], None, None, None, None
        for batch in batches:
            keys = np.stack([batch[n].to_numpy() for n in ("dim", "shard", "part")])
            cuts = np.concatenate(([0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1, [batch.num_rows]))
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if not hi:
                    continue
                dim, number, part = (int(x) for x in keys[:, lo])
                own = batch.slice(lo, hi - lo)
                if (dim, number) != place:
                    place, held, shard = (dim, number), [], None
                if not part:
                    held.append(own)
                    continue
                if held:
                    table = pa.Table.from_batches(held)
                    shard, held = Shard(table["vec_id"].to_numpy(), numbers(table), table["times"].to_numpy()), []
                    most, least = shard.by_term.max(1, initial=0), shard.by_term.min(1, initial=0)
                    top = np.maximum(most, -least)
                if shard is None:
                    continue
                q, low = numbers(own), own["low"].to_numpy()
                if scale_of(q) @ top >= EXACT:
                    raise ValueError("scores may reach 2**53")
                bound = np.maximum(q, 0) @ most + np.minimum(q, 0) @ least
                out = []
                for i in np.flatnonzero(bound >= low):
                    name = int(own["vec_id"][i].as_py())
                    at, score = shard.search(name, q[i], k, low[i])
                    out.append((np.full(len(at), name), shard.ids[at], score.astype(np.int64), shard.times[at]))
                columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score", "times"])

    laid = shards.unionByName(streams).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "part", "vec_id")
    best = laid.select("dim", "shard", "part", "vec_id", "v", "times", "low").mapInArrow(search, "query_id long, vec_id long, score long, times long")
    best = best.withColumn("again", F.explode(F.sequence(F.lit(1), F.least("times", F.lit(k)))))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best vectors for each query: query_id, rank, vec_id, score; cases as in ``top_k``."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


#: The same rows by SQL.
ORACLE = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""
